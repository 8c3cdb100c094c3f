"""SQL building blocks of the DuckDB oracles, one CTE list per constant."""

CAL = """
yr AS (SELECT y::INT AS y, (y % 19)::INT AS a, (y // 100)::INT AS b, (y % 100)::INT AS c
       FROM range(1993, 2029) t(y)),
yr2 AS (SELECT *, (19*a + b - b//4 - (b - (b+8)//25 + 1)//3 + 15) % 30 AS h FROM yr),
yr3 AS (SELECT *, (32 + 2*(b%4) + 2*(c//4) - h - c%4) % 7 AS l FROM yr2),
yr4 AS (SELECT y, h + l - 7*((a + 11*h + 22*l)//451) + 114 AS k FROM yr3),
fixed_day AS (SELECT y, n, CASE isodow(d) WHEN 6 THEN d - 1 WHEN 7 THEN d + 1 ELSE d END AS d
   FROM (SELECT y, n, make_date(y, m, dd) AS d FROM yr4,
         (VALUES ('new_year',1,1),('juneteenth',6,19),('independence',7,4),('christmas',12,25)) f(n,m,dd))),
nth_day AS (SELECT y, n, f1 + ((w - isodow(f1) + 7) % 7)::INT + 7*(nth-1) AS d
   FROM (SELECT y, n, w, nth, make_date(y, m, 1) AS f1 FROM yr4,
         (VALUES ('king_day',1,1,3),('presidents',2,1,3),('labor',9,1,1),('thanksgiving',11,4,4)) f(n,m,w,nth))),
hol AS (SELECT n AS holiday, CAST(d AS DATE) AS d FROM (
   SELECT y, n, d FROM fixed_day UNION ALL SELECT y, n, d FROM nth_day
   UNION ALL SELECT y, 'memorial', make_date(y,5,31) - (isodow(make_date(y,5,31)) - 1)::INT FROM yr4
   UNION ALL SELECT y, 'good_friday', make_date(y, (k//31)::INT, (k%31 + 1)::INT) - 2 FROM yr4)
   WHERE year(d) = y),
days AS (SELECT CAST(d AS DATE) AS d, date_trunc('month', d)::DATE AS month, isodow(d)::INT - 1 AS dow
   FROM range(DATE '1993-01-01', DATE '2029-01-01', INTERVAL 1 DAY) t(d)),
cal1 AS (SELECT days.*, holiday, holiday IS NOT NULL AS is_holiday,
   dow < 5 AND holiday IS NULL AS is_bd,
   coalesce(holiday = 'good_friday', false)
   OR strftime(days.d, '%m-%d') IN ('01-01','06-19','07-04','12-25')
   OR (dow = 0 AND strftime(days.d, '%m-%d') IN ('01-02','06-20','07-05','12-26'))
   OR (dow = 4 AND strftime(days.d, '%m-%d') IN ('12-31','06-18','07-03','12-24'))
   OR (dow = 0 AND month(days.d) IN (1,2) AND day(days.d) BETWEEN 15 AND 21)
   OR (dow = 0 AND month(days.d) = 5 AND day(days.d) >= 25)
   OR (dow = 0 AND month(days.d) = 9 AND day(days.d) <= 7)
   OR (dow = 3 AND month(days.d) = 11 AND day(days.d) BETWEEN 22 AND 28) AS is_holiday_alt
   FROM days LEFT JOIN hol USING (d)),
bds AS (SELECT d, row_number() OVER (ORDER BY d) AS ord FROM cal1 WHERE is_bd),
cal2 AS (SELECT cal1.*,
   (SELECT count(*) FROM bds WHERE bds.d <= cal1.d) AS bd_ord,
   (SELECT max(d) FROM bds WHERE bds.d < cal1.d) AS prev_bd,
   (SELECT min(d) FROM bds WHERE bds.d > cal1.d) AS next_bd FROM cal1),
ltd AS (SELECT (month + INTERVAL 1 MONTH)::DATE AS contract_month,
   max(d) FILTER (WHERE is_bd) AS ltd_refined,
   (SELECT b.d FROM bds b WHERE b.ord = max(bd_ord) FILTER (WHERE day(cal2.d) = 25) - 3) AS ltd_crude
   FROM cal2 GROUP BY month),
cut AS (SELECT contract_month, ltd_refined, ltd_crude,
   (SELECT d FROM bds WHERE ord = (SELECT ord FROM bds b2 WHERE b2.d = ltd_refined) - 2) AS cut_refined,
   (SELECT d FROM bds WHERE ord = (SELECT ord FROM bds b2 WHERE b2.d = ltd_crude) - 2) AS cut_crude
   FROM ltd),
cal3 AS (SELECT cal2.*,
   (SELECT min(contract_month) FROM cut WHERE cut_refined >= cal2.d) AS front_refined,
   (SELECT min(contract_month) FROM cut WHERE cut_crude >= cal2.d) AS front_crude FROM cal2),
cal AS (SELECT c.*, c.is_bd AND coalesce(c.front_refined <> p.front_refined, false) AS is_roll,
   c.is_bd AND coalesce(c.front_crude <> p.front_crude, false) AS is_roll_crude
   FROM cal3 c LEFT JOIN cal3 p ON p.d = c.prev_bd)"""

PANEL = """
panel AS (SELECT l_linestatus AS series_id, CAST(l_shipdate AS DATE) AS session,
   2.0 + CAST(sum(round(l_extendedprice*100)::BIGINT) AS DOUBLE) / (count(*)::DOUBLE * 1e7) AS driver,
   2.0 + CAST(sum(round(l_extendedprice*100)::BIGINT * (100 - round(l_discount*100)::BIGINT)) AS DOUBLE)
       / (count(*)::DOUBLE * 1e9) AS response
   FROM lineitem GROUP BY 1, 2),
wk AS (SELECT * FROM panel WHERE isodow(session) < 6)"""

PAIRS = CAL + "," + PANEL + """,
moved AS (SELECT *, lag(session) OVER w AS prior_session, lag(driver) OVER w AS prior_driver,
   lag(response) OVER w AS prior_response,
   (driver - lag(driver) OVER w) * 100 AS x, (response - lag(response) OVER w) * 100 AS y
   FROM wk WINDOW w AS (PARTITION BY series_id ORDER BY session)),
pairs AS (SELECT m.*, c.is_bd, c.is_roll, (session - prior_session)::INT AS session_gap
   FROM moved m JOIN cal c ON c.d = m.session WHERE m.prior_session = c.prev_bd)"""

TRAIN = PAIRS + """,
train AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY session) AS ord,
   count(*) OVER (PARTITION BY series_id) AS n FROM pairs WHERE NOT is_roll)"""


def fit(name: str, src: str, keys: str, where: str = "true") -> str:
    """CTEs ``name``_f (fit per key) and ``name``_r (rows with residuals)."""
    return f"""{name}_f AS (SELECT {keys}, regr_slope(y,x) AS slope, regr_intercept(y,x) AS intercept,
   regr_r2(y,x) AS r2, count(*) AS rows, regr_syy(y,x) AS syy FROM {src} WHERE {where} GROUP BY {keys}),
{name}_r AS (SELECT s.*, f.slope, f.intercept, f.r2, f.rows, f.syy, y - (f.intercept + f.slope*x) AS resid
   FROM {src} s JOIN {name}_f f USING ({keys}) WHERE {where})"""


def thresholds(name: str, src: str, keys: str, where: str = "true", floor: float = 0.6,
               target: float = 0.75, lean: float = 0.65) -> str:
    """CTE ``name``: one row per key with the four thresholds."""
    th = lambda q, up: (
        f"greatest(greatest(0.3, least(8.0, (-({q}) - intercept)/slope)), {floor}::DOUBLE)" if up else
        f"least(greatest(-8.0, least(-0.3, (-({q}) - intercept)/slope)), -{floor}::DOUBLE)")
    return fit(name, src, keys, where) + f""",
{name}_q AS (SELECT {keys}, max(slope) AS slope, max(intercept) AS intercept, max(r2) AS r2,
   max(rows) AS rows, sqrt(max(syy)*(1-max(r2))/(max(rows)-2)) AS sigma,
   quantile_cont(resid, [{1 - target}, {target}, {1 - lean}, {lean}]) AS q FROM {name}_r GROUP BY {keys}),
{name}_t AS (SELECT *, CASE WHEN rows < 40 THEN 'too_few_rows' WHEN slope IS NULL THEN 'constant_driver'
   WHEN slope <= 0 THEN 'inverted_slope' END AS fit_error FROM {name}_q),
{name}_u AS (SELECT *, CASE WHEN fit_error IS NULL THEN {th('q[1]', True)} END AS hike,
   CASE WHEN fit_error IS NULL THEN {th('q[2]', False)} END AS drop_,
   CASE WHEN fit_error IS NULL THEN {th('q[3]', True)} END AS lh,
   CASE WHEN fit_error IS NULL THEN {th('q[4]', False)} END AS ld FROM {name}_t),
{name} AS (SELECT {keys}, slope, intercept, r2, rows, sigma, fit_error, hike, drop_,
   least(lh, hike) AS lean_hike, greatest(ld, drop_) AS lean_drop FROM {name}_u)"""


DIR = "CASE WHEN x >= hike THEN 1 WHEN x <= drop_ THEN -1 ELSE 0 END"


def payoff(direction: str = "dir", y: str = "y") -> str:
    """Select list of the alert summary."""
    return f"""count(*) FILTER (WHERE {direction} <> 0) AS alerts,
   count(*) FILTER (WHERE {direction}*{y} > 0) AS correct,
   round(count(*) FILTER (WHERE {direction}*{y} > 0) / nullif(count(*) FILTER (WHERE {direction} <> 0), 0), 6) AS precision,
   round(coalesce(sum({direction}*{y}) FILTER (WHERE {direction} <> 0), 0), 6) + 0.0 AS total_savings,
   round(coalesce(sum({direction}*{y}) FILTER (WHERE {direction} <> 0), 0)
         / nullif(count(*) FILTER (WHERE {direction} <> 0), 0), 6) + 0.0 AS mean_savings"""


def draw(key: str, n: str, word: str = "0") -> str:
    """32-bit word of an md5 digest, reduced modulo ``n``."""
    return f"(('0x' || substr(md5({key}), ({word})*8 + 1, 8))::BIGINT % ({n}))"


def mixed_draw(prefix: str, i: str, n: str) -> str:
    """Position ``i`` (from 0) of the mixed draws keyed by ``prefix``."""
    v = f"((('0x' || substr(md5({prefix}), 1, 7))::BIGINT + (({i}) + 1)::BIGINT * 1640531527) % 2147483647)"
    for _ in range(2):
        v = f"((xor({v}, {v} >> 16) * 73244475) % 2147483647)"
    return f"(xor({v}, {v} >> 16) % ({n}))"


_GRID = "[" + ", ".join(repr(i / 100) for i in range(101)) + "]"
_M = lambda c: f"CAST(round({c}*1e6) AS BIGINT)"

ARTIFACTS = TRAIN + """,
ao AS (SELECT series_id, n, k AS block, 360 + 20*k AS start FROM (SELECT DISTINCT series_id, n FROM train), range(1000) b(k) WHERE 360 + 20*k < n),
atr AS (SELECT o.block, t.* FROM ao o JOIN train t ON t.series_id = o.series_id AND t.ord - 1 >= o.start - 360 AND t.ord - 1 < o.start),
""" + thresholds("af", "atr", "series_id, block") + f""",
ag AS (SELECT series_id, block, list_transform(quantile_cont(resid, {_GRID}), lambda v: round(v, 4) + 0.0) AS grid FROM af_r GROUP BY 1, 2),
ax AS (SELECT series_id, block, min(session) AS training_start, max(session) AS training_end, round(stddev_samp(x), 4) AS daily_std FROM atr GROUP BY 1, 2),
ae AS (SELECT o.series_id, o.block, min(t.session) AS effective_session FROM ao o JOIN train t ON t.series_id = o.series_id AND t.ord - 1 >= o.start GROUP BY 1, 2),
ac AS (SELECT series_id, block, effective_session, training_start, training_end, daily_std, grid, rows, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
  round(sigma, 6) AS sigma, round(r2, 6) AS r2, round(hike, 2) AS hike, round(drop_, 2) AS drop_, round(lean_hike, 2) AS lean_hike, round(lean_drop, 2) AS lean_drop
  FROM af JOIN ag USING (series_id, block) JOIN ax USING (series_id, block) JOIN ae USING (series_id, block) WHERE fit_error IS NULL),
ak AS (SELECT *, concat_ws('|', series_id, effective_session::VARCHAR, training_start::VARCHAR, training_end::VARCHAR, rows::VARCHAR,
  {_M('slope')}, {_M('intercept')}, {_M('hike')}, {_M('drop_')}, {_M('lean_hike')}, {_M('lean_drop')}, {_M('daily_std')}) AS core FROM ac),
an AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY block) AS seq FROM ak),
ah AS (SELECT series_id, seq, 'bootstrap_config' AS prior_artifact_id, sha256('bootstrap_config|' || core) AS artifact_id FROM an WHERE seq = 1
  UNION ALL SELECT an.series_id, an.seq, ah.artifact_id, sha256(ah.artifact_id || '|' || core) FROM ah JOIN an ON an.series_id = ah.series_id AND an.seq = ah.seq + 1),
arts AS (SELECT an.*, prior_artifact_id, artifact_id FROM an JOIN ah USING (series_id, seq))"""


def byte(at: int, *keys: str) -> str:
    key = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    if at >= 16:
        key += " || '|x'"
    return f"('0x' || substr(md5({key}), {2 * (at % 16) + 1}, 2))::INT"


_B = lambda i: byte(i, "series_id", "session")

LOG = ARTIFACTS + f""",
l0 AS (SELECT series_id, session, prior_session, ord, n, x, y, driver AS settle, prior_driver AS baseline_price, response, prior_response, (ord - 1 - 360)//20 AS block,
  CASE WHEN {_B(0)} < 16 THEN 'backfill' WHEN {_B(0)} < 24 THEN '' WHEN {_B(0)} < 28 THEN NULL WHEN {_B(0)} < 32 THEN 'imported' ELSE 'live' END AS raw_source,
  CASE WHEN {_B(1)} < 12 THEN 'live_proxy:quote' WHEN {_B(1)} < 18 THEN NULL ELSE 'exchange_snapshot' END AS settlement_source,
  CASE WHEN {_B(2)} < 16 THEN 'exchange_close' WHEN {_B(2)} < 40 THEN 'history_same_contract' ELSE 'provenance_verified' END AS baseline_source,
  session::TIMESTAMP + INTERVAL 14 HOUR + to_minutes(35 + {_B(3)} % 85) AS verdict_ts,
  CASE WHEN ord > n - 5 THEN 'PENDING' WHEN {_B(4)} < 4 THEN 'NO_PRIOR_SESSION' ELSE 'RESOLVED' END AS outcome_status,
  driver + ({_B(5)} - 128)/25600.0::DOUBLE + CASE WHEN {_B(5)} = 0 THEN 0.03 ELSE 0.0 END::DOUBLE AS signal_price FROM train WHERE ord > 360),
l1 AS (SELECT l0.*, (signal_price - baseline_price)*100 AS move, a.artifact_id, a.effective_session, a.slope, a.intercept, a.daily_std, a.grid,
  a.hike AS artifact_hike, a.drop_ AS artifact_drop_, a.lean_hike AS artifact_lean_hike, a.lean_drop AS artifact_lean_drop,
  baseline_source IN ('provenance_verified', 'history_same_contract') AS known FROM l0 JOIN arts a USING (series_id, block)),
l2 AS (SELECT *, CASE WHEN known THEN artifact_hike ELSE greatest(artifact_hike, 1.2::DOUBLE) END AS hike, CASE WHEN known THEN artifact_drop_ ELSE least(artifact_drop_, -1.2::DOUBLE) END AS drop_,
  CASE WHEN known THEN artifact_lean_hike ELSE greatest(artifact_lean_hike, 1.2::DOUBLE) END AS lh, CASE WHEN known THEN artifact_lean_drop ELSE least(artifact_lean_drop, -1.2::DOUBLE) END AS ld,
  intercept + slope*move AS expected, len(list_filter(grid, lambda g: g <= -(intercept + slope*move))) AS below FROM l1),
l3 AS (SELECT * EXCLUDE (lh, ld, below, grid, known), least(lh, hike) AS lean_hike, greatest(ld, drop_) AS lean_drop, move / nullif(daily_std, 0) AS z,
  1.0::DOUBLE - greatest(1.0::DOUBLE/103.0::DOUBLE, least(1.0::DOUBLE - 1.0::DOUBLE/103.0::DOUBLE, below/101.0::DOUBLE)) AS p_up FROM l2),
l4 AS (SELECT * EXCLUDE (p_up), CASE WHEN move >= 0 THEN p_up ELSE 1.0::DOUBLE - p_up END AS p,
  CASE WHEN move >= hike THEN 'BUY_NOW' WHEN move <= drop_ THEN 'WAIT' WHEN move >= lean_hike THEN 'LEAN_BUY' WHEN move <= lean_drop THEN 'LEAN_WAIT' ELSE 'NO_EDGE' END AS modeled_action FROM l3),
l5 AS (SELECT *, CASE WHEN modeled_action IN ('BUY_NOW','LEAN_BUY') THEN expected - 0.5 WHEN modeled_action IN ('WAIT','LEAN_WAIT') THEN -expected - 1.25 ELSE 0 END::DOUBLE AS net_edge FROM l4),
l6 AS (SELECT *, CASE WHEN modeled_action <> 'NO_EDGE' AND net_edge <= 0 THEN 'NO_EDGE' ELSE modeled_action END AS final_action,
  CASE WHEN raw_source IN ('live', 'backfill') THEN raw_source ELSE 'unlabelled' END AS prediction_source,
  CASE WHEN p >= 0.90 THEN 'High' WHEN p >= 0.75 THEN 'Moderate' ELSE 'Low' END || ' confidence (' || round(p*100)::INT || '%) | p=0.' || lpad((round(p*10000)::INT)::VARCHAR, 4, '0') AS label,
  CASE WHEN outcome_status = 'RESOLVED' THEN y END AS actual FROM l5),
l7 AS (SELECT *, CASE WHEN final_action IN ('BUY_NOW','LEAN_BUY') THEN 1 WHEN final_action IN ('WAIT','LEAN_WAIT') THEN -1 ELSE 0 END AS dir FROM l6),
log AS (SELECT *, CASE dir WHEN 1 THEN 'HIKE' WHEN -1 THEN 'DROP' ELSE 'FLAT' END AS direction, dir*actual AS savings, coalesce(dir*actual > 0, false) AS correct,
  CASE final_action WHEN 'BUY_NOW' THEN hike WHEN 'LEAN_BUY' THEN lean_hike WHEN 'WAIT' THEN drop_ WHEN 'LEAN_WAIT' THEN lean_drop ELSE 0 END AS threshold_used,
  NOT regexp_matches(coalesce(settlement_source, 'unknown'), '^(live_proxy|legacy_unknown|unknown)') AS snapshot_based FROM l7)"""

LIVE = LOG + """,
live AS (SELECT * FROM log WHERE prediction_source = 'live' AND snapshot_based AND actual IS NOT NULL)"""


def simpson(density: str, upper: str, panels: int = 2000) -> str:
    """Aggregate over ``range(panels + 1) r(i)``: the integral of ``density`` (of ``v``) from 0 to ``upper``."""
    at = density.replace("v_", f"(({upper}) * i / {panels}.0)")
    weight = f"CASE WHEN i IN (0, {panels}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(max({upper}) / {3 * panels}.0 * sum({weight} * {at}))"


def t_density(dof: str) -> str:
    return (f"exp(lgamma(({dof} + 1) / 2.0) - lgamma(({dof}) / 2.0) - 0.5 * ln(({dof}) * pi())"
            f" - (({dof}) + 1) / 2.0 * ln(1 + v_ * v_ / ({dof})))")


NORMAL_DENSITY = "(exp(-v_ * v_ / 2) / sqrt(2 * pi()))"


def f_density(d1: str, d2: str) -> str:
    return (f"CASE WHEN i = 0 THEN 0 ELSE exp(lgamma(({d1} + {d2}) / 2.0) - lgamma(({d1}) / 2.0) - lgamma(({d2}) / 2.0)"
            f" + ({d1}) / 2.0 * ln(({d1})::DOUBLE / ({d2})) + (({d1}) / 2.0 - 1) * ln(greatest(v_, 1e-300))"
            f" - ({d1} + {d2}) / 2.0 * ln(1 + ({d1})::DOUBLE / ({d2}) * v_)) END")


def beta_ends(name: str, src: str, key: str, wins: str, losses: str, panels: int = 100_000) -> str:
    """CTE ``name`` (key, low, high): 2.5% and 97.5% points of Beta(wins + 1, losses + 1), off its summed density."""
    a, b = f"({wins} + 1.0)", f"({losses} + 1.0)"
    density = (f"CASE WHEN i IN (0, {panels}) THEN 0 ELSE exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b})"
               f" + ({a} - 1) * ln(greatest(i, 1) / {panels}.0) + ({b} - 1) * ln(greatest({panels} - i, 1) / {panels}.0)) END")
    point = lambda q: f"(max(i) FILTER (WHERE c < {q}) + ({q} - max(c) FILTER (WHERE c < {q})) / (min(c) FILTER (WHERE c >= {q}) - max(c) FILTER (WHERE c < {q}))) / {panels}.0"
    return f"""
{name}_d AS (SELECT {key}, i, {density} / {panels}.0 AS d FROM {src}, range({panels + 1}) r(i)),
{name}_c AS (SELECT {key}, i, sum(d) OVER (PARTITION BY {key} ORDER BY i) - d / 2 AS c FROM {name}_d),
{name} AS (SELECT {key}, {point('0.025')} AS low, {point('0.975')} AS high FROM {name}_c GROUP BY 1)"""
