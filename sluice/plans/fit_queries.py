"""Model and evaluation queries over the proxy panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.distributions import beta_interval
from sluice.functions.exprs import count_if, r6, ratio, wilson
from sluice.operators import evaluate as ev, fit as m
from sluice.operators.align import in_series
from sluice.operators.decide import action_ladder
from sluice.plans.base import cut_train, train_of
from sluice.plans.ctes import DIR, TRAIN, beta_ends, draw, fit, mixed_draw, payoff, thresholds
from sluice.plans.registry import query, with_ctes

LAST = "ord > n - 360"


def rounded(df, *cols):
    """Round the named columns to six places, keep the rest."""
    return df.withColumns({c: r6(c) for c in cols})


PAY = ("precision", "total_savings", "mean_savings")


@query("ols_fit", with_ctes(TRAIN, fit("f", "train", "series_id"), """
SELECT series_id, rows, round(slope, 6) AS slope, round(intercept, 6) + 0.0 AS intercept, round(r2, 6) AS r2,
  round(sqrt(syy*(1-r2)/(rows-2)), 6) AS sigma FROM f_f WHERE rows >= 40"""))
def ols_fit(spark, sf_dir):
    """Grouped fit: partial sums on the map side, one row per series shuffled."""
    g = train_of(spark, sf_dir).groupBy("series_id").agg(
        *[c.alias(k) for k, c in m.fit_aggregates(F.col("x"), F.col("y")).items()])
    g = g.where(F.col("rows") >= m.MIN_FIT_ROWS).withColumn("sigma", m.sigma())
    return rounded(g, "slope", "intercept", "r2", "sigma").drop("syy")


@query("residual_cdf", with_ctes(TRAIN, fit("f", "train", "series_id", LAST), """
v AS (SELECT series_id, session, x, y, intercept + slope*x AS expected, rows FROM f_r),
c AS (SELECT v.*, (SELECT count(*) FROM f_r r WHERE r.series_id = v.series_id AND r.resid <= -v.expected) AS k FROM v),
p AS (SELECT *, 1 - greatest(1.0/(rows+2)::DOUBLE, least(1 - 1.0/(rows+2)::DOUBLE, k / rows::DOUBLE)) AS p_up FROM c)""", """
SELECT series_id, session, round(expected, 6) + 0.0 AS expected, round(p_up, 6) AS p_up,
  round(CASE WHEN x >= 0 THEN p_up ELSE 1 - p_up END, 6) AS p_correct FROM p"""))
def residual_cdf(spark, sf_dir):
    rows = m.with_fit(m.last_rows(train_of(spark, sf_dir)), ["series_id"])
    # At most a window of residuals per series, gathered once.
    rows = rows.join(rows.groupBy("series_id").agg(F.collect_list("resid").alias("rs")), "series_id")
    p_up = m.probability_up(F.col("rs"), F.col("x"))
    return rows.select("series_id", "session",
                       r6(F.col("intercept") + F.col("slope") * F.col("x")).alias("expected"),
                       r6(p_up).alias("p_up"),
                       r6(m.probability_correct(p_up, F.col("x"))).alias("p_correct"))


@query("thresholds", with_ctes(TRAIN, thresholds("t", "train", "series_id", LAST), """
SELECT series_id, rows, fit_error, round(hike, 6) AS hike, round(drop_, 6) AS drop_, round(lean_hike, 6) AS lean_hike,
  round(lean_drop, 6) AS lean_drop, round(sigma, 6) AS sigma FROM t"""))
def thresholds_q(spark, sf_dir):
    t = m.group_thresholds(m.last_rows(train_of(spark, sf_dir)), ["series_id"])
    return rounded(t, "hike", "drop_", "lean_hike", "lean_drop", "sigma").select(
        "series_id", "rows", "fit_error", "hike", "drop_", "lean_hike", "lean_drop", "sigma")


GRID = "[" + ", ".join(repr(i / 100) for i in range(101)) + "]"


@query("quantile_grid", with_ctes(TRAIN, fit("f", "train", "series_id", LAST), f"""
g AS (SELECT series_id, quantile_cont(resid, {GRID}) AS q FROM f_r GROUP BY 1),
e AS (SELECT series_id, unnest(range(101)) AS point, unnest(q) AS v FROM g),
l AS (SELECT series_id, list(round(v, 4) + 0.0 ORDER BY point) AS grid FROM e GROUP BY 1)""", """
SELECT e.series_id, point, round(v, 4) + 0.0 AS quantile,
  round(greatest(1/103, least(102/103, len(list_filter(grid, lambda g: g <= round(v, 4) + 0.0))/101)), 6) AS cdf_at
FROM e JOIN l USING (series_id)"""))
def quantile_grid(spark, sf_dir):
    """101-point grid, and the probability a rebuilt grid gives at each point."""
    rows = m.with_fit(m.last_rows(train_of(spark, sf_dir)), ["series_id"])
    g = rows.groupBy("series_id").agg(m.quantile_grid(F.col("resid")).alias("grid"))
    e = g.select("series_id", "grid", F.posexplode("grid").alias("point", "quantile"))
    below = F.size(F.filter("grid", lambda v: v <= F.col("quantile"))).cast("double")
    return e.select("series_id", "point", "quantile",
                    r6(m.rank_probability(below, F.lit(float(m.GRID_POINTS)))).alias("cdf_at"))


THRESH = thresholds("t", "train", "series_id", LAST)

LADDER = """CASE WHEN x >= hike THEN 'BUY_NOW' WHEN x <= drop_ THEN 'WAIT' WHEN x >= lean_hike THEN 'LEAN_BUY'
  WHEN x <= lean_drop THEN 'LEAN_WAIT' ELSE 'NO_EDGE' END"""


@query("economic_value", with_ctes(TRAIN, THRESH, f"""
a AS (SELECT tr.series_id, session, {LADDER} AS action, intercept + slope*x AS e, ord % 11 AS g, ord % 13 AS c
  FROM train tr JOIN t USING (series_id) WHERE {LAST}),
i AS (SELECT *, CASE WHEN g = 0 THEN 0.0 ELSE 8500.0 END::DOUBLE AS gallons, CASE WHEN c = 0 THEN -1.0 ELSE 0.5 END::DOUBLE AS buy_cost FROM a),
v AS (SELECT *, CASE WHEN gallons <= 0 THEN 'gallons_not_positive' WHEN buy_cost < 0 THEN 'negative_cost' END AS input_error,
  CASE WHEN action IN ('BUY_NOW','LEAN_BUY') THEN e WHEN action IN ('WAIT','LEAN_WAIT') THEN -e ELSE 0 END AS gross,
  CASE WHEN action IN ('BUY_NOW','LEAN_BUY') THEN buy_cost WHEN action IN ('WAIT','LEAN_WAIT') THEN 1.25 ELSE 0 END AS cost FROM i)""", """
SELECT series_id, session, action, input_error,
  CASE WHEN input_error IS NULL THEN round(gross - cost, 6) + 0.0 END AS net_edge_cents,
  CASE WHEN input_error IS NULL THEN round((gross - cost)/100*gallons, 4) + 0.0 END AS net_value_dollars,
  CASE WHEN input_error IS NULL THEN gross - cost > 0 END AS economically_positive FROM v"""))
def economic_value(spark, sf_dir):
    """Net value of the modelled action; some rows carry invalid inputs."""
    rows = m.with_fit(m.last_rows(train_of(spark, sf_dir)), ["series_id"])
    rows = rows.withColumn("q", F.percentile("resid", m.quantile_targets()).over(in_series()))
    rows = m.with_thresholds(rows, F.col("q")).withColumn("action", action_ladder(F.col("x")))
    value = m.economic_value(
        F.col("action"), F.col("intercept") + F.col("slope") * F.col("x"),
        F.when(F.col("ord") % 11 == 0, 0.0).otherwise(m.TRUCK_GALLONS),
        F.when(F.col("ord") % 13 == 0, -1.0).otherwise(0.5), F.lit(1.25))
    return rows.withColumns(value).select(
        "series_id", "session", "action", "input_error", r6("net_edge_cents").alias("net_edge_cents"),
        (F.round("net_value_dollars", 4) + 0.0).alias("net_value_dollars"), "economically_positive")


CI_SQL = (f"""
r0 AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ord) - 1 AS i,
  count(*) OVER (PARTITION BY series_id) AS m, x, y FROM train WHERE {LAST}),
sz AS (SELECT DISTINCT series_id, m FROM r0 WHERE m >= 40),
pos AS (SELECT series_id, m, rep, i AS slot, i // 5 AS j, i % 5 AS o FROM sz, range(1, 501) r(rep), range(360) s(i) WHERE i < m),
dr AS (SELECT *, {draw("'threshold|' || series_id || '|' || rep || '|' || j", 'm - 5 + 1')} + o AS i FROM pos),
bs AS (SELECT d.series_id, d.rep, r0.x, r0.y FROM dr d JOIN r0 ON r0.series_id = d.series_id AND r0.i = d.i)""",
    thresholds("bt", "bs", "series_id, rep"), """
SELECT series_id, round(quantile_cont(hike, 0.025), 6) AS hike_low, round(quantile_cont(hike, 0.975), 6) AS hike_high,
  round(quantile_cont(drop_, 0.025), 6) AS drop_low, round(quantile_cont(drop_, 0.975), 6) AS drop_high, count(*) AS replicates
FROM bt WHERE fit_error IS NULL GROUP BY 1 HAVING count(*) >= 400""")


@query("threshold_ci", with_ctes(TRAIN, *CI_SQL))
def threshold_ci(spark, sf_dir):
    ci = m.block_threshold_interval(m.last_rows(train_of(spark, sf_dir)))
    return rounded(ci, "hike_low", "hike_high", "drop_low", "drop_high")


@query("payoff_summary", with_ctes(TRAIN, THRESH, f"""
s AS (SELECT series_id, y, {DIR} AS dir FROM train JOIN t USING (series_id) WHERE {LAST})""", f"""
SELECT series_id, {payoff()} FROM s GROUP BY 1"""))
def payoff_summary(spark, sf_dir):
    scored = ev.full_fit_scores(m.last_rows(train_of(spark, sf_dir)), m.NOISE_FLOOR)
    return rounded(scored.groupBy("series_id").agg(
        *m.payoff_aggregates(F.col("dir"), F.col("y"))), *PAY)


TAIL = f"""
w0 AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY y) - 1 AS i,
  count(*) OVER (PARTITION BY series_id) AS m FROM train JOIN t USING (series_id) WHERE x <= drop_),
wc AS (SELECT series_id, m, quantile_cont(y, 0.95) AS cutoff, quantile_cont(y, 0.5) AS median_move,
  count(*) FILTER (WHERE y > 0) / count(*) AS adverse FROM w0 WHERE m >= 20 GROUP BY 1, 2),
wt AS (SELECT series_id, avg(y) AS cvar, count(*) AS tail_n FROM w0 JOIN wc USING (series_id) WHERE y >= cutoff GROUP BY 1),
wd AS (SELECT wc.series_id, rep, {mixed_draw("'tail|' || wc.series_id || '|' || rep", 's.i', 'wc.m')} AS i
  FROM wc, range(1, 2001) r(rep), range(20000) s(i) WHERE s.i < wc.m),
wb AS (SELECT d.series_id, d.rep, w0.y FROM wd d JOIN w0 ON w0.series_id = d.series_id AND w0.i = d.i),
wq AS (SELECT series_id, rep, quantile_cont(y, 0.95) AS c FROM wb GROUP BY 1, 2),
wm AS (SELECT wb.series_id, wb.rep, avg(y) AS v FROM wb JOIN wq ON wq.series_id = wb.series_id AND wq.rep = wb.rep
  WHERE y >= c GROUP BY 1, 2),
wi AS (SELECT series_id, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM wm GROUP BY 1)"""


@query("tail_risk", with_ctes(TRAIN, THRESH, TAIL, """
SELECT series_id, round(cvar, 6) AS cvar, round(lo, 6) AS cvar_low, round(hi, 6) AS cvar_high, tail_n, m AS sample_n,
  round(adverse, 6) AS probability_adverse, round(median_move, 6) AS median_move
FROM wc JOIN wt USING (series_id) JOIN wi USING (series_id) WHERE tail_n >= 4"""))
def tail_risk(spark, sf_dir):
    train = cut_train(spark, sf_dir)
    drops = m.group_thresholds(m.last_rows(train), ["series_id"])
    return rounded(m.tail_risk(train, drops).drop("cutoff"), "cvar", "cvar_low", "cvar_high",
                   "probability_adverse", "median_move")


FOLDS = """
fr AS (SELECT *, n - ord AS back FROM train WHERE n >= 311),
ft AS (SELECT fold, fr.* FROM fr, range(6) f(fold) WHERE back >= (fold+1)*45 + 1 AND back < (fold+1)*45 + 361),
fs AS (SELECT fold, fr.* FROM fr, range(6) f(fold) WHERE back >= fold*45 AND back < (fold+1)*45)"""


@query("walk_forward", with_ctes(TRAIN, FOLDS, thresholds("wt", "ft", "series_id, fold"), f"""
ws AS (SELECT fs.series_id, fs.fold, session, y, hike, drop_, {DIR} AS dir FROM fs JOIN wt USING (series_id, fold)
  WHERE fit_error IS NULL)""", f"""
SELECT series_id, fold::INT AS fold, min(session) AS test_start, max(session) AS test_end, round(max(hike), 6) AS hike,
  round(max(drop_), 6) AS drop_, {payoff()} FROM ws GROUP BY 1, 2"""))
def walk_forward(spark, sf_dir):
    return rounded(ev.walk_forward(train_of(spark, sf_dir)), "hike", "drop_", *PAY)


def origin_sql(window: int, floor: float = 0.6, name: str = "o", first: int = 120, step: int = 10) -> str:
    """Rolling origins by range join: {name}_tr, {name}_te, thresholds {name} and scored rows {name}_s."""
    return f"""
{name}_or AS (SELECT series_id, n, unnest(range({first}, n, {step})) AS start FROM (SELECT DISTINCT series_id, n FROM train)),
{name}_tr AS (SELECT o.start, t.* FROM {name}_or o JOIN train t ON t.series_id = o.series_id
  AND t.ord - 1 >= o.start - {window} AND t.ord - 1 < o.start),
{name}_te AS (SELECT o.start, t.* FROM {name}_or o JOIN train t ON t.series_id = o.series_id
  AND t.ord - 1 >= o.start AND t.ord - 1 < o.start + {step}),
""" + thresholds(name, f"{name}_tr", "series_id, start", floor=floor) + f""",
{name}_s AS (SELECT e.*, hike, drop_, lean_hike, lean_drop, slope, intercept, rows, {DIR} AS dir FROM {name}_te e
  JOIN {name} USING (series_id, start) WHERE fit_error IS NULL)"""


WILSON = lambda s, t: f"""round(greatest(0, (({s}/{t} + 3.841458822790181/(2*{t})) / (1 + 3.841458822790181/{t}))
   - (1.959963985/(1 + 3.841458822790181/{t}))*sqrt(({s}/{t})*(1-{s}/{t})/{t} + 3.841458822790181/(4*{t}*{t}))), 6) AS wilson_low,
   round(least(1, (({s}/{t} + 3.841458822790181/(2*{t})) / (1 + 3.841458822790181/{t}))
   + (1.959963985/(1 + 3.841458822790181/{t}))*sqrt(({s}/{t})*(1-{s}/{t})/{t} + 3.841458822790181/(4*{t}*{t}))), 6) AS wilson_high"""


@query("rolling_origin", with_ctes(TRAIN, origin_sql(360), f"""
agg AS (SELECT series_id, count(*) AS scored, min(session) AS first_session, max(session) AS last_session, {payoff()},
  round(quantile_cont(dir*y, 0.5) FILTER (WHERE dir <> 0), 9) AS median_savings,
  round(avg(dir*y) FILTER (WHERE dir*y > 0), 6) AS avg_win, round(-avg(dir*y) FILTER (WHERE dir <> 0 AND dir*y < 0), 6) AS avg_loss
  FROM o_s GROUP BY 1)""", "SELECT * FROM agg"))
def rolling_origin(spark, sf_dir):
    rows = ev.rolling_scores(train_of(spark, sf_dir))
    pay = F.when(F.col("dir") != 0, F.col("dir") * F.col("y"))
    out = rows.groupBy("series_id").agg(
        F.count("*").alias("scored"), F.min("session").alias("first_session"),
        F.max("session").alias("last_session"),
        *m.payoff_aggregates(F.col("dir"), F.col("y")),
        F.round(F.percentile(pay, 0.5), 9).alias("median_savings"),
        F.avg(F.when(pay > 0, pay)).alias("avg_win"),
        (-F.avg(F.when(pay < 0, pay))).alias("avg_loss"))
    return rounded(out, *PAY, "avg_win", "avg_loss")


@query("wilson", with_ctes(TRAIN, origin_sql(360), """
w AS (SELECT series_id, count(*) FILTER (WHERE dir <> 0)::DOUBLE AS t, count(*) FILTER (WHERE dir*y > 0)::DOUBLE AS s FROM o_s GROUP BY 1)""",
    f"SELECT series_id, t::BIGINT AS alerts, s::BIGINT AS correct, {WILSON('s', 't')} FROM w"))
def wilson_q(spark, sf_dir):
    g = ev.rolling_scores(train_of(spark, sf_dir)).groupBy("series_id").agg(
        count_if(F.col("dir") != 0).alias("alerts"),
        count_if(F.col("dir") * F.col("y") > 0).alias("correct"))
    lo, hi = wilson(F.col("correct"), F.col("alerts"))
    return g.withColumn("wilson_low", r6(lo)).withColumn("wilson_high", r6(hi))


@query("beta_interval", with_ctes(TRAIN, origin_sql(360), """
bw AS (SELECT series_id, count(*) FILTER (WHERE dir <> 0) AS alerts, count(*) FILTER (WHERE dir*y > 0) AS correct FROM o_s GROUP BY 1)""",
    beta_ends("be", "bw", "series_id", "correct", "(alerts - correct)"), """
SELECT series_id, alerts, correct, round(low, 6) AS low, round(high, 6) AS high FROM bw JOIN be USING (series_id)"""))
def beta_interval_q(spark, sf_dir):
    """Posterior interval of the out-of-sample precision; the SQL sums the density."""
    g = ev.rolling_scores(train_of(spark, sf_dir)).groupBy("series_id").agg(
        count_if(F.col("dir") != 0).alias("alerts"),
        count_if(F.col("dir") * F.col("y") > 0).alias("correct"))
    lo, hi = beta_interval(F.col("correct"), F.col("alerts") - F.col("correct"))
    return g.select("series_id", "alerts", "correct", r6(lo).alias("low"), r6(hi).alias("high"))


@query("daily_origin", with_ctes(TRAIN, """
dtr AS (SELECT a.ord AS start, b.series_id, b.x, b.y FROM train a JOIN train b ON b.series_id = a.series_id
  AND b.ord BETWEEN a.ord - 361 AND a.ord - 2 WHERE a.ord > 361)""", thresholds("d", "dtr", "series_id, start"), """
j AS (SELECT t.*, d.*EXCLUDE(series_id, start) FROM train t JOIN d ON d.series_id = t.series_id AND d.start = t.ord),
cdf AS (SELECT j.series_id, j.ord, count(*) FILTER (WHERE r.resid <= -(j.intercept + j.slope*j.x)) AS k
  FROM j JOIN d_r r ON r.series_id = j.series_id AND r.start = j.ord GROUP BY 1, 2),
p AS (SELECT j.*, 1 - greatest(1/362, least(361/362, k/360)) AS p_up FROM j JOIN cdf USING (series_id, ord))""", f"""
SELECT series_id, session, round(intercept + slope*x, 6) + 0.0 AS expected, round(hike, 6) AS hike, round(drop_, 6) AS drop_,
  round(p_up, 6) AS p_up, round(CASE WHEN x >= 0 THEN p_up ELSE 1 - p_up END, 6) AS p_correct,
  CASE WHEN x >= hike THEN 1 WHEN x <= drop_ THEN -1 WHEN x >= lean_hike THEN 1 WHEN x <= lean_drop THEN -1 ELSE 0 END AS dir FROM p"""))
def daily_origin(spark, sf_dir):
    rows = ev.daily_origin(train_of(spark, sf_dir)).withColumn("dir", ev.two_band_signal(F.col("x")))
    return rounded(rows, "expected", "hike", "drop_", "p_up", "p_correct").select(
        "series_id", "session", "expected", "hike", "drop_", "p_up", "p_correct", "dir")


QUOTED = """
k AS (SELECT s.series_id, s.start, s.ord, count(*) FILTER (WHERE r.resid <= -(s.intercept + s.slope*s.x)) AS k, max(r.rows) AS m
  FROM o_s s JOIN o_r r ON r.series_id = s.series_id AND r.start = s.start GROUP BY 1, 2, 3),
pu AS (SELECT s.series_id, s.session, s.x, s.y, 1 - greatest(1/(m+2)::DOUBLE, least(1 - 1/(m+2)::DOUBLE, k/m::DOUBLE)) AS p_up
  FROM o_s s JOIN k USING (series_id, start, ord)),
qd AS (SELECT series_id, session, CASE WHEN x >= 0 THEN p_up ELSE 1 - p_up END AS quoted,
  CASE WHEN (x >= 0 AND y > 0) OR (x < 0 AND y < 0) THEN 1.0 ELSE 0.0 END::DOUBLE AS hit FROM pu)"""


@query("calibration_check", with_ctes(TRAIN, origin_sql(240), QUOTED, """
b AS (SELECT *, avg(hit) OVER (PARTITION BY series_id) AS base FROM qd),
s AS (SELECT series_id, count(*) AS n, avg(quoted) AS quoted, avg(hit) AS realised, avg((quoted-hit)^2) AS brier,
  avg((base-hit)^2) AS reference FROM b GROUP BY 1)""", """
SELECT series_id, n, round(quoted, 6) AS quoted, round(realised, 6) AS realised, round(brier, 6) AS brier,
  round(reference, 6) AS reference, round(realised - quoted, 6) + 0.0 AS gap,
  round(CASE WHEN reference > 0 THEN 1 - brier/reference ELSE 0 END, 6) + 0.0 AS skill FROM s"""))
def calibration_check(spark, sf_dir):
    s = ev.calibration_summary(ev.quoted_probabilities(train_of(spark, sf_dir)))
    return rounded(s, "quoted", "realised", "brier", "reference", "gap", "skill")


@query("reliability_bins", with_ctes(TRAIN, origin_sql(240), QUOTED, """
rb AS (SELECT series_id, least(floor((quoted - 0.5) / 0.1), 4)::BIGINT AS bin, quoted, hit FROM qd WHERE quoted >= 0.5)""", """
SELECT series_id, bin, count(*) AS n, round(avg(quoted), 6) AS quoted, round(avg(hit), 6) AS realised
FROM rb GROUP BY 1, 2 HAVING count(*) >= 5"""))
def reliability_bins(spark, sf_dir):
    return rounded(ev.reliability_bins(ev.quoted_probabilities(train_of(spark, sf_dir))),
                   "quoted", "realised")


HOLD = thresholds("h", "train", "series_id", "n >= 100 AND ord <= n - 60", floor=1.2) + f""",
hs AS (SELECT tr.series_id, row_number() OVER (PARTITION BY tr.series_id ORDER BY ord) - 1 AS i, x, y, hike, drop_, {DIR} AS dir
  FROM train tr JOIN h USING (series_id) WHERE ord > n - 60 AND fit_error IS NULL),
ho AS (SELECT series_id, sum(dir*y) AS total FROM hs GROUP BY 1),
hp AS (SELECT series_id, rep, i, row_number() OVER (PARTITION BY series_id, rep
  ORDER BY md5('holdout|' || series_id || '|' || rep || '|' || i), i) - 1 AS slot FROM hs, range(1, 5001) r(rep)),
hn AS (SELECT p.series_id, p.rep, sum(a.dir*b.y) AS t FROM hp p JOIN hs a ON a.series_id = p.series_id AND a.i = p.slot
  JOIN hs b ON b.series_id = p.series_id AND b.i = p.i GROUP BY 1, 2)"""


@query("holdout_permutation", with_ctes(TRAIN, HOLD, f"""
nul AS (SELECT series_id, count(*) FILTER (WHERE t >= total - 1e-9) AS as_extreme, count(*) AS permutations,
  avg(t) AS null_mean FROM hn JOIN ho USING (series_id) GROUP BY 1),
obs AS (SELECT series_id, round(max(hike), 6) AS hike, round(max(drop_), 6) AS drop_, {payoff()} FROM hs GROUP BY 1)""", """
SELECT obs.*, as_extreme, permutations, round(null_mean, 6) + 0.0 AS null_mean,
  round((as_extreme + 1)/(permutations + 1), 6) AS p_value FROM obs JOIN nul USING (series_id)"""))
def holdout_permutation(spark, sf_dir):
    return rounded(ev.holdout_permutation(train_of(spark, sf_dir)),
                   "hike", "drop_", *PAY, "null_mean", "p_value")


@query("residual_dw", with_ctes(TRAIN, fit("f", "train", "series_id"), """
l AS (SELECT series_id, resid, lag(resid) OVER (PARTITION BY series_id ORDER BY session) AS prev FROM f_r)""", """
SELECT series_id, count(*) AS n, round(corr(resid, prev), 6) + 0.0 AS lag1, round(sum((resid-prev)^2)/sum(resid^2), 6) AS dw FROM l GROUP BY 1"""))
def residual_dw(spark, sf_dir):
    return rounded(ev.residual_autocorrelation(train_of(spark, sf_dir)), "lag1", "dw")


FULL = thresholds("ft", "train", "series_id", floor=1.2) + f""",
fsc AS (SELECT tr.*, hike, drop_, {DIR} AS dir FROM train tr JOIN ft USING (series_id) WHERE fit_error IS NULL)"""


@query("optimism", with_ctes(TRAIN, FULL, origin_sql(180, 1.2), """
i AS (SELECT series_id, count(*) FILTER (WHERE dir*y > 0)/count(*) FILTER (WHERE dir <> 0) AS p, count(*) FILTER (WHERE dir <> 0) AS a FROM fsc GROUP BY 1),
o2 AS (SELECT series_id, count(*) FILTER (WHERE dir*y > 0)/count(*) FILTER (WHERE dir <> 0) AS p, count(*) FILTER (WHERE dir <> 0) AS a FROM o_s GROUP BY 1)""", """
SELECT series_id, i.a AS insample_alerts, o2.a AS oos_alerts, round(i.p, 6) AS insample_precision,
  round(o2.p, 6) AS oos_precision, round(i.p - o2.p, 6) + 0.0 AS optimism FROM i JOIN o2 USING (series_id)"""))
def optimism(spark, sf_dir):
    train = cut_train(spark, sf_dir)
    summary = lambda rows, tag: rows.groupBy("series_id").agg(
        count_if(F.col("dir") != 0).alias(f"{tag}_alerts"),
        ratio(count_if(F.col("dir") * F.col("y") > 0),
              count_if(F.col("dir") != 0)).alias(f"{tag}_precision"))
    both = summary(ev.full_fit_scores(train), "insample").join(
        summary(ev.rolling_scores(train, 180, ev.CHECK_FLOOR), "oos"), "series_id")
    both = both.withColumn("optimism", F.col("insample_precision") - F.col("oos_precision"))
    return rounded(both, "insample_precision", "oos_precision", "optimism")


@query("benchmark_sign", with_ctes(TRAIN, FULL, f"""
a AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY ord) - 1 AS i FROM fsc WHERE dir <> 0),
b AS (SELECT series_id, count(*) FILTER (WHERE dir <> 0) AS decisions, sum(dir*y) AS model_total,
  avg(dir*y) FILTER (WHERE dir <> 0) AS per_decision, avg((dir*y > 0)::INT) FILTER (WHERE dir <> 0) AS model_precision,
  count(*) AS sign_decisions, avg(CASE WHEN x >= 0 THEN y ELSE -y END) AS sign_per_decision,
  avg((CASE WHEN x >= 0 THEN y ELSE -y END > 0)::INT) AS sign_precision FROM fsc GROUP BY 1),
c AS (SELECT series_id, rep, sum(CASE WHEN {mixed_draw("'coin|' || series_id || '|' || rep", 'i', '2')} = 0 THEN y ELSE -y END) AS t
  FROM a, range(1, 2001) r(rep) GROUP BY 1, 2),
nul AS (SELECT series_id, count(*) FILTER (WHERE t >= model_total) AS as_extreme, count(*) AS draws FROM c JOIN b USING (series_id) GROUP BY 1)""", """
SELECT series_id, decisions, round(model_total, 6) AS model_total, round(per_decision, 6) AS per_decision,
  round(model_precision, 6) AS model_precision, sign_decisions, round(sign_per_decision, 6) AS sign_per_decision,
  round(sign_precision, 6) AS sign_precision, as_extreme, draws, round((as_extreme+1)/(draws+1), 6) AS p_value FROM b JOIN nul USING (series_id)"""))
def benchmark_sign(spark, sf_dir):
    b = ev.benchmark_signs(ev.full_fit_scores(train_of(spark, sf_dir)))
    return rounded(b, "model_total", "per_decision", "model_precision", "sign_per_decision",
                   "sign_precision", "p_value")


@query("regime_split", with_ctes(TRAIN, FULL, """
c AS (SELECT *, quantile_cont(abs(x), 0.5) OVER (PARTITION BY series_id) AS cut FROM fsc),
g AS (SELECT *, CASE WHEN abs(x) <= cut THEN 'calm' ELSE 'volatile' END AS regime FROM c)""", f"""
SELECT series_id, regime, max(cut) AS cut, {payoff()} FROM g GROUP BY 1, 2"""))
def regime_split(spark, sf_dir):
    return rounded(ev.regime_split(ev.full_fit_scores(train_of(spark, sf_dir))), *PAY)


@query("plausibility", with_ctes(TRAIN, fit("f", "train", "series_id"), """
SELECT series_id, rows, round(slope, 6) AS slope, round(r2, 6) AS r2, slope > 0.2 AND slope < 1.3 AND r2 > 0.3 AS sane FROM f_f"""))
def plausibility(spark, sf_dir):
    g = train_of(spark, sf_dir).groupBy("series_id").agg(
        *[c.alias(k) for k, c in m.fit_aggregates(F.col("x"), F.col("y")).items()])
    g = g.withColumn("sane", (F.col("slope") > 0.2) & (F.col("slope") < 1.3) & (F.col("r2") > 0.3))
    return rounded(g, "slope", "r2").select("series_id", "rows", "slope", "r2", "sane")
