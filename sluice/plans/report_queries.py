"""Reports over the decision log, quotes and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.calendar import business_calendar
from sluice.functions.distributions import beta_interval, normal_two_sided
from sluice.functions.exprs import count_if, r6, wilson
from sluice.operators import fit as m, ledger, report as rp, resample as rs
from sluice.operators.align import in_series
from sluice.plans.base import cut_train, log_of
from sluice.plans.ctes import LIVE, LOG, NORMAL_DENSITY, PANEL, beta_ends, mixed_draw, simpson
from sluice.plans.decision_queries import CI, WF, walk_totals
from sluice.plans.fit_queries import TAIL, THRESH, WILSON, rounded
from sluice.plans.registry import query, with_ctes
from sluice.session import durable
from sluice.sources.panel import daily_panel, weekdays

HIST = """
hist AS (SELECT * FROM wk WHERE substr(md5(series_id || '|' || session::VARCHAR), 13, 1) <> '0')"""


def gappy_history(spark, sf_dir):
    """Weekday panel with one row in sixteen never recorded."""
    return weekdays(daily_panel(spark, sf_dir)).where(
        F.substring(F.md5(F.concat_ws("|", "series_id", F.col("session").cast("string")).cast("binary")), 13, 1) != "0")


@query("log_labels", with_ctes(LOG, """
SELECT coalesce(raw_source, '<null>') AS raw_source, prediction_source, coalesce(settlement_source, 'unknown') AS settlement_source, count(*) AS decisions FROM log GROUP BY 1, 2, 3"""))
def log_labels(spark, sf_dir):
    return log_of(spark, sf_dir).groupBy(
        F.coalesce("raw_source", F.lit("<null>")).alias("raw_source"), "prediction_source",
        F.coalesce("settlement_source", F.lit("unknown")).alias("settlement_source")).agg(
        F.count("*").alias("decisions"))


@query("resolve_outcomes", with_ctes(LOG, HIST, """
h2 AS (SELECT series_id, session, response, lag(session) OVER w AS ps, lag(response) OVER w AS pr FROM hist WINDOW w AS (PARTITION BY series_id ORDER BY session)),
j AS (SELECT l.series_id, l.session, c.prev_bd, h2.ps, h2.response, h2.pr FROM log l JOIN cal c ON c.d = l.session LEFT JOIN h2 ON h2.series_id = l.series_id AND h2.session = l.session),
s AS (SELECT *, CASE WHEN ps IS NULL THEN 'PENDING' WHEN ps <> prev_bd THEN 'NO_PRIOR_SESSION' ELSE 'RESOLVED' END AS status FROM j)""", """
SELECT series_id, session, status, CASE WHEN status = 'RESOLVED' THEN (response - pr)*100 END AS move FROM s"""))
def resolve_outcomes(spark, sf_dir):
    return rp.resolve_outcomes(log_of(spark, sf_dir), gappy_history(spark, sf_dir),
                               business_calendar(spark)).select("series_id", "session", "status", "move")


@query("score_log", with_ctes(LOG, """
SELECT series_id, session, direction, actual, savings + 0.0 AS savings, correct, sum(round(savings * 1e6)::BIGINT) OVER (PARTITION BY series_id ORDER BY verdict_ts)::BIGINT / 1e6::DOUBLE AS cumulative
FROM log WHERE actual IS NOT NULL"""))
def score_log(spark, sf_dir):
    # Whole millionths add up alike in any order.
    rows = log_of(spark, sf_dir).where("actual IS NOT NULL").withColumn("millionths", F.round(F.col("savings") * 1e6).cast("long"))
    return rows.select("series_id", "session", "direction", "actual", (F.col("savings") + 0.0).alias("savings"),
                       "correct", (F.sum("millionths").over(in_series().orderBy("verdict_ts")) / 1e6).alias("cumulative"))


@query("source_split", with_ctes(LOG, """
SELECT prediction_source, snapshot_based, count(*) AS decisions, count(*) FILTER (WHERE actual IS NOT NULL) AS resolved, count(*) FILTER (WHERE dir <> 0) AS alerts FROM log GROUP BY 1, 2"""))
def source_split(spark, sf_dir):
    return log_of(spark, sf_dir).groupBy(
        "prediction_source", ledger.settlement_based(F.col("settlement_source")).alias("snapshot_based")).agg(
        F.count("*").alias("decisions"), F.count("actual").alias("resolved"),
        count_if(F.col("dir") != 0).alias("alerts"))


@query("source_summary", with_ctes(LOG, """
r AS (SELECT *, max(verdict_ts) OVER () - INTERVAL 7 DAY AS cut FROM log WHERE actual IS NOT NULL),
g AS (SELECT prediction_source, count(*) AS rows, count(*) FILTER (WHERE dir <> 0) AS a, count(*) FILTER (WHERE dir <> 0 AND correct) AS h, coalesce(sum(savings) FILTER (WHERE dir <> 0), 0) AS s,
  count(*) FILTER (WHERE dir <> 0 AND verdict_ts >= cut) AS wa, count(*) FILTER (WHERE dir <> 0 AND correct AND verdict_ts >= cut) AS wh,
  coalesce(sum(savings) FILTER (WHERE dir <> 0 AND verdict_ts >= cut), 0) AS ws FROM r GROUP BY 1)""", """
SELECT prediction_source, rows, a AS alerts, round(s, 6) + 0.0 AS savings_cents, wa AS week_alerts, round(ws, 6) + 0.0 AS week_savings, round(coalesce(100*h/nullif(a, 0), 0), 6) AS precision,
  round(coalesce(100*wh/nullif(wa, 0), 0), 6) AS week_precision, round(coalesce(s/nullif(a, 0), 0), 6) + 0.0 AS avg_savings, round(s/100*8500, 4) AS full_dollars, round(s/100*8500*0.5, 4) AS estimated_dollars FROM g"""))
def source_summary(spark, sf_dir):
    s = rp.source_summary(log_of(spark, sf_dir).where("actual IS NOT NULL"))
    s = rounded(s, "savings_cents", "week_savings", "precision", "week_precision", "avg_savings")
    return s.withColumns({c: F.round(c, 4) for c in ("full_dollars", "estimated_dollars")})


@query("band_summary", with_ctes(LIVE, """
b AS (SELECT unnest(['Low confidence', 'Moderate confidence', 'High confidence']) AS band),
g AS (SELECT regexp_extract(label, '^(Low|Moderate|High)') || ' confidence' AS band, count(*) AS a, 100*avg(correct::INT) AS p, sum(savings) AS s FROM live WHERE dir <> 0 GROUP BY 1)""", """
SELECT b.band, coalesce(a, 0) AS alerts, round(coalesce(p, 0), 6) AS precision, round(coalesce(s, 0), 6) + 0.0 AS savings_cents FROM b LEFT JOIN g USING (band)"""))
def band_summary(spark, sf_dir):
    bands = spark.createDataFrame([(f"{b} confidence",) for b in ("Low", "Moderate", "High")], "band string")
    return rounded(rp.band_summary(rp.live_rows(log_of(spark, sf_dir)), bands), "precision", "savings_cents")


@query("live_summary", with_ctes(LIVE, """
q AS (SELECT *, TRY_CAST(regexp_extract(label, '\\| p=(.*)$', 1) AS DOUBLE) AS q0, correct::INT::DOUBLE AS hit FROM live WHERE dir <> 0),
g AS (SELECT coalesce(series_id, 'All') AS series_id, count(*) AS alerts, count(*) FILTER (WHERE correct) AS wins, avg(savings) AS avg_savings, min(savings) AS max_adverse,
  avg((q0 - hit)^2) AS brier, avg(q0) AS mq, count(q0) AS probability_n FROM q GROUP BY GROUPING SETS ((), (series_id)))""", """
SELECT series_id, alerts, wins, round(avg_savings, 6) AS avg_savings, max_adverse, round(brier, 6) AS brier, round(mq, 6) AS mean_probability, probability_n,
  round(wins/alerts, 6) AS precision, round(wins/alerts - mq, 6) + 0.0 AS calibration_gap FROM g"""))
def live_summary(spark, sf_dir):
    return rounded(rp.live_summary(rp.live_rows(log_of(spark, sf_dir))), "avg_savings", "brier",
                   "mean_probability", "precision", "calibration_gap")


@query("live_posterior", with_ctes(LIVE, """
lw AS (SELECT series_id, count(*) AS alerts, count(*) FILTER (WHERE correct) AS wins FROM live WHERE dir <> 0 GROUP BY 1
  UNION ALL SELECT 'All', count(*), count(*) FILTER (WHERE correct) FROM live WHERE dir <> 0)""",
    beta_ends("be", "lw", "series_id", "wins", "(alerts - wins)"), """
SELECT series_id, alerts, wins, round(low, 6) AS low, round(high, 6) AS high FROM lw JOIN be USING (series_id)"""))
def live_posterior(spark, sf_dir):
    """Posterior interval of the live precision, all and per series; the SQL sums the density."""
    s = rp.live_summary(rp.live_rows(log_of(spark, sf_dir)))
    lo, hi = beta_interval(F.col("wins"), F.col("alerts") - F.col("wins"))
    return s.select("series_id", "alerts", "wins", r6(lo).alias("low"), r6(hi).alias("high"))


@query("policy_benchmark", with_ctes(LIVE, """
pb AS (SELECT session, dir, CASE WHEN dir = 0 THEN 0 ELSE dir*actual END AS mp, sign(move)*actual AS sp FROM live),
ps AS (SELECT session, sum(mp - sp) AS inc, row_number() OVER (ORDER BY session) - 1 AS i, count(*) OVER () AS n FROM pb GROUP BY 1),
gc AS (SELECT i + 1 AS pos, sum(inc) OVER (ORDER BY i) AS c FROM ps UNION ALL SELECT 0, 0),
sz AS (SELECT DISTINCT n FROM ps),""" + f"""
bs AS (SELECT n, rep, j, {mixed_draw("'policy|5|all|' || rep", 'j', 'n - 5 + 1')} AS st FROM sz, range(1, 2001) r(rep), range(4000) b(j) WHERE j < ceil(n/5)),
be AS (SELECT *, st + least(5, n - j*5) AS en FROM bs),
bd AS (SELECT rep, sum(b.c - a.c) AS t FROM be JOIN gc a ON a.pos = st JOIN gc b ON b.pos = en GROUP BY 1),
ci AS (SELECT quantile_cont(t, 0.025) AS lo, quantile_cont(t, 0.975) AS hi FROM bd)""", """
SELECT count(*) AS rows, count(*) FILTER (WHERE dir <> 0) AS accepted, count(*) FILTER (WHERE dir = 0) AS rejected, round(sum(mp), 6) AS model_total,
  round(avg(mp) FILTER (WHERE dir <> 0), 6) AS model_avg_active, round(sum(sp), 6) AS sign_total, round(avg(sp), 6) AS sign_avg, round(sum(mp - sp), 6) AS incremental_total,
  round(max(lo), 5) AS incremental_ci_low, round(max(hi), 5) AS incremental_ci_high, (SELECT max(n) FROM sz) AS sessions FROM pb, ci"""))
def policy_benchmark(spark, sf_dir):
    live = rp.live_rows(log_of(spark, sf_dir))
    model = F.when(F.col("dir") == 0, 0.0).otherwise(F.col("dir") * F.col("actual"))
    rows = live.withColumn("mp", model).withColumn("sp", F.signum("move") * F.col("actual"))
    total = rows.agg(
        F.count("*").alias("rows"), count_if(F.col("dir") != 0).alias("accepted"),
        count_if(F.col("dir") == 0).alias("rejected"), F.sum("mp").alias("model_total"),
        F.avg(F.when(F.col("dir") != 0, F.col("mp"))).alias("model_avg_active"),
        F.sum("sp").alias("sign_total"), F.avg("sp").alias("sign_avg"),
        F.sum(F.col("mp") - F.col("sp")).alias("incremental_total"),
        F.countDistinct("session").alias("sessions"))
    day = rows.groupBy("session").agg(F.sum(F.col("mp") - F.col("sp")).alias("inc")).withColumn(
        "series_id", F.lit("all"))
    ci = rs.block_intervals(day, "session", ["inc"], 5, 2000, "policy", mean=False)
    out = total.join(F.broadcast(ci.select(F.col("low").alias("incremental_ci_low"),
                                           F.col("high").alias("incremental_ci_high"))))
    out = rounded(out, "model_total", "model_avg_active", "sign_total", "sign_avg", "incremental_total")
    return out.withColumns({c: F.round(c, 5) for c in ("incremental_ci_low", "incremental_ci_high")})


@query("date_block_perm", with_ctes(LIVE, """
lately AS (SELECT max(verdict_ts) - INTERVAL 180 DAY AS since FROM live),
w AS (SELECT live.* FROM live, lately WHERE verdict_ts >= since OR (SELECT count(*) FROM live, lately WHERE verdict_ts >= since) < 5),
sg AS (SELECT session, list(series_id ORDER BY series_id) AS sig, count(*) AS k, count(DISTINCT series_id) AS kd FROM w GROUP BY 1),
pl AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY session) AS place FROM sg),
sh AS (SELECT rep, sig, session AS donor, row_number() OVER (PARTITION BY rep, sig ORDER BY md5('dates|' || rep || '|' || session::VARCHAR)) AS place FROM pl, range(1, 5001) r(rep)),
mv2 AS (SELECT sh.rep, pl.session, sh.donor FROM sh JOIN pl ON pl.sig = sh.sig AND pl.place = sh.place),
t AS (SELECT rep, sum(a.dir*b.actual) AS t FROM mv2 JOIN w a ON a.session = mv2.session JOIN w b ON b.session = mv2.donor AND b.series_id = a.series_id GROUP BY 1),
re AS (SELECT sum(dir*actual) AS real_savings FROM w)""", """
SELECT round(max(real_savings), 6) AS real_savings, count(*) FILTER (WHERE t >= real_savings - 1e-9) AS as_extreme, count(*) AS permutations, round(avg(t), 6) + 0.0 AS null_mean,
  round((count(*) FILTER (WHERE t >= real_savings - 1e-9) + 1)/(count(*) + 1), 6) AS p_value, (SELECT count(*) FROM sg WHERE k <> kd) AS duplicate_sessions FROM t, re"""))
def date_block_perm(spark, sf_dir):
    rows = durable(rp.tested_rows(rp.live_rows(log_of(spark, sf_dir))).select(
        "series_id", "session", "dir", F.col("actual").alias("y")))
    return rounded(rs.date_block_permutation(rows, 5000, "dates"), "real_savings", "null_mean", "p_value").select(
        "real_savings", "as_extreme", "permutations", "null_mean", "p_value", "duplicate_sessions")


@query("rolling_precision", with_ctes(LIVE, """
t AS (SELECT *, epoch(verdict_ts)::BIGINT AS ep, epoch(max(verdict_ts) OVER (PARTITION BY series_id))::BIGINT - epoch(min(verdict_ts) OVER (PARTITION BY series_id))::BIGINT AS span FROM live),
a AS (SELECT * FROM t WHERE dir <> 0)""", """
SELECT series_id, session, CASE WHEN span >= 7776000 THEN round(100*sum(correct::INT) OVER w / count(*) OVER w, 6) END AS rolling_precision FROM a
WINDOW w AS (PARTITION BY series_id ORDER BY ep RANGE BETWEEN 7776000 PRECEDING AND CURRENT ROW)"""))
def rolling_precision(spark, sf_dir):
    return rounded(rp.rolling_precision(rp.live_rows(log_of(spark, sf_dir))), "rolling_precision")


@query("alert_rate", with_ctes(LIVE, """
d AS (SELECT session, count(*) FILTER (WHERE dir <> 0) AS a FROM live GROUP BY 1),
o AS (SELECT max(session) AS as_of FROM d),
wk2 AS (SELECT date_trunc('week', session) AS week, sum(a) AS a FROM d GROUP BY 1 HAVING sum(a) > 0),
ws AS (SELECT avg(a) AS mean_alerts, coalesce(stddev_samp(a), 0) AS sd_alerts FROM wk2),
rc AS (SELECT sum(a)::BIGINT AS raw_alerts FROM d, o WHERE session >= as_of - 7),
rl AS (SELECT count(*) AS rolls FROM cal, o WHERE is_roll AND d BETWEEN as_of - 7 AND as_of),
z AS (SELECT *, CASE WHEN rolls < 5 THEN raw_alerts*(5.0/(5 - rolls)) ELSE raw_alerts END::DOUBLE AS normalized, CASE WHEN sd_alerts > 0 THEN mean_alerts + 2*sd_alerts ELSE 999 END AS lim FROM ws, rc, rl, o)""", """
SELECT as_of, round(mean_alerts, 6) AS mean_alerts, round(sd_alerts, 6) AS sd_alerts, raw_alerts, rolls, round(normalized, 6) AS normalized, round(lim, 6) AS limit_alerts, normalized > lim AS anomaly FROM z"""))
def alert_rate(spark, sf_dir):
    return rounded(rp.alert_rate(rp.live_rows(log_of(spark, sf_dir)), business_calendar(spark)),
                   "mean_alerts", "sd_alerts", "normalized", "limit_alerts")


MK = PANEL + """,
mkb AS (SELECT series_id, session, (response - driver)*100 AS v, row_number() OVER (PARTITION BY series_id ORDER BY session DESC) AS back FROM wk),
mk AS (SELECT series_id, v, row_number() OVER (PARTITION BY series_id ORDER BY session) AS i, count(*) OVER (PARTITION BY series_id)::DOUBLE AS n FROM mkb WHERE back <= 65),
pr AS (SELECT a.series_id, sign(b.v - a.v) AS sg, (b.v - a.v)/(b.i - a.i) AS sl FROM mk a JOIN mk b ON a.series_id = b.series_id AND a.i < b.i),
ss AS (SELECT series_id, sum(sg)::DOUBLE AS s, quantile_cont(sl, 0.5) AS sen_slope FROM pr GROUP BY 1),
tt AS (SELECT series_id, v, count(*) AS t FROM mk GROUP BY 1, 2),
ts AS (SELECT series_id, sum(t*(t-1)*(2*t+5)) AS tie_sum, sum(t*(t-1)/2) AS tie_pairs FROM tt GROUP BY 1),
rk AS (SELECT series_id, i, n, rank() OVER (PARTITION BY series_id ORDER BY v) + (count(*) OVER (PARTITION BY series_id, v) - 1)/2 - (n + 1)/2 AS c FROM mk),
dn AS (SELECT series_id, sum(c*c) AS den FROM rk GROUP BY 1),
rh AS (SELECT a.series_id, b.i - a.i AS lag, max(a.n) AS n, sum(a.c*b.c)/max(den) AS rho FROM rk a JOIN rk b ON a.series_id = b.series_id AND b.i - a.i BETWEEN 1 AND a.n//4
  JOIN dn ON dn.series_id = a.series_id GROUP BY 1, 2),
fi AS (SELECT series_id, max(n) AS n, greatest(1, 1 + 2/(max(n)*(max(n)-1)*(max(n)-2))*sum(CASE WHEN abs(rho) > 1.96/sqrt(n) THEN (n-lag)*(n-lag-1)*(n-lag-2)*rho ELSE 0 END)) AS inflation FROM rh GROUP BY 1),
mz AS (SELECT fi.series_id, n, s, sen_slope, inflation, (n*(n-1)*(2*n+5) - tie_sum)/18 AS var0, tie_pairs FROM fi JOIN ss USING (series_id) JOIN ts USING (series_id))"""


@query("mann_kendall", with_ctes(MK, """
SELECT series_id, n::INT AS n, s, round((s - sign(s))/sqrt(var0), 6) + 0.0 AS z_plain, round(sen_slope, 6) + 0.0 AS sen_slope,
  round(s/sqrt((n*(n-1)/2 - tie_pairs)*n*(n-1)/2), 6) + 0.0 AS tau FROM mz"""))
def mann_kendall(spark, sf_dir):
    mk = rp.mann_kendall(weekdays(daily_panel(spark, sf_dir)))
    return rounded(mk, "z_plain", "sen_slope", "tau").select("series_id", "n", "s", "z_plain", "sen_slope", "tau")


@query("hamed_rao", with_ctes(MK, "SELECT rh.series_id, lag::INT AS lag, round(rho, 6) + 0.0 AS rho, round(inflation, 6) AS inflation FROM rh JOIN fi USING (series_id)"))
def hamed_rao(spark, sf_dir):
    mk = rp.mann_kendall(weekdays(daily_panel(spark, sf_dir)))
    e = mk.select("series_id", "inflation", F.posexplode("rhos").alias("k", "rho"))
    return e.select("series_id", (F.col("k") + 1).alias("lag"), r6("rho").alias("rho"), r6("inflation").alias("inflation"))


@query("basis_drift", with_ctes(MK, """
SELECT series_id, round((s - sign(s))/sqrt(var0*inflation), 6) + 0.0 AS z, abs((s - sign(s))/sqrt(var0*inflation)) > 1.959963984540054 AS drifted, round(65*sen_slope, 5) + 0.0 AS change_over_window FROM mz WHERE n >= 65"""))
def basis_drift(spark, sf_dir):
    mk = rp.mann_kendall(weekdays(daily_panel(spark, sf_dir))).where("n >= 65")
    return mk.select("series_id", r6("z").alias("z"), (F.abs("z") > rp.Z95).alias("drifted"),
                     (F.round(65 * F.col("sen_slope"), 5) + 0.0).alias("change_over_window"))


@query("basis_p_value", with_ctes(MK, f"""
SELECT series_id, round(greatest(0, 1 - 2 * {simpson(NORMAL_DENSITY, 'abs((s - sign(s))/sqrt(var0*inflation))')}), 6) AS p_value
FROM mz, range(2001) r(i) GROUP BY 1"""))
def basis_p_value(spark, sf_dir):
    """Two-sided p of the trend; the SQL integrates the density."""
    mk = rp.mann_kendall(weekdays(daily_panel(spark, sf_dir)))
    return mk.select("series_id", r6(normal_two_sided(F.col("z"))).alias("p_value"))


@query("sig_gate", with_ctes(LOG, """
c AS (SELECT count(*) FILTER (WHERE prediction_source = 'live') AS lp, count(*) FILTER (WHERE prediction_source = 'live' AND snapshot_based AND actual IS NOT NULL) AS rl,
  count(*) FILTER (WHERE prediction_source = 'live' AND snapshot_based AND actual IS NOT NULL AND verdict_ts >= (SELECT max(verdict_ts) FROM log) - INTERVAL 180 DAY) AS rr FROM log)""", """
SELECT lp AS live_predictions, rl AS resolved_live, rr AS resolved_recent, CASE WHEN rr < 5 THEN 'full_history' ELSE 'last_180_days' END AS period, lp >= 30 AND (CASE WHEN rr < 5 THEN rl ELSE rr END) >= 30 AS available FROM c"""))
def sig_gate(spark, sf_dir):
    return rp.significance_gate(log_of(spark, sf_dir))


@query("decoupling", with_ctes(LOG, """
r AS (SELECT *, max(session) OVER (PARTITION BY series_id) AS as_of FROM log)""", """
SELECT series_id, count(*) AS alerts, count(*) FILTER (WHERE correct) AS wins, count(*) >= 5 AND count(*) FILTER (WHERE correct)/count(*) < 0.4 AS decoupled
FROM r WHERE session >= as_of - 14 AND dir <> 0 AND actual IS NOT NULL GROUP BY 1"""))
def decoupling(spark, sf_dir):
    return rp.decoupling(log_of(spark, sf_dir))


@query("confirmation", with_ctes(LOG, HIST, """
h2 AS (SELECT series_id, session, response, lag(response) OVER (PARTITION BY series_id ORDER BY session) AS pr FROM hist),
j AS (SELECT l.series_id, l.session, l.direction, l.dir, (h2.response - pr)*100 AS move, row_number() OVER (PARTITION BY l.series_id ORDER BY l.session DESC) AS k
  FROM log l JOIN h2 ON h2.series_id = l.series_id AND h2.session = l.session AND pr IS NOT NULL)""", """
SELECT series_id, session, direction, move, dir*move + 0.0 AS savings, dir*move > 0 AS correct FROM j WHERE k = 1"""))
def confirmation(spark, sf_dir):
    return rp.confirmation(log_of(spark, sf_dir), gappy_history(spark, sf_dir)).withColumn(
        "savings", F.col("savings") + 0.0)


@query("replay", with_ctes(LOG, """
r AS (SELECT *, CASE WHEN x >= artifact_hike THEN 'HIKE' WHEN x <= artifact_drop_ THEN 'DROP' ELSE 'FLAT' END AS replayed,
  CASE WHEN x >= hike OR x >= lean_hike THEN 'HIKE' WHEN x <= drop_ OR x <= lean_drop THEN 'DROP' ELSE 'FLAT' END AS every,
  CASE WHEN modeled_action IN ('BUY_NOW','LEAN_BUY') THEN 'HIKE' WHEN modeled_action IN ('WAIT','LEAN_WAIT') THEN 'DROP' ELSE 'FLAT' END AS modeled FROM log)""", """
SELECT series_id, session, artifact_id, replayed, replayed = direction AS match_full, every = modeled AS match_all, round(abs(x - move), 6) AS gap, abs(x - move) > 2.0 AS gap_exceeded FROM r"""))
def replay(spark, sf_dir):
    return rounded(rp.replay(log_of(spark, sf_dir)), "gap")


@query("log_completeness", with_ctes(LOG, """
h AS (SELECT series_id, session, (driver - lag(driver) OVER (PARTITION BY series_id ORDER BY session))*100 AS x FROM wk),
mi AS (SELECT h.* FROM h WHERE x IS NOT NULL AND NOT EXISTS (SELECT 1 FROM log l WHERE l.series_id = h.series_id AND l.session = h.session AND l.prediction_source = 'live'))""", """
SELECT mi.series_id, mi.session, CASE WHEN a.artifact_id IS NULL THEN 'no_artifact' ELSE 'backfilled' END AS status,
  CASE WHEN a.artifact_id IS NOT NULL THEN CASE WHEN x >= hike THEN 'HIKE' WHEN x <= drop_ THEN 'DROP' ELSE 'FLAT' END END AS direction
FROM mi LEFT JOIN arts a ON a.series_id = mi.series_id AND a.effective_session = mi.session"""))
def log_completeness(spark, sf_dir):
    train = cut_train(spark, sf_dir)
    arts = durable(ledger.artifacts(train))
    return rp.completeness(weekdays(daily_panel(spark, sf_dir)), ledger.decision_log(train, arts), arts)


@query("live_floor_check", with_ctes(LIVE, """
g AS (SELECT series_id, CASE WHEN abs(z) >= 1.5 THEN 'High' WHEN abs(z) >= 1 THEN 'Moderate' ELSE 'Low' END AS band, count(*) AS alerts, count(*) FILTER (WHERE correct) AS hits FROM live WHERE dir <> 0 GROUP BY 1, 2)""", """
SELECT series_id, band, alerts, hits, CASE WHEN alerts >= 20 THEN round(hits/alerts, 6) END AS precision,
  CASE WHEN alerts < 20 THEN 'insufficient' WHEN hits/alerts >= CASE series_id WHEN 'F' THEN 0.53 ELSE 0.60 END THEN 'validated' ELSE 'warning' END AS status FROM g"""))
def live_floor_check(spark, sf_dir):
    """The floors are a parameter table: one series has its own, the others share one."""
    live = durable(rp.live_rows(log_of(spark, sf_dir)))
    floors = live.select("series_id").distinct().withColumn(
        "floor", F.when(F.col("series_id") == "F", 0.53).otherwise(0.60))
    return rounded(rp.live_floor_check(live, floors), "precision")


@query("cumulative_trend", with_ctes(LIVE, """
a AS (SELECT *, max(session) OVER (PARTITION BY series_id) AS newest, row_number() OVER (PARTITION BY series_id ORDER BY session DESC) AS back FROM live),
b AS (SELECT *, count(*) FILTER (WHERE session >= newest - 90) OVER (PARTITION BY series_id) AS near_n FROM a),
c AS (SELECT *, dir <> 0 AS is_alert FROM b WHERE CASE WHEN near_n < 10 THEN back <= 60 ELSE session >= newest - 90 END),
d AS (SELECT *, sum(savings) OVER (PARTITION BY series_id ORDER BY session) AS cumulative FROM c)""", """
SELECT series_id, session, is_alert, round(cumulative, 6) + 0.0 AS cumulative, CASE WHEN is_alert THEN round(avg(cumulative) OVER (PARTITION BY series_id, is_alert ORDER BY session ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) + 0.0 END AS trend FROM d"""))
def cumulative_trend(spark, sf_dir):
    return rounded(rp.cumulative_trend(rp.live_rows(log_of(spark, sf_dir))), "cumulative", "trend")


@query("snapshot_error", with_ctes(LOG, """
e AS (SELECT *, (signal_price - settle)*100 AS e FROM log),
e2 AS (SELECT *, quantile_cont(e, 0.5) OVER (PARTITION BY series_id) AS mid, CASE WHEN x >= hike THEN 'BUY_NOW' WHEN x <= drop_ THEN 'WAIT' WHEN x >= lean_hike THEN 'LEAN_BUY' WHEN x <= lean_drop THEN 'LEAN_WAIT' ELSE 'NO_EDGE' END AS s FROM e)""", """
SELECT series_id, count(*) AS n, round(avg(e), 6) + 0.0 AS mean_error, round(1.4826*quantile_cont(abs(e - mid), 0.5), 6) AS robust_sigma, round(avg(abs(e)), 6) AS mean_abs,
  round(quantile_cont(abs(e), 0.95), 6) AS p95_abs, round(avg((s <> modeled_action)::INT), 6) AS reclassified FROM e2 GROUP BY 1"""))
def snapshot_error(spark, sf_dir):
    return rounded(rp.snapshot_error(log_of(spark, sf_dir)), "mean_error", "robust_sigma", "mean_abs", "p95_abs", "reclassified")


@query("verdict_context", with_ctes(LOG, THRESH, CI, WF, TAIL, f"""
la AS (SELECT * FROM log),
wl AS (SELECT series_id, oos_alerts, oos_correct/oos_alerts AS op, {WILSON('oos_correct', 'oos_alerts')} FROM (SELECT series_id, oos_alerts::DOUBLE AS oos_alerts, oos_correct::DOUBLE AS oos_correct FROM wfa))""", """
SELECT la.series_id, la.session, modeled_action, round(expected, 6) + 0.0 AS expected, round(net_edge/100*8500, 4) + 0.0 AS net_value_dollars,
  CASE WHEN modeled_action = 'BUY_NOW' THEN move >= hike_high WHEN modeled_action = 'WAIT' THEN move <= drop_low END AS stable,
  round(op, 6) AS oos_precision, wilson_low, wilson_high, round(cvar, 6) AS cvar, round(adverse, 6) AS probability_adverse
FROM la JOIN ci USING (series_id) JOIN wl USING (series_id) LEFT JOIN wt USING (series_id) LEFT JOIN wc USING (series_id)"""))
def verdict_context(spark, sf_dir):
    """What an operator should see beside each verdict."""
    train = cut_train(spark, sf_dir)
    log = ledger.decision_log(train, ledger.artifacts(train))
    last = m.last_rows(train)
    ci = rounded(m.block_threshold_interval(last), "hike_high", "drop_low").select("series_id", "hike_high", "drop_low")
    wf = walk_totals(train)
    lo, hi = wilson(F.col("oos_correct"), F.col("oos_alerts"))
    wf = wf.select("series_id", r6(F.col("oos_correct") / F.col("oos_alerts")).alias("oos_precision"),
                   r6(lo).alias("wilson_low"), r6(hi).alias("wilson_high"))
    tail = m.tail_risk(train, m.group_thresholds(last, ["series_id"])).select(
        "series_id", r6("cvar").alias("cvar"), r6("probability_adverse").alias("probability_adverse"))
    act = F.col("modeled_action")
    stable = F.when(act == "BUY_NOW", F.col("move") >= F.col("hike_high")).when(
        act == "WAIT", F.col("move") <= F.col("drop_low"))
    out = log.join(ci, "series_id").join(wf, "series_id").join(tail, "series_id", "left")
    return out.select("series_id", "session", "modeled_action", r6("expected").alias("expected"),
                      (F.round(F.col("net_edge") / 100 * m.TRUCK_GALLONS, 4) + 0.0).alias("net_value_dollars"),
                      stable.alias("stable"), "oos_precision", "wilson_low", "wilson_high", "cvar",
                      "probability_adverse")
