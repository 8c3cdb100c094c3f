"""Prospective-trial queries: production log against the weighted challenger."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.calendar import business_calendar
from sluice.operators import forecast as fc, learners as ln, ledger, trial as tr
from sluice.operators.ledger import byte_of
from sluice.plans.base import cut_train
from sluice.plans.ctes import LOG, byte
from sluice.plans.fit_queries import rounded
from sluice.plans.forecast_queries import PREQ, adapter_sql, block_sql
from sluice.plans.registry import query, with_ctes
from sluice.plans.report_queries import HIST, gappy_history
from sluice.session import durable

START = "1996-07-01"
B = lambda i: byte(i, "series_id", "session")
LB = lambda i: byte(i, "l.series_id", "l.session")
TB = lambda i: byte(i, "t0.series_id", "t0.session")


def b(i):
    return byte_of(i, "series_id", "session")


TRIAL = LOG + "," + HIST + "," + PREQ + "," + adapter_sql("weighted") + f""",
t0 AS (SELECT l.*, verdict_ts + to_minutes({LB(16)} % 4) AS captured_at, baseline_price + CASE WHEN {LB(15)} < 4 THEN 0.001 ELSE 0.0 END::DOUBLE AS recorded_baseline,
  lag(session, 482) OVER w AS training_start0, lag(session) OVER w AS training_end0 FROM log l WINDOW w AS (PARTITION BY series_id ORDER BY session)),
tb AS (SELECT series_id, session, lag(session, 482) OVER w AS training_start, lag(session) OVER w AS training_end FROM train WINDOW w AS (PARTITION BY series_id ORDER BY session)),
hv AS (SELECT series_id, session, driver + CASE WHEN {B(22)} < 6 THEN 0.002 ELSE 0.0 END::DOUBLE AS driver, session + CASE WHEN {B(20)} < 4 THEN INTERVAL 14 HOUR WHEN {B(21)} < 4 THEN INTERVAL 79 HOUR ELSE INTERVAL 31 HOUR END AS recorded_at FROM hist
  UNION ALL SELECT series_id, session, driver, session + INTERVAL 100 HOUR FROM hist WHERE {B(22)} < 6),
t1 AS (SELECT t0.* EXCLUDE (training_start0, training_end0), tb.training_start, tb.training_end, prediction_source = 'live' AND {TB(17)} >= 4 AS unique_live, session + to_minutes(810 + {TB(18)} % 18) AS snapshot_at, {TB(19)} < 3 AS reconfigured,
  (SELECT arg_max(h.driver, h.recorded_at) FROM hv h WHERE h.series_id = t0.series_id AND h.session = t0.prior_session AND h.recorded_at <= t0.captured_at) AS h_driver,
  EXISTS (SELECT 1 FROM hv h WHERE h.series_id = t0.series_id AND h.session >= t0.session AND h.recorded_at <= t0.captured_at) AS on_file FROM t0 JOIN tb USING (series_id, session)
  WHERE t0.session >= DATE '{START}' AND strftime(captured_at, '%H%M') < '1600'),
t2 AS (SELECT *, CASE WHEN NOT unique_live THEN 'no_unique_live_row' WHEN NOT (baseline_source <> 'exchange_close' AND snapshot_based AND strftime(snapshot_at, '%H%M') BETWEEN '1330' AND '1345') THEN 'not_same_contract_verdict' WHEN on_file THEN 'outcome_on_file' WHEN h_driver IS NULL THEN 'prior_posting_missing'
  WHEN abs(h_driver - recorded_baseline) > 0.000051 THEN 'baseline_differs' WHEN ord - 1 < 482 THEN 'insufficient_history' WHEN reconfigured THEN 'config_changed' END AS reason FROM t1),
t3 AS (SELECT *, CASE WHEN reason IS NULL THEN 'eligible' ELSE 'ineligible' END AS status, captured_at + to_minutes({B(7)} % 20) AS computed_at, {B(8)} < 4 AS worker_failed, CASE WHEN move >= 0 THEN p ELSE 1.0::DOUBLE - p END AS p_up FROM t2),
t4 AS (SELECT *, CASE WHEN status = 'ineligible' THEN 'ineligible' WHEN strftime(computed_at, '%H%M') >= '1600' THEN 'missed_deadline' WHEN worker_failed THEN 'failed' ELSE 'forecasted' END AS state FROM t3),
t5 AS (SELECT t4.*, e.point AS shadow_point, e.p_up AS shadow_p_up, e.dir AS shadow_dir FROM t4 JOIN eo_weighted e USING (series_id, session)),
t6 AS (SELECT *, state = 'forecasted' AS on_time, CASE WHEN state = 'forecasted' THEN shadow_point ELSE expected END AS ip, CASE WHEN state = 'forecasted' THEN shadow_p_up ELSE p_up END AS iu,
  CASE WHEN state = 'forecasted' THEN shadow_dir ELSE dir END AS idr FROM t5 WHERE status = 'eligible' AND actual IS NOT NULL),
oc AS (SELECT *, abs(expected - actual) AS prod_abs_error, abs(ip - actual) AS itt_abs_error, (expected - actual)^2 AS prod_squared_error, (ip - actual)^2 AS itt_squared_error,
  (p_up - (actual > 0)::INT)^2 AS prod_brier_up, (iu - (actual > 0)::INT)^2 AS itt_brier_up, dir*actual AS prod_gross_timing, idr*actual AS itt_gross_timing,
  CASE WHEN dir = -1 THEN greatest(actual, 0) ELSE 0 END::DOUBLE AS prod_wrong_wait_cost, CASE WHEN idr = -1 THEN greatest(actual, 0) ELSE 0 END::DOUBLE AS itt_wrong_wait_cost FROM t6)"""


def recorded_history(spark, sf_dir):
    """The history with the time each row was recorded: mostly next morning, some at once or days late, some corrected later."""
    at = lambda hours: F.to_timestamp_ntz(F.col("session").cast("string"), F.lit("yyyy-MM-dd")) + F.make_dt_interval(F.lit(0), hours)
    h = gappy_history(spark, sf_dir)
    first = h.withColumn("recorded_at", at(F.when(b(20) < 4, 14).when(b(21) < 4, 79).otherwise(31))).withColumn(
        "driver", F.col("driver") + F.when(b(22) < 6, 0.002).otherwise(0.0))
    return first.unionByName(h.where(b(22) < 6).withColumn("recorded_at", at(F.lit(100))))


def forecasts_of(spark, sf_dir, sealed_huber=False):
    """Sealed inputs with forecast states and the challenger's numbers.

    The challenger is the weighted line, which SQL can follow, or the sealed
    Huber forecast of every session.
    """
    train = cut_train(spark, sf_dir)
    log = ledger.decision_log(train, ledger.artifacts(train))
    minutes = lambda i, n: F.make_dt_interval(F.lit(0), F.lit(0), b(i) % n)
    log = (log.where(F.col("session") >= F.lit(START).cast("date"))
           .withColumn("captured_at", F.col("verdict_ts") + minutes(16, 4))
           .withColumn("recorded_baseline", F.col("baseline_price") + F.when(b(15) < 4, 0.001).otherwise(0.0))
           .withColumn("p_up", F.when(F.col("move") >= 0, F.col("p")).otherwise(1.0 - F.col("p"))))
    # Some sessions were decided twice, some snapshots came early or late, some configurations changed before the capture.
    log = log.withColumns({
        "snapshot_at": F.to_timestamp_ntz(F.col("session").cast("string"), F.lit("yyyy-MM-dd")) + F.make_dt_interval(F.lit(0), F.lit(0), 810 + b(18) % 18),
        "logged_config": F.col("artifact_id"), "runtime_config": F.when(b(19) < 3, F.sha2("artifact_id", 256)).otherwise(F.col("artifact_id")),
        "twice": F.when(b(17) < 4, 2).otherwise(1)}).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("twice")))).drop("twice", "copy")
    sealed = tr.inputs(log, train, recorded_history(spark, sf_dir))
    sealed = (sealed.withColumn("computed_at", F.col("captured_at") + minutes(7, 20))
              .withColumn("worker_failed", b(8) < 4)
              .withColumn("input_hash", F.sha2(F.concat_ws("|", "series_id", F.col("session").cast("string"), "artifact_id"), 256)))
    name = "huber" if sealed_huber else "weighted_360"
    rows = ln.sealed_forecasts(train) if sealed_huber else fc.forecast_rows(train)
    shadow = rows.select("series_id", "session", *[
        F.col(f"{name}.{c}").alias(f"shadow_{c}") for c in ("point", "p_up", "dir")])
    return durable(tr.states(sealed).join(shadow, ["series_id", "session"]))


@query("trial_eligibility", with_ctes(TRIAL, """
SELECT series_id, session, status, reason, (ord - 1)::INT AS prior_pairs, training_start, training_end FROM t5"""))
def trial_eligibility(spark, sf_dir):
    return forecasts_of(spark, sf_dir).select("series_id", "session", "status", "reason", "prior_pairs",
                                              "training_start", "training_end")


@query("trial_state", with_ctes(TRIAL, "SELECT series_id, state, count(*) AS sessions FROM t5 GROUP BY 1, 2"))
def trial_state(spark, sf_dir):
    return forecasts_of(spark, sf_dir).groupBy("series_id", "state").agg(F.count("*").alias("sessions"))


_SC = [f"{w}_{k}" for w in ("prod", "itt") for k in tr.SCORES]


@query("trial_scores", with_ctes(TRIAL, "SELECT series_id, session, on_time, " + ", ".join(
    f"round({c}, 6) + 0.0 AS {c}" for c in _SC) + " FROM oc"))
def trial_scores(spark, sf_dir):
    return rounded(tr.outcomes(forecasts_of(spark, sf_dir)), *_SC).select("series_id", "session", "on_time", *_SC)


@query("trial_sealed_scores")
def trial_sealed_scores(spark, sf_dir):
    """The same scores with the sealed Huber forecast of every session as the challenger."""
    scored = tr.outcomes(forecasts_of(spark, sf_dir, sealed_huber=True))
    return rounded(scored, *_SC).select("series_id", "session", "on_time", *_SC)


@query("trial_sealed_status")
def trial_sealed_status(spark, sf_dir):
    """Where the trial of the sealed Huber forecast stands."""
    f = forecasts_of(spark, sf_dir, sealed_huber=True)
    return rounded(tr.status(f, business_calendar(spark), START), "prod_mae", "itt_mae", "prod_rmse", "itt_rmse",
                   "prod_brier", "itt_brier")


@query("trial_link_audit", with_ctes(TRIAL, f"""
st AS (SELECT *, {B(9)} AS t FROM oc),
au AS (SELECT series_id, CASE WHEN t = 0 THEN 'input_hash' WHEN t = 1 THEN 'scored_before_forecast' WHEN t = 2 THEN 'mislabelled' WHEN t = 3 THEN 'score_differs' ELSE 'ok' END AS issue FROM st
  UNION ALL SELECT series_id, 'no_forecast' FROM st WHERE t = 4)""", """
SELECT series_id, issue, count(*) AS outcomes FROM au GROUP BY 1, 2"""))
def trial_link_audit(spark, sf_dir):
    """Stored outcomes of which some were edited and some point nowhere."""
    f = forecasts_of(spark, sf_dir)
    t, c = b(9), F.col
    o = tr.outcomes(f).withColumn("t", t)
    o = o.withColumn("scored_at", F.when(c("t") == 1, c("captured_at") - F.expr("INTERVAL 1 DAY")).otherwise(
        c("computed_at") + F.expr("INTERVAL 4 HOURS")))
    o = o.withColumn("input_hash", F.when(c("t") == 0, F.lit("0")).otherwise(c("input_hash")))
    o = o.withColumn("on_time", F.when(c("t") == 2, ~c("on_time")).otherwise(c("on_time")))
    o = o.withColumn("itt_abs_error", F.when(c("t") == 3, c("itt_abs_error") + 1e-6).otherwise(c("itt_abs_error")))
    cols = ["series_id", "session", "input_hash", "scored_at", "on_time", "itt_dir", *_SC]
    stray = o.where("t = 4").withColumn("session", F.date_add("session", 20000))
    stored = o.select(*cols).unionByName(stray.select(*cols))
    return tr.link_audit(stored, f).groupBy("series_id", "issue").agg(F.count("*").alias("outcomes"))


STATUS = f"""
pl AS (SELECT t5.*, oc.prod_abs_error AS pe, row_number() OVER (PARTITION BY t5.series_id, t5.status ORDER BY t5.session) AS place FROM t5 LEFT JOIN oc USING (series_id, session)),
un AS (SELECT m.series_id, count(*) AS uncaptured FROM (SELECT series_id, max(session) AS ls FROM t5 GROUP BY 1) m JOIN cal ON is_bd AND d BETWEEN DATE '{START}' AND ls
  WHERE NOT EXISTS (SELECT 1 FROM t5 WHERE t5.series_id = m.series_id AND t5.session = cal.d) GROUP BY 1),
ag AS (SELECT series_id, count(*) AS captured, count(*) FILTER (WHERE status = 'eligible') AS eligible, count(*) FILTER (WHERE state = 'forecasted') AS on_time, count(*) FILTER (WHERE state IN ('failed','missed_deadline')) AS failed_or_late,
  count(pe) AS resolved, count(*) FILTER (WHERE status = 'eligible' AND place <= 320) AS cohort, count(pe) FILTER (WHERE status = 'eligible' AND place <= 320) AS cohort_resolved, max(session) AS last_session FROM pl GROUP BY 1),
er AS (SELECT series_id, round(avg(prod_abs_error), 6) AS prod_mae, round(avg(itt_abs_error), 6) AS itt_mae, round(sqrt(avg(prod_squared_error)), 6) AS prod_rmse, round(sqrt(avg(itt_squared_error)), 6) AS itt_rmse,
  round(avg(prod_brier_up), 6) AS prod_brier, round(avg(itt_brier_up), 6) AS itt_brier FROM oc GROUP BY 1)"""


@query("trial_status", with_ctes(TRIAL, STATUS.replace("ag AS", "agg_ AS").replace("un AS", "unc AS"), """
SELECT a.*, coalesce(uncaptured, 0) AS uncaptured, eligible - resolved AS pending, resolved >= 60 AS operational_review_due, cohort = 320 AND cohort_resolved = 320 AS cohort_complete,
  prod_mae, itt_mae, prod_rmse, itt_rmse, prod_brier, itt_brier FROM agg_ a JOIN er USING (series_id) LEFT JOIN unc USING (series_id)"""))
def trial_status(spark, sf_dir):
    return rounded(tr.status(forecasts_of(spark, sf_dir), business_calendar(spark), START), "prod_mae", "itt_mae",
                   "prod_rmse", "itt_rmse", "prod_brier", "itt_brier")


@query("trial_review", with_ctes(TRIAL, STATUS.replace("ag AS", "agg_ AS").replace("un AS", "unc AS"), """
co AS (SELECT series_id, session, on_time, prod_abs_error - itt_abs_error AS g, row_number() OVER (PARTITION BY series_id ORDER BY session) AS place FROM oc),
cw AS (SELECT *, place - 1 AS i FROM co WHERE place <= 320),
gm AS (SELECT series_id, 'gain' AS candidate, avg(g) AS mean_gain, count(*) AS n, min(session) AS start_session, max(session) AS end_session, count(*) FILTER (WHERE on_time)/count(*) AS coverage FROM cw GROUP BY 1 HAVING count(*) = 320),
gc AS (SELECT series_id, 'gain' AS candidate, i + 1 AS pos, sum(g) OVER (PARTITION BY series_id ORDER BY i) AS c FROM cw UNION ALL SELECT series_id, 'gain', 0, 0 FROM gm)""",
    *[block_sql(f"r{k}", k, tr.RESAMPLES, "review") for k in tr.BLOCKS],
    ", ".join(f"q{k} AS (SELECT series_id, quantile_cont(m, 0.025) AS low_{k}, quantile_cont(m, 0.975) AS high_{k} FROM r{k}_d GROUP BY 1)" for k in tr.BLOCKS), """
SELECT gm.series_id, n, start_session, end_session, round(mean_gain, 6) + 0.0 AS mean_gain, round(coverage, 6) AS coverage, round(low_5, 6) + 0.0 AS low_5, round(high_5, 6) + 0.0 AS high_5, round(low_10, 6) + 0.0 AS low_10, round(high_10, 6) + 0.0 AS high_10,
  round(low_20, 6) + 0.0 AS low_20, round(high_20, 6) + 0.0 AS high_20, uncaptured, low_5 > 0 AND low_10 > 0 AND low_20 > 0 AS positive_all,
  low_5 > 0 AND low_10 > 0 AND low_20 > 0 AND mean_gain >= 0.1 AND coverage >= 0.95 AND coalesce(uncaptured, 0) = 0 AS passes
FROM gm JOIN q5 USING (series_id) JOIN q10 USING (series_id) JOIN q20 USING (series_id) LEFT JOIN unc USING (series_id)"""))
def trial_review(spark, sf_dir):
    f = forecasts_of(spark, sf_dir)
    uncaptured = tr.status(f, business_calendar(spark), START).select("series_id", "uncaptured")
    cols = [f"{e}_{k}" for k in tr.BLOCKS for e in ("low", "high")]
    return rounded(tr.formal_review(f, uncaptured), "mean_gain", "coverage", *cols)
