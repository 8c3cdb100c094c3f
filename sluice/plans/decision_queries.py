"""Decision rules and the decision log."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.exprs import count_if, r6, ratio
from sluice.operators import decide, evaluate as ev, fit as m, ledger
from sluice.plans.base import artifacts_of, cut_train, log_of
from sluice.plans.ctes import ARTIFACTS, LOG, TRAIN
from sluice.plans.fit_queries import FOLDS, TAIL, THRESH, rounded
from sluice.plans.registry import ORACLES, query, with_ctes
from sluice.plans.ctes import DIR, thresholds
from sluice.session import durable


@query("artifact_ledger", with_ctes(ARTIFACTS, """
SELECT series_id, block::BIGINT AS block, effective_session, training_start, training_end, rows, slope, intercept, hike, drop_, lean_hike, lean_drop, daily_std,
  prior_artifact_id, artifact_id FROM arts"""))
def artifact_ledger(spark, sf_dir):
    return artifacts_of(spark, sf_dir).select(
        "series_id", "block", "effective_session", "training_start", "training_end", "rows", "slope",
        "intercept", "hike", "drop_", "lean_hike", "lean_drop", "daily_std", "prior_artifact_id", "artifact_id")


@query("effective_thresholds", with_ctes(LOG, """
SELECT series_id, session, baseline_source, hike, drop_, lean_hike, lean_drop, hike <> artifact_hike OR drop_ <> artifact_drop_ AS widened FROM log"""))
def effective_thresholds(spark, sf_dir):
    log = log_of(spark, sf_dir)
    return log.select("series_id", "session", "baseline_source", "hike", "drop_", "lean_hike", "lean_drop",
                      ((F.col("hike") != F.col("artifact_hike"))
                       | (F.col("drop_") != F.col("artifact_drop_"))).alias("widened"))


@query("action_ladder", with_ctes(LOG, """
SELECT series_id, session, modeled_action, final_action, direction, threshold_used, round(net_edge, 6) + 0.0 AS net_edge,
  p < 0.70 AND final_action <> 'NO_EDGE' AS low_confidence FROM log"""))
def action_ladder(spark, sf_dir):
    low = (F.col("p") < decide.LOW_CONFIDENCE) & (F.col("final_action") != "NO_EDGE")
    return log_of(spark, sf_dir).select(
        "series_id", "session", "modeled_action", "final_action", "direction", "threshold_used",
        r6("net_edge").alias("net_edge"), low.alias("low_confidence"))


@query("confidence_band", with_ctes(LOG, """
SELECT label, count(*) AS decisions, round(avg(p), 6) AS mean_p FROM log GROUP BY 1"""))
def confidence_band(spark, sf_dir):
    return log_of(spark, sf_dir).groupBy("label").agg(
        F.count("*").alias("decisions"), r6(F.avg("p")).alias("mean_p"))


@query("z_move", with_ctes(LOG, """
SELECT series_id, session, round(z, 6) + 0.0 AS z, CASE WHEN abs(z) >= 1.5 THEN 'High' WHEN abs(z) >= 1 THEN 'Moderate' ELSE 'Low' END AS band FROM log"""))
def z_move(spark, sf_dir):
    return log_of(spark, sf_dir).select("series_id", "session", r6("z").alias("z"),
                                        decide.z_band(F.col("z")).alias("band"))


_CI = ORACLES["threshold_ci"]
_CI_CTES, _CI_FINAL = _CI[len("WITH RECURSIVE "):].rsplit("\nSELECT series_id, round(quantile_cont(hike", 1)
CI = _CI_CTES[len(TRAIN.strip()) + 2:] + ",\nci AS (SELECT series_id, round(quantile_cont(hike" + _CI_FINAL + ")"


@query("threshold_stability", with_ctes(LOG, CI, """
SELECT series_id, session, modeled_action, CASE WHEN modeled_action = 'BUY_NOW' THEN move >= hike_high WHEN modeled_action = 'WAIT' THEN move <= drop_low END AS stable
FROM log JOIN ci USING (series_id)"""))
def threshold_stability(spark, sf_dir):
    """Alerts whose move clears the cautious end of the bootstrap interval."""
    train = cut_train(spark, sf_dir)
    log = ledger.decision_log(train, ledger.artifacts(train))
    ci = rounded(m.block_threshold_interval(m.last_rows(train)), "hike_high", "drop_low")
    act = F.col("modeled_action")
    stable = F.when(act == "BUY_NOW", F.col("move") >= F.col("hike_high")).when(
        act == "WAIT", F.col("move") <= F.col("drop_low"))
    return log.join(ci, "series_id").select("series_id", "session", "modeled_action", stable.alias("stable"))


WF = FOLDS + "," + thresholds("wf", "ft", "series_id, fold") + f""",
wfs AS (SELECT fs.series_id, fs.session, fs.y, {DIR} AS dir FROM fs JOIN wf USING (series_id, fold) WHERE fit_error IS NULL),
wfa AS (SELECT series_id, count(*) FILTER (WHERE dir <> 0) AS oos_alerts, count(*) FILTER (WHERE dir*y > 0) AS oos_correct,
  sum(dir*y) AS oos_total, min(session) AS oos_start, max(session) AS oos_end FROM wfs GROUP BY 1)"""


def walk_totals(train):
    rows = ev.scored_rows(ev.fold_rows(train), "fold", m.NOISE_FLOOR)
    return rows.groupBy("series_id").agg(
        count_if(F.col("dir") != 0).alias("oos_alerts"),
        count_if(F.col("dir") * F.col("y") > 0).alias("oos_correct"),
        F.sum(F.col("dir") * F.col("y")).alias("oos_total"),
        F.min("session").alias("oos_start"), F.max("session").alias("oos_end"))


# The tail uses the rounded-free drop threshold of the final fit and all pairs.
@query("calibration_row", with_ctes(TRAIN, THRESH, CI, WF, TAIL, f"""
ins AS (SELECT series_id, count(*) FILTER (WHERE dir <> 0) AS a, count(*) FILTER (WHERE dir*y > 0) AS c, stddev_samp(x) AS sd FROM
  (SELECT series_id, x, y, {DIR} AS dir FROM train JOIN t USING (series_id) WHERE ord > n - 360) GROUP BY 1)""", """
SELECT t.series_id, t.rows, round(slope, 6) AS slope, round(intercept, 6) + 0.0 AS intercept, round(sigma, 6) AS sigma, round(r2, 6) AS r2,
  round(hike, 2) AS hike, round(drop_, 2) AS drop_, round(lean_hike, 2) AS lean_hike, round(lean_drop, 2) AS lean_drop, round(sd, 4) AS daily_std,
  round(hike_low, 4) AS ci_hike_low, round(hike_high, 4) AS ci_hike_high, round(drop_low, 4) AS ci_drop_low, round(drop_high, 4) AS ci_drop_high,
  oos_alerts, round(oos_correct/oos_alerts, 4) AS oos_precision, round(oos_total/oos_alerts, 4) AS oos_mean_savings, round(oos_total, 4) AS oos_total_savings, oos_start, oos_end,
  a AS insample_alerts, round(c/a, 4) AS insample_precision, CASE WHEN wi.lo IS NULL THEN 'insufficient_tail' ELSE 'ok' END AS tail_status,
  round(cvar, 4) AS cvar, round(lo, 4) AS cvar_low, round(hi, 4) AS cvar_high, tail_n, wc.m AS sample_n
FROM t JOIN ci ON ci.series_id = t.series_id JOIN wfa ON wfa.series_id = t.series_id JOIN ins ON ins.series_id = t.series_id
LEFT JOIN wc ON wc.series_id = t.series_id LEFT JOIN wt ON wt.series_id = t.series_id LEFT JOIN wi ON wi.series_id = t.series_id"""))
def calibration_row(spark, sf_dir):
    """Everything one calibration run publishes, one wide row per series."""
    train = cut_train(spark, sf_dir)
    last = m.last_rows(train)
    fits = durable(m.group_thresholds(last, ["series_id"], extra=[
        F.stddev_samp("x").alias("daily_std")]))
    scored = last.join(fits.select("series_id", "hike", "drop_"), "series_id").withColumn(
        "dir", m.signal(F.col("x"), F.col("hike"), F.col("drop_")))
    inside = scored.groupBy("series_id").agg(
        count_if(F.col("dir") != 0).alias("insample_alerts"),
        ratio(count_if(F.col("dir") * F.col("y") > 0),
              count_if(F.col("dir") != 0)).alias("insample_precision"))
    ci = m.block_threshold_interval(last).drop("replicates")
    ci = rounded(ci, *[c for c in ci.columns if c != "series_id"])
    ci = ci.select("series_id", *[F.round(c, 4).alias(f"ci_{c}") for c in ci.columns if c != "series_id"])
    tail = m.tail_risk(train, fits).select(
        "series_id", "cvar", "cvar_low", "cvar_high", F.col("tail_n").cast("long").alias("tail_n"),
        F.col("sample_n").cast("long").alias("sample_n"))
    out = (fits.join(ci, "series_id").join(walk_totals(train), "series_id")
           .join(inside, "series_id").join(tail, "series_id", "left"))
    r4 = lambda c: F.round(c, 4)
    return out.select(
        "series_id", "rows", *[r6(c).alias(c) for c in ("slope", "intercept", "sigma", "r2")],
        *[F.round(c, 2).alias(c) for c in ("hike", "drop_", "lean_hike", "lean_drop")],
        r4("daily_std").alias("daily_std"), "ci_hike_low", "ci_hike_high", "ci_drop_low", "ci_drop_high",
        "oos_alerts", r4(F.col("oos_correct") / F.col("oos_alerts")).alias("oos_precision"),
        r4(F.col("oos_total") / F.col("oos_alerts")).alias("oos_mean_savings"),
        r4("oos_total").alias("oos_total_savings"), "oos_start", "oos_end", "insample_alerts",
        r4("insample_precision").alias("insample_precision"),
        F.when(F.col("cvar").isNull(), "insufficient_tail").otherwise("ok").alias("tail_status"),
        *[r4(c).alias(c) for c in ("cvar", "cvar_low", "cvar_high")], "tail_n", "sample_n")
