"""The same questions over many series: one per supplier, and one per line grade.

The panels of the other modules have as many series as there are line statuses.
Here the number of series grows with the suppliers, so windows, fits and
resamples run on groups that spread over a cluster.  Short series stay in the
result with the reason why they have no fit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sluice.functions.calendar import business_calendar
from sluice.functions.exprs import r6
from sluice.operators import align, evaluate as ev, fit as m, quality as ql, report as rp
from sluice.operators.align import one_session_deltas
from sluice.operators.recalibrate import recalibrated
from sluice.plans.align_queries import ADJ, lag_fit_sql
from sluice.plans.ctes import DIR, PAIRS, PANEL, TRAIN, fit, payoff, thresholds
from sluice.plans.fit_queries import CI_SQL, FOLDS, LAST, PAY, TAIL, THRESH, rounded
from sluice.plans.quality_queries import HASHES
from sluice.plans.registry import query, with_ctes
from sluice.plans.report_queries import MK
from sluice.session import durable, shared_folder
from sluice.sources.panel import daily_panel, weekdays

SUPPLIER, GRADE = ("l_suppkey",), ("l_returnflag", "l_linestatus")
_KEY = "l_linestatus AS series_id"


def by_supplier(sql: str) -> str:
    assert _KEY in sql
    return sql.replace(_KEY, "l_suppkey::VARCHAR AS series_id")


def by_grade(sql: str) -> str:
    assert _KEY in sql
    return sql.replace(_KEY, "l_returnflag || '-' || l_linestatus AS series_id")


def panel_by(spark, sf_dir, series):
    return weekdays(daily_panel(spark, sf_dir, series))


def pairs_by(spark, sf_dir, series):
    return one_session_deltas(panel_by(spark, sf_dir, series), business_calendar(spark))


def train_by(spark, sf_dir, series):
    return align.training_pairs(pairs_by(spark, sf_dir, series))


@query("supplier_ols_fit", with_ctes(by_supplier(TRAIN), fit("f", "train", "series_id"), """
SELECT series_id, rows, CASE WHEN rows >= 40 THEN 'fitted' ELSE 'too_few_rows' END AS status, CASE WHEN rows >= 40 THEN round(slope, 6) END AS slope,
  CASE WHEN rows >= 40 THEN round(r2, 6) END AS r2, CASE WHEN rows >= 40 THEN round(sqrt(syy*(1-r2)/(rows-2)), 6) END AS sigma FROM f_f"""))
def supplier_ols_fit(spark, sf_dir):
    g = train_by(spark, sf_dir, SUPPLIER).groupBy("series_id").agg(
        *[c.alias(k) for k, c in m.fit_aggregates(F.col("x"), F.col("y")).items()])
    enough = F.col("rows") >= m.MIN_FIT_ROWS
    g = g.withColumn("sigma", m.sigma())
    return g.select("series_id", "rows", F.when(enough, "fitted").otherwise("too_few_rows").alias("status"),
                    *[F.when(enough, r6(c)).alias(c) for c in ("slope", "r2", "sigma")])


@query("supplier_lag_diag", with_ctes(by_supplier(PAIRS), ADJ, lag_fit_sql("lagf", "adj", "series_id"), """
SELECT series_id, n, round(b0, 6) AS b0, round(b1, 6) + 0.0 AS b1, round(ratio, 6) AS ratio FROM lagf"""))
def supplier_lag_diag(spark, sf_dir):
    d = align.lag_diagnostics(pairs_by(spark, sf_dir, SUPPLIER))
    return d.select("series_id", "n", *[r6(c).alias(c) for c in ("b0", "b1", "ratio")])


@query("supplier_mann_kendall", with_ctes(by_supplier(MK), """
SELECT series_id, n::INT AS n, s, round((s - sign(s))/sqrt(var0), 6) + 0.0 AS z_plain, round(sen_slope, 6) + 0.0 AS sen_slope FROM mz"""))
def supplier_mann_kendall(spark, sf_dir):
    mk = rp.mann_kendall(panel_by(spark, sf_dir, SUPPLIER))
    return rounded(mk, "z_plain", "sen_slope").select("series_id", "n", "s", "z_plain", "sen_slope")


@query("supplier_history_hash", with_ctes(by_supplier(PANEL), HASHES, "SELECT * FROM hh"))
def supplier_history_hash(spark, sf_dir):
    return ql.history_hash(panel_by(spark, sf_dir, SUPPLIER))


@query("supplier_thresholds", with_ctes(by_supplier(TRAIN), thresholds("t", "train", "series_id", LAST), """
SELECT series_id, rows, fit_error, round(hike, 6) AS hike, round(drop_, 6) AS drop_ FROM t"""))
def supplier_thresholds(spark, sf_dir):
    t = m.group_thresholds(m.last_rows(train_by(spark, sf_dir, SUPPLIER)), ["series_id"])
    return rounded(t, "hike", "drop_").select("series_id", "rows", "fit_error", "hike", "drop_")


# The first run knows all sessions but those of the panel's last five days; the second fits the suppliers that have some.
@query("supplier_recalibration", with_ctes(by_supplier(TRAIN), HASHES, thresholds("t", "train", "series_id", LAST), """
SELECT series_id, history_hash, last_session, last_session > (SELECT max(session) FROM wk) - 5 AS refitted, coalesce(t.rows, 0) AS rows,
  CASE WHEN t.rows IS NULL THEN 'too_few_rows' ELSE fit_error END AS fit_error, round(hike, 6) AS hike, round(drop_, 6) AS drop_
FROM (SELECT series_id, history_hash, last_session FROM hh) LEFT JOIN t USING (series_id)"""))
def supplier_recalibration(spark, sf_dir):
    """Two runs over one table of calibrations; most suppliers keep the calibration of the first."""
    cal = business_calendar(spark)

    def calibrate(history):
        train = align.training_pairs(one_session_deltas(history, cal))
        return m.group_thresholds(m.last_rows(train), ["series_id"])

    history = durable(panel_by(spark, sf_dir, SUPPLIER))
    path = f"{shared_folder(spark)}/calibrations-{uuid.uuid4().hex}"
    known = history.crossJoin(F.broadcast(history.agg(F.date_sub(F.max("session"), 5).alias("cut")))).where("session <= cut").drop("cut")
    recalibrated(known, path, calibrate, "thresholds")
    out = recalibrated(history, path, calibrate, "thresholds")
    return rounded(out, "hike", "drop_").select(
        "series_id", "history_hash", "last_session", "refitted", F.coalesce("rows", F.lit(0)).alias("rows"),
        F.when(F.col("rows").isNull(), "too_few_rows").otherwise(F.col("fit_error")).alias("fit_error"), "hike", "drop_")


@query("grade_threshold_ci", with_ctes(by_grade(TRAIN), *CI_SQL))
def grade_threshold_ci(spark, sf_dir):
    ci = m.block_threshold_interval(m.last_rows(train_by(spark, sf_dir, GRADE)))
    return rounded(ci, "hike_low", "hike_high", "drop_low", "drop_high")


@query("grade_tail_risk", with_ctes(by_grade(TRAIN), THRESH, TAIL, """
SELECT series_id, round(cvar, 6) AS cvar, tail_n, m AS sample_n, round(adverse, 6) AS probability_adverse
FROM wc JOIN wt USING (series_id) WHERE tail_n >= 4"""))
def grade_tail_risk(spark, sf_dir):
    train = train_by(spark, sf_dir, GRADE)
    drops = m.group_thresholds(m.last_rows(train), ["series_id"])
    return rounded(m.tail_risk(train, drops), "cvar", "probability_adverse").select(
        "series_id", "cvar", "tail_n", "sample_n", "probability_adverse")


@query("grade_walk_forward", with_ctes(by_grade(TRAIN), FOLDS, thresholds("wt", "ft", "series_id, fold"), f"""
ws AS (SELECT fs.series_id, fs.fold, session, y, hike, drop_, {DIR} AS dir FROM fs JOIN wt USING (series_id, fold)
  WHERE fit_error IS NULL)""", f"""
SELECT series_id, fold::INT AS fold, min(session) AS test_start, max(session) AS test_end, round(max(hike), 6) AS hike,
  round(max(drop_), 6) AS drop_, {payoff()} FROM ws GROUP BY 1, 2"""))
def grade_walk_forward(spark, sf_dir):
    return rounded(ev.walk_forward(train_by(spark, sf_dir, GRADE)), "hike", "drop_", *PAY)
