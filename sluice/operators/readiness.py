"""Evaluations that answer for every series: the result, or the reason why there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions.exprs import ratio
from sluice.operators import audits, evaluate as ev, fit as m, trial

GRID_ROWS = audits.GRID_TEST * audits.GRID_FOLDS + max(audits.GRID_WINDOWS)


def reported(series: DataFrame, rows: DataFrame, result: DataFrame, needed: int, later: Column | str) -> DataFrame:
    """One row per series with the ``pairs`` it has in ``rows``, those ``needed`` and the columns of ``result``.

    ``reason`` is null where there is a result, ``short_history`` below the needed rows, else ``later``.  All sides hold
    one row per series, so the joins shuffle summaries only.
    """
    later = F.lit(later) if isinstance(later, str) else later
    counts = rows.groupBy("series_id").agg(F.count("*").alias("pairs"))
    out = (series.select("series_id").distinct().join(counts, "series_id", "left").na.fill(0, ["pairs"])
           .join(result.withColumn("_there", F.lit(True)), "series_id", "left").withColumn("needed", F.lit(needed)))
    reason = F.when(F.col("_there"), F.lit(None)).when(F.col("pairs") < needed, "short_history").otherwise(later)
    return out.withColumn("reason", reason).drop("_there")


def walk_forward(series: DataFrame, train: DataFrame) -> DataFrame:
    """Totals over the purged folds of each series; ``no_fold_fitted`` if every fold's fit failed."""
    folds = ev.walk_forward(train).groupBy("series_id").agg(
        F.count("*").alias("folds"), F.sum("alerts").alias("alerts"), F.sum("correct").alias("correct"),
        F.sum("total_savings").alias("total_savings"))
    folds = (folds.withColumn("precision", ratio(F.col("correct"), F.col("alerts")))
             .withColumn("mean_savings", ratio(F.col("total_savings"), F.col("alerts"))))
    return reported(series, train, folds, ev.FOLDS * ev.FOLD_ROWS + ev.PURGE + m.MIN_FIT_ROWS, "no_fold_fitted")


def holdout(series: DataFrame, train: DataFrame) -> DataFrame:
    """The frozen holdout against permutations; ``no_fit`` if the rows before it allow none."""
    return reported(series, train, ev.holdout_permutation(train), ev.HOLDOUT_ROWS + m.MIN_FIT_ROWS, "no_fit")


def threshold_interval(series: DataFrame, train: DataFrame) -> DataFrame:
    """Bootstrap intervals of the thresholds; ``few_replicates`` if too few resamples could be fitted."""
    return reported(series, train, m.block_threshold_interval(m.last_rows(train)), m.MIN_FIT_ROWS, "few_replicates")


def tail_risk(series: DataFrame, train: DataFrame, min_sample: int = 20) -> DataFrame:
    """Tail of the wait signals; ``no_fit``, ``few_waits`` or ``thin_tail`` where it cannot be told.

    ``waits`` counts the wait signals, null without a threshold.
    """
    drops = m.group_thresholds(m.last_rows(train), ["series_id"])
    tail = m.tail_risk(train, drops, min_sample=min_sample)
    waits = (train.join(drops.select("series_id", "drop_"), "series_id").groupBy("series_id").agg(
        F.count(F.when(F.col("x") <= F.col("drop_"), 1)).alias("waits"), F.max("drop_").alias("_drop")))
    known = waits.withColumn("waits", F.when(F.col("_drop").isNotNull(), F.col("waits"))).drop("_drop")
    out = reported(series, train, tail, m.MIN_FIT_ROWS, "thin_tail").join(known, "series_id", "left")
    late = F.when(F.col("waits").isNull(), "no_fit").when(F.col("waits") < min_sample, "few_waits").otherwise("thin_tail")
    return out.withColumn("reason", F.when(F.col("reason") == "thin_tail", late).otherwise(F.col("reason")))


def grid_check(panel: DataFrame, embargo: int = 5) -> DataFrame:
    """The reality check and the best grid point of the embargoed folds, per series.

    The check has no embargo: with enough rows for it but not for the embargoed folds the reason is ``short_history``
    of the latter and the check's columns are filled.
    """
    best = audits.embargoed_folds(panel, embargo).where("best").groupBy("series_id").agg(
        F.min(F.struct("win", "hp", "dp", "median_savings")).alias("b")).select("series_id", "b.*")
    out = reported(panel, panel, best, GRID_ROWS + embargo, "no_fold")
    return out.join(audits.reality_check(panel), "series_id", "left")


def formal_review(forecasts: DataFrame, uncaptured: DataFrame) -> DataFrame:
    """The review of the fixed cohort; ``short_history`` names cohorts that are not full yet."""
    return reported(forecasts, trial.outcomes(forecasts), trial.formal_review(forecasts, uncaptured), trial.REVIEW_PAIRS, "no_interval")
