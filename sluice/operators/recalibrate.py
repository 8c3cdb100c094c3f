"""Calibration of the series whose history changed, and of no others.

A calibration is filed under the fingerprint of the history that it was fitted on, in an insert-only table.  A run
fingerprints all histories, fits those that have no calibration filed under their fingerprint, files these as one commit
and returns what is filed for every series.  So a second run over the same history fits nothing, a run that ended before
its commit is done anew, and a history that is put back finds its old calibration again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from sluice.operators import commits
from sluice.operators.ledger import month_of
from sluice.operators.quality import history_hash
from sluice.session import durable

#: Gives at most one row per series of the history (series_id, session, driver, response) it gets.
Calibration = Callable[[DataFrame], DataFrame]


def recalibrated(history: DataFrame, path: str, calibrate: Calibration, method: str) -> DataFrame:
    """The calibration of every series of ``history``, fitted now only where none is filed at ``path``.

    ``calibrate`` may look at one series at a time only.  ``method`` names it with its parameters: calibrations of another
    method do not count as filed.  Returned are series_id, history_hash, last_session, refitted and the columns of
    ``calibrate``, which are null for a series that it gives no row for; such a series is filed as well, so that it is not
    tried again before its history changes.  Runs may go on side by side: one commits first, the other decides anew.
    A null series id is a series like any other.
    """
    spark = history.sparkSession
    fresh = durable(history_hash(history).select("series_id", "history_hash", "last_session"))
    empty = calibrate(history.where(F.lit(False)))
    found = [c for c in empty.columns if c != "series_id"]
    months = {r["month"] for r in fresh.select(month_of("last_session").alias("month")).distinct().collect()}  # bounded by the calendar

    def filing(series: DataFrame, fits: DataFrame) -> DataFrame:
        same = F.col("s.series_id").eqNullSafe(F.col("f.series_id"))
        return series.alias("s").join(fits.alias("f"), same, "left").select(
            "s.*", F.lit(method).alias("method"), *(F.col(f"f.{c}") for c in found), month_of("s.last_session").alias("month"))

    def unfiled(filed: DataFrame) -> DataFrame:
        known = filed.where(F.col("method") == method).select("series_id", "history_hash")
        same = F.col("s.series_id").eqNullSafe(F.col("k.series_id")) & (F.col("s.history_hash") == F.col("k.history_hash"))
        return fresh.alias("s").join(known.alias("k"), same, "left_anti")

    def decide(filed: DataFrame) -> tuple[DataFrame, DataFrame]:
        stale = durable(unfiled(filed))
        same = F.col("h.series_id").eqNullSafe(F.col("s.series_id"))
        changed = history.alias("h").join(stale.alias("s"), same, "left_semi")
        return filing(stale, calibrate(changed)), stale

    schema = filing(fresh.where(F.lit(False)), empty).schema
    stale = commits.append(spark, path, schema, decide, months).select("series_id", F.lit(True).alias("refitted"))
    filed = commits.latest(spark, path).rows(spark, schema, months).where(F.col("method") == method)
    of_series = F.col("s.series_id").eqNullSafe(F.col("c.series_id")) & (F.col("s.history_hash") == F.col("c.history_hash"))
    was_stale = F.col("s.series_id").eqNullSafe(F.col("n.series_id"))
    return (fresh.alias("s").join(filed.alias("c"), of_series).join(stale.alias("n"), was_stale, "left")
            .select("s.series_id", "s.history_hash", "s.last_session", F.coalesce("n.refitted", F.lit(False)).alias("refitted"),
                    *(F.col(f"c.{c}") for c in found)))
