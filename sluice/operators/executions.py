"""What an execution record takes from the decision log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def live_directions(log: DataFrame) -> DataFrame:
    """(series_id, session, live_rows, direction) of the live rows; ``direction`` only where there is exactly one."""
    live = log.where("prediction_source = 'live'").groupBy("series_id", "session").agg(
        F.count("*").alias("live_rows"), F.min("direction").alias("direction"))
    return live.withColumn("direction", F.when(F.col("live_rows") == 1, F.col("direction")))


def with_live_recommendation(records: DataFrame, log: DataFrame) -> DataFrame:
    """Records with the ``recommendation`` of the one live row of their series and day.

    Records without a live row, with several, or whose row names no direction keep none and say so in ``refusal``; a stated
    recommendation is never taken over.  The log is reduced to one row per series and day before the join, so a
    record is never repeated.
    """
    live = live_directions(log).withColumnRenamed("session", "signal_date")
    out = records.drop("recommendation", "live_rows").join(live, ["series_id", "signal_date"], "left")
    refusal = (F.when(F.col("live_rows").isNull(), "no_live_row").when(F.col("live_rows") > 1, "several_live_rows")
               .when(F.col("direction").isNull(), "no_direction"))
    return out.withColumn("refusal", refusal).na.fill(0, ["live_rows"]).withColumnRenamed("direction", "recommendation")
