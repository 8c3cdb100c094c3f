"""Daily driver/response panel derived from the raw line table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def daily_panel(spark: SparkSession, sf_dir: str,
                series: Sequence[str] = ("l_linestatus",)) -> DataFrame:
    """(series_id, session, driver, response), one row per series and day.

    The means are taken over whole cents, so the sums are exact and do not
    depend on how partial aggregates are merged.  The map side reduces any
    number of lines to one row per series and day before the only shuffle;
    afterwards a series can never hold more rows than there are days.
    """
    lines = read(spark, sf_dir, "lineitem", *series,
                 "l_extendedprice", "l_discount", "l_shipdate")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    kept = 100 - F.round(F.col("l_discount") * 100).cast("long")
    key = F.col(series[0]).cast("string") if len(series) == 1 else F.concat_ws("-", *series)
    sums = lines.groupBy(key.alias("series_id"), F.to_date("l_shipdate").alias("session")).agg(
        F.sum(cents).alias("s1"), F.sum(cents * kept).alias("s2"), F.count("*").alias("lines"))
    n = F.col("lines").cast("double")
    return sums.select(
        "series_id", "session",
        (2.0 + F.col("s1").cast("double") / (n * 1e7)).alias("driver"),
        (2.0 + F.col("s2").cast("double") / (n * 1e9)).alias("response"))


def weekdays(rows: DataFrame, day: str = "session") -> DataFrame:
    """Monday to Friday only.  Must come before any ``lag``: a weekend row left
    in would split one session's move in two."""
    return rows.where(F.weekday(day) < 5)


def wide_panel(panel: DataFrame) -> DataFrame:
    """One row per session with the prices of every series in a map by its id."""
    prices = F.struct("driver", "response")
    return panel.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("series_id", prices))).alias("prices"))


def long_panel(wide: DataFrame) -> DataFrame:
    """Unpivot of :func:`wide_panel`, rows with neither price dropped."""
    rows = wide.select("session", F.explode("prices").alias("series_id", "p"))
    return rows.select("series_id", "session", "p.driver", "p.response").where("driver IS NOT NULL OR response IS NOT NULL")
