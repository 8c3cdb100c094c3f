"""Operators that place table rows on the business and contract calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sluice.functions.calendar import (
    business_calendar, central_time, contract_symbol, in_calendar, last_trade_dates, product_prefix)
from sluice.functions.exprs import tick_order
from sluice.sources.panel import read


def orders_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders reduced to one row per day before any calendar join."""
    return in_calendar(read(spark, sf_dir, "orders", "o_orderdate").groupBy(
        F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("orders")), "d")


def lines_per_day(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return in_calendar(read(spark, sf_dir, "lineitem", "l_shipdate", *keys).groupBy(
        *keys, F.to_date("l_shipdate").alias("d")).agg(F.count("*").alias("lines")), "d")


def candidate_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols a series may have quoted: whole range, and the next four months.

    Series that are no product have none.
    """
    span = read(spark, sf_dir, "lineitem", "l_linestatus", "l_shipdate").groupBy(
        "l_linestatus").agg(F.to_date(F.min("l_shipdate")).alias("lo"),
                            F.to_date(F.max("l_shipdate")).alias("d"))
    cal = business_calendar(spark)
    ltd = last_trade_dates(cal).select(F.col("contract_month").alias("front_refined"), "ltd_refined")
    span = (span.withColumn("prefix", product_prefix(F.col("l_linestatus"))).where("prefix IS NOT NULL")
            .join(F.broadcast(cal.select("d", "front_refined")), "d")
            .join(F.broadcast(ltd), "front_refined"))
    # A contract whose last trade date has come is left for the next one.
    first = F.when(F.col("d") >= F.col("ltd_refined"),
                   F.add_months("front_refined", 1)).otherwise(F.col("front_refined"))
    months = lambda a, b: F.explode(F.sequence(a, b, F.expr("INTERVAL 1 MONTH"))).alias("m")
    ranged = span.select("prefix", F.lit("range").alias("kind"), months(
        F.add_months(F.trunc("lo", "MM"), -1), F.add_months(F.trunc("d", "MM"), 3)))
    ahead = span.select("prefix", F.lit("next").alias("kind"), months(first, F.add_months(first, 3)))
    return ranged.unionByName(ahead).select(
        "prefix", "kind", contract_symbol(F.col("prefix"), F.col("m")).alias("symbol"))


def time_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks per instrument inside the snapshot, verdict and market windows.

    Ticks are first counted per (instrument, local minute); the calendar join
    then sees at most 1,440 rows per instrument and day.
    """
    lt = central_time(F.col("ts"))
    minutes = read(spark, sf_dir, "events", "event_type", "ts").groupBy(
        F.col("event_type").alias("instrument"), F.to_date(lt).alias("d"),
        F.date_format(lt, "HHmm").alias("hm")).agg(F.count("*").alias("ticks"))
    cal = business_calendar(spark).select("d", "is_holiday")
    hm, dow = F.col("hm"), F.weekday("d")
    is_open = ~F.col("is_holiday") & (
        (dow.between(0, 3) & ~((hm >= "1600") & (hm < "1700")))
        | ((dow == 4) & (hm < "1600")) | ((dow == 6) & (hm >= "1700")))
    n = lambda cond: F.sum(F.when(cond, F.col("ticks")).otherwise(0))
    return in_calendar(minutes, "d").join(F.broadcast(cal), "d").groupBy("instrument").agg(
        F.sum("ticks").alias("ticks"),
        n(hm.between("1330", "1345")).alias("snapshot_window"),
        n((hm >= "1435") & (hm < "1600")).alias("verdict_window"),
        n(is_open).alias("market_open"), n(F.col("is_holiday")).alias("on_holiday"))


def missing_sessions(spark: SparkSession, sf_dir: str, grace: int = 10) -> DataFrame:
    """Business days a series lacks; only days after its newest may be appended."""
    day = F.to_date("o_orderdate")
    have = (read(spark, sf_dir, "orders", "o_orderstatus", "o_orderdate")
            .where(F.substring(F.md5(day.cast("string").cast("binary")), 1, 1) != "0")
            .select(F.col("o_orderstatus").alias("series_id"), day.alias("session")).distinct())
    span = have.groupBy("series_id").agg(F.min("session").alias("lo"), F.max("session").alias("hi"))
    want = span.select("series_id", "hi", F.explode(F.sequence(
        "lo", F.date_add("hi", grace))).alias("session"))
    days = business_calendar(spark).where("is_bd").select(F.col("d").alias("session"))
    return (in_calendar(want, "session").join(F.broadcast(days), "session")
            .join(have, ["series_id", "session"], "left_anti")
            .select("series_id", "session", (F.col("session") > F.col("hi")).alias("appendable")))


def crack_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3:2:1 spread of the last daily quotes and its change on the day before."""
    last = F.max_by("px", tick_order())
    px = read(spark, sf_dir, "events", "event_id", "ts", "event_type", "value").withColumn(
        "px", 2 + F.col("value") / 500)
    daily = px.where(F.col("event_type").isin("click", "view", "error")).groupBy(
        F.to_date("ts").alias("session"), "event_type").agg(last.alias("px"))
    leg = lambda t: F.max(F.when(F.col("event_type") == t, F.col("px")))
    spread = daily.groupBy("session").agg(
        (28 * leg("click") + 14 * leg("view") - leg("error")).alias("spread"))
    # One row per calendar day is left, so one ordering task is enough.
    return spread.withColumn("change", F.col("spread") - F.lag("spread").over(
        Window.orderBy("session")))
