"""Panel and calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.calendar import (
    business_calendar, central_time, contract_symbol, in_calendar, last_trade_dates, product_prefix, session_date, valid_symbol)
from sluice.functions.exprs import count_if, r6
from sluice.operators import calendar_ops as ops
from sluice.plans.ctes import CAL, PANEL
from sluice.plans.registry import query, with_ctes
from sluice.sources.panel import daily_panel, long_panel, read, weekdays, wide_panel


@query("panel_weekday", with_ctes(PANEL, """
SELECT series_id, session, driver, response FROM wk"""))
def panel_weekday(spark, sf_dir):
    return weekdays(daily_panel(spark, sf_dir)).select(
        "series_id", "session", "driver", "response")


@query("panel_dedup", """
SELECT o_orderstatus AS series_id, CAST(o_orderdate AS DATE) AS session,
   min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS price
FROM orders GROUP BY 1, 2""")
def panel_dedup(spark, sf_dir):
    """First order of each (status, day): min_by needs no sort and reduces on
    the map side, so a hot day costs one row per map task."""
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    return rows.groupBy(F.col("o_orderstatus").alias("series_id"),
                        F.to_date("o_orderdate").alias("session")).agg(
        F.min("o_orderkey").alias("o_orderkey"),
        F.min_by("o_totalprice", "o_orderkey").alias("price"))


@query("panel_unpivot", with_ctes(PANEL, """
SELECT series_id, session, driver, response FROM wk"""))
def panel_unpivot(spark, sf_dir):
    long = long_panel(wide_panel(weekdays(daily_panel(spark, sf_dir))))
    return long.select("series_id", "session", "driver", "response")


@query("holidays", with_ctes(CAL, """
SELECT h.d, h.holiday, count(l_orderkey) AS lines, coalesce(sum(round(l_extendedprice*100)::BIGINT), 0)::BIGINT AS cents
FROM hol h JOIN lineitem ON CAST(l_shipdate AS DATE) = h.d GROUP BY 1, 2"""))
def holidays(spark, sf_dir):
    """Lines shipped on a market holiday: reduced per day, then joined to the dim."""
    days = in_calendar(read(spark, sf_dir, "lineitem", "l_extendedprice", "l_shipdate").groupBy(
        F.to_date("l_shipdate").alias("d")).agg(
        F.count("*").alias("lines"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents")), "d")
    cal = business_calendar(spark).where("is_holiday").select("d", "holiday")
    return days.join(F.broadcast(cal), "d").select("d", "holiday", "lines", "cents")


@query("business_days", with_ctes(CAL, """
SELECT year(o_orderdate)::INT AS y, count(*) AS orders, count(*) FILTER (WHERE is_bd) AS business,
   count(*) FILTER (WHERE is_holiday AND dow < 5) AS on_holiday,
   count(*) FILTER (WHERE is_holiday_alt AND dow < 5) AS on_holiday_alt,
   count(*) FILTER (WHERE is_holiday_alt <> is_holiday AND dow < 5) AS rule_conflict
FROM orders JOIN cal ON CAST(o_orderdate AS DATE) = cal.d GROUP BY 1"""))
def business_days(spark, sf_dir):
    per_day = ops.orders_per_day(spark, sf_dir)
    weekday = F.weekday("d") < 5
    n = lambda cond: F.sum(F.when(cond, F.col("orders")).otherwise(0))
    return per_day.join(F.broadcast(business_calendar(spark)), "d").groupBy(
        F.year("d").alias("y")).agg(
        F.sum("orders").alias("orders"), n(F.col("is_bd")).alias("business"),
        n(F.col("is_holiday") & weekday).alias("on_holiday"),
        n(F.col("is_holiday_alt") & weekday).alias("on_holiday_alt"),
        n((F.col("is_holiday_alt") != F.col("is_holiday")) & weekday).alias("rule_conflict"))


@query("prev_next_business", with_ctes(CAL, """
SELECT d, prev_bd, next_bd, (bd_ord - min(bd_ord) OVER ())::BIGINT AS bd_ord, last_bd, orders FROM
 (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS orders FROM orders GROUP BY 1)
 JOIN cal USING (d) JOIN (SELECT month, max(d) FILTER (WHERE is_bd) AS last_bd FROM cal2 GROUP BY month) USING (month)"""))
def prev_next_business(spark, sf_dir):
    cal = business_calendar(spark)
    last = last_trade_dates(cal).select(
        F.add_months("contract_month", -1).alias("month"), F.col("ltd_refined").alias("last_bd"))
    days = ops.orders_per_day(spark, sf_dir).join(F.broadcast(cal), "d").join(F.broadcast(last), "month")
    start = days.agg(F.min("bd_ord").alias("start"))  # one row
    return days.join(F.broadcast(start)).select(
        "d", "prev_bd", "next_bd", (F.col("bd_ord") - F.col("start")).alias("bd_ord"), "last_bd", "orders")


@query("last_trade_dates", with_ctes(CAL, """
SELECT contract_month, ltd_refined, ltd_crude, count(*) AS lines,
   count(*) FILTER (WHERE CAST(l_shipdate AS DATE) <= ltd_refined) AS until_refined,
   count(*) FILTER (WHERE CAST(l_shipdate AS DATE) <= ltd_crude) AS until_crude
FROM lineitem JOIN ltd ON contract_month = (date_trunc('month', l_shipdate) + INTERVAL 1 MONTH)::DATE
GROUP BY 1, 2, 3"""))
def last_trade_dates_q(spark, sf_dir):
    """Lines shipped in the month before delivery, up to each last trade date."""
    per_day = ops.lines_per_day(spark, sf_dir).withColumn(
        "contract_month", F.add_months(F.trunc("d", "MM"), 1))
    ltd = last_trade_dates(business_calendar(spark))
    upto = lambda c: F.sum(F.when(F.col("d") <= F.col(c), F.col("lines")).otherwise(0))
    return (per_day.join(F.broadcast(ltd), "contract_month")
            .groupBy("contract_month", "ltd_refined", "ltd_crude").agg(
        F.sum("lines").alias("lines"), upto("ltd_refined").alias("until_refined"),
        upto("ltd_crude").alias("until_crude")))


@query("front_month", with_ctes(CAL, """
SELECT front_refined, front_crude, count(*) AS days, sum(orders)::BIGINT AS orders, min(d) AS first_day, max(d) AS last_day FROM
 (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS orders FROM orders GROUP BY 1) JOIN cal USING (d) GROUP BY 1, 2"""))
def front_month(spark, sf_dir):
    return (ops.orders_per_day(spark, sf_dir)
            .join(F.broadcast(business_calendar(spark)), "d")
            .groupBy("front_refined", "front_crude").agg(
        F.count("*").alias("days"), F.sum("orders").alias("orders"),
        F.min("d").alias("first_day"), F.max("d").alias("last_day")))


@query("roll_sessions", with_ctes(CAL, PANEL, """
SELECT series_id, session, is_roll, is_roll_crude, front_refined FROM wk JOIN cal ON d = session
WHERE is_roll OR is_roll_crude"""))
def roll_sessions(spark, sf_dir):
    return (in_calendar(weekdays(daily_panel(spark, sf_dir)), "session")
            .join(F.broadcast(business_calendar(spark).withColumnRenamed("d", "session")), "session")
            .where("is_roll OR is_roll_crude")
            .select("series_id", "session", "is_roll", "is_roll_crude", "front_refined"))


SYMBOL_SQL = """'/' || p || substr('FGHJKMNQUVXZ', month(m)::INT, 1) || lpad((year(m) % 100)::VARCHAR, 2, '0')"""


@query("symbols", with_ctes(CAL, """
s AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'RB' ELSE 'HO' END AS p, front_refined AS m, count(*) AS lines
FROM lineitem JOIN cal ON d = CAST(l_shipdate AS DATE) GROUP BY 1, 2)""", f"""
SELECT {SYMBOL_SQL} AS symbol, substr({SYMBOL_SQL}, 2) || '.NYM' AS vendor_symbol,
   p || '_' || substr({SYMBOL_SQL}, 2) AS state_key,
   regexp_matches({SYMBOL_SQL}, '^/(RB|HO)[FGHJKMNQUVXZ][0-9]{{2}}$') AS valid, lines FROM s"""))
def symbols(spark, sf_dir):
    cal = business_calendar(spark).select("d", "front_refined")
    lines = ops.lines_per_day(spark, sf_dir, "l_linestatus").join(F.broadcast(cal), "d")
    prefix = product_prefix(F.col("l_linestatus"))
    sym = lines.where(prefix.isNotNull()).groupBy(prefix.alias("p"), "front_refined").agg(F.sum("lines").alias("lines"))
    sym = sym.withColumn("symbol", contract_symbol(F.col("p"), F.col("front_refined")))
    bare = F.expr("substring(symbol, 2)")
    return sym.select("symbol", F.concat(bare, F.lit(".NYM")).alias("vendor_symbol"),
                      F.concat("p", F.lit("_"), bare).alias("state_key"),
                      valid_symbol(F.col("symbol")).alias("valid"), "lines")


@query("candidate_symbols", with_ctes(CAL, f"""
span AS (SELECT l_linestatus, CASE WHEN l_linestatus = 'F' THEN 'RB' ELSE 'HO' END AS p,
   date_trunc('month', min(l_shipdate)) AS lo, date_trunc('month', max(l_shipdate)) AS hi,
   CAST(max(l_shipdate) AS DATE) AS last_day FROM lineitem GROUP BY 1)""", f"""
SELECT p AS prefix, 'range' AS kind, {SYMBOL_SQL} AS symbol FROM
 (SELECT p, unnest(generate_series(lo - INTERVAL 1 MONTH, hi + INTERVAL 3 MONTH, INTERVAL 1 MONTH)) AS m FROM span)
UNION ALL
SELECT p, 'next', {SYMBOL_SQL} FROM (SELECT p, unnest(generate_series(f, f + INTERVAL 3 MONTH, INTERVAL 1 MONTH)) AS m FROM
 (SELECT p, CASE WHEN last_day >= ltd_refined THEN front_refined + INTERVAL 1 MONTH ELSE front_refined END AS f
  FROM span JOIN cal ON d = last_day JOIN ltd ON contract_month = front_refined))"""))
def candidate_symbols(spark, sf_dir):
    return ops.candidate_symbols(spark, sf_dir)


@query("session_date", """
WITH q AS (SELECT event_type AS instrument, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS lt FROM events)
SELECT instrument, CASE WHEN hour(lt) >= 17 THEN CAST(lt AS DATE) + 1 ELSE CAST(lt AS DATE) END AS session,
   count(*) AS ticks, min(lt) AS first_local, max(lt) AS last_local FROM q GROUP BY 1, 2""")
def session_date_q(spark, sf_dir):
    q = read(spark, sf_dir, "events", "event_type", "ts").select(
        F.col("event_type").alias("instrument"), central_time(F.col("ts")).alias("lt"))
    return q.groupBy("instrument", session_date(F.col("lt")).alias("session")).agg(
        F.count("*").alias("ticks"), F.min("lt").alias("first_local"),
        F.max("lt").alias("last_local"))


@query("local_stamp", """
WITH q AS (SELECT ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS lt FROM events)
SELECT CAST(ts AS DATE) AS header_date, CAST(lt AS DATE) AS local_date, count(*) AS postings,
   count(*) FILTER (WHERE CAST(ts AS DATE) <> CAST(lt AS DATE)) AS shifted FROM q GROUP BY 1, 2""")
def local_stamp(spark, sf_dir):
    """UTC header stamps whose local calendar day is the one before."""
    lt = central_time(F.col("ts"))
    q = read(spark, sf_dir, "events", "ts").select(
        F.to_date("ts").alias("header_date"), F.to_date(lt).alias("local_date"))
    return q.groupBy("header_date", "local_date").agg(
        F.count("*").alias("postings"),
        count_if(F.col("header_date") != F.col("local_date")).alias("shifted"))


@query("time_windows", with_ctes(CAL, """
q AS (SELECT event_type AS instrument, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS lt FROM events),
f AS (SELECT instrument, strftime(lt, '%H%M') AS hm, CAST(lt AS DATE) AS d FROM q)""", """
SELECT instrument, count(*) AS ticks, count(*) FILTER (WHERE hm BETWEEN '1330' AND '1345') AS snapshot_window,
   count(*) FILTER (WHERE hm >= '1435' AND hm < '1600') AS verdict_window,
   count(*) FILTER (WHERE NOT is_holiday AND (dow BETWEEN 0 AND 3 AND NOT (hm >= '1600' AND hm < '1700')
       OR dow = 4 AND hm < '1600' OR dow = 6 AND hm >= '1700')) AS market_open,
   count(*) FILTER (WHERE is_holiday) AS on_holiday
FROM f JOIN cal1 USING (d) GROUP BY 1"""))
def time_windows(spark, sf_dir):
    return ops.time_window_counts(spark, sf_dir)


@query("missing_sessions", with_ctes(CAL, """
have AS (SELECT DISTINCT o_orderstatus AS series_id, CAST(o_orderdate AS DATE) AS d FROM orders
   WHERE substr(md5(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)), 1, 1) <> '0'),
span AS (SELECT series_id, min(d) AS lo, max(d) AS hi FROM have GROUP BY 1)""", """
SELECT series_id, cal.d AS session, cal.d > hi AS appendable FROM span JOIN cal
  ON cal.is_bd AND cal.d >= lo AND cal.d <= hi + 10
WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.series_id = span.series_id AND h.d = cal.d)"""))
def missing_sessions(spark, sf_dir):
    return ops.missing_sessions(spark, sf_dir)


@query("spread_321", """
WITH q AS (SELECT CAST(ts AS DATE) AS session, event_type, last(2 + value/500 ORDER BY ts, event_id) AS px
  FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1, 2),
p AS (SELECT session, max(px) FILTER (WHERE event_type = 'click') AS rb, max(px) FILTER (WHERE event_type = 'view') AS ho,
  max(px) FILTER (WHERE event_type = 'error') AS cl FROM q GROUP BY 1),
s AS (SELECT session, 28*rb + 14*ho - cl AS spread FROM p)
SELECT session, round(spread, 6) AS spread, round(spread - lag(spread) OVER (ORDER BY session), 6) + 0.0 AS change FROM s""")
def spread_321(spark, sf_dir):
    return ops.crack_spread(spark, sf_dir).select(
        "session", r6("spread").alias("spread"), r6("change").alias("change"))
