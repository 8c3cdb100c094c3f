"""Streams over the whole event table, compared on closed windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.exprs import r6
from sluice.operators import ledger
from sluice.plans.registry import query, with_ctes
from sluice.streaming import jobs

TS = """
tk AS (SELECT event_id, event_type AS instrument, user_id, ts, 2 + value/500 AS px, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' + INTERVAL 7 HOUR AS st FROM events),
wm AS (SELECT max(st) - INTERVAL 15 HOUR AS wm FROM tk)"""


def ticks(spark, sf_dir):
    return jobs.tick_stream(spark, f"{sf_dir}/events*.parquet")


@query("stream_ohlc", with_ctes(TS, """
SELECT instrument, CAST(st AS DATE) AS session, first(px ORDER BY ts, event_id) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY ts, event_id) AS close, count(*) AS ticks
FROM tk, wm WHERE CAST(st AS DATE) + INTERVAL 1 DAY <= wm GROUP BY 1, 2"""))
def stream_ohlc(spark, sf_dir):
    return jobs.run_to_table(jobs.stream_bars(ticks(spark, sf_dir)))


@query("stream_ledger", with_ctes(TS, """
SELECT instrument, CAST(st AS DATE) AS session, first(px ORDER BY ts, event_id) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY ts, event_id) AS close, count(*) AS ticks
FROM tk, wm WHERE CAST(st AS DATE) + INTERVAL 1 DAY <= wm GROUP BY 1, 2"""))
def stream_ledger(spark, sf_dir):
    """Session bars filed by one stream in three legs, as its input grows, and then delivered again in one batch."""
    events = spark.read.parquet(f"{sf_dir}/events*.parquet")
    low, high = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [0.3, 0.6])).first()[0]
    leg = F.when(F.unix_micros(F.col("ts").cast("timestamp")) < low, 0).when(F.unix_micros(F.col("ts").cast("timestamp")) < high, 1).otherwise(2)
    base, keys = jobs.new_base(spark), ["instrument", "session"]
    for k in range(3):
        events.where(leg == k).write.parquet(f"{base}/in/{k}")
        bars = jobs.stream_bars(jobs.tick_stream(spark, f"{base}/in/*"))
        jobs.filed(bars, f"{base}/bars", keys, base)
    again = jobs.run_to_table(jobs.stream_bars(ticks(spark, sf_dir)))
    ledger.append_table(again, f"{base}/bars", keys)
    return ledger.table_at(f"{base}/bars", again)


@query("stream_snapshot", with_ctes(TS, """
SELECT instrument, CAST(st AS DATE) AS session, first(px ORDER BY ts, event_id) AS px
FROM tk, wm WHERE strftime(st - INTERVAL 7 HOUR, '%H%M') BETWEEN '1330' AND '1345' AND CAST(st AS DATE) + INTERVAL 1 DAY <= wm GROUP BY 1, 2"""))
def stream_snapshot(spark, sf_dir):
    return jobs.run_to_table(jobs.stream_snapshots(ticks(spark, sf_dir))).drop("ts")


@query("stream_swing", with_ctes(TS, """
po AS (SELECT instrument, CAST(st AS DATE) AS session, time_bucket(INTERVAL 5 MINUTE, st) AS slot, strftime(time_bucket(INTERVAL 5 MINUTE, st) + INTERVAL 10 DAY + INTERVAL 5 HOUR, '%Y-%m') AS contract, last(px ORDER BY ts, event_id) AS px FROM tk, wm
  WHERE time_bucket(INTERVAL 5 MINUTE, st) + INTERVAL 5 MINUTE <= wm GROUP BY 1, 2, 3, 4),
pi AS (SELECT *, row_number() OVER (PARTITION BY instrument, session ORDER BY slot) AS i FROM po),
br AS (SELECT instrument, session, coalesce(lag(close) OVER (PARTITION BY instrument ORDER BY session), open) AS base FROM (
  SELECT instrument, CAST(st AS DATE) AS session, first(px ORDER BY ts, event_id) AS open, last(px ORDER BY ts, event_id) AS close
  FROM tk, wm WHERE time_bucket(INTERVAL 5 MINUTE, st) + INTERVAL 5 MINUTE <= wm GROUP BY 1, 2)),
sw AS (SELECT pi.*, base, (px - base)/base*100 AS swing, NULL::DOUBLE AS ap, '' AS ac FROM pi JOIN br ON br.instrument = pi.instrument AND br.session = pi.session WHERE i = 1
  UNION ALL SELECT instrument, session, slot, contract, px, i, base, (px - ref)/ref*100, ap, ac FROM (
   SELECT p.*, r.base, r.ap, r.ac, CASE WHEN r.ac = p.contract THEN r.ap ELSE r.base END AS ref FROM
    (SELECT instrument, session, i, base, CASE WHEN abs(swing) >= 1.5 THEN round(px, 4) ELSE ap END AS ap, CASE WHEN abs(swing) >= 1.5 THEN contract ELSE ac END AS ac FROM sw) r
    JOIN pi p ON p.instrument = r.instrument AND p.session = r.session AND p.i = r.i + 1))""", """
SELECT instrument, session, slot, contract, px, round(swing, 6) AS swing FROM sw WHERE abs(swing) >= 1.5"""))
def stream_swing(spark, sf_dir):
    return jobs.run_to_table(jobs.stream_swing(ticks(spark, sf_dir))).withColumn("swing", r6("swing"))


@query("stream_once", with_ctes(TS, """
SELECT DISTINCT instrument, CAST(st AS DATE) AS session FROM tk, wm WHERE time_bucket(INTERVAL 5 MINUTE, st) + INTERVAL 5 MINUTE <= wm"""))
def stream_once(spark, sf_dir):
    return jobs.run_to_table(jobs.stream_once(ticks(spark, sf_dir)))


# Join results leave one batch later than the windows they join, so the last
# sessions are left open on both sides.
@query("stream_late_join", with_ctes(TS, """
c AS (SELECT user_id, CAST(st AS DATE) AS session, count(*) AS decisions FROM tk WHERE instrument = 'click' GROUP BY 1, 2),
p AS (SELECT user_id, CAST(st AS DATE) AS session, count(*) AS postings FROM tk WHERE instrument = 'purchase' GROUP BY 1, 2)""", """
SELECT user_id, session, decisions, postings, CASE WHEN postings IS NULL THEN 'PENDING' ELSE 'RESOLVED' END AS status
FROM c LEFT JOIN p USING (user_id, session), wm WHERE session + INTERVAL 1 DAY <= wm"""))
def stream_late_join(spark, sf_dir):
    return jobs.run_to_table(jobs.stream_late_outcomes(ticks(spark, sf_dir)))


@query("stream_rate", with_ctes(TS, """
SELECT instrument, CAST(CAST(st AS DATE) - k::INT AS DATE) AS first_day, count(*) AS alerts FROM tk, wm, range(7) r(k) WHERE CAST(st AS DATE) - k::INT + INTERVAL 7 DAY <= wm GROUP BY 1, 2"""))
def stream_rate(spark, sf_dir):
    return jobs.run_to_table(jobs.stream_rate(ticks(spark, sf_dir)))


@query("stream_activity", with_ctes(TS, """
g AS (SELECT *, st - lag(st) OVER w > INTERVAL 30 MINUTE AS cut FROM tk WINDOW w AS (PARTITION BY instrument ORDER BY st)),
s AS (SELECT *, sum(coalesce(cut, false)::INT) OVER (PARTITION BY instrument ORDER BY st) AS k FROM g),
a AS (SELECT instrument, k, min(st) AS start, max(st) + INTERVAL 30 MINUTE AS e, count(*) AS ticks FROM s GROUP BY 1, 2)""", """
SELECT instrument, CAST(start AS DATE) AS session, count(*) AS bursts, sum(ticks)::BIGINT AS ticks FROM a, wm WHERE e <= wm GROUP BY 1, 2"""))
def stream_activity(spark, sf_dir):
    """Closed bursts per session: those whose silence the watermark has passed."""
    rows = jobs.run_to_table(jobs.stream_activity(ticks(spark, sf_dir)))
    return rows.groupBy("instrument", F.to_date("start").alias("session")).agg(
        F.count("*").alias("bursts"), F.sum("ticks").alias("ticks"))
