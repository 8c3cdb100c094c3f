"""Quote streams: bars, snapshots, swing alerts, once-only alerts, late outcomes.

All jobs read a folder or glob of parquet files as a stream, keep event time in
the session clock (17:00 central opens the next session) and write to a table.
A posting may arrive until nine the next morning, hence the 15-hour watermark.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from sluice.functions.exprs import tick_order
from sluice.operators import ledger
from sluice.session import shared_folder
from sluice.sources.records import SWING_PCT, traded_contract

WATERMARK = "15 hours"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tick_stream(spark: SparkSession, path: str) -> DataFrame:
    """Ticks with ``st``, the local clock moved so that sessions are days."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).parquet(path)
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/Chicago")
    return raw.select(
        "event_id", F.col("event_type").alias("instrument"), "user_id", "value",
        F.col("ts").cast("timestamp").alias("ts"), (2 + F.col("value") / 500).alias("px"),
        (local + F.expr("INTERVAL 7 HOURS")).alias("st")).withWatermark("st", WATERMARK)


@contextmanager
def _stream_settings(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, and sessions merged before the shuffle, for the queries that start inside."""
    wanted = {STORE: ROCKS, "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def new_base(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, base: str) -> StreamingQuery:
    """Run the input that is there into the table ``base``/data and end.

    What the query knows lies in ``base``/state: started again with the same base, after
    an end or a failure, it goes on where it was and reads only what is new.
    """
    with _stream_settings(stream.sparkSession):
        query = (stream.writeStream.outputMode("append").format("parquet")
                 .option("path", f"{base}/data").option("checkpointLocation", f"{base}/state")
                 .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def run_to_table(stream: DataFrame, base: str | None = None) -> DataFrame:
    """The table of a stream whose available input has run through; a new one without ``base``."""
    base = base or new_base(stream.sparkSession)
    drained(stream, base)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/data")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were left out, in the batches that ``query`` remembers."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def filed(stream: DataFrame, path: str, keys: list[str], base: str, session: str = "session") -> StreamingQuery:
    """Append the rows of a stream to the ledger table at ``path``, each key once.

    A batch is committed under the stream's own name and number, so a batch that runs
    again after a failure, whether it had committed or not, files nothing twice.  Rows
    of other writers count too: a key they have filed is not filed again.
    """
    def file(rows: DataFrame, batch: int) -> None:
        ledger.append_table(rows, path, keys, session, writer=base, batch=batch)

    with _stream_settings(stream.sparkSession):
        query = (stream.writeStream.outputMode("append").foreachBatch(file)
                 .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def stream_bars(ticks: DataFrame) -> DataFrame:
    """Open, high, low, close of each closed session."""
    at = tick_order()
    g = ticks.groupBy("instrument", F.window("st", "1 day").alias("w")).agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", at).alias("close"), F.count("*").alias("ticks"))
    return g.select("instrument", F.to_date("w.start").alias("session"), "open", "high", "low", "close", "ticks")


def stream_snapshots(ticks: DataFrame) -> DataFrame:
    """First quote inside 13:30-13:45 of each session, once."""
    clock = F.date_format(F.col("st") - F.expr("INTERVAL 7 HOURS"), "HHmm")
    g = ticks.where(clock.between("1330", "1345")).groupBy("instrument", F.window("st", "1 day").alias("w")).agg(
        F.min_by(F.struct("px", "ts"), tick_order()).alias("s"))
    return g.select("instrument", F.to_date("w.start").alias("session"), F.col("s.px").alias("px"), F.col("s.ts").alias("ts"))


def stream_once(ticks: DataFrame) -> DataFrame:
    """One alert per instrument and session however often it fires.

    Ticks become polls and polls alerts in one query: at most 288 rows per instrument
    and session reach the second state, however many ticks there were.
    """
    keyed = stream_polls(ticks).select("instrument", "session", "closed")
    return keyed.dropDuplicatesWithinWatermark(["instrument", "session"]).select("instrument", "session")


def stream_rate(ticks: DataFrame) -> DataFrame:
    """Ticks per instrument over the last seven days, sliding daily.

    Ticks are counted per day first; only day counts are copied into windows.
    """
    days = ticks.groupBy("instrument", F.window("st", "1 day").alias("d")).agg(F.count("*").alias("n"))
    g = days.groupBy("instrument", F.window(F.window_time("d"), "7 days", "1 day").alias("w")).agg(
        F.sum("n").alias("alerts"))
    return g.select("instrument", F.to_date("w.start").alias("first_day"), "alerts")


def stream_late_outcomes(ticks: DataFrame) -> DataFrame:
    """Decisions joined to postings of the same user and session, late or not.

    Both sides are reduced to one row per user and session first, so a busy
    user cannot multiply rows; a decision without a posting stays pending.
    """
    side = lambda kind, name: (
        ticks.where(F.col("instrument") == kind).groupBy("user_id", F.window("st", "1 day").alias("w"))
        .agg(F.count("*").alias(name)))
    joined = side("click", "decisions").join(side("purchase", "postings"), ["user_id", "w"], "left_outer")
    return joined.select("user_id", F.to_date("w.start").alias("session"), "decisions", "postings",
                         F.when(F.col("postings").isNull(), "PENDING").otherwise("RESOLVED").alias("status"))


SWING_OUT = "instrument string, session date, slot timestamp, contract string, px double, swing double"


class Swings(StatefulProcessor):
    """Alerts of one instrument, poll by poll.

    ``alert`` is the last alert: its session, contract and price; it is the reference for
    polls of that session and contract alone, all others start from ``base``, the last
    price of the session before (the open in the first of all).  A timer at the end of
    the session clears it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alert = handle.getValueState("alert", "session date, contract string, px double")
        self.base = handle.getValueState("base", "session date, base double, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        polls = pd.concat(list(rows)).sort_values("slot")
        of, at, ref = self.alert.get() if self.alert.exists() else (None, None, None)
        session, base, last = self.base.get() if self.base.exists() else (None, None, None)
        out, days = [], set()
        for day, slot, contract, first, px in zip(*(polls[c] for c in ("session", "slot", "contract", "first_px", "px"))):
            if day != session:
                session, base = day, first if last is None else last
            reference = ref if (of, at) == (day, contract) else base
            swing = (px - reference) / reference * 100
            if abs(swing) >= SWING_PCT:
                out.append((key[0], day, slot, contract, px, swing))
                of, at, ref = day, contract, round(px, 4)
                days.add(day)
            last = px
        self.base.update((session, float(base), float(last)))
        if days:
            self.alert.update((of, at, float(ref)))
        for day in days:
            self.handle.registerTimer(_session_end(day))
        yield pd.DataFrame(out, columns=["instrument", "session", "slot", "contract", "px", "swing"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.alert.exists() and _session_end(self.alert.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.alert.clear()  # an alert of a later session stays
        yield pd.DataFrame(columns=["instrument", "session", "slot", "contract", "px", "swing"])

    def close(self) -> None:
        pass


def _session_end(day: dt.date) -> int:
    """Milliseconds of the session clock at the end of a session."""
    end = dt.datetime.combine(day, dt.time(), dt.timezone.utc) + dt.timedelta(days=1)
    return int(end.timestamp() * 1000)


def stream_polls(ticks: DataFrame) -> DataFrame:
    """First and last quote of each closed five-minute slot; at most 288 per session.

    ``closed`` is the event time that states further down the query go by.
    """
    slots = ticks.groupBy("instrument", F.window("st", "5 minutes").alias("w")).agg(
        F.min_by("px", tick_order()).alias("first_px"), F.max_by("px", tick_order()).alias("px"))
    return slots.select("instrument", F.to_date("w.start").alias("session"), F.col("w.start").alias("slot"),
                        "first_px", "px", F.window_time("w").alias("closed"))


def stream_swing(ticks: DataFrame) -> DataFrame:
    """Swing alerts of the polls, in one query with the polls themselves."""
    polls = stream_polls(ticks).withColumn("contract", traded_contract(F.col("slot")))
    return polls.groupBy("instrument").transformWithStateInPandas(
        statefulProcessor=Swings(), outputStructType=SWING_OUT, outputMode="Append", timeMode="EventTime")


def stream_activity(ticks: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Ticks coalesced into activity sessions separated by silence, merged in each task before the shuffle."""
    g = ticks.groupBy("instrument", F.session_window("st", f"{gap_minutes} minutes").alias("w")).agg(F.count("*").alias("ticks"))
    return g.select("instrument", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "ticks")
