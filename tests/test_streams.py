"""Streams that are ended and started again: late rows, rolls inside a session, batches that run twice."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException

from sluice.functions.calendar import central_time, session_date
from sluice.operators import ledger
from sluice.sources import records as rec
from sluice.streaming import jobs

SCHEMA = "event_id long, ts timestamp, event_type string, user_id long, value double"
UTC = dt.timezone.utc


def at(day, hour, minute=0):
    """A time of the session clock (noon there is five in the morning in Chicago, six hours behind UTC in January)."""
    return dt.datetime(2026, 1, day, hour, minute, tzinfo=UTC) - dt.timedelta(hours=1)


def deliver(spark, folder, rows):
    """One more file of the input; ``rows`` are (event_id, session clock, price)."""
    spark.createDataFrame([(i, t, "rb", 1, (px - 2) * 500) for i, t, px in rows], SCHEMA).coalesce(1).write.parquet(
        f"{folder}/{len(list(folder.iterdir())) if folder.exists() else 0}")


def run(spark, folder, base, job):
    stream = job(jobs.tick_stream(spark, f"{folder}/*"))
    query = jobs.drained(stream, str(base))
    rows = spark.read.schema(stream.schema).parquet(f"{base}/data").collect()
    return query, sorted(tuple(r) for r in rows)


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    folder, base = tmp_path / "in", tmp_path / "run"
    deliver(spark, folder, [(1, at(5, 10), 2.0), (2, at(5, 11), 2.1)])
    run(spark, folder, base, jobs.stream_bars)
    deliver(spark, folder, [(3, at(5, 13), 2.2), (4, at(6, 20), 2.3)])  # the first session goes on, then the watermark passes it
    _, second = run(spark, folder, base, jobs.stream_bars)
    assert [(r[1].isoformat(), r[2], r[5], r[6]) for r in second] == [("2026-01-05", 2.0, 2.2, 3)]
    deliver(spark, folder, [(5, at(5, 12), 9.9), (6, at(8, 1), 2.4)])  # a row of the closed session, and a new one
    query, third = run(spark, folder, base, jobs.stream_bars)
    assert jobs.late_rows(query) == 1
    assert [(r[1].isoformat(), r[6]) for r in third] == [("2026-01-05", 3), ("2026-01-06", 1)]
    assert run(spark, folder, base, jobs.stream_bars)[1] == third  # nothing new: nothing twice


def swings(spark, rows, tmp_path):
    """Alerts of the batch form of the same rows, as (slot of the session clock, contract, price)."""
    ticks = spark.createDataFrame([(i, t, "rb", 1, (px - 2) * 500) for i, t, px in rows], SCHEMA)
    from pyspark.sql import functions as F
    lt = central_time(F.col("ts").cast("timestamp_ntz"))
    ticks = ticks.select("event_id", F.col("event_type").alias("instrument"), "ts", (2 + F.col("value") / 500).alias("px"),
                         lt.alias("lt"), session_date(lt).alias("session"))
    found = rec.swing_alerts(rec.polls(ticks), rec.bar_context(rec.session_bars(ticks))).collect()
    return sorted((r["session"].isoformat(), r["contract"], round(r["px"], 4)) for r in found)


#: 21 January, 19:00 of the session clock: quotes go over to the February contract.
ROLL = [(1, at(20, 10), 2.0), (2, at(20, 22), 2.0),
        (3, at(21, 10), 2.1), (4, at(21, 12), 2.11),  # an alert at 2.1, then quiet
        (5, at(21, 20), 2.11),  # the new contract starts from the close 2.0 again: an alert
        (6, at(21, 21), 2.12), (7, at(22, 9), 2.12),  # a new session starts from 2.12
        (8, at(22, 10), 2.2), (9, at(26, 10), 2.2)]
ALERTS = [("2026-01-21", "2026-01", 2.1), ("2026-01-21", "2026-02", 2.11), ("2026-01-22", "2026-02", 2.2)]


def test_a_roll_inside_a_session_drops_the_old_reference(spark, tmp_path):
    assert swings(spark, ROLL, tmp_path) == ALERTS


@pytest.mark.parametrize("legs", [[9], [3, 9], [4, 5, 7, 9]])
def test_swing_state_outlives_restarts(spark, tmp_path, legs):
    folder, base, begin = tmp_path / "in", tmp_path / "run", 0
    for end in legs:
        deliver(spark, folder, ROLL[begin:end])
        begin = end
        _, rows = run(spark, folder, base, jobs.stream_swing)
    found = sorted((r[1].isoformat(), r[3], round(r[4], 4)) for r in rows)
    assert found == ALERTS


def test_once_and_activity_run_on(spark, tmp_path):
    folder = tmp_path / "in"
    deliver(spark, folder, [(1, at(5, 10), 2.0), (2, at(5, 10, 20), 2.0), (3, at(5, 15), 2.0)])
    run(spark, folder, tmp_path / "once", jobs.stream_once)
    run(spark, folder, tmp_path / "bursts", jobs.stream_activity)
    deliver(spark, folder, [(4, at(5, 15, 10), 2.0), (5, at(7, 12), 2.0)])
    once = run(spark, folder, tmp_path / "once", jobs.stream_once)[1]
    assert [r[1].isoformat() for r in once] == ["2026-01-05"]
    bursts = run(spark, folder, tmp_path / "bursts", jobs.stream_activity)[1]
    assert [r[3] for r in bursts] == [2, 2]


def test_a_batch_that_runs_again_files_nothing_twice(spark, tmp_path, monkeypatch):
    folder, base, path = tmp_path / "in", str(tmp_path / "run"), str(tmp_path / "ledger")
    bars = lambda: jobs.stream_bars(jobs.tick_stream(spark, f"{folder}/*"))
    deliver(spark, folder, [(1, at(5, 10), 2.0), (2, at(7, 20), 2.1)])
    append = ledger.append_table

    def dies(rows, *args, **kw):
        append(rows, *args, **kw)
        raise RuntimeError("lost after the commit")

    with monkeypatch.context() as m:
        m.setattr(ledger, "append_table", dies)
        with pytest.raises(StreamingQueryException):
            jobs.filed(bars(), path, ["instrument", "session"], base)
    jobs.filed(bars(), path, ["instrument", "session"], base)
    deliver(spark, folder, [(3, at(9, 20), 2.2)])
    jobs.filed(bars(), path, ["instrument", "session"], base)
    rows = ledger.table_at(path, spark.createDataFrame([], bars().schema)).collect()
    assert sorted((r["session"].day, r["ticks"]) for r in rows) == [(5, 1), (7, 1)]
