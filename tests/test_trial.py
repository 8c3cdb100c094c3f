"""Eligibility by what was known at the capture."""

import datetime as dt

from pyspark.sql import functions as F

from sluice.operators import trial as tr

DAY = dt.date(2026, 3, 4)
PRIOR = dt.date(2026, 3, 3)


def stamp(day, hour, minute=0):
    return dt.datetime(day.year, day.month, day.day, hour, minute)


BASE = {"series_id": "s", "session": DAY, "prior_session": PRIOR, "prediction_source": "live", "baseline_source": "history_same_contract",
        "settlement_source": "exchange_snapshot", "verdict_ts": stamp(DAY, 14, 40), "captured_at": stamp(DAY, 14, 45),
        "snapshot_at": stamp(DAY, 13, 35), "recorded_baseline": 2.5, "logged_config": "c", "runtime_config": "c"}
RECORDED = [(PRIOR, 2.5, stamp(DAY, 7))]


def reason(spark, logs=({},), history=RECORDED, pairs=600):
    log = spark.createDataFrame([{**BASE, **x} for x in logs], ", ".join(
        f"{k} {'date' if k.endswith('session') else 'timestamp_ntz' if k.endswith(('_ts', '_at')) else 'double' if k == 'recorded_baseline' else 'string'}" for k in BASE))
    train = spark.range(1, pairs + 2).select(F.lit("s").alias("series_id"), F.col("id").cast("int").alias("ord"),
                                             F.date_add(F.lit(DAY), (F.col("id") - pairs - 1).cast("int")).alias("session"))
    hist = spark.createDataFrame([("s", d, x, t) for d, x, t in history], "series_id string, session date, driver double, recorded_at timestamp_ntz")
    rows = tr.inputs(log, train, hist).collect()
    assert len(rows) <= 1
    return rows[0]["reason"] if rows else "no row"


def test_every_reason_in_order(spark):
    assert reason(spark) is None
    assert reason(spark, [{"prediction_source": "backfill"}]) == "no_unique_live_row"
    assert reason(spark, [{}, {}]) == "no_unique_live_row"
    assert reason(spark, [{}, {"prediction_source": "backfill"}]) is None
    for wrong in ({"baseline_source": "exchange_close"}, {"settlement_source": None}, {"verdict_ts": stamp(DAY, 14, 30)},
                  {"snapshot_at": stamp(DAY, 13, 46)}, {"snapshot_at": stamp(PRIOR, 13, 35)}, {"snapshot_at": None},
                  {"verdict_ts": stamp(DAY, 14, 46)}):
        assert reason(spark, [wrong]) == "not_same_contract_verdict", wrong
    assert reason(spark, [{"captured_at": stamp(DAY, 16, 0)}]) == "no row"
    assert reason(spark, history=[]) == "prior_posting_missing"
    assert reason(spark, [{"recorded_baseline": 2.5001}]) == "baseline_differs"
    assert reason(spark, pairs=481) == "insufficient_history"
    assert reason(spark, [{"runtime_config": "d"}]) == "config_changed"


def test_history_as_it_was_known(spark):
    late = stamp(DAY, 15)
    assert reason(spark, history=[*RECORDED, (DAY, 2.6, stamp(DAY, 14))]) == "outcome_on_file"
    assert reason(spark, history=[*RECORDED, (DAY + dt.timedelta(3), 2.6, stamp(DAY, 14))]) == "outcome_on_file"
    assert reason(spark, history=[*RECORDED, (DAY, 2.6, late)]) is None
    assert reason(spark, history=[(PRIOR, 2.5, late)]) == "prior_posting_missing"
    # A correction counts from when it was recorded.
    assert reason(spark, history=[(PRIOR, 2.4, stamp(DAY, 6)), *RECORDED]) is None
    assert reason(spark, history=[*RECORDED, (PRIOR, 2.4, stamp(DAY, 8))]) == "baseline_differs"
    assert reason(spark, history=[*RECORDED, (PRIOR, 2.4, late)]) is None
