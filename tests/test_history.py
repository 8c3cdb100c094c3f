"""History rules on every price column and on files as delivered."""

import datetime as dt

from sluice.functions.calendar import business_calendar
from sluice.operators import quality as ql


def rules(spark, *rows):
    raw = spark.createDataFrame([("s", dt.date.fromisoformat(d), x, y, i) for i, (d, x, y) in enumerate(rows)],
                                "series_id string, session date, driver double, response double, line_no int")
    return {(r["session"].isoformat(), r["rule"]) for r in ql.history_violations(raw, business_calendar(spark)).collect()}


def test_jumps_of_either_price_over_missing_lines(spark):
    assert rules(spark, ("2026-01-05", 2.0, 2.1), ("2026-01-06", 2.0, 6.4)) == {("2026-01-06", "response_jump_over_1")}
    assert rules(spark, ("2026-01-05", 2.0, 2.1), ("2026-01-06", 2.0, None), ("2026-01-07", 3.5, 3.2)) == {
        ("2026-01-07", "jump_over_1"), ("2026-01-07", "response_jump_over_1")}
    assert rules(spark, ("2026-01-05", 2.0, 2.1), ("2026-01-06", 3.0, 3.1)) == set()  # a whole dollar is allowed


def found(df):
    return {(r["column"], r["rule"], r["lines"]) for r in df.collect()}


def test_files_as_delivered(spark):
    text = "session string, driver string, response string, extra string"
    rows = [("2026-01-05", "2.0", "2.1", "x"), ("2026-01-06", "two", " N/A ", None), ("6 Jan", None, "1e0", ""), (None, "", "3,1", "")]
    assert found(ql.file_violations(spark.createDataFrame(rows, text), "f")) == {
        ("session", "invalid_date", 1), ("driver", "non_numeric", 1), ("response", "non_numeric", 1)}
    assert found(ql.file_violations(spark.createDataFrame(rows, text).drop("driver"), "f")) == {
        ("driver", "missing_column", None), ("session", "invalid_date", 1), ("response", "non_numeric", 1)}
    assert found(ql.file_violations(spark.createDataFrame([], text), "f")) == {("*", "empty_file", 0)}
    assert found(ql.file_violations(spark.createDataFrame(rows[:1], text), "f")) == set()
