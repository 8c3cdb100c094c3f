"""Recommendations of execution records come from the one live row; lists of recipients."""

from pyspark.sql import functions as F

from sluice.operators import executions as ex, postings as po
from tests.helpers import day


def test_only_one_live_row_recommends(spark):
    d = [day(f"2001-01-0{i}") for i in range(2, 7)]
    log = spark.createDataFrame(
        [("s", d[0], "HIKE", "live"), ("s", d[0], "DROP", "backfill"), ("s", d[1], "HIKE", "live"), ("s", d[1], "HIKE", "live"),
         ("s", d[2], "DROP", "backfill"), ("s", d[3], None, "live"), ("t", d[0], "FLAT", "live")],
        "series_id string, session date, direction string, prediction_source string")
    records = spark.createDataFrame(
        [(1, "s", d[0], "FLAT"), (2, "s", d[0], "FLAT"), (3, "s", d[1], "HIKE"), (4, "s", d[2], "DROP"), (5, "s", d[3], "HIKE"),
         (6, "t", d[0], None), (7, "s", d[4], None), (8, None, d[0], None), (9, "s", None, "HIKE")],
        "record_id int, series_id string, signal_date date, recommendation string")
    out = ex.with_live_recommendation(records, log).collect()
    assert {r["record_id"]: (r["recommendation"], r["refusal"], r["live_rows"]) for r in out} == {
        1: ("HIKE", None, 1), 2: ("HIKE", None, 1), 3: (None, "several_live_rows", 2), 4: (None, "no_live_row", 0),
        5: (None, "no_direction", 1), 6: ("FLAT", None, 1), 7: (None, "no_live_row", 0), 8: (None, "no_live_row", 0),
        9: (None, "no_live_row", 0)}
    assert len(out) == 9


def test_lists_of_recipients(spark):
    rows = spark.createDataFrame([("anna.smith@a.example, bo@b.example",), (" , 5551234567 ,",), ("abcd",), ("",), (None,), (" , ",)], "v string")
    got = [r[0] for r in rows.select(po.mask_recipients(F.col("v"))).collect()]
    assert got == [["an***h@a.example", "***@b.example"], ["55***67"], ["***"], ["None"], ["None"], []]
