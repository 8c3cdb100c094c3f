import pytest
from pyspark.sql import functions as F

from sluice.functions.calendar import business_calendar
from sluice.operators import align
from sluice.sources.panel import long_panel, weekdays, wide_panel
from tests.helpers import panel, synthetic


def deltas(spark, rows):
    out = align.one_session_deltas(weekdays(panel(spark, rows)), business_calendar(spark))
    return [(r["session"].isoformat(), round(r["x"], 6), r["session_gap"]) for r in out.orderBy("session").collect()]


def test_null_session_kills_both_pairs(spark):
    got = deltas(spark, [("A", "2026-05-15", 2.0, 2.0), ("A", "2026-05-18", None, 2.1),
                         ("A", "2026-05-19", 2.10, 2.2), ("A", "2026-05-20", 2.15, 2.3)])
    assert got == [("2026-05-20", 5.0, 1)]


def test_weekend_is_one_session_and_saturday_rows_do_not_split_it(spark):
    got = deltas(spark, [("A", "2026-05-15", 2.0, 2.0), ("A", "2026-05-16", 9.0, 9.0),
                         ("A", "2026-05-18", 2.10, 2.2), ("A", "2026-05-19", 2.05, 2.1)])
    assert got == [("2026-05-18", 10.0, 3), ("2026-05-19", -5.0, 1)]


def test_week_classes(spark):
    rows = [("A", d, 2.0, 2.0) for d in (
        "2026-03-03", "2026-03-04", "2026-03-05", "2026-03-06", "2026-03-07",   # Tue-Sat
        "2026-03-09", "2026-03-10", "2026-03-13",                                # Mon-Fri
        "2026-03-16", "2026-03-21",                                              # Mon + Sat
        "2026-02-25", "2026-03-25")]                                             # neither
    got = {r["week"].isoformat(): r["kind"] for r in align.week_classes(panel(spark, rows)).collect()}
    assert got == {"2026-03-02": "legacy", "2026-03-09": "live", "2026-03-16": "interleaved",
                   "2026-02-23": "legacy", "2026-03-23": "ambiguous"}


@pytest.mark.parametrize("lag,aligned", [(0, True), (1, False)])
def test_lag_diagnostics_tell_a_shifted_series(spark, lag, aligned):
    frame = synthetic(spark, 400, lag=lag)
    pairs = align.one_session_deltas(frame, business_calendar(spark))
    row = align.alignment_gate(frame, business_calendar(spark)).first()
    assert row["aligned"] is aligned
    diag = align.lag_diagnostics(pairs).first()
    assert (abs(diag["b1"]) > abs(diag["b0"])) is (lag == 1)


def test_too_few_pairs_are_not_aligned(spark):
    frame = synthetic(spark, 20)
    assert align.alignment_gate(frame, business_calendar(spark)).first()["aligned"] is False


def test_era_scan_last_suffix_equals_direct_fit(spark):
    frame = synthetic(spark, 300)
    pairs = align.one_session_deltas(frame, business_calendar(spark))
    scan = align.era_scan(pairs, frame).orderBy("start").collect()
    whole = align.lag_diagnostics(pairs).first()
    assert scan[0]["n"] == whole["n"] and scan[0]["b0"] == pytest.approx(whole["b0"], abs=1e-9)
    cut = scan[3]["start"]
    part = align.one_session_deltas(frame.where(F.col("session") >= F.lit(cut)), business_calendar(spark))
    direct = align.lag_diagnostics(part).first()
    assert scan[3]["n"] == direct["n"] and scan[3]["b1"] == pytest.approx(direct["b1"], abs=1e-9)


@pytest.mark.parametrize("start", ["1985-03-04", "2035-03-05"])
def test_no_session_is_lost_outside_the_present(spark, start):
    frame = synthetic(spark, 60, start=start)
    assert align.one_session_deltas(frame, business_calendar(spark)).count() == 59


def test_a_session_without_a_calendar_day_is_an_error(spark):
    rows = [("A", "2101-01-03", 2.0, 2.0), ("A", "2101-01-04", 2.0, 2.0)]
    with pytest.raises(Exception, match="no calendar day for 2101-01-0"):
        align.one_session_deltas(panel(spark, rows), business_calendar(spark)).collect()


def test_wide_panel_keeps_every_series(spark):
    rows = [(s, d, p, q) for s, p, q in (("F", 1.0, 2.0), ("O", 3.0, None), ("third", None, None), ("4", 5.0, 6.0))
            for d in ("2026-05-18", "2026-05-19")]
    frame = panel(spark, rows)
    back = long_panel(wide_panel(frame))
    want = [tuple(r) for r in frame.where("driver IS NOT NULL OR response IS NOT NULL").orderBy("series_id", "session").collect()]
    assert [tuple(r) for r in back.orderBy("series_id", "session").collect()] == want


def test_era_scan_holds_every_series_to_every_month(spark):
    """A series without pairs in a month is judged there by its later months."""
    good = synthetic(spark, 300, start="2010-01-04", series="GOOD")
    bad = synthetic(spark, 300, start="2010-01-04", lag=1, series="BAD").where("month(session) <> 5")
    frame = good.unionByName(bad)
    scan = align.era_scan(align.one_session_deltas(frame, business_calendar(spark)), frame)
    rows = {(r["series_id"], r["start"].isoformat()): r for r in scan.collect()}
    months = sorted({k[1] for k in rows})
    assert len(rows) == 2 * len(months) and "2010-05-01" in months
    assert rows["BAD", "2010-05-01"]["n"] == rows["BAD", "2010-06-01"]["n"] > 30
    assert rows["GOOD", months[-1]]["n"] < 30


def test_gate_looks_at_its_era_alone(spark):
    """A shifted past fails the gate, unless the era begins after it."""
    cal = business_calendar(spark)
    old = synthetic(spark, 400, lag=1, start="2001-01-02")
    new = synthetic(spark, 400, lag=0, start="2003-03-03")
    both = old.unionByName(new)
    assert align.alignment_gate(both, cal).first()["aligned"] is False
    assert align.alignment_gate(both, cal, "2003-03-03").first()["aligned"] is True
