from pyspark.sql import functions as F

from sluice.functions.calendar import (
    business_calendar, contract_symbol, generate_calendar, last_trade_dates, valid_symbol)
from tests.helpers import day

HOLIDAYS = {
    2024: ["2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19",
           "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25"],
    2025: ["2025-01-01", "2025-01-20", "2025-02-17", "2025-04-18", "2025-05-26", "2025-06-19",
           "2025-07-04", "2025-09-01", "2025-11-27", "2025-12-25"],
}


def one(cal, d):
    return cal.where(F.col("d") == F.lit(d).cast("date")).first()


def test_holiday_lists(spark):
    cal = business_calendar(spark)
    for year, expected in HOLIDAYS.items():
        got = [r["d"].isoformat() for r in cal.where(f"is_holiday AND year(d) = {year}").orderBy("d").collect()]
        assert got == expected


def test_saturday_new_year_is_observed_only_by_the_alternate_rule(spark):
    row = one(business_calendar(spark), "2021-12-31")
    assert row["is_bd"] and not row["is_holiday"] and row["is_holiday_alt"]


def test_neighbours(spark):
    cal = business_calendar(spark)
    assert one(cal, "2026-05-26")["prev_bd"] == day("2026-05-22")
    assert one(cal, "2026-04-06")["prev_bd"] == day("2026-04-02")
    assert one(cal, "2026-07-02")["next_bd"] == day("2026-07-06")


def test_last_trade_dates(spark):
    ltd = {r["contract_month"].isoformat(): r["ltd_refined"].isoformat()
           for r in last_trade_dates(business_calendar(spark)).collect()}
    assert ltd["2026-06-01"] == "2026-05-29"
    assert ltd["2026-01-01"] == "2025-12-31"
    assert ltd["2025-05-01"] == "2025-04-30"


def test_front_month_and_offset(spark):
    cal = business_calendar(spark)
    assert one(cal, "2025-04-30")["front_refined"] == day("2025-06-01")
    assert one(cal, "2025-05-01")["front_refined"] == day("2025-06-01")
    assert one(cal, "2025-04-01")["front_refined"] == day("2025-05-01")
    late = generate_calendar(spark, early_roll_days=0)
    assert one(late, "2025-04-30")["front_refined"] == day("2025-05-01")


def test_one_roll_a_month_and_only_on_business_days(spark):
    cal = business_calendar(spark).where("year(d) BETWEEN 2024 AND 2026")
    for flag in ("is_roll", "is_roll_crude"):
        rolls = cal.where(flag)
        assert rolls.count() == 36
        assert rolls.select(F.trunc("d", "MM")).distinct().count() == 36
        assert rolls.where("NOT is_bd").count() == 0


def test_symbols(spark):
    df = spark.sql("SELECT date'2026-12-01' AS m, date'2007-01-01' AS k")
    row = df.select(contract_symbol(F.lit("RB"), F.col("m")).alias("a"),
                    contract_symbol(F.lit("HO"), F.col("k")).alias("b")).first()
    assert tuple(row) == ("/RBZ26", "/HOF07")
    ok = spark.createDataFrame([("/RBZ26",), ("RBZ26",), ("/RBA26",), ("/CLZ26",)], "s string")
    assert [r[0] for r in ok.select(valid_symbol(F.col("s"))).collect()] == [True, False, False, False]


def test_only_products_have_symbols(spark, tmp_path):
    from sluice.operators.calendar_ops import candidate_symbols
    days = [("F", day("1995-03-01")), ("O", day("1995-03-01")), ("X", day("1995-03-01")), (None, day("1995-03-01"))]
    spark.createDataFrame(days, "l_linestatus string, l_shipdate date").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r["prefix"], r["kind"]): r["symbols"] for r in candidate_symbols(spark, str(tmp_path)).groupBy("prefix", "kind").agg(
        F.count("*").alias("symbols")).collect()}
    assert got == {("RB", "range"): 5, ("HO", "range"): 5, ("RB", "next"): 4, ("HO", "next"): 4}
