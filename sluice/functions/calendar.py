"""Business-day and futures-contract calendar as a generated dimension.

The dimension holds one row per calendar day of the two centuries that prices
can come from, so its size is bounded by the rule that builds it (some 73,000
narrow rows) and it may always be broadcast.  A day outside of them is an
error (``in_calendar``), never a row that a join leaves out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sluice.session import durable

FIRST_YEAR, LAST_YEAR = 1900, 2100

# Fixed value: business days before the last trade date at which the quoted
# front month moves to the next contract.
EARLY_ROLL_DAYS = 2

# Delivery month letters, January to December.
MONTH_CODES = "FGHJKMNQUVXZ"


def holiday_rules(spark: SparkSession, first_year: int = FIRST_YEAR,
                  last_year: int = LAST_YEAR) -> DataFrame:
    """(y, holiday, d): ten market holidays of each year as observed.

    A holiday is kept only when its observed day lies in its own year, so a
    Saturday New Year's Day is not observed on the Friday before.
    """
    golden = spark.range(first_year, last_year + 1).selectExpr(
        "CAST(id AS INT) AS y", "CAST(id % 19 AS INT) AS a",
        "CAST(id div 100 AS INT) AS b", "CAST(id % 100 AS INT) AS c")
    epact = golden.selectExpr(
        "y", "a", "b", "c",
        "(19*a + b - b div 4 - (b - (b + 8) div 25 + 1) div 3 + 15) % 30 AS h")
    weekday = epact.selectExpr(
        "y", "a", "h", "(32 + 2*(b % 4) + 2*(c div 4) - h - c % 4) % 7 AS l")
    paschal = weekday.selectExpr(
        "y", "h + l - 7*((a + 11*h + 22*l) div 451) + 114 AS k")
    fixed = lambda m, d: f"""
        CASE weekday(make_date(y,{m},{d})) WHEN 5 THEN date_sub(make_date(y,{m},{d}), 1)
             WHEN 6 THEN date_add(make_date(y,{m},{d}), 1) ELSE make_date(y,{m},{d}) END"""
    nth = lambda m, day, n: (
        f"date_add(next_day(date_sub(make_date(y,{m},1), 1), '{day}'), {7 * (n - 1)})")
    rules = {
        "new_year": fixed(1, 1),
        "king_day": nth(1, "MON", 3),
        "presidents": nth(2, "MON", 3),
        "good_friday": "date_sub(make_date(y, CAST(k div 31 AS INT), CAST(k % 31 + 1 AS INT)), 2)",
        "memorial": "next_day(date_sub(make_date(y,5,31), 7), 'MON')",
        "juneteenth": fixed(6, 19),
        "independence": fixed(7, 4),
        "labor": nth(9, "MON", 1),
        "thanksgiving": nth(11, "THU", 4),
        "christmas": fixed(12, 25),
    }
    pairs = ", ".join(f"'{name}', {rule}" for name, rule in rules.items())
    return (paschal.selectExpr("y", f"stack({len(rules)}, {pairs}) AS (holiday, d)")
            .where("year(d) = y"))


def alternate_holiday(d: Column, good_friday: Column) -> Column:
    """The stricter day rule the validators use.

    Differs from :func:`holiday_rules` on a Friday 31 December, and also counts
    a fixed holiday that itself falls on a weekend.
    """
    m, day, dow = F.month(d), F.dayofmonth(d), F.weekday(d)
    fixed = lambda mm, dd: (
        ((m == mm) & (day == dd)) | ((m == mm) & (day == dd + 1) & (dow == 0))
        | ((m == mm) & (day == dd - 1) & (dow == 4)))
    new_year = (((m == 1) & (day == 1)) | ((m == 1) & (day == 2) & (dow == 0))
                | ((m == 12) & (day == 31) & (dow == 4)))
    floating = (((dow == 0) & m.isin(1, 2) & day.between(15, 21))
                | ((dow == 0) & (m == 5) & (day >= 25))
                | ((dow == 0) & (m == 9) & (day <= 7))
                | ((dow == 3) & (m == 11) & day.between(22, 28)))
    return good_friday | new_year | floating | fixed(6, 19) | fixed(7, 4) | fixed(12, 25)


_WRITTEN: dict[tuple, DataFrame] = {}


def business_calendar(spark: SparkSession, early_roll_days: int = EARLY_ROLL_DAYS) -> DataFrame:
    """The calendar as a written dimension, generated once per application.

    It depends on no input table, so every query of a session may share it.
    """
    key = (spark.sparkContext.applicationId, early_roll_days)
    if key not in _WRITTEN:
        _WRITTEN[key] = durable(generate_calendar(spark, early_roll_days))
    return _WRITTEN[key]


def generate_calendar(spark: SparkSession, early_roll_days: int = EARLY_ROLL_DAYS,
                      first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    """One row per day: business flags, neighbours, contract months and rolls.

    ``front_refined`` / ``front_crude`` are the first day of the delivery month
    of the quoted contract.  The cut-off of the next month's contract always
    lies inside the current month, so the front month is either one or two
    months ahead and needs no range join.
    """
    hol = holiday_rules(spark, first_year, last_year).select("d", "holiday")
    days = (spark.range(1)
            .select(F.explode(F.sequence(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)),
                                         F.make_date(F.lit(last_year), F.lit(12), F.lit(31))))
                    .alias("d")))
    # Bounded dimension: these two frames run over ~73,000 generated rows.
    w = Window.orderBy("d")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # Descending, because a frame that ends at the last row is recomputed per row.
    after = Window.orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, -1)
    month = Window.partitionBy("month")
    bd_day = F.when(F.col("is_bd"), F.col("d"))
    cal = (
        days.join(F.broadcast(hol), "d", "left")
        .withColumn("month", F.trunc("d", "MM"))
        .withColumn("is_holiday", F.col("holiday").isNotNull())
        .withColumn("is_holiday_alt", alternate_holiday(
            F.col("d"), F.coalesce(F.col("holiday") == "good_friday", F.lit(False))))
        .withColumn("is_bd", (F.weekday("d") < 5) & ~F.col("is_holiday"))
        .withColumn("bd_ord", F.sum(F.col("is_bd").cast("int")).over(upto))
        .withColumn("prev_bd", F.max(bd_day).over(before))
        .withColumn("next_bd", F.min(bd_day).over(after))
        .withColumn("ltd_refined_ord", F.max(F.when(F.col("is_bd"), F.col("bd_ord"))).over(month))
        .withColumn("ltd_crude_ord",
                    F.max(F.when(F.dayofmonth("d") == 25, F.col("bd_ord"))).over(month) - 3)
    )
    for product in ("refined", "crude"):
        cutoff = F.col(f"ltd_{product}_ord") - early_roll_days
        not_later = F.when(F.col("is_bd"), F.col("bd_ord") <= cutoff).otherwise(
            F.col("bd_ord") < cutoff)
        cal = cal.withColumn(f"front_{product}", F.when(
            not_later, F.add_months("month", 1)).otherwise(F.add_months("month", 2)))
    for product, flag in (("refined", "is_roll"), ("crude", "is_roll_crude")):
        front = F.col(f"front_{product}")
        prior = F.last(F.when(F.col("is_bd"), front), ignorenulls=True).over(before)
        cal = cal.withColumn(flag, F.coalesce(F.col("is_bd") & (front != prior), F.lit(False)))
    return cal


def in_calendar(rows: DataFrame, day: str, first_year: int = FIRST_YEAR,
                last_year: int = LAST_YEAR) -> DataFrame:
    """``rows`` as they are, or an error on a day that the calendar does not hold."""
    known = F.col(day).isNull() | F.year(day).between(first_year, last_year)
    message = F.concat(F.lit("no calendar day for "), F.col(day).cast("string"))
    return rows.withColumn(day, F.when(known, F.col(day)).otherwise(F.raise_error(message).cast("date")))


def last_trade_dates(cal: DataFrame) -> DataFrame:
    """(contract_month, ltd_refined, ltd_crude) per delivery month."""
    on = lambda name: F.max(F.when(
        F.col("is_bd") & (F.col("bd_ord") == F.col(name)), F.col("d")))
    return cal.groupBy(F.add_months("month", 1).alias("contract_month")).agg(
        on("ltd_refined_ord").alias("ltd_refined"), on("ltd_crude_ord").alias("ltd_crude"))


def contract_symbol(prefix: Column, contract_month: Column) -> Column:
    """``/`` + product + month letter + two-digit year."""
    code = F.substring(F.lit(MONTH_CODES), F.month(contract_month), F.lit(1))
    return F.concat(F.lit("/"), prefix, code,
                    F.lpad((F.year(contract_month) % 100).cast("string"), 2, "0"))


#: Contract prefix of each line status that stands for a product.
PRODUCTS = {"F": "RB", "O": "HO"}


def product_prefix(status: Column, products: dict[str, str] = PRODUCTS) -> Column:
    """Contract prefix of a series; null for a series that is no product."""
    return F.element_at(F.create_map(*[F.lit(v) for pair in products.items() for v in pair]), status)


def valid_symbol(symbol: Column, prefixes: str = "RB|HO") -> Column:
    return symbol.rlike(f"^/({prefixes})[{MONTH_CODES}][0-9]{{2}}$")


def session_date(local_ts: Column) -> Column:
    """Trading session of a local clock time: 17:00 opens the next day."""
    return F.to_date(local_ts + F.expr("INTERVAL 7 HOURS"))


def central_time(utc_ts: Column) -> Column:
    """America/Chicago wall clock of a UTC wall-clock timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit("America/Chicago"), utc_ts)
