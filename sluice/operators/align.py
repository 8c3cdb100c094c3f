"""One-session move pairs and the checks that both prices share a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.functions.calendar import in_calendar
from sluice.functions.distributions import t_two_sided
from sluice.functions.exprs import count_if, ratio, spread

# Fixed values of the alignment check.
MAX_LAG_RATIO = 0.08
DRIFT_P = 0.01
ERA_P = 0.05
MIN_LAG_PAIRS = 30
MAX_LEGACY_WEEKS = 0.15


def in_series():
    return Window.partitionBy("series_id")


def by_session():
    return in_series().orderBy("session")


def one_session_deltas(panel: DataFrame, cal: DataFrame) -> DataFrame:
    """Moves in cents between a session and the business day just before it.

    Rows with a missing price are dropped, not filled, and a pair survives only
    if the previous *surviving* row is the previous business day.  The calendar
    is a bounded dimension, so its join keeps the partitioning by series that
    the ``lag`` already paid for.
    """
    present = in_calendar(panel.where(F.col("driver").isNotNull() & F.col("response").isNotNull()), "session")
    moves = (
        spread(present, "series_id")
        .withColumn("prior_session", F.lag("session").over(by_session()))
        .withColumn("prior_driver", F.lag("driver").over(by_session()))
        .withColumn("prior_response", F.lag("response").over(by_session()))
        .withColumn("x", (F.col("driver") - F.col("prior_driver")) * 100)
        .withColumn("y", (F.col("response") - F.col("prior_response")) * 100)
    )
    days = cal.select(F.col("d").alias("session"), "prev_bd", "is_bd", "is_roll")
    return (moves.join(F.broadcast(days), "session")
            .where("prior_session = prev_bd")
            .withColumn("session_gap", F.datediff("session", "prior_session"))
            .drop("prev_bd"))


def training_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs off contract-roll sessions, numbered 1..n within their series.

    The roll filter comes after the difference: dropping the row first would
    turn the next move into a two-session one.
    """
    return (pairs.where(~F.col("is_roll"))
            .withColumn("ord", F.row_number().over(by_session()))
            .withColumn("n", F.count("*").over(in_series())))


def adjacent_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs whose previous pair ends where they start, with its move as ``z``."""
    return (pairs.withColumn("z", F.lag("x").over(by_session()))
            .withColumn("_last", F.lag("session").over(by_session()))
            .where("prior_session = _last").drop("_last"))


MOMENTS = {"n": "1", "sx": "x", "sz": "z", "sy": "y", "sxx": "x*x", "szz": "z*z",
           "sxz": "x*z", "sxy": "x*y", "szy": "z*y", "syy": "y*y"}


def moments() -> list[Column]:
    """Additive sums from which a two-regressor fit can be solved."""
    return [F.sum(F.expr(e).cast("double")).alias(name) for name, e in MOMENTS.items()]


def solve_lag_fit(sums: DataFrame) -> DataFrame:
    """b0, b1, t and ratio of ``y ~ 1 + x + z`` from :func:`moments` columns."""
    c = lambda ab, a, b: F.col(ab) - F.col(a) * F.col(b) / F.nullif(F.col("n"), F.lit(0.0))
    df = (sums.withColumn("cxx", c("sxx", "sx", "sx")).withColumn("czz", c("szz", "sz", "sz"))
          .withColumn("cxz", c("sxz", "sx", "sz")).withColumn("cxy", c("sxy", "sx", "sy"))
          .withColumn("czy", c("szy", "sz", "sy")).withColumn("cyy", c("syy", "sy", "sy"))
          .withColumn("det", F.expr("nullif(cxx*czz - cxz*cxz, 0D)")))
    enough = F.col("n") >= MIN_LAG_PAIRS
    return (df.withColumn("b0", F.when(enough, F.expr("(cxy*czz - czy*cxz)/det")))
            .withColumn("b1", F.when(enough, F.expr("(czy*cxx - cxy*cxz)/det")))
            .withColumn("se_b1", F.expr("sqrt((cyy - b0*cxy - b1*czy)/nullif(n - 3, 0) * cxx/det)"))
            .withColumn("t_b1", F.expr("b1 / nullif(se_b1, 0D)"))
            .withColumn("ratio", F.expr("abs(b1) / nullif(abs(b0), 0D)"))
            .withColumn("n", F.col("n").cast("long"))
            .drop("cxx", "czz", "cxz", "cxy", "czy", "cyy", "det", *list(MOMENTS)[1:]))


def lag_diagnostics(pairs: DataFrame) -> DataFrame:
    """Per series: does the response load on the previous session's move?"""
    return solve_lag_fit(adjacent_pairs(pairs).groupBy("series_id").agg(*moments()))


def era_scan(pairs: DataFrame, history: DataFrame) -> DataFrame:
    """Lag fit of every suffix of ``history`` that starts at a month boundary.

    The sums are additive, so each month is reduced once and the suffixes are a
    running sum from the end; no row is repeated per candidate.  A pair belongs
    to the suffix when its *prior* row is inside too, as the cut comes first.
    """
    # First pair inside a suffix has no earlier pair there, so z needs the
    # pair before it to be inside as well: its own prior session's prior.
    chained = (pairs.withColumn("z", F.lag("x").over(by_session()))
               .withColumn("_last", F.lag("session").over(by_session()))
               .withColumn("_first", F.lag("prior_session").over(by_session()))
               .where("prior_session = _last"))
    monthly = chained.groupBy("series_id", F.trunc("_first", "MM").alias("month")).agg(*moments())
    # Every series gets every month of the whole history, also those in which it
    # has no pair: a start there leaves it the pairs of its later months, or none.
    span = history.agg(F.trunc(F.min("session"), "MM").alias("lo"), F.trunc(F.max("session"), "MM").alias("hi"))
    months = F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month")
    grid = history.select("series_id").distinct().join(F.broadcast(span)).select("series_id", months)
    suffix = (in_series().orderBy(F.col("month").desc())
              .rowsBetween(Window.unboundedPreceding, 0))
    every = grid.join(monthly, ["series_id", "month"], "left")
    return solve_lag_fit(every.select("series_id", F.col("month").alias("start"), *[
        F.coalesce(F.sum(m).over(suffix), F.lit(0.0)).alias(m) for m in MOMENTS]))


def week_classes(rows: DataFrame) -> DataFrame:
    """legacy / live / interleaved / ambiguous per series and week.

    A week with a Saturday row and no Monday row carries the one-day-late
    stamping.  Ambiguous weeks before the first live week are legacy.
    """
    dow = F.weekday("session")
    weeks = rows.groupBy("series_id", F.to_date(F.date_trunc("week", "session")).alias("week")).agg(
        F.bool_or(dow == 5).alias("has_sat"), F.bool_or(dow == 0).alias("has_mon"),
        F.count("*").alias("days"))
    raw = (F.when(F.col("has_sat") & F.col("has_mon"), "interleaved")
           .when(F.col("has_sat"), "legacy").when(F.col("has_mon"), "live")
           .otherwise("ambiguous"))
    first_live = F.min(F.when(F.col("raw_kind") == "live", F.col("week"))).over(in_series())
    return (weeks.withColumn("raw_kind", raw).withColumn("first_live", first_live)
            .withColumn("kind", F.when((F.col("raw_kind") == "ambiguous")
                                       & (F.col("week") < F.col("first_live")), "legacy")
                        .otherwise(F.col("raw_kind"))))


def redate_plan(stamped: DataFrame, external: DataFrame, cal: DataFrame,
                era_start: str) -> DataFrame:
    """Move rows of legacy weeks back one calendar day and re-source the driver.

    The driver comes from the row already stamped with that day, else from the
    external table, else stays null on a day without a session, else the row is
    unresolved.
    """
    kinds = week_classes(stamped).select("series_id", "week", "kind")
    rows = (stamped.withColumn("week", F.to_date(F.date_trunc("week", "session")))
            .join(kinds, ["series_id", "week"]))
    rows = rows.withColumnRenamed("session", "stamp")
    target = F.date_sub("stamp", 1)
    moved = ((F.col("stamp") < F.lit(era_start).cast("date")) & (F.col("kind") == "legacy")
             & (F.weekday(target) < 5))
    rows = rows.withColumn("session", F.when(moved, target).otherwise(F.col("stamp")))
    donor = stamped.select("series_id", "session", F.col("driver").alias("donor"))
    ext = external.select("series_id", "session", F.col("driver").alias("ext"))
    days = cal.select(F.col("d").alias("session"), "is_bd")
    joined = (rows.join(donor, ["series_id", "session"], "left")
              .join(ext, ["series_id", "session"], "left")
              .join(F.broadcast(days), "session", "left"))
    is_moved = F.col("session") != F.col("stamp")
    source = (F.when(~is_moved, "kept").when(F.col("donor").isNotNull(), "internal")
              .when(F.col("ext").isNotNull(), "external")
              .when(~F.col("is_bd"), "holiday_no_settle").otherwise("missing"))
    return joined.select(
        "series_id", "stamp", "session", "kind", source.alias("source"),
        F.when(~is_moved, "keep").when(source == "missing", "unresolved")
        .otherwise("redate").alias("action"),
        F.when(~is_moved, F.col("driver")).otherwise(
            F.coalesce("donor", "ext")).alias("driver"), "response")


def alignment_gate(stamped: DataFrame, cal: DataFrame, era_start: str | None = None) -> DataFrame:
    """Per series: lag check on the weekday pairs, share of late-stamped weeks on the rows.

    With ``era_start`` both look at the calibration era alone.  The rows are cut
    before they are differenced, so no pair reaches back across the cut.
    """
    if era_start is not None:
        stamped = stamped.where(F.col("session") >= F.lit(era_start).cast("date"))
    pairs = one_session_deltas(stamped.where(F.weekday("session") < 5), cal)
    diag = lag_diagnostics(pairs)
    drifted = (F.col("ratio") > MAX_LAG_RATIO) & (t_two_sided("t_b1", F.col("n") - 3) < DRIFT_P)
    diag = diag.withColumn("aligned", (F.col("n") >= MIN_LAG_PAIRS)
                           & ~F.coalesce(drifted, F.lit(False)))
    weeks = week_classes(stamped).groupBy("series_id").agg(ratio(
        count_if(F.col("has_sat")), count_if(F.col("has_sat") | F.col("has_mon"))).alias("legacy_share"))
    ok = F.col("legacy_share") <= MAX_LEGACY_WEEKS
    return (diag.join(weeks, "series_id").withColumn("structure_ok", ok)
            .withColumn("passed", F.col("aligned") & ok))


def redate_gates(before: DataFrame, plan: DataFrame, truth: DataFrame,
                 era_start: str) -> DataFrame:
    """Reconciliation of a re-dating plan, one row per series.

    Multisets are compared by signed counts, which reduces on the map side
    and needs one shuffle instead of two set differences.
    """
    era = F.col("session") >= F.lit(era_start).cast("date")
    deviation = (plan.where("stamp <> session")
                 .join(truth.select("series_id", "session", F.col("driver").alias("t")),
                       ["series_id", "session"])
                 .groupBy("series_id").agg(F.max(F.abs(F.col("driver") - F.col("t")))
                                           .alias("max_deviation")))
    collisions = (plan.groupBy("series_id", "session").count().groupBy("series_id")
                  .agg(count_if(F.col("count") > 1).alias("collisions"),
                       F.sum("count").alias("rows_after")))
    signed = (before.select("series_id", "response", F.lit(1).alias("s"))
              .unionByName(plan.select("series_id", "response", F.lit(-1).alias("s")))
              .groupBy("series_id", "response").agg(F.sum("s").alias("s"))
              .groupBy("series_id").agg(F.sum(F.abs("s")).alias("response_changes")))
    cols = ["series_id", "session", "driver", "response"]
    kept = (before.where(era).select(*cols, F.lit(1).alias("s"))
            .unionByName(plan.where(era).select(*cols, F.lit(-1).alias("s")))
            .groupBy(*cols).agg(F.sum("s").alias("s"))
            .groupBy("series_id").agg(F.sum(F.greatest("s", F.lit(0))).alias("era_changes")))
    sizes = before.groupBy("series_id").agg(F.count("*").alias("rows_before"))
    out = sizes
    for part in (collisions, deviation, signed, kept):
        out = out.join(part, "series_id", "left")
    return out.na.fill(0, ["response_changes", "era_changes"])


def roll_offsets(fitted: DataFrame, cal: DataFrame, offsets: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """How well each candidate roll offset isolates large residuals.

    The session on which the quote moves is the business day ``k - 1`` before
    the last trade date, so one calendar serves every candidate.
    """
    days = cal.select(F.col("d").alias("session"), "bd_ord", "ltd_refined_ord")
    rows = (fitted.select("series_id", "session", "is_bd", F.abs("resid").alias("ar"))
            .join(F.broadcast(days), "session")
            .withColumn("k", F.explode(F.array(*[F.lit(k) for k in offsets]))))
    hit = F.col("is_bd") & (F.col("bd_ord") == F.col("ltd_refined_ord") - F.col("k") + 1)
    per = rows.groupBy("k", "series_id").agg(
        (F.avg(F.when(hit, F.col("ar"))) / F.avg(F.when(~hit, F.col("ar")))).alias("r"))
    scored = per.groupBy("k").agg(F.min("r").alias("min_ratio"))
    best = scored.agg(F.max_by("k", "min_ratio").alias("best_k"))
    return scored.join(F.broadcast(best)).select(
        "k", "min_ratio", (F.col("k") == F.col("best_k")).alias("best"))
