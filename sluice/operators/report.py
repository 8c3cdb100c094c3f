"""Scoring and monitoring of a decision log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.functions.calendar import in_calendar
from sluice.functions.exprs import array_quantile, count_if, ratio, settle
from sluice.operators import fit as m
from sluice.operators.align import by_session, in_series
from sluice.operators.decide import z_band
from sluice.operators.ledger import settlement_based

# Fixed values of the reports.
DISPATCH_RATE, MIN_SIGNIFICANT, BASIS_ROWS = 0.50, 30, 65
Z95 = 1.959963984540054


def live_rows(log: DataFrame) -> DataFrame:
    """Resolved live decisions taken from a settlement snapshot."""
    return log.where((F.col("prediction_source") == "live")
                     & settlement_based(F.col("settlement_source")) & F.col("actual").isNotNull())


def resolve_outcomes(log: DataFrame, history: DataFrame, cal: DataFrame) -> DataFrame:
    """Outcome of each decision from the history rows themselves.

    Resolved only if the row before is the previous business day; otherwise the
    outcome can never be attributed to one session.  Not yet there: pending.
    """
    rows = (history.withColumn("prev_row", F.lag("session").over(by_session()))
            .withColumn("prev_response", F.lag("response").over(by_session()))
            .select("series_id", "session", "response", "prev_row", "prev_response"))
    days = cal.select(F.col("d").alias("session"), "prev_bd")
    joined = (in_calendar(log.select("series_id", "session"), "session").join(F.broadcast(days), "session")
              .join(rows, ["series_id", "session"], "left"))
    gap = F.col("prev_row") != F.col("prev_bd")
    status = (F.when(F.col("prev_row").isNull(), "PENDING").when(gap, "NO_PRIOR_SESSION")
              .when(F.col("response").isNull() | F.col("prev_response").isNull(), "PENDING")
              .otherwise("RESOLVED"))
    return joined.withColumn("status", status).withColumn("move", F.when(
        F.col("status") == "RESOLVED", (F.col("response") - F.col("prev_response")) * 100))


def alert_summary(cond: Column) -> list[Column]:
    alert = cond & (F.col("dir") != 0)
    n, hit = count_if(alert), count_if(alert & F.col("correct"))
    total = F.coalesce(F.sum(F.when(alert, F.col("savings"))), F.lit(0.0))
    return [n, hit, total]


def source_summary(rows: DataFrame) -> DataFrame:
    """Lifetime and last-week figures per source, as of the newest decision."""
    as_of = rows.agg(F.max("verdict_ts").alias("as_of"))
    # One row of the newest time; broadcasting it is bounded by construction.
    work = rows.join(F.broadcast(as_of))
    n, hit, total = alert_summary(F.lit(True))
    wn, whit, wtotal = alert_summary(F.col("verdict_ts") >= F.col("as_of") - F.expr("INTERVAL 7 DAYS"))
    g = work.groupBy("prediction_source").agg(
        F.count("*").alias("rows"), n.alias("alerts"), hit.alias("hits"), total.alias("savings_cents"),
        wn.alias("week_alerts"), whit.alias("week_hits"), wtotal.alias("week_savings"))
    pct = lambda a, b: F.coalesce(100 * ratio(F.col(a), F.col(b)), F.lit(0.0))
    return (g.withColumn("precision", pct("hits", "alerts"))
            .withColumn("week_precision", pct("week_hits", "week_alerts"))
            .withColumn("avg_savings", F.coalesce(ratio(F.col("savings_cents"), F.col("alerts")), F.lit(0.0)))
            .withColumn("full_dollars", F.col("savings_cents") / 100 * m.TRUCK_GALLONS)
            .withColumn("estimated_dollars", F.col("full_dollars") * DISPATCH_RATE)
            .drop("hits", "week_hits"))


def band_of(label: Column) -> Column:
    """Reported band from the text written at decision time."""
    head = F.trim(F.regexp_extract(label, r"^([^|]*?)( \||$)", 1))
    first = F.regexp_extract(head, "^(Low|Moderate|High)", 1)
    return F.when(first != "", F.concat(first, F.lit(" confidence")))


def captured_probability(label: Column) -> Column:
    """Probability stored in a label, null unless it parses into [0, 1]."""
    p = F.trim(F.regexp_extract(label, r"\| p=([^|]*)$", 1)).try_cast("double")
    return F.when(p.between(0, 1), p)


def band_summary(live: DataFrame, bands: DataFrame) -> DataFrame:
    g = (live.where("dir <> 0").groupBy(band_of(F.col("label")).alias("band"))
         .agg(F.count("*").alias("alerts"), (100 * F.avg(F.col("correct").cast("int"))).alias("precision"),
              F.sum("savings").alias("savings_cents")))
    return bands.join(g, "band", "left").na.fill(0, ["alerts"]).na.fill(
        0.0, ["precision", "savings_cents"])


def live_summary(live: DataFrame) -> DataFrame:
    """All series together and each alone, in one pass of grouping sets."""
    alerts = live.where("dir <> 0").withColumn("q", captured_probability(F.col("label"))).withColumn(
        "hit", F.col("correct").cast("double"))
    scored = F.when(F.col("q").isNotNull(), F.pow(F.col("q") - F.col("hit"), F.lit(2.0)))
    g = alerts.groupingSets([[], ["series_id"]], "series_id").agg(
        F.grouping("series_id").alias("is_total"), F.count("*").alias("alerts"),
        count_if(F.col("correct")).alias("wins"), F.avg("savings").alias("avg_savings"),
        F.min("savings").alias("max_adverse"), F.avg(scored).alias("brier"),
        F.avg("q").alias("mean_probability"), F.count("q").alias("probability_n"))
    return (g.withColumn("series_id", F.when(F.col("is_total") == 1, "All").otherwise(F.col("series_id")))
            .withColumn("precision", ratio(F.col("wins"), F.col("alerts")))
            .withColumn("calibration_gap", F.col("precision") - F.col("mean_probability"))
            .drop("is_total"))


def rolling_precision(live: DataFrame, days: int = 90) -> DataFrame:
    """Alert precision over the trailing days, both ends included.

    Given only once the series' decisions span that many days.
    """
    secs = F.unix_timestamp(F.to_timestamp(F.col("verdict_ts")))
    span = F.max("t").over(in_series()) - F.min("t").over(in_series())
    rows = live.withColumn("t", secs).withColumn("span", span).where("dir <> 0")
    w = in_series().orderBy("t").rangeBetween(-days * 86400, 0)
    p = 100 * F.sum(F.col("correct").cast("int")).over(w) / F.count("*").over(w)
    return rows.select("series_id", "session", F.when(F.col("span") >= days * 86400, p).alias("rolling_precision"))


def alert_rate(live: DataFrame, cal: DataFrame) -> DataFrame:
    """Alerts of the last seven days against the weekly history, roll-adjusted.

    Decisions are reduced to one row per session first, so the week statistics
    and the one-row result never see more than the calendar's length.
    """
    per_day = live.groupBy("session").agg(
        F.max("verdict_ts").alias("last_ts"), F.count("*").alias("decisions"),
        count_if(F.col("dir") != 0).alias("alerts"))
    as_of = per_day.agg(F.max("session").alias("as_of"))
    weeks = (per_day.groupBy(F.date_trunc("week", "session").alias("week"))
             .agg(F.sum("alerts").alias("a")).where("a > 0")
             .agg(F.avg("a").alias("mean_alerts"), F.coalesce(F.stddev_samp("a"), F.lit(0.0)).alias("sd_alerts")))
    recent = per_day.join(F.broadcast(as_of)).where("session >= date_sub(as_of, 7)").agg(
        F.sum("alerts").alias("raw_alerts"))
    rolls = (cal.where("is_roll").select("d").join(F.broadcast(as_of))
             .where("d BETWEEN date_sub(as_of, 7) AND as_of").agg(F.count("*").alias("rolls")))
    out = weeks.join(F.broadcast(recent)).join(F.broadcast(rolls)).join(F.broadcast(as_of))
    norm = F.when(F.col("rolls") < 5, F.col("raw_alerts") * (5.0 / (5 - F.col("rolls")))).otherwise(
        F.col("raw_alerts"))
    limit = F.when(F.col("sd_alerts") > 0, F.col("mean_alerts") + 2 * F.col("sd_alerts")).otherwise(999.0)
    return (out.withColumn("normalized", norm.cast("double")).withColumn("limit_alerts", limit)
            .withColumn("anomaly", F.col("normalized") > F.col("limit_alerts")))


def mann_kendall(panel: DataFrame, rows: int = BASIS_ROWS) -> DataFrame:
    """Trend of the last basis levels with ties and serial correlation.

    The window is 65 rows by definition, so all comparisons of a series happen
    inside one bounded array; no pair rows are produced.
    """
    tail = (panel.where("driver IS NOT NULL AND response IS NOT NULL")
            .withColumn("back", F.row_number().over(in_series().orderBy(F.col("session").desc())))
            .where(F.col("back") <= rows))
    g = tail.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(
        "session", ((F.col("response") - F.col("driver")) * 100).alias("b")))), lambda s: s["b"]).alias("v"))
    g = settle(g, n=F.size("v").cast("double"))
    idx = lambda: F.sequence(F.lit(0), F.size("v") - 1)
    later = lambda i: F.slice(F.col("v"), i + 2, F.size("v"))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    g = settle(
        g,
        s=total(F.transform("v", lambda v, i: total(F.transform(later(i), lambda w: F.signum(w - v))))),
        ties=F.transform("v", lambda v: F.size(F.filter("v", lambda w: w == v)).cast("double")),
        less=F.transform("v", lambda v: F.size(F.filter("v", lambda w: w < v)).cast("double")),
        slopes=F.sort_array(F.flatten(F.transform("v", lambda v, i: F.transform(
            later(i), lambda w, k: (w - v) / (k + 1))))))
    g = settle(
        g, tie_sum=total(F.transform("ties", lambda t: (t - 1) * (2 * t + 5))),
        tie_pairs=total(F.transform("ties", lambda t: (t - 1) / 2)),
        c=F.transform(F.arrays_zip("less", "ties"),
                      lambda z: z["less"] + (z["ties"] + 1) / 2 - (F.col("n") + 1) / 2))
    g = settle(g, den=total(F.transform("c", lambda x: x * x)))
    n = F.col("n")
    max_lag = F.least(n - 2, F.greatest(F.lit(1.0), F.floor(n / 4).cast("double"))).cast("int")
    rho = lambda k: total(F.transform(
        F.slice(F.col("c"), k + 1, F.size("c")), lambda x, i: x * F.get(F.col("c"), i))) / F.col("den")
    g = settle(g, rhos=F.transform(F.sequence(F.lit(1), max_lag), lambda k: rho(k)))
    part = lambda r, i: F.when(F.abs(r) > 1.96 / F.sqrt(n), (n - i - 1) * (n - i - 2) * (n - i - 3) * r).otherwise(0.0)
    infl = 1 + 2 / (n * (n - 1) * (n - 2)) * total(F.transform("rhos", part))
    g = settle(g, inflation=F.when(F.col("den") == 0, 1.0).otherwise(F.greatest(infl, F.lit(1.0))),
               var0=(n * (n - 1) * (2 * n + 5) - F.col("tie_sum")) / 18.0)
    var = F.col("var0") * F.col("inflation")
    z = (F.col("s") - F.signum("s")) / F.sqrt(F.when(var > 0, var))
    pairs = 0.5 * n * (n - 1)
    return g.select(
        "series_id", n.cast("int").alias("n"), "s", "inflation", "rhos", z.alias("z"),
        ((F.col("s") - F.signum("s")) / F.sqrt("var0")).alias("z_plain"),
        array_quantile(F.col("slopes"), 0.5).alias("sen_slope"),
        (F.col("s") / F.sqrt((pairs - F.col("tie_pairs")) * pairs)).alias("tau"))


def significance_gate(log: DataFrame, days: int = 180, min_rows: int = 5) -> DataFrame:
    """Whether the live sample supports a test, and over which period."""
    live = F.col("prediction_source") == "live"
    as_of = log.agg(F.max("verdict_ts").alias("as_of"))
    used = live & settlement_based(F.col("settlement_source")) & F.col("actual").isNotNull()
    recent = F.col("verdict_ts") >= F.col("as_of") - F.make_dt_interval(F.lit(days))
    g = log.join(F.broadcast(as_of)).agg(
        count_if(live).alias("live_predictions"), count_if(used).alias("resolved_live"),
        count_if(used & recent).alias("resolved_recent"))
    full = F.col("resolved_recent") < min_rows
    g = g.withColumn("period", F.when(full, "full_history").otherwise("last_180_days"))
    tested = F.when(full, F.col("resolved_live")).otherwise(F.col("resolved_recent"))
    return g.withColumn("available", (F.col("live_predictions") >= MIN_SIGNIFICANT) & (tested >= MIN_SIGNIFICANT))


def tested_rows(live: DataFrame, days: int = 180, min_rows: int = 5) -> DataFrame:
    """Rows of the period that :func:`significance_gate` names: the recent ones,
    or the whole sample when fewer than ``min_rows`` of it are recent."""
    as_of = live.agg(F.max("verdict_ts").alias("as_of"))  # one row, as is the next
    recent = F.col("verdict_ts") >= F.col("as_of") - F.make_dt_interval(F.lit(days))
    dated = live.join(F.broadcast(as_of))
    period = dated.agg(count_if(recent).alias("recent_rows"))
    return (dated.join(F.broadcast(period)).where(recent | (F.col("recent_rows") < min_rows))
            .drop("as_of", "recent_rows"))


def decoupling(log: DataFrame, days: int = 14, min_alerts: int = 5, floor: float = 0.40) -> DataFrame:
    """Series whose recent alerts mostly failed, as of their newest decision."""
    as_of = F.max("session").over(in_series())
    rows = log.withColumn("as_of", as_of).where(
        (F.col("session") >= F.date_sub("as_of", days)) & (F.col("dir") != 0) & F.col("actual").isNotNull())
    g = rows.groupBy("series_id").agg(F.count("*").alias("alerts"), count_if(F.col("correct")).alias("wins"))
    return g.withColumn("decoupled", (F.col("alerts") >= min_alerts)
                        & (F.col("wins") / F.col("alerts") < floor))


def confirmation(log: DataFrame, history: DataFrame) -> DataFrame:
    """Newest logged session that has a history row and a row before it.

    Uses the row before, not the previous business day: this report shows what
    was posted, the scored outcome applies the stricter rule.
    """
    rows = history.withColumn("prev", F.lag("response").over(by_session())).where("prev IS NOT NULL")
    both = log.join(rows.select("series_id", "session", F.col("response").alias("r"), "prev"),
                    ["series_id", "session"])
    g = both.groupBy("series_id").agg(F.max_by(F.struct(
        "session", "direction", "dir", ((F.col("r") - F.col("prev")) * 100).alias("move")), "session").alias("t"))
    return g.select("series_id", "t.*").withColumn("savings", F.col("dir") * F.col("move")).withColumn(
        "correct", F.col("savings") > 0).drop("dir")


def replay(log: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Re-apply the stored artifact to the settle move.

    ``match_full`` uses full thresholds only; ``match_all`` adds the lean and
    fallback-floor rules, under which a lean decision is no mismatch.
    """
    x, c = F.col("x"), F.col
    full = F.when(x >= c("artifact_hike"), "HIKE").when(x <= c("artifact_drop_"), "DROP").otherwise("FLAT")
    every = (F.when((x >= c("hike")) | (x >= c("lean_hike")), "HIKE")
             .when((x <= c("drop_")) | (x <= c("lean_drop")), "DROP").otherwise("FLAT"))
    modeled = F.when(c("modeled_action").isin("BUY_NOW", "LEAN_BUY"), "HIKE").when(
        c("modeled_action").isin("WAIT", "LEAN_WAIT"), "DROP").otherwise("FLAT")
    gap = F.abs(x - c("move"))
    return log.select(
        "series_id", "session", "artifact_id", full.alias("replayed"), (full == c("direction")).alias("match_full"),
        (every == modeled).alias("match_all"), gap.alias("gap"), (gap > tolerance).alias("gap_exceeded"))


def completeness(history: DataFrame, log: DataFrame, arts: DataFrame) -> DataFrame:
    """Sessions without a live decision, and what may be rebuilt for them.

    Only an artifact effective on exactly that session may be used; without one
    the gap stays a gap.
    """
    rows = (history.withColumn("x", (F.col("driver") - F.lag("driver").over(by_session())) * 100)
            .where("x IS NOT NULL").select("series_id", "session", "x"))
    have = log.where("prediction_source = 'live'").select("series_id", "session")
    a = arts.select("series_id", F.col("effective_session").alias("session"), "artifact_id", "hike", "drop_")
    missing = rows.join(have, ["series_id", "session"], "left_anti").join(a, ["series_id", "session"], "left")
    return missing.select(
        "series_id", "session", F.when(F.col("artifact_id").isNull(), "no_artifact").otherwise("backfilled").alias("status"),
        F.when(F.col("artifact_id").isNotNull(), F.when(F.col("x") >= F.col("hike"), "HIKE")
               .when(F.col("x") <= F.col("drop_"), "DROP").otherwise("FLAT")).alias("direction"))


def live_floor_check(live: DataFrame, floors: DataFrame, min_alerts: int = 20) -> DataFrame:
    """Precision by series and conviction band against a historical floor.

    ``floors`` has (series_id, floor); a series without one is ``no_floor``.
    """
    g = live.where("dir <> 0").groupBy("series_id", z_band(F.col("z")).alias("band")).agg(
        F.count("*").alias("alerts"), count_if(F.col("correct")).alias("hits"))
    g = g.join(floors, "series_id", "left")
    p = ratio(F.col("hits"), F.col("alerts"))
    return g.withColumn("precision", F.when(F.col("alerts") >= min_alerts, p)).withColumn(
        "status", F.when(F.col("alerts") < min_alerts, "insufficient").when(
            F.col("floor").isNull(), "no_floor").when(p >= F.col("floor"), "validated").otherwise("warning")).drop("floor")


def cumulative_trend(live: DataFrame, days: int = 90, min_rows: int = 10, fallback: int = 60) -> DataFrame:
    """Running savings of the recent rows and the mean of the last five alerts."""
    w = in_series().orderBy("session")
    rows = (live.withColumn("newest", F.max("session").over(in_series()))
            .withColumn("back", F.row_number().over(in_series().orderBy(F.col("session").desc()))))
    near = F.col("session") >= F.date_sub("newest", days)
    rows = rows.withColumn("near_n", F.sum(near.cast("int")).over(in_series()))
    rows = rows.where(F.when(F.col("near_n") < min_rows, F.col("back") <= fallback).otherwise(near))
    rows = rows.withColumn("cumulative", F.sum("savings").over(w))
    alerts = Window.partitionBy("series_id", "is_alert").orderBy("session").rowsBetween(-4, 0)
    rows = rows.withColumn("is_alert", F.col("dir") != 0)
    return rows.select("series_id", "session", "is_alert", "cumulative", F.when(
        F.col("is_alert"), F.avg("cumulative").over(alerts)).alias("trend"))


def snapshot_error(log: DataFrame) -> DataFrame:
    """How far the captured price lay from the settle, and what that changed."""
    err = (F.col("signal_price") - F.col("settle")) * 100
    rows = log.withColumn("e", err).withColumn("mid", F.percentile("e", 0.5).over(in_series()))
    on_settle = F.when(F.col("x") >= F.col("hike"), "BUY_NOW").when(F.col("x") <= F.col("drop_"), "WAIT").when(
        F.col("x") >= F.col("lean_hike"), "LEAN_BUY").when(F.col("x") <= F.col("lean_drop"), "LEAN_WAIT").otherwise("NO_EDGE")
    return rows.groupBy("series_id").agg(
        F.count("*").alias("n"), F.avg("e").alias("mean_error"),
        (1.4826 * F.percentile(F.abs(F.col("e") - F.col("mid")), 0.5)).alias("robust_sigma"),
        F.avg(F.abs("e")).alias("mean_abs"), F.percentile(F.abs("e"), 0.95).alias("p95_abs"),
        F.avg((on_settle != F.col("modeled_action")).cast("int")).alias("reclassified"))
