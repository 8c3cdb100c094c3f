"""Calibration artifacts, the decision log, and insert-only ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.functions.exprs import settle
from sluice.operators import commits, decide, fit as m
from sluice.operators.align import in_series
from sluice.operators.evaluate import origin_rows
from sluice.session import durable

# Artifacts are published every 20 pairs from the first full window on.
ARTIFACT_FIRST, ARTIFACT_STEP = m.FIT_WINDOW, 20
GENESIS = "bootstrap_config"
BUY_COST, WAIT_COST = 0.5, 1.25


def micro(c: str) -> Column:
    """A double as whole millionths in text, equal on any engine."""
    return F.round(F.col(c) * 1e6).cast("long").cast("string")


def artifacts(train: DataFrame) -> DataFrame:
    """One immutable calibration per (series, block), hash chained.

    The id covers the content and the id before it, so the chain is a fold over
    the ordered artifacts of a series; there is at most one per 20 sessions.
    """
    keys = ["series_id", "block"]
    tagged = origin_rows(train, ARTIFACT_FIRST, ARTIFACT_STEP)
    fitted = m.with_fit(tagged, keys, F.col("is_train"))
    inside = lambda c: F.when(F.col("is_train"), F.col(c))
    g = fitted.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("slope", "intercept", "r2", "rows", "syy")],
        F.percentile("resid", m.quantile_targets()).alias("q"),
        m.quantile_grid(F.col("resid")).alias("grid"),
        F.min(F.when(~F.col("is_train"), F.col("session"))).alias("effective_session"),
        F.min(inside("session")).alias("training_start"),
        F.max(inside("session")).alias("training_end"),
        F.round(F.stddev_samp(inside("x")), 4).alias("daily_std"))
    g = m.with_thresholds(g.withColumn("sigma", m.sigma()), F.col("q"))
    g = g.withColumns({c: F.round(c, 6) for c in ("slope", "intercept", "sigma", "r2")})
    g = g.withColumns({c: F.round(c, 2) for c in ("hike", "drop_", "lean_hike", "lean_drop")})
    core = F.concat_ws("|", "series_id", *[F.col(c).cast("string") for c in (
        "effective_session", "training_start", "training_end", "rows")], *[micro(c) for c in (
            "slope", "intercept", "hike", "drop_", "lean_hike", "lean_drop", "daily_std")])
    g = g.where(F.col("fit_error").isNull()).withColumn("core", core).drop("q", "syy", "fit_error")
    rest = [c for c in g.columns if c not in ("series_id", "block")]
    chain = g.groupBy("series_id").agg(F.sort_array(F.collect_list(
        F.struct("block", F.struct(*rest).alias("r")))).alias("a"))
    ids = F.aggregate("a", F.array(F.lit(GENESIS)), lambda acc, s: F.concat(acc, F.array(
        F.sha2(F.concat_ws("|", F.element_at(acc, -1), s["r"]["core"]), 256))))
    links = settle(chain, ids=ids).select("series_id", F.inline(F.transform(
        "a", lambda s, i: F.struct(s["block"].alias("block"), s["r"].alias("r"),
                                   F.get("ids", i).alias("prior_artifact_id"),
                                   F.get("ids", i + 1).alias("artifact_id")))))
    return links.select("series_id", "block", "r.*", "prior_artifact_id", "artifact_id")


def byte_of(at: int, *keys: str) -> Column:
    """Deterministic byte of a row, for proxy columns the tables lack."""
    salt = [F.lit("x")] if at >= 16 else []
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], *salt)
    return F.conv(F.substring(F.md5(key.cast("binary")), 2 * (at % 16) + 1, 2), 16, 10).cast("int")


def decision_log(train: DataFrame, arts: DataFrame) -> DataFrame:
    """One decision per (session, series) under the artifact of its block.

    The signal price is a snapshot that differs from the settle by up to half
    a cent; provenance columns come from a hash of the key.
    """
    block = F.floor((F.col("ord") - 1 - ARTIFACT_FIRST) / ARTIFACT_STEP)
    b = lambda i: byte_of(i, "series_id", "session")
    rows = train.where(F.col("ord") > ARTIFACT_FIRST).select(
        "series_id", "session", "prior_session", "ord", "n", "x", "y",
        F.col("driver").alias("settle"), F.col("prior_driver").alias("baseline_price"),
        F.col("response"), "prior_response", block.alias("block"),
        F.when(b(0) < 16, "backfill").when(b(0) < 24, "").when(b(0) < 28, F.lit(None))
        .when(b(0) < 32, "imported").otherwise("live").alias("raw_source"),
        F.when(b(1) < 12, "live_proxy:quote").when(b(1) < 18, F.lit(None))
        .otherwise("exchange_snapshot").alias("settlement_source"),
        F.when(b(2) < 16, "exchange_close").when(b(2) < 40, "history_same_contract")
        .otherwise("provenance_verified").alias("baseline_source"),
        (F.to_timestamp_ntz(F.col("session").cast("string"), F.lit("yyyy-MM-dd"))
         + F.make_dt_interval(F.lit(0), F.lit(14), 35 + b(3) % 85)).alias("verdict_ts"),
        F.when(F.col("ord") > F.col("n") - 5, "PENDING").when(b(4) < 4, "NO_PRIOR_SESSION")
        .otherwise("RESOLVED").alias("outcome_status"),
        (F.col("driver") + (b(5) - 128) / 25600.0
         + F.when(b(5) == 0, 0.03).otherwise(0.0)).alias("signal_price"))
    cols = ["series_id", "block", "artifact_id", "effective_session", "slope", "intercept",
            "daily_std", "grid", "hike", "drop_", "lean_hike", "lean_drop"]
    log = rows.join(arts.select(*cols), ["series_id", "block"])
    log = log.withColumn("move", (F.col("signal_price") - F.col("baseline_price")) * 100)
    log = log.withColumns({f"artifact_{c}": F.col(c) for c in ("hike", "drop_", "lean_hike", "lean_drop")})
    log = log.withColumns(decide.effective_thresholds(F.col("baseline_source")))
    p_up = m.probability_up(F.col("grid"), F.col("move"))
    log = (log.withColumn("expected", F.col("intercept") + F.col("slope") * F.col("move"))
           .withColumn("p", m.probability_correct(p_up, F.col("move"))).drop("grid")
           .withColumn("z", F.col("move") / F.nullif(F.col("daily_std"), F.lit(0.0)))
           .withColumn("modeled_action", decide.action_ladder(F.col("move"))))
    value = m.economic_value(F.col("modeled_action"), F.col("expected"), F.lit(m.TRUCK_GALLONS),
                             F.lit(BUY_COST), F.lit(WAIT_COST))
    act = F.col("modeled_action")
    log = log.withColumn("net_edge", value["net_edge_cents"]).withColumn(
        "final_action", F.when(act.isin(*decide.ACTIONS) & (F.col("net_edge") <= 0), "NO_EDGE").otherwise(act))
    known = F.col("raw_source").isin("live", "backfill", "unlabelled")
    resolved = F.col("outcome_status") == "RESOLVED"
    digits = F.lpad(F.round(F.col("p") * 10000).cast("int").cast("string"), 4, "0")
    log = (log.withColumn("direction", decide.direction_of(F.col("final_action")))
           .withColumn("threshold_used", decide.threshold_used(F.col("final_action")))
           .withColumn("prediction_source", F.when(known, F.col("raw_source")).otherwise("unlabelled"))
           .withColumn("label", F.concat(decide.confidence_label(F.col("p")), F.lit(" | p=0."), digits))
           .withColumn("actual", F.when(resolved, F.col("y"))))
    side = F.when(F.col("direction") == "HIKE", 1).when(F.col("direction") == "DROP", -1).otherwise(0)
    return (log.withColumn("dir", side)
            .withColumn("savings", F.col("dir") * F.col("actual"))
            .withColumn("correct", F.coalesce(F.col("savings") > 0, F.lit(False))))


def settlement_based(source: Column) -> Column:
    """Decided from a captured snapshot; unknown sources count as proxies."""
    return ~F.coalesce(source, F.lit("unknown")).rlike("^(live_proxy|legacy_unknown|unknown)")


def append_absent(ledger: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key the ledger lacks, one per key, with a ``conflict`` flag.

    A key delivered several times appends once if its rows agree.  Different
    rows for one key are a conflict: the smallest row is shown, so that a re-run
    shows the same one, and the flag says that it must not be appended as it is.
    """
    fresh = incoming.join(ledger.select(*keys), keys, "left_anti")
    row = F.struct(*[c for c in incoming.columns if c not in keys])
    return fresh.groupBy(*keys).agg(F.min(row).alias("r"), F.max(row).alias("q")).select(
        *keys, "r.*", (~F.col("r").eqNullSafe(F.col("q"))).alias("conflict"))


def table_at(path: str, like: DataFrame) -> DataFrame:
    """The rows committed under ``path``; none before the first append."""
    return commits.latest(like.sparkSession, path).rows(like.sparkSession, like.schema).select(*like.columns)


def month_of(session: str) -> Column:
    """The partition of a row; rows without a session have one of their own."""
    return F.coalesce(F.date_format(session, "yyyy-MM"), F.lit("none"))


def append_table(incoming: DataFrame, path: str, keys: list[str], session: str = "session",
                 writer: str | None = None, batch: int | None = None) -> DataFrame:
    """Append what the table at ``path`` lacks and tell what became of every incoming key.

    ``appended`` rows are new.  ``present`` ones are filed already just so, which
    makes a re-run append nothing.  A key that is filed with another row, or that
    arrives with different rows, is a ``conflict`` and changes nothing.  The table
    is partitioned by month, and only the months that arrive are read.  Appends may
    run side by side: one commits first, the other decides anew over what it filed.
    The ``batch`` of a ``writer`` is filed once; a repeated one is told as such.
    The session has to be among the keys, since a key belongs to one month.
    """
    if session not in keys:
        raise ValueError(f"{session} must be one of the keys")
    spark, rows = incoming.sparkSession, incoming.withColumn("month", month_of(session))
    row = F.struct(*[c for c in incoming.columns if c not in keys])
    arriving = durable(rows.groupBy("month", *keys).agg(F.min(row).alias("r"), F.max(row).alias("q")))
    months = {r["month"] for r in arriving.select("month").distinct().collect()}  # bounded by the calendar
    same_keys = F.lit(True)
    for k in ("month", *keys):
        same_keys = same_keys & F.col(f"arriving.{k}").eqNullSafe(F.col(f"filed.{k}"))
    status = (F.when(~F.col("r").eqNullSafe(F.col("q")), "conflict").when(F.col("known").isNull(), "appended")
              .when(F.col("old").eqNullSafe(F.col("r")), "present").otherwise("conflict"))

    def decide(filed: DataFrame) -> tuple[DataFrame, DataFrame]:
        known = filed.select("month", *keys, row.alias("old"), F.lit(True).alias("known")).alias("filed")
        decided = durable(arriving.alias("arriving").join(known, same_keys, "left").select(
            "arriving.*", "old", "known").withColumn("status", status))
        return decided.where("status = 'appended'").select("month", *keys, "r.*").select(*rows.columns), decided.select(*keys, "status")

    told = commits.append(spark, path, rows.schema, decide, months, writer, batch)
    return arriving.select(*keys, F.lit("repeated").alias("status")) if told is None else told


def append_status(ledger: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """same / conflict / out_of_order / broken_chain / training_back / new, per incoming artifact.

    Every distinct id of a session has its own row: a session that is filed with
    another id, or that arrives with two ids in one batch, is a conflict.  The
    artifacts that are new must follow one another in session order behind the
    newest entry of their series, name the one before them as ``prior_artifact_id``
    and may not move ``training_end`` back.  A series' ledger is one window; its
    rows are bounded by its sessions.
    """
    cols = ["series_id", key, "artifact_id", "prior_artifact_id", "training_end"]
    old = ledger.select(*cols).distinct().withColumn("filed", F.lit(True))
    new = incoming.select(*cols).distinct().withColumn("filed", F.lit(False))
    same_key = Window.partitionBy("series_id", key)
    both = old.unionByName(new).withColumn("old_id", F.max(F.when(F.col("filed"), F.col("artifact_id"))).over(same_key))
    arriving = F.when(~F.col("filed"), F.col("artifact_id"))
    both = both.withColumn("ids", F.size(F.collect_set(arriving).over(same_key)))
    newest = F.max(F.when(F.col("filed"), F.col(key))).over(in_series())
    both = both.withColumn("newest", newest)
    # The chain runs over filed entries and over arrivals that nothing else speaks against.
    sound = F.col("filed") | (F.col("old_id").isNull() & (F.col("ids") == 1)
                              & F.coalesce(F.col(key) > F.col("newest"), F.lit(True)))
    before = in_series().orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(sound, F.struct("artifact_id", "training_end")), ignorenulls=True).over(before)
    both = both.withColumn("last", last)
    status = (F.when(F.col("old_id") == F.col("artifact_id"), "same")
              .when(F.col("old_id").isNotNull() | (F.col("ids") > 1), "conflict")
              .when(F.col(key) < F.col("newest"), "out_of_order")
              .when(F.col("prior_artifact_id") != F.coalesce("last.artifact_id", F.lit(GENESIS)), "broken_chain")
              .when(F.col("training_end") < F.col("last.training_end"), "training_back").otherwise("new"))
    return both.withColumn("status", status).where(~F.col("filed")).select(
        "series_id", key, "old_id", F.col("artifact_id").alias("new_id"), "status")


def file_artifacts(incoming: DataFrame, path: str, key: str = "effective_session") -> DataFrame:
    """File the artifacts that continue the chains of the ledger at ``path``, and tell what became of each.

    The status is that of ``append_status`` over what is filed; an artifact behind a broken or refused link of its
    series is ``held_back``, since its own predecessor is not filed.  So a filed chain has no gap, also when two
    deliveries run side by side: the second is judged over what the first has committed.
    """
    rows = incoming.withColumn("month", month_of(key))
    before = in_series().orderBy(key).rowsBetween(Window.unboundedPreceding, -1)

    def decide(filed: DataFrame) -> tuple[DataFrame, DataFrame]:
        told = append_status(filed, rows, key)
        broken = F.max(F.col("status").isin("broken_chain", "training_back")).over(before)
        told = durable(told.withColumn("status", F.when((F.col("status") == "new") & broken, "held_back").otherwise(F.col("status"))))
        taken = told.where("status = 'new'").select("series_id", key, F.col("new_id").alias("artifact_id"))
        return rows.join(taken, ["series_id", key, "artifact_id"], "left_semi").dropDuplicates(["series_id", key]), told

    return commits.append(incoming.sparkSession, path, rows.schema, decide)


def current_rows(ledger: DataFrame) -> DataFrame:
    """Rows no later record supersedes; absent references never enter the join."""
    gone = (ledger.where(F.col("supersedes").isNotNull())
            .select(F.col("supersedes").alias("record_id")).distinct())
    return ledger.join(gone, "record_id", "left_anti")
