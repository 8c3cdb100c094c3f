"""Readers of nested, delimited and per-file records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.functions.calendar import MONTH_CODES
from sluice.functions.exprs import settle, tick_order
from sluice.session import shared_folder

QUOTE_SCHEMA = ("map<string, struct<reference: struct<futureActiveSymbol: string, futureIsActive: string>, "
                "quote: struct<symbol: string>, symbol: string>>")


def normalized_symbol(raw: Column, prefix: str) -> Column:
    """Upper-case symbol without exchange suffix, null unless well formed."""
    s = F.upper(F.trim(F.split(raw, ":", 2)[0]))
    s = F.when(s.startswith("/"), s).otherwise(F.concat(F.lit("/"), s))
    return F.when(s.rlike(f"^/{prefix}[{MONTH_CODES}][0-9]{{2}}$"), s)


def active_symbol(response: Column, prefix: str) -> Column:
    """Declared root symbol, else the only declared one, else the only flagged one.

    All three tiers read the entries of one response in place, so the choice is
    a projection and needs no explode or shuffle.
    """
    entries = F.map_entries(response)
    declared = F.array_distinct(F.array_compact(F.transform(
        entries, lambda e: normalized_symbol(e["value"]["reference"]["futureActiveSymbol"], prefix))))
    flagged = F.array_distinct(F.array_compact(F.transform(
        F.filter(entries, lambda e: F.lower(e["value"]["reference"]["futureIsActive"]) == "true"),
        lambda e: normalized_symbol(F.coalesce(
            e["value"]["quote"]["symbol"], e["value"]["symbol"], e["key"]), prefix))))
    root = normalized_symbol(F.element_at(response, f"/{prefix}")["reference"]["futureActiveSymbol"], prefix)
    only = lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0)))
    return F.coalesce(root, only(declared), only(flagged))


def candle_closes(payload: DataFrame, column: str) -> DataFrame:
    """(instrument, session, close) from JSON candle arrays, nulls skipped."""
    schema = "array<struct<datetime: bigint, close: double>>"
    rows = payload.select("instrument", F.inline(F.from_json(column, schema)))
    return (rows.where("datetime IS NOT NULL AND close IS NOT NULL")
            .select("instrument", F.to_date(F.timestamp_millis("datetime")).alias("session"), "close"))


def split_malformed(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Parsed columns, and ``quarantined`` for a short or unreadable line anywhere."""
    fields = [f.split()[0] for f in schema.split(", ")]
    parsed = F.from_csv(column, F.lit(f"{schema}, _bad STRING"),
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = lines.withColumn("r", parsed)
    # _bad is filled only when a field is requested, so the count is tested too.
    short = F.size(F.split(column, ",")) != len(fields)
    return out.select("*", "r.*").withColumn("quarantined", F.col("_bad").isNotNull() | short).drop("r", "_bad")


LEDGER_SCHEMA = ("artifact_id string, effective_session string, training_end string, "
                 "calibration struct<hike: double, drop_: double>")


def checked_lines(lines: DataFrame, column: str) -> DataFrame:
    """Ledger lines with what is wrong with each; a bad line stops no other."""
    parsed = F.from_json(column, f"{LEDGER_SCHEMA}, _bad string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.withColumn("r", parsed)
    field = lambda n: F.col(f"r.{n}")
    missing = field("artifact_id").isNull() | field("effective_session").isNull() | field("calibration").isNull()
    status = (F.when(field("_bad").isNotNull(), "unreadable").when(missing, "missing_field")
              .when(field("effective_session").try_cast("date").isNull(), "bad_date").otherwise("ok"))
    return rows.withColumn("status", status)


def export(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write a result as parquet, csv or json; existing output is not replaced."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)


def write_and_check_stems(records: DataFrame, stem: str, expected: Column) -> DataFrame:
    """Write records under a name per stem and read back what disagrees.

    The stem that is checked is the one in the path of the file a record came
    from, not a column of the record.  The folder is a new one below the shared
    checkpoint directory.
    """
    spark = records.sparkSession
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    schema = records.drop(stem).schema
    records.repartition(stem).write.partitionBy(stem).json(path)
    # Every file as it lies, without partition columns.
    back = spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    filed = F.regexp_extract(F.col("_metadata.file_path"), f"/{stem}=([^/]+)/", 1)
    return back.withColumn(stem, filed).withColumn("stem_ok", expected)


def priority_pick(candidates: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Candidate of lowest priority number per key that has a ``value`` at all.

    A minimum over (priority, value) is combined before the shuffle, unlike a
    ranking window over all candidates.
    """
    rest = [c for c in candidates.columns if c not in keys and c != "priority"]
    return candidates.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(F.struct("priority", *rest)).alias("r")).select(*keys, "r.*")


def overlay(layers: DataFrame, keys: list[str], policy_suffixes: tuple[str, ...],
            stale_suffixes: tuple[str, ...], cache_rank: int) -> DataFrame:
    """Effective value per key: the highest layer wins.

    Policy keys are never taken from the generated cache layer, and keys of a
    retired engine are dropped from every layer.
    """
    name = F.col("name")
    ends = lambda suffixes: name.rlike("(" + "|".join(suffixes) + ")$")
    kept = layers.where(~ends(stale_suffixes) & ~((F.col("rank") == cache_rank) & ends(policy_suffixes)))
    return kept.groupBy(*keys, "name").agg(
        F.max_by("value", "rank").alias("value"), F.max("rank").alias("rank"))


def session_bars(ticks: DataFrame) -> DataFrame:
    """Open, high, low, close per (instrument, session), combined before the shuffle."""
    at = tick_order()
    return ticks.groupBy("instrument", "session").agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", at).alias("close"), F.count("*").alias("ticks"))


def bar_context(bars: DataFrame) -> DataFrame:
    """Levels known strictly before each session: 5-session range and averages."""
    w = Window.partitionBy("instrument").orderBy("session")
    back = lambda k: w.rowsBetween(-k, -1)
    n = F.row_number().over(w) - 1
    return (bars.withColumn("high_5", F.max("close").over(back(5)))
            .withColumn("low_5", F.min("close").over(back(5)))
            .withColumn("mean_30", F.avg("close").over(back(30)))
            .withColumn("sma_3", F.when(n >= 3, F.avg("close").over(back(3))))
            .withColumn("sma_10", F.when(n >= 10, F.avg("close").over(back(10))))
            .withColumn("prior_close", F.lag("close").over(w)))


def upsert_ticks(ticks: DataFrame, stamp: Column) -> DataFrame:
    """One price per (instrument, session, stamp): the last written wins."""
    return ticks.groupBy("instrument", "session", stamp.alias("stamp")).agg(
        F.max_by("px", "event_id").alias("px"), F.count("*").alias("writes"))


SWING_PCT = 1.5


def traded_contract(st: Column) -> Column:
    """The contract month quoted at a time of the session clock, which is seven hours ahead of the local one.

    Quotes go over to the next month's contract at noon, eleven days before a month of
    31 days ends: inside a session.
    """
    return F.date_format(st + F.expr("INTERVAL 10 DAYS 5 HOURS"), "yyyy-MM")


def polls(ticks: DataFrame) -> DataFrame:
    """Last quote of every five-minute slot, as the tracker polls it, with the contract quoted then."""
    slot = F.floor(F.hour("lt") * 12 + F.minute("lt") / 5).cast("int")
    contract = traded_contract(F.col("lt") + F.expr("INTERVAL 7 HOURS"))
    return ticks.groupBy("instrument", "session", F.to_date("lt").alias("day"), slot.alias("slot")).agg(
        F.max_by("px", tick_order()).alias("px"), F.max(contract).alias("contract"))


def swing_alerts(polled: DataFrame, bars: DataFrame) -> DataFrame:
    """Alerts at 1.5% from the last alert of the session and contract, else from the prior close.

    A contract that takes over inside a session starts from the prior close again.  A session has at most 288 polls, so its fold runs over one bounded array,
    and each (instrument, session) folds on its own.
    """
    ref = bars.select("instrument", "session", F.coalesce("prior_close", "open").alias("baseline"))
    g = polled.groupBy("instrument", "session").agg(
        F.sort_array(F.collect_list(F.struct("day", "slot", "px", "contract"))).alias("p"))
    g = g.join(ref, ["instrument", "session"])
    entry = "struct<day: date, slot: int, contract: string, px: double, swing: double>"
    state = F.struct(F.lit(None).cast("double").alias("ref"), F.lit("").alias("contract"),
                     F.array().cast(f"array<{entry}>").alias("alerts"))

    def step(acc: Column, p: Column) -> Column:
        ref = F.when(acc["contract"] == p["contract"], acc["ref"]).otherwise(F.col("baseline"))
        swing = (p["px"] - ref) / ref * 100
        hit = F.abs(swing) >= SWING_PCT
        alert = F.struct(p["day"].alias("day"), p["slot"].alias("slot"), p["contract"].alias("contract"),
                         p["px"].alias("px"), swing.alias("swing"))
        return F.struct(
            F.when(hit, F.round(p["px"], 4)).otherwise(acc["ref"]).alias("ref"),
            F.when(hit, p["contract"]).otherwise(acc["contract"]).alias("contract"),
            F.when(hit, F.concat(acc["alerts"], F.array(alert))).otherwise(acc["alerts"]).alias("alerts"))

    folded = settle(g, a=F.aggregate("p", state, step, lambda acc: acc["alerts"]))
    return folded.select("instrument", "session", F.inline("a"))
