"""Balanced shards by sampled splitters (native DataFrame operations only).

Records are ordered by (hash of the text, id).  A size-weighted sample of these keys gives quantile boundaries; the
boundaries cut the records into many fine ranges whose exact sizes are then counted.  A range that turned out overfull,
because the sample missed or one text is very frequent, is sampled again by itself, now by (hash, id), until it is
subdivided.  Each fine range is one window partition; the ranges' exact sizes, a table of bounded length, place every
record at its byte position in the whole order, and the position decides the shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import parked, range_of

#: Fine ranges at least, and records that a fine range holds on average at most (up to MOST_RANGES ranges).
LEAST_RANGES, RANGE_ROWS, MOST_RANGES = 256, 200_000, 8192
#: Sampled keys for each fine range.
PER_RANGE = 24
#: Records with one text stay in one shard while they take less than this part of a shard.
WHOLE_PART = 1 / 256


def _splitters(rows: DataFrame, bytes_each: float, whole_groups: bool, turn: int = 0) -> list[tuple]:
    """Keys at about every ``bytes_each`` bytes of ``rows``, from a sample that prefers large records; one for each turn."""
    share = F.col("size") * PER_RANGE / F.lit(float(bytes_each))
    draw = F.pmod(F.xxhash64("key", "tie", F.lit("draw"), F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    weight = F.floor(share) + F.when(draw < share - F.floor(share), 1).otherwise(0)
    sample = rows.select("key", "tie", weight.alias("weight")).where("weight > 0")
    if whole_groups:
        sample = sample.groupBy("key").agg(F.min("tie").alias("tie"), F.sum("weight").alias("weight"))
    cuts, held = [], 0
    # The sample is bounded: PER_RANGE keys for each of at most MOST_RANGES ranges, however many records there are.
    for r in sorted(sample.collect(), key=lambda r: (r["key"], r["tie"])):
        held += r["weight"]
        if held >= PER_RANGE:
            cuts.append((r["key"], -(1 << 63) if whole_groups else r["tie"]))
            held = 0
    return sorted(set(cuts))


def _with_range(rows: DataFrame, cuts: list[tuple]) -> DataFrame:
    return rows.withColumn("range", range_of(F.struct(F.col("key").alias("k0"), F.col("tie").alias("k1")), cuts))


def sharded(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every record of ``docs`` with its shard under the law ``bytes``: shard totals are near equal.

    Returns id, size (UTF-8 bytes plus 1), text_crc32, shard, slot.  Null text: size 1, checksum of the empty text.
    Null ids order first; repeated rows each get their own slot.  Equal texts share a shard unless together they take
    ``WHOLE_PART`` of it or more; then, and only then, they are subdivided by id.  An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = parked(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("tie")), "shard-rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, n // RANGE_ROWS))
    ideal = max(1.0, total / ranges)

    cuts, turn = _splitters(rows, ideal, whole_groups=True), 0
    while True:  # each turn but the last adds a cut, so what is counted last belongs to the cuts that stay
        placed = _with_range(rows, cuts)
        counted = sorted(placed.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
                         .collect(), key=lambda r: r["range"])
        over, turn = [r["range"] for r in counted if r["size"] > 4 * ideal], turn + 1
        # An overfull range shrinks by the sample's factor each time; ties of one id stay together.
        finer = _splitters(placed.where(F.col("range").isin(over)), ideal, whole_groups=False, turn=turn) if over else []
        more = sorted(set(cuts) | set(finer))
        if len(more) == len(cuts):
            break
        cuts = more

    spark = docs.sparkSession
    before, table = (0, 0), []
    for r in counted:
        table.append((r["range"], before[0], before[1]))
        before = (before[0] + r["size"], before[1] + r["n"])
    offsets = spark.createDataFrame(table, "range int, bytes_before long, rows_before long")

    order = Window.partitionBy("range").orderBy("key", "tie")
    group = Window.partitionBy("range", "key")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # One fine range per window partition; the offsets have one row for each of the bounded number of ranges.
    at = (_with_range(rows, cuts).join(F.broadcast(offsets), "range")
          .withColumn("start", F.col("bytes_before") + upto - F.col("size"))
          .withColumn("rank", F.col("rows_before") + F.row_number().over(order) - 1)
          .withColumn("group_start", F.min("start").over(group))
          .withColumn("group_size", F.sum("size").over(group)))
    whole = F.col("group_size") < F.lit(WHOLE_PART * total / shards)
    place = F.when(whole, F.col("group_start") + F.col("group_size") / 2).otherwise(F.col("start") + F.col("size") / 2)
    at = parked(at.select("id", "size", "text_crc32", "rank", F.least(
        F.floor(place * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int").alias("shard")), "shard-placed")
    first = at.groupBy("shard").agg(F.min("rank").alias("first"))  # one row a shard
    return at.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))
