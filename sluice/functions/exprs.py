"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def r6(col: Column | str) -> Column:
    """Six decimals, with negative zero folded into zero."""
    return F.round(col, 6) + F.lit(0.0)


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, null where the denominator is zero."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def count_if(cond: Column) -> Column:
    """Rows on which ``cond`` holds; an empty group counts zero."""
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def clip(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def draw(key: Column, word: int | Column, n: Column) -> Column:
    """Uniform draw in ``[0, n)`` from 32 bits of ``md5(key)``.

    One digest holds four words, so ``word`` selects which eighth-of-digest is
    read.  Draws depend only on the key: a re-run task repeats them exactly.
    """
    start = (F.lit(word) if isinstance(word, int) else word) * 8 + 1
    hexa = F.substring(F.md5(key.cast("binary")), start, F.lit(8))
    return F.conv(hexa, 16, 10).cast("long") % n


def tick_order(ts: str = "ts", tie: str = "event_id") -> Column:
    """Order of ticks by time, then id, as one fixed-width number.

    A struct would order the same way but cannot live in a hash aggregate's
    buffer, so every ``max_by`` over it would sort the raw rows on the map side.
    """
    return F.expr(f"CAST(unix_micros(CAST({ts} AS TIMESTAMP)) AS DECIMAL(18,0)) * 10000000000000000000BD + {tie}")


def array_quantile(arr: Column, q: Column | float) -> Column:
    """Linear-interpolation quantile of an ascending array."""
    q = F.lit(q) if isinstance(q, float) else q
    pos = (F.size(arr) - 1) * q
    lo = F.floor(pos).cast("int")
    hi = F.ceil(pos).cast("int")
    a, b = F.element_at(arr, lo + 1), F.element_at(arr, hi + 1)
    return a + (b - a) * (pos - lo)


def wilson(successes: Column, trials: Column, z: float = 1.959963985) -> tuple[Column, Column]:
    """Wilson score interval of a proportion, null when nothing was tried."""
    n = F.nullif(trials.cast("double"), F.lit(0.0))
    p = successes.cast("double") / n
    den = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / den
    half = (z / den) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (F.when(n.isNotNull(), F.greatest(F.lit(0.0), centre - half)),
            F.when(n.isNotNull(), F.least(F.lit(1.0), centre + half)))


def settle(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later lambdas read as values.

    An expression used inside an array lambda may be merged into it and then
    run once per element.  Emitting the columns from a one-row generator keeps
    them out of reach of that merge, so each is computed once per row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into a given number of partitions.

    Stands where a window or group over ``keys`` would shuffle anyway.  Naming
    the count matters because the rows are few bytes and much work: left to
    itself, the adaptive planner would merge them into one task.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def replicate_chunks(df: DataFrame, chunks: int) -> DataFrame:
    """``chunks`` copies of every row, each on a task of its own."""
    copies = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return spread(copies, "series_id", "chunk")


def replicates(df: DataFrame, reps: int, chunks: int) -> DataFrame:
    """``rep`` 1..reps for every row, spread over ``chunks`` tasks per row.

    Only ``chunks`` copies of a row are shuffled; the replicates of a chunk are
    unfolded behind the shuffle.
    """
    return replicate_chunks(df, chunks).withColumn("rep", F.explode(F.sequence(
        F.col("chunk") + 1, F.lit(reps), F.lit(chunks))))


def draws(prefix: Column, count: Column, n: Column) -> Column:
    """Array of ``count`` draws in ``[0, n)`` keyed by ``prefix`` and position.

    One digest per array seeds an integer mixer that stays below 2^62, so the
    draws repeat on any engine and a re-run task yields the same sample.
    """
    p31 = 2147483647
    base = F.conv(F.substring(F.md5(prefix.cast("binary")), F.lit(1), F.lit(7)), 16, 10).cast("long")
    start = F.transform(
        F.sequence(F.lit(1).cast("long"), count.cast("long")),
        lambda i: (base + i * F.lit(1640531527)) % F.lit(p31))
    fold = lambda v: v.bitwiseXOR(F.shiftright(v, 16))
    mixed = F.transform(start, lambda v: fold(v) * F.lit(73244475) % F.lit(p31))
    mixed = F.transform(mixed, lambda v: fold(v) * F.lit(73244475) % F.lit(p31))
    return F.transform(mixed, lambda v: (fold(v) % n).cast("int"))
