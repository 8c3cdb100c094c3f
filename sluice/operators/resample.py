"""Resampling of paired loss series.

A resampled mean only needs sums over blocks, and a block sum is the
difference of two running sums.  A replicate therefore costs one look-up per
block, not one per row, and no replicate x row table is ever built.  The
arrays hold one entry per session, which the calendar bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sluice.functions.draws import hashed_draws
from sluice.functions.exprs import replicate_chunks
from sluice.session import durable


def block_totals(rows: DataFrame, order: str, columns: Sequence[str], block: int, reps: int,
                 seed: str, chunks: int = 16) -> DataFrame:
    """(series_id, rep, n, <columns>): totals of moving-block samples.

    Blocks are contiguous and not circular; the last one is cut so that every
    sample has the length of the series.  All columns of a replicate share the
    same draws, which keeps comparisons paired.
    """
    columns = list(columns)
    w = Window.partitionBy("series_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select("series_id", order, *[F.sum(c).over(w).alias(c) for c in columns])
    arr = sums.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("p"))
    work = replicate_chunks(arr.select("series_id", *[
        F.col(f"p.{c}").alias(c) for c in columns]), chunks)

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                n = len(row[columns[0]])
                length = min(block, n)
                k = math.ceil(n / length)
                mine = np.arange(row["chunk"] + 1, reps + 1, chunks)
                starts = np.stack([hashed_draws(f"{seed}|{block}|{row['series_id']}|{r}", k, n - length + 1)
                                   for r in mine])
                ends = starts + np.minimum(length, n - np.arange(k) * length)
                out = {"series_id": row["series_id"], "rep": mine, "n": n}
                for c in columns:
                    run = np.concatenate([[0.0], row[c]])
                    out[c] = (run[ends] - run[starts]).sum(1)
                yield pd.DataFrame(out)

    fields = ", ".join(f"{c} double" for c in columns)
    return work.mapInPandas(sample, f"series_id string, rep int, n int, {fields}")


def block_intervals(rows: DataFrame, order: str, columns: Sequence[str], block: int, reps: int,
                    seed: str, confidence: float = 0.95, mean: bool = True) -> DataFrame:
    """Interval of the mean (or total) of each column, one row per column."""
    alpha = (1 - confidence) / 2
    totals = block_totals(rows, order, columns, block, reps, seed)
    scale = F.col("n") if mean else F.lit(1)
    ends = F.array(F.lit(alpha), F.lit(1 - alpha))
    wide = totals.groupBy("series_id").agg(*[
        F.percentile(F.col(c) / scale, ends).alias(c) for c in columns])
    return wide.select("series_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c)[0].alias("low"), F.col(c)[1].alias("high"))
        for c in columns])))


def iid_mean_interval(values: DataFrame, reps: int, seed: str, chunks: int = 32) -> DataFrame:
    """95% interval of the mean of ``v`` per series by iid resampling."""
    arr = values.groupBy("series_id").agg(F.sort_array(F.collect_list("v")).alias("a"))

    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sid, chunk, a in zip(batch["series_id"], batch["chunk"], batch["a"]):
                mine = range(chunk + 1, reps + 1, chunks)
                yield pd.DataFrame({"series_id": sid, "m": [
                    a[hashed_draws(f"{seed}|{sid}|{r}", len(a), len(a))].mean() for r in mine]})

    work = replicate_chunks(arr.where(F.size("a") > 0), chunks)
    return (work.mapInPandas(means, "series_id string, m double").groupBy("series_id").agg(
        F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
        .select("series_id", F.col("ci")[0].alias("mean_low"), F.col("ci")[1].alias("mean_high")))


#: Vectors (a series' days of one stratum) that one task multiplies, about, and the parts that replicates are dealt in.
VECTORS, REP_PARTS = 1024, 8


def _earned(vectors: pd.DataFrame, orders: pd.DataFrame) -> pd.DataFrame:
    """What some vectors earn under each replicate's order of the days.

    What one day earns from the outcomes of another is a sum of products over the vectors of a stratum: a matrix of days
    by days that stays here.  A replicate picks one entry of each of its rows.
    """
    moves = dict(iter(orders.groupby("stratum", sort=False)))
    reps = np.sort(orders["rep"].unique())
    total = np.zeros(len(reps))
    for stratum, part in vectors.groupby("stratum", sort=False):
        signals, outcomes = (np.stack(part[c].to_numpy()).astype(float) for c in ("dir", "y"))
        earned, mine = signals.T @ outcomes, moves[stratum]
        donors = np.stack(mine["donors"].to_numpy()) - 1
        total[np.searchsorted(reps, mine["rep"])] += earned[np.arange(len(earned)), donors].sum(1)
    return pd.DataFrame({"rep": reps, "t": total})


def date_block_permutation(log: DataFrame, reps: int, seed: str) -> DataFrame:
    """Total savings against outcomes permuted among like-covered sessions.

    ``log`` has (series_id, session, dir, y).  A session's outcomes move as one
    block and only between sessions that hold the same set of series, its
    stratum.  Days are shuffled once per replicate and stratum, whatever the
    number of series.  Vectors of a bounded number are held by one task, which
    gets the orders of its strata in parts and hands on one total per replicate:
    no table of pairs of days leaves a task.
    """
    day = log.groupBy("session").agg(
        F.count("*").alias("k"), F.countDistinct("series_id").alias("distinct_series"),
        F.bit_xor(F.xxhash64("series_id")).alias("sig"),
        F.sum(F.xxhash64("series_id", F.lit(1)).cast("decimal(38,0)")).alias("sig2"))
    violations = day.where("k <> distinct_series").agg(F.count("*").alias("duplicate_sessions"))
    day = day.select("session", F.concat_ws("|", "sig", F.col("sig2").cast("string"), "k").alias("stratum"))
    places = day.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy("session")))

    one = log.groupBy("session", "series_id").agg(F.sum("dir").alias("dir"), F.sum("y").alias("y"))
    vectors = one.join(places, "session").groupBy("stratum", "series_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "dir", "y"))).alias("v"))
    vectors = durable(vectors.select("stratum", "series_id", F.col("v.dir").alias("dir"), F.col("v.y").alias("y")))
    chunks = -(-vectors.count() // VECTORS) or 1
    vectors = vectors.withColumn("chunk", F.pmod(F.xxhash64("stratum", "series_id"), F.lit(chunks)))

    dealt_in = min(REP_PARTS, reps)
    # The day that comes i-th by its hash is the donor of the i-th day.
    spread = places.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    order = F.md5(F.concat_ws("|", F.lit(seed), "rep", F.col("session").cast("string")).cast("binary"))
    orders = spread.groupBy("rep", "stratum").agg(
        F.sort_array(F.collect_list(F.struct(order.alias("o"), "place"))).alias("d"))
    orders = orders.select("rep", "stratum", F.col("d.place").alias("donors"), (F.col("rep") % dealt_in).alias("part"))
    needed = vectors.select(F.col("chunk").alias("of"), F.col("stratum").alias("needed")).distinct()
    parts = F.explode(F.sequence(F.lit(0), F.lit(dealt_in - 1)))
    dealt = orders.join(needed, F.col("stratum") == F.col("needed")).select("of", F.col("part").alias("of_part"), "rep", "stratum", "donors")
    sums = (vectors.select("chunk", "stratum", "dir", "y", parts.alias("part")).groupBy("chunk", "part")
            .cogroup(dealt.groupBy("of", "of_part")).applyInPandas(_earned, "rep int, t double"))
    totals = sums.groupBy("rep").agg(F.sum("t").alias("t"))
    real = log.agg(F.sum(F.col("dir") * F.col("y")).alias("real_savings"))
    null = totals.join(F.broadcast(real)).agg(
        F.max("real_savings").alias("real_savings"),
        F.sum((F.col("t") >= F.col("real_savings") - 1e-9).cast("int")).alias("as_extreme"),
        F.count("*").alias("permutations"), F.avg("t").alias("null_mean"))
    return (null.join(F.broadcast(violations))
            .withColumn("p_value", (F.col("as_extreme") + 1) / (F.col("permutations") + 1)))
