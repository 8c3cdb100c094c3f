"""Near-duplicate embeddings by sorted projection passes.

A vector's signs under random projections, concatenated, are its code; every pass has projections of its own.  In each
pass the vectors are ordered by their codes and each is compared with the WINDOW that follow it.  A row of a pass carries,
beside its own code, the codes of the next two passes: 128 more signs.  Where very few of them differ the two are taken
together at once; where more differ, but not more than the cosine asked for allows, the pair is verified with the vectors
themselves.  Links of all passes are united into groups.

The links inside a group are then counted in double precision.  Vectors within half the angle of the group's pivot are
linked with one another, since angles add up: they are counted without comparing any two.  Only the others, the shell, are
compared, block by block, with the members of their group; no pair leaves a task.  Equal vectors are one vector with a
count all along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from sluice.llm.common import parked
from sluice.llm.simhash import components

#: Passes, rows that each row is compared with, signs of a code, seed of the projections.
PASSES, WINDOW, SIGNS, SEED = 16, 64, 64, 7
#: Vectors handled at once, and rows on either side of a block of the shell's comparison.
SLICE, BLOCK = 2048, 1024
#: Tasks that the members of a group are dealt to when they meet their pivot.
PARTS = 8

Batches = Iterator[pa.RecordBatch]


def differing_signs(cosine: float, deviations: float) -> int:
    """Of 2 * SIGNS signs, how many differ between vectors of that cosine, and so many standard deviations more."""
    p, n = np.arccos(cosine) / np.pi, 2 * SIGNS
    return int(np.ceil(n * p + deviations * np.sqrt(n * p * (1 - p))))


def _whole(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose arrays start at 0."""
    for row in range(0, batch.num_rows, SLICE):
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.slice(row, SLICE).columns], names=batch.schema.names)


def _scaled(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of the usable vectors, one pair for each dimension.

    Rows are doubles, scaled by a power of two, which changes no digit, so that no square leaves the range.
    """
    values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    start = lists.offsets.to_numpy()
    size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(start), 0)
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == dim)
        rows = values[start[at][:, None] + np.arange(dim)]
        most = np.abs(rows).max(axis=1)
        good = np.isfinite(most) & (most > 0)
        yield at[good], np.ldexp(rows[good], -np.frexp(most[good])[1][:, None]) + 0.0  # -0.0 becomes 0.0


def _named(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _keyed(with_vector: bool) -> Callable[[Batches], Batches]:
    """Adds a 128-bit key of the components; vectors that cannot be compared have none."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in _whole(batch):
                keys: list[bytes | None] = [None] * part.num_rows
                lists = _named(part, "vector")
                flat, start = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0, lists.offsets.to_numpy()
                for at, _ in _scaled(lists):
                    for i in at.tolist():
                        keys[i] = hashlib.md5(flat[start[i]:start[i + 1]].tobytes(), usedforsecurity=False).digest()
                columns, names = [_named(part, "id"), pa.array(keys, pa.binary())], ["id", "key"]
                if with_vector:
                    columns, names = [*columns, lists], [*names, "vector"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


_CODED = pa.schema([("pass", pa.int32()), ("dim", pa.int32()), ("code", pa.int64()), ("ref", pa.int64()), ("more", pa.int64()), ("most", pa.int64())])


def _coded(batches: Batches) -> Batches:
    """One row a pass of every vector: its code, as a long that sorts like its signs, and the codes of the next two passes."""
    known: dict[int, np.ndarray] = {}
    weights = np.uint64(1) << np.arange(SIGNS, dtype=np.uint64)[::-1]
    for batch in batches:
        for part in _whole(batch):
            refs = _named(part, "ref").to_numpy()
            for at, rows in _scaled(_named(part, "vector")):
                n, dim = rows.shape
                if dim not in known:
                    known[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim, PASSES * SIGNS))
                signs = (rows @ known[dim] > 0).reshape(n, PASSES, SIGNS)
                codes = ((signs * weights).sum(axis=2, dtype=np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.arange(PASSES, dtype=np.int32), n)), pa.array(np.full(n * PASSES, dim, dtype=np.int32)),
                    pa.array(codes.T.reshape(-1)), pa.array(np.tile(refs[at], PASSES)),
                    pa.array(np.roll(codes, -1, axis=1).T.reshape(-1)), pa.array(np.roll(codes, -2, axis=1).T.reshape(-1))], schema=_CODED)


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position of each of ``n`` positions' component under the links (a, b)."""
    parent = np.arange(n)
    while len(a):
        a, b = parent[a], parent[b]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(parent, high, low)
        while not (parent[parent] == parent).all():
            parent = parent[parent]
    return parent


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])


def _windowed(sure: int, most_differing: int) -> Callable[[Batches], Batches]:
    """Links of the windows of one sorted range: sure ones as a forest, each doubtful one between trees of it."""
    def run(batches: Batches) -> Batches:
        held: list[np.ndarray] | None = None
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            old = 0
            if held is not None:
                old, rows = len(held[0]), [np.concatenate(p) for p in zip(held, rows)]
            turn, dim, _, ref, more, most = rows
            more, most = more.view(np.uint64), most.view(np.uint64)
            ends: list[list[np.ndarray]] = [[], [], []]
            for step in range(1, min(WINDOW, len(ref) - 1) + 1):
                low = max(0, old - step)  # what lies before has been compared
                x, y = slice(low, len(ref) - step), slice(low + step, len(ref))
                bits = np.bitwise_count(more[x] ^ more[y]) + np.bitwise_count(most[x] ^ most[y])
                at = np.flatnonzero((bits <= most_differing) & (turn[x] == turn[y]) & (dim[x] == dim[y]))
                for held_ends, found in zip(ends, (at + low, at + low + step, bits[at])):
                    held_ends.append(found)
            held = [r[-WINDOW:] for r in rows]
            if not ends[0]:
                continue
            a, b, bits = (np.concatenate(e) for e in ends)
            parent = spanning(len(ref), a[bits <= sure], b[bits <= sure])
            moved = np.flatnonzero(parent != np.arange(len(ref)))
            open_ = parent[a] != parent[b]
            first, second = np.r_[ref[moved], ref[a[open_]]], np.r_[ref[parent[moved]], ref[b[open_]]]
            flag = np.arange(len(first)) < len(moved)
            for at in range(0, len(first), 1 << 16):
                cut = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(first, second)[cut]), pa.array(np.maximum(first, second)[cut]),
                                                  pa.array(flag[cut])], schema=_LINKS)

    return run


def _double(vector: str) -> Column:
    return F.col(vector).cast("array<double>")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def links_of(classes: DataFrame, cosine: float) -> DataFrame:
    """(a, b): links over ``ref`` of ``classes`` (ref, vector) that span what any pass finds to be as near as ``cosine``."""
    coded = classes.select("ref", "vector").mapInArrow(_coded, "pass int, dim int, code long, ref long, more long, most long")
    # Ranges may end within a pass or a code, so that neither a pass nor a group of one code stays in one task.
    order = ["pass", "dim", "code", "ref"]
    bounds = differing_signs(cosine, -2.0), differing_signs(cosine, 3.5)
    found = parked(coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _windowed(*bounds), "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure")), "vector-links")
    # Doubtful pairs, at most WINDOW a row and pass, fetch their vectors.
    fetched = (found.where(~F.col("sure")).join(classes.select(F.col("ref").alias("a"), F.col("vector").alias("va")), "a")
               .join(classes.select(F.col("ref").alias("b"), F.col("vector").alias("vb")), "b"))
    near = _dot("va", "vb") >= cosine * F.sqrt(_dot("va", "va")) * F.sqrt(_dot("vb", "vb"))
    return found.where("sure").select("a", "b").unionByName(fetched.where(near).select("a", "b"))


def _rescaled(batches: Batches) -> Batches:
    for batch in batches:
        for part in _whole(batch):
            vectors: list[np.ndarray | None] = [None] * part.num_rows
            for at, rows in _scaled(_named(part, "vector")):
                for i, row in zip(at.tolist(), rows):
                    vectors[i] = row
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(vectors, pa.list_(pa.float64()))], names=part.schema.names)


def _at_pivots(members: DataFrame, cosine: float) -> DataFrame:
    """Members with ``core``: whether they lie within half the angle of their pivot; large groups go to PARTS tasks."""
    pivots = members.where("ref = pivot").select("pivot", F.col("vector").alias("middle"), F.explode(
        F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    half = float(np.cos(np.arccos(cosine) / 2)) + 1e-9  # beyond any rounding
    core = _dot("vector", "middle") >= half * F.sqrt(_dot("vector", "vector")) * F.sqrt(_dot("middle", "middle"))
    return members.withColumn("part", F.pmod(F.xxhash64("ref"), F.lit(PARTS)).cast("int")).join(pivots, ["pivot", "part"]).select(
        "pivot", "ref", "copies", "vector", core.alias("core"))


_FOUND = pa.schema([("ref", pa.int64()), ("linked", pa.int64()), ("other", pa.int64())])


def _compared(cosine: float) -> Callable[[Batches], Batches]:
    """Rows of block pairs, the members first, then the rows of the shell, which are compared with all members at once.

    Gives how many vectors each is linked with, and links (ref, other) that span what is linked, the core being its pivot.
    """
    def answered(pivot: int, sides: list[list[tuple]]) -> Batches:
        (m_ref, m_copies, m_core, members), (ref, copies, _, asked) = (
            [np.array(c) for c in zip(*side)] for side in sides)
        lengths = [np.sqrt((v * v).sum(axis=1)) for v in (asked, members)]
        near = (asked @ members.T >= cosine * lengths[0][:, None] * lengths[1][None, :]) & (ref[:, None] != m_ref[None, :])
        yield pa.RecordBatch.from_arrays([pa.array(ref), pa.array(near @ m_copies), pa.nulls(len(ref), pa.int64())], schema=_FOUND)
        if m_core.any():  # a pair of shell rows is met from both of its ends, one with the core only here
            yield pa.RecordBatch.from_arrays([pa.array(m_ref[m_core]), pa.array(copies @ near[:, m_core]),
                                              pa.nulls(int(m_core.sum()), pa.int64())], schema=_FOUND)
        # Nodes: all refs met here, core members as their pivot.
        nodes, place = np.unique(np.r_[ref, np.where(m_core, pivot, m_ref)], return_inverse=True)
        a, b = np.nonzero(near)
        parent = spanning(len(nodes), place[a], place[len(ref) + b])
        moved = np.flatnonzero(parent != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(np.zeros(len(moved), dtype=np.int64)),
                                          pa.array(nodes[parent[moved]])], schema=_FOUND)

    def run(batches: Batches) -> Batches:
        at, sides = None, [[], []]
        for batch in batches:
            for row in range(0, batch.num_rows, SLICE):
                for pivot, block, asking, asks, ref, copies, core, vector in zip(*(c.to_pylist() for c in batch.slice(row, SLICE).columns)):
                    if (pivot, block, asking) != at:
                        if all(sides):
                            yield from answered(at[0], sides)
                        at, sides = (pivot, block, asking), [[], []]
                    sides[asks].append((ref, copies, core, vector))
        if all(sides):
            yield from answered(at[0], sides)

    return run


def _shell_found(placed: DataFrame, cosine: float) -> DataFrame:
    """(ref, linked, other) of comparing every row of the shells with its group, in blocks of about BLOCK rows a side."""
    sizes = placed.groupBy("pivot").agg(F.count("*").alias("rows"), F.count_if(~F.col("core")).alias("outside")).where("outside > 0").select(
        "pivot", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("outside") / BLOCK).cast("int").alias("askings"))
    near = placed.join(sizes, "pivot")
    block = F.pmod(F.xxhash64("ref"), F.col("blocks")).cast("int")
    asking = F.pmod(F.xxhash64("ref", F.lit(1)), F.col("askings")).cast("int")

    def side(rows: DataFrame, block: Column, asking: Column, asks: int) -> DataFrame:
        return rows.select("pivot", block.alias("block"), "askings", "ref", "copies", "core", "vector", asking.alias("asking")).select(
            "pivot", "block", "asking", F.lit(asks).alias("asks"), "ref", "copies", "core", "vector")

    every = [F.explode(F.sequence(F.lit(0), F.col(n) - 1)) for n in ("askings", "blocks")]
    both = side(near, block, every[0], 0).unionByName(side(near.where(~F.col("core")), every[1], asking, 1))
    keys = ["pivot", "block", "asking"]
    return both.repartition(*keys).sortWithinPartitions(*keys, "asks", "ref").mapInArrow(_compared(cosine), "ref long, linked long, other long")


def _prepared(vectors: DataFrame, with_vector: bool) -> DataFrame:
    def ddl(name: str) -> str:
        kind: DataType = vectors.schema[name].dataType
        return f"{name} {kind.simpleString()}"

    return vectors.mapInArrow(_keyed(with_vector), f"{ddl('id')}, key binary" + (f", {ddl('vector')}" if with_vector else ""))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """id, n_links, component_id and kept of every row of ``vectors``.

    Linked are rows whose cosine, in double precision, is at least ``cosine``, as far as the passes bring them into one
    group; within a group every link counts.  component_id is the smallest id that can be reached, the row's own id
    included; kept says that it is the row's own.  Vectors of different length are never linked, nor are vectors that are
    null, empty or zero or hold a null or non-finite component.  Repeated rows are linked with each other; null ids name
    no component unless it has no other, and are kept there.  Other columns are not read; an empty table gives no rows.
    """
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    # Equal vectors are one class, with a number of its own from here on.
    once = _prepared(given, True).where("key is not null").groupBy("key").agg(
        F.count("*").alias("copies"), F.min("id").alias("least"), F.first("vector").alias("vector"))
    classes = parked(once.withColumn("ref", F.monotonically_increasing_id()), "vector-classes")
    groups = components(links_of(classes, cosine)).select(F.col("code").alias("ref"), F.col("rep").alias("pivot"))
    members = groups.join(classes, "ref").select("pivot", "ref", "copies", "vector")
    placed = parked(_at_pivots(members.mapInArrow(_rescaled, "pivot long, ref long, copies long, vector array<double>"), cosine), "vector-placed")
    inner = placed.where("core").groupBy("pivot").agg(F.sum("copies").alias("inner"))
    told = placed.join(inner, "pivot").select(
        "ref", "pivot", "core", F.when(F.col("core"), F.col("inner")).otherwise(F.col("copies")).alias("own"))
    node = F.when(F.col("core"), F.col("pivot")).otherwise(F.col("ref"))
    if placed.where(~F.col("core")).isEmpty():
        told = told.select("ref", (F.col("own") - 1).alias("n"), node.alias("group"))
    else:
        found = parked(_shell_found(placed, cosine), "vector-shell")
        linked = found.groupBy("ref").agg(F.sum("linked").alias("linked"))
        label = components(found.where("other is not null").select(F.col("ref").alias("a"), F.col("other").alias("b")))
        told = (told.withColumn("node", node).join(linked, "ref", "left").join(label, F.col("node") == F.col("code"), "left")
                .select("ref", (F.col("own") - 1 + F.coalesce("linked", F.lit(0))).alias("n"), F.coalesce("rep", "node").alias("group")))
    whole = classes.select("key", "copies", "least", "ref").join(told, "ref", "left").select(
        "key", "least", F.coalesce("n", F.col("copies") - 1).alias("n"), F.coalesce("group", "ref").alias("group"))
    whole = parked(whole, "vector-whole")
    least = whole.groupBy("group").agg(F.min("least").alias("component"))
    answer = whole.join(least, "group").select("key", "n", "component", F.lit(True).alias("known"))
    rows = _prepared(given, False).join(answer, "key", "left")
    component = F.when(F.col("known"), F.col("component")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                       component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
