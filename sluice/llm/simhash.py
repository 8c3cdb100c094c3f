"""SimHash near-duplicates over a Gray-order hierarchical index.

Every text has a 64-bit fingerprint.  Two fingerprints that differ in at most two bits agree in two of four 16-bit
blocks, so the distinct fingerprints are dealt out under each of the six pairs of blocks.  The codes of one pair value
form the root of an index: sorted by Gray rank, consecutive codes are grouped, and the bits on which a group agrees are
factored into its node.  A search carries the differences found so far down the tree and drops a whole group as soon
as they exceed the bound.  Links leave a task as a spanning forest; components are joined by rounds of two joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import parked, pieces, widened

BITS, BLOCKS, WITHIN, SEED, SHINGLE = 64, 4, 2, 42, 3
#: Children of an index node, and (query, node) pairs held at once.
FAN, HELD = 8, 1 << 18
_SHINGLES = 1 << 16


def _hashes(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a text, in bounded pieces; none for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return
    if len(words) < SHINGLE:
        words = [b" ".join(words)]
        runs: Iterator[bytes] = iter(words)
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - SHINGLE + 1)
    for at in range(0, n, _SHINGLES):
        size = min(_SHINGLES, n - at)
        yield np.fromiter((digest(next(runs), SEED) for _ in range(size)), dtype=np.uint64, count=size)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text; zero for a text without words."""
    total, n = np.zeros(BITS, dtype=np.int64), 0
    for h in _hashes(text):
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0]) if n else 0


def with_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` and ``out``, the fingerprint as a signed long; null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, text_col):
                codes = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codes)], names=[*part.schema.names, out])

    return docs.mapInArrow(run, widened(docs, f"{out} long"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Codes of several roots, sorted by (root, Gray rank); every level groups FAN neighbours of one root."""

    def __init__(self, root: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), root))
        self.codes, self.root = codes[order], root[order]
        # Of each level: agreed bits, their values, and where a node's children start; level 0 are the codes.
        self.mask = [np.full(len(codes), ~np.uint64(0))]
        self.value = [self.codes]
        self.start = [np.arange(len(codes) + 1)]
        owner = self.root
        while len(np.unique(owner)) < len(owner):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            inside = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
            begin = np.flatnonzero(inside % FAN == 0)
            ones = np.bitwise_and.reduceat(self.value[-1] & self.mask[-1], begin)
            zeros = np.bitwise_and.reduceat(~self.value[-1] & self.mask[-1], begin)
            self.mask.append(ones | zeros)
            self.value.append(ones)
            self.start.append(np.r_[begin, len(owner)])
            owner = owner[begin]
        self.top_of = np.searchsorted(owner, self.root)  # the top node of each code

    def links(self, within: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of codes of one root that differ in at most ``within`` bits, the larger position first."""
        top = len(self.mask) - 1
        todo = [(top, np.arange(a, min(len(self.codes), a + HELD)), None, None)
                for a in range(0, len(self.codes), HELD)][::-1]
        while todo:
            level, query, node, seen = todo.pop()
            if node is None:
                node = self.top_of[query]
                seen = np.bitwise_count((self.codes[query] ^ self.value[top][node]) & self.mask[top][node]).astype(np.int64)
            if level == 0:
                ahead = (query > node) & (seen <= within)
                yield query[ahead], node[ahead]
                continue
            # A node whose codes all come after the query holds no pair that the others do not hold.
            first, size = self.start[level][node], np.diff(self.start[level])[node]
            below = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            asks, had = np.repeat(query, size), np.repeat(seen, size)
            parent = np.repeat(self.mask[level][node], size)
            fresh = self.mask[level - 1][below] & ~parent
            now = had + np.bitwise_count((self.codes[asks] ^ self.value[level - 1][below]) & fresh)
            near = now <= within
            asks, below, now = asks[near], below[near], now[near]
            for a in range(0, len(asks), HELD):
                todo.append((level - 1, asks[a:a + HELD], below[a:a + HELD], now[a:a + HELD]))


def _forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest position of each position's component, by hooking and pointer jumping per piece of links."""
    parent = np.arange(n)
    for a, b in links:
        while len(a):
            a, b = parent[a], parent[b]
            high, low = np.maximum(a, b), np.minimum(a, b)
            open_ = high != low
            a, b, high, low = a[open_], b[open_], high[open_], low[open_]
            np.minimum.at(parent, high, low)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    return parent


def _local_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of one partition; rows of one root are always together."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not parts:
        return
    root = np.concatenate([p[0] for p in parts])
    codes = np.concatenate([p[1] for p in parts]).view(np.uint64)
    alone = np.unique(root, return_inverse=True, return_counts=True)
    shared = alone[2][alone[1]] > 1
    if not shared.any():
        return
    index = GrayIndex(root[shared], codes[shared])
    first = _forest(len(index.codes), index.links(WITHIN))
    moved = np.flatnonzero(first != np.arange(len(first)))
    a, b = index.codes[moved].view(np.int64), index.codes[first[moved]].view(np.int64)
    for at in range(0, len(a), HELD):
        yield pa.RecordBatch.from_arrays([pa.array(a[at:at + HELD]), pa.array(b[at:at + HELD])], names=["a", "b"])


def links_of(codes: DataFrame) -> DataFrame:
    """Links (a, b) that span every component of the distinct long column ``code`` under WITHIN differing bits."""
    width = BITS // BLOCKS
    roots = []
    for k, (i, j) in enumerate(combinations(range(BLOCKS), BLOCKS - WITHIN)):
        part = [F.shiftrightunsigned("code", width * x).bitwiseAND((1 << width) - 1) for x in (i, j)]
        roots.append(F.lit(k << 2 * width) + F.shiftleft(part[0], width) + part[1])
    dealt = codes.select(F.explode(F.array(*roots)).alias("root"), "code")
    return dealt.repartition("root").mapInArrow(_local_links, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(code, rep): the smallest code reachable over ``links``, for codes that have a link.

    Rounds of joining every code with its neighbours' smallest label and jumping to that label's own label.  Each round
    is written to the shared folder, so its lineage ends there.
    """
    both = parked(links.select("a", "b").union(links.select("b", "a")), "simhash-links")
    label = parked(both.groupBy("a").agg(F.min("b").alias("least")).select(
        F.col("a").alias("code"), F.least("a", "least").alias("rep")), "simhash-labels")
    while True:
        near = both.join(label, both.b == label.code).groupBy("a").agg(F.min("rep").alias("near"))
        least = label.join(near, label.code == near.a).select("code", "rep", F.least("rep", "near").alias("least"))
        up = label.select(F.col("code").alias("least"), F.col("rep").alias("jump"))
        after = parked(least.join(up, "least").select(
            "code", F.least("least", "jump").alias("rep"), (F.least("least", "jump") != F.col("rep")).alias("moved")), "simhash-labels")
        label = after.select("code", "rep")
        if after.where("moved").isEmpty():
            return label


def grouped(prints: DataFrame, id_col: str = "doc_id", fingerprint_col: str = "fingerprint",
            out: str = "component_id") -> DataFrame:
    """``prints`` with ``out``, the smallest id of a row's component of linked fingerprints, and group_, its smallest code.

    Equal fingerprints are one code with their smallest id before anything is compared, so groups of copies cost one
    row.  Null ids never name a component unless it has no other.  Repeated rows each keep their row.
    """
    code = F.col(fingerprint_col)
    codes = parked(prints.groupBy(code.alias("code")).agg(F.min(id_col).alias("least")), "simhash-codes")
    label = components(links_of(codes.select("code")))
    of = codes.join(label, "code", "left").select("code", "least", F.coalesce("rep", "code").alias("rep"))
    # Components get their smallest id; a component of thousands of codes is reduced on the map side.
    ids = of.groupBy("rep").agg(F.min("least").alias(out))
    wide = parked(of.join(ids, "rep").select(F.col("code").alias(fingerprint_col), out, F.col("rep").alias("group_")), "simhash-groups")
    return prints.join(wide, fingerprint_col)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, fingerprint (16 hexadecimal digits) and component_id of every document; an empty table gives no rows."""
    prints = parked(with_fingerprints(docs.select(id_col, text_col), text_col, "fingerprint_").select(
        id_col, "fingerprint_"), "simhash-prints")
    return grouped(prints, id_col, "fingerprint_").select(
        id_col, F.lower(F.lpad(F.hex("fingerprint_"), 16, "0")).alias("fingerprint"), "component_id")
