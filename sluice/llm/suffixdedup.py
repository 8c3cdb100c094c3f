"""Exact removal of repeated byte strings: every byte of a LENGTH-byte string that starts more than once.

``merged_repeats`` merges the Burrows-Wheeler transforms of shards by iterative interleave refinement: the order of all
suffixes is never sorted anew, one byte a round is prepended to what the order already agrees on, and the places where
neighbours part give common prefixes and repeated intervals.  It needs LENGTH rounds over all bytes, which no large
corpus affords (figures in the README).  ``spans_of`` therefore refines the same intervals on sampled suffixes:

* In every window of LENGTH bytes the GRAM-byte string of the smallest hash is its anchor (leftmost of equals).  Equal
  windows have their anchors at equal offsets, so only suffixes that start at an anchor need comparing: about 1 in 60.
* An interval is the set of anchors with one GRAM; a shard reduces its own before they are merged.  A member whose
  whole surroundings (all windows of that anchor) occur twice is decided; an interval of one member is dropped.
* What is left is refined: the offsets are cut into blocks, the string common to all windows of a block splits the
  interval, and so on until windows are compared themselves.  All of this compares bytes and is exact.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import column, give_back, parked, pieces

LENGTH, GRAM = 200, 48
WINDOW = LENGTH - GRAM + 1
#: Window starts handled at once in a long text; members of one interval that a task refines by itself.
PIECE, CROWD = 1 << 20, 50_000
_FAN, _FIRST_BLOCK = 4, 64
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = 24


def merged_repeats(shards: list[list[bytes]], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(shard, text, position) of every ``length``-byte string that starts more than once in any of the shards.

    Each shard's transform is built alone; the merge only reads the transforms, front to back, once a round.
    """
    places, transforms, texts = [], [], []
    for shard in shards:
        flat = np.concatenate([np.r_[np.frombuffer(t, np.uint8).astype(np.int64) + 1, 0] for t in shard] or [np.zeros(0, np.int64)])
        # A shard's own suffixes, by doubling; the ends of texts count as different and keep their order.
        rank = flat + len(flat)
        rank[flat == 0] = np.arange((flat == 0).sum())
        width = 1
        while width <= length:
            ahead = np.r_[rank[width:], np.full(min(width, len(rank)), -1)]
            order = np.lexsort((ahead, rank))
            fresh = (np.diff(rank[order]) != 0) | (np.diff(ahead[order]) != 0)
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(np.r_[0, fresh]) if len(order) else 0
            width *= 2
        order = np.argsort(rank, kind="stable")
        places.append(order)
        transforms.append(np.r_[0, flat[:-1]][order] if len(flat) else flat)
        texts.append(len(shard))
    source = np.repeat(np.arange(len(shards)), [len(p) for p in places])
    ends = np.repeat(np.arange(len(shards)), texts)  # the ends of all texts stand first, shard by shard
    part = np.zeros(len(source), dtype=bool)  # whether a row is known to differ from the one before
    part[:1] = True
    for _ in range(length):
        symbol = np.empty(len(source), dtype=np.int64)
        for s, t in enumerate(transforms):
            symbol[source == s] = t
        group = np.cumsum(part)
        order = np.argsort(symbol, kind="stable")
        order = order[symbol[order] > 0]
        source = np.r_[ends, source[order]]
        moved = np.diff(symbol[order], prepend=-1) != 0
        part = np.r_[np.ones(len(ends), dtype=bool), moved | (np.diff(group[order], prepend=-1) != 0)]
    alone = part & np.r_[part[1:], True]
    found = []
    for s, place in enumerate(places):
        starts = np.cumsum([0, *(len(t) + 1 for t in shards[s])])
        for p in place[~alone[source == s]].tolist():
            t = int(np.searchsorted(starts, p, side="right")) - 1
            if p + length < starts[t + 1]:
                found.append((s, t, p - int(starts[t])))
    return sorted(found)


def anchors(raw: bytes, start: int = 0) -> tuple[np.ndarray, ...]:
    """GRAM hashes, positions, smallest and largest distances to a window start, of the anchors of one piece of text."""
    data = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) * _A
    data ^= data >> np.uint64(29)
    size = 1
    while size < GRAM:  # hash of 2k bytes from two hashes of k
        step = min(size, GRAM - size)
        data = data[:len(data) - step] * _B + data[step:]
        size += step
    data ^= data >> np.uint64(31)
    data *= _A
    # Hash above, position below: the minimum over a window is its leftmost smallest string.
    least = (data >> np.uint64(_LOW) << np.uint64(_LOW)) | np.arange(len(data), dtype=np.uint64)
    size = 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        least = np.minimum(least[:len(least) - step], least[step:])
        size += step
    at = (least & np.uint64((1 << _LOW) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    where = at[first]
    return data[where].view(np.int64), where + start, where - last, where - first


def _pieces(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Parts of a text that hold each of its windows once."""
    for start in range(0, len(raw) - LENGTH + 1, PIECE):
        yield start, raw[start:start + PIECE + LENGTH - 1]


def _place(position: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    return position << 16 | near << 8 | far


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of a shard.  Members with equal surroundings are decided at once (kind 1); one of them goes on (kind 0)."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for part, texts in pieces(batch, "text"):
            held: list[tuple[np.ndarray, ...]] = []  # arrays of each piece: core, span, ref, place
            for ref, text in zip(column(part, "ref"), texts):
                raw = (text or "").encode()
                for start, piece in _pieces(raw):
                    code, p, near, far = anchors(piece, start)
                    seeds, begin, end = near << 8 | far, p - far, p - near + LENGTH
                    span = np.fromiter(map(digest, map(raw.__getitem__, map(slice, begin.tolist(), end.tolist())), seeds.tolist()),
                                       dtype=np.uint64, count=len(p))
                    held.append((code, span.view(np.int64), np.full(len(p), ref), _place(p, near, far)))
            if not held:
                continue
            core, span, ref, place = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((span, core))
            core, span, ref, place = core[order], span[order], ref[order], place[order]
            first = np.flatnonzero(np.r_[True, (core[1:] != core[:-1]) | (span[1:] != span[:-1])])
            many = np.diff(np.r_[first, len(core)]) > 1
            yield _anchor_rows(0, core[first], span[first], ref[first], place[first], many)
            inside = np.repeat(many, np.diff(np.r_[first, len(core)]))
            zero = np.zeros(int(inside.sum()), dtype=np.int64)
            yield _anchor_rows(1, zero, zero, ref[inside], place[inside], np.ones(len(zero), dtype=bool))
    give_back()


def _anchor_rows(kind: int, core: np.ndarray, span: np.ndarray, ref: np.ndarray, place: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(core), kind, dtype=np.int32)), *(pa.array(x, pa.int64()) for x in (core, span, ref, place)), pa.array(many, pa.bool_())],
        names=["kind", "core", "span", "ref", "place", "many"])


DECIDED, OPEN, PARTNER = 0, 1, 2


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of all shards, sorted by (core, span): each row is judged by the rows before and after it.

    DECIDED rows have equal surroundings elsewhere; OPEN ones share only their core; a PARTNER is a decided row that
    stands for its surroundings in an interval with others.  Members of an interval of one are dropped.
    """
    names = ("core", "span", "ref", "place", "many")
    held = {n: np.zeros(0, dtype=bool if n == "many" else np.int64) for n in names}

    def judged(rows: dict[str, np.ndarray], first: int, last: int) -> pa.RecordBatch:
        core, span = rows["core"], rows["span"]
        same_core = np.r_[False, core[1:] == core[:-1], False]
        same_span = np.r_[False, (core[1:] == core[:-1]) & (span[1:] == span[:-1]), False]
        twice = rows["many"] | same_span[:-1] | same_span[1:]
        crowd = same_core[:-1] | same_core[1:]
        edge = (same_core[:-1] & ~same_span[:-1]) | (same_core[1:] & ~same_span[1:])
        state = np.where(~twice, np.where(crowd, OPEN, -1), np.where(edge, PARTNER, DECIDED))[first:last]
        keep = state >= 0
        return pa.RecordBatch.from_arrays(
            [*(pa.array(rows[n][first:last][keep]) for n in ("core", "ref", "place")), pa.array(state[keep].astype(np.int32))],
            names=["core", "ref", "place", "state"])

    done = 0  # rows of ``held`` that are judged already and only serve as neighbours
    for batch in batches:
        new = {n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names}
        rows = {n: np.concatenate([held[n], new[n]]) for n in names}
        size = len(rows["core"])
        if size - 1 > done:
            yield judged(rows, done, size - 1)
        keep = max(0, size - 2)
        held, done = {n: rows[n][keep:] for n in names}, max(0, size - 1 - keep)
    if len(held["core"]) > done:
        yield judged(held, done, len(held["core"]))


def _surroundings(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the open members and partners of each text."""
    for batch in rows:
        for part, texts in pieces(batch, "text", 1 << 20):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for ref, text, need in zip(column(part, "ref"), texts, column(part, "needs")):
                raw = text.encode()
                for x in need:
                    p, near, far = x["place"] >> 16, x["place"] >> 8 & 255, x["place"] & 255
                    for o, v in zip(out, (x["core"], ref, x["place"], raw[p - far:p - near + LENGTH])):
                        o.append(v)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.binary())], names=["core", "ref", "place", "around"])


Member = tuple[int, int, int, int, bytes]  # ref, position, near, far, bytes from the farthest start on


def refine(members: list[Member], block: tuple[int, int] = (0, 256), size: int = _FIRST_BLOCK) -> Iterator[tuple[int, int, int]]:
    """(ref, first window start, last window start) of repeated windows among the members of one interval.

    ``size`` is the length of the blocks that the offsets of ``block`` are cut into.
    """
    for low in range(block[0], block[1], size):
        high = low + size - 1
        split: dict[bytes, list[tuple[Member, int, int]]] = defaultdict(list)
        for m in members:
            near, far = max(m[2], low), min(m[3], high)
            if near <= far:
                split[m[4][m[3] - low:m[3] - high + LENGTH]].append((m, near, far))
        for part in split.values():
            if len(part) < 2:
                continue
            whole: dict[tuple, list[Member]] = defaultdict(list)
            for m, near, far in part:
                whole[near, far, m[4][m[3] - far:m[3] - near + LENGTH]].append(m)
            left, open_ = [], False
            for (near, far, _), same in whole.items():
                left.append(same[0])
                if len(same) > 1:
                    yield from ((m[0], m[1] - far, m[1] - near) for m in same)
                else:
                    open_ = True
            if open_ and size > 1 and len(left) > 1:
                yield from refine(left, (low, high + 1), size // _FAN)


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of whole intervals, which arrive one after another."""
    def judged(members: list[Member]) -> pa.RecordBatch:
        found = list(refine(members)) if len(members) > 1 else []
        return _spans([f[0] for f in found], [f[1] for f in found], [f[2] + LENGTH for f in found])

    core, members = None, []
    for batch in batches:
        for c, ref, place, around in zip(*(column(batch, n) for n in ("core", "ref", "place", "around"))):
            if c != core:
                if members:
                    yield judged(members)
                core, members = c, []
            members.append((ref, place >> 16, place >> 8 & 255, place & 255, around))
    if members:
        yield judged(members)


def _spans(ref: Iterable[int], start: Iterable[int], end: Iterable[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ref, start, end)], names=["ref", "start", "end"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of crowded intervals with a 128-bit hash of its bytes."""
    for batch in batches:
        for ref, place, around in zip(*(column(batch, n) for n in ("ref", "place", "around"))):
            p, near, far = place >> 16, place >> 8 & 255, place & 255
            starts = range(p - far, p - near + 1)
            hashes = [xxhash.xxh3_128_digest(around[i:i + LENGTH]) for i in range(len(starts))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ref] * len(hashes), pa.int64()), pa.array(starts, pa.int64()), pa.array(hashes, pa.binary())],
                names=["ref", "start", "window"])


_SPAN = "ref long, start long, end long"


def spans_of(docs: DataFrame) -> DataFrame:
    """(ref, start, end) of byte runs to remove; they may overlap.  ``docs`` has ref (a row's key) and text.

    Rows with one ref must have one text.  An interval of more than CROWD open members, such as the edge of a passage
    that very many documents share, is not refined in a task: its windows are counted by hash instead.
    """
    found = parked(docs.select("ref", "text").mapInArrow(
        _reduced, "kind int, core long, span long, ref long, place long, many boolean"), "repeat-anchors")
    shards = found.where("kind = 0").select("core", "span", "ref", "place", "many")
    merged = parked(shards.repartition("core").sortWithinPartitions("core", "span").mapInArrow(
        _merged, "core long, ref long, place long, state int"), "repeat-intervals")
    decided = found.where("kind = 1").select("ref", "place").union(merged.where(F.col("state") != OPEN).select("ref", "place"))
    position = F.shiftright("place", 16)
    near, far = F.shiftright("place", 8).bitwiseAND(255), F.col("place").bitwiseAND(255)
    spans = decided.select("ref", (position - far).alias("start"), (position - near + LENGTH).alias("end"))

    open_ = merged.where(F.col("state") != DECIDED)
    crowded = parked(open_.groupBy("core").count().where(F.col("count") > CROWD).select("core"), "repeat-crowds")
    needs = open_.groupBy("ref").agg(F.collect_set(F.struct("core", "place")).alias("needs"))  # bounded by the text
    around = docs.join(needs, "ref").select("doc_id", "ref", "text", "needs").mapInArrow(
        _surroundings, "core long, ref long, place long, around binary")
    if crowded.isEmpty():
        return spans.union(_in_tasks(around))
    around = parked(around, "repeat-surroundings")
    windows = around.join(crowded, "core", "left_semi").mapInArrow(_windows, "ref long, start long, window binary")
    twice = windows.groupBy("window").count().where(F.col("count") > 1).select("window")
    repeated = windows.join(twice, "window").select("ref", "start", (F.col("start") + LENGTH).alias("end"))
    return spans.union(_in_tasks(around.join(crowded, "core", "left_anti"))).union(repeated)


def _in_tasks(around: DataFrame) -> DataFrame:
    return around.repartition("core").sortWithinPartitions("core").mapInArrow(_refined, _SPAN)


_STEP = 1 << 20  # a run's end is packed behind its start


def _cut(raw: bytes, runs: list[int] | None) -> tuple[bytes, int]:
    """The bytes outside all runs, and how many maximal runs there are."""
    if not runs:
        return raw, 0
    kept, at, spans, open_to = [], 0, 0, -1
    for x in sorted(runs):
        start, end = x // _STEP, x // _STEP + x % _STEP
        if start > open_to:
            if open_to >= 0:
                at = open_to
            kept.append(raw[at:start])
            spans += 1
        open_to = max(open_to, end)
    kept.append(raw[open_to:])
    return b"".join(kept), spans


def _keyed(docs: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` under safe names with a key of each text, and the runs to remove of each key."""
    named = docs.select(F.col(f"`{text_col}`").alias("text"), F.struct(*(F.col(f"`{k}`") for k in keep)).alias("doc_id"))
    # A row's key is its columns: rows that repeat in full share it and each count as an occurrence.
    keyed = named.select("doc_id", F.xxhash64("doc_id", "text").alias("ref"), "text")
    runs = spans_of(keyed).select("ref", (F.col("start") * _STEP + F.col("end") - F.col("start")).alias("run"))
    # Sets, because rows with one key bring equal runs; the set of one text is bounded by its length.
    return keyed, runs.groupBy("ref").agg(F.collect_set("run").alias("runs"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_bytes, n_removed, n_spans and kept_sha256 of every document, judged on the whole input.

    Null text counts as empty; texts shorter than LENGTH lose nothing; an empty table gives no rows.  Rows that repeat
    in full are occurrences of each other.
    """
    keyed, runs = _keyed(docs, [id_col], text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                out = []
                for text, cuts in zip(texts, column(part, "runs")):
                    raw = (text or "").encode()
                    left, spans = _cut(raw, cuts)
                    out.append((len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest()))
                ids = part.column(part.schema.get_field_index("doc_id")).flatten()[0]
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, zip(*out))],
                                                 names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return keyed.join(runs, "ref", "left").select("doc_id", "ref", "text", "runs").mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with repeated bytes taken out of their texts; same columns.

    Bytes left of a character that a run has cut drop out, and ``chars_col``, where present, follows the new text.  A
    text that loses all of itself drops its row; untouched texts, null and empty ones too, stay as they are.
    """
    names = docs.columns
    rest = [n for n in names if n != text_col]
    keyed, runs = _keyed(docs, rest, text_col)
    of = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                cuts = column(part, "runs")
                new = [_cut(t.encode(), c)[0].decode("utf-8", "ignore") if c else t for t, c in zip(texts, cuts)]
                rows = part.column(part.schema.get_field_index("doc_id")).flatten()
                rows.insert(of[text_col], pa.array(new, pa.string()))
                if chars_col in of:
                    old = rows[of[chars_col]].to_pylist()
                    size = [len(n) if c else o for n, c, o in zip(new, cuts, old)]
                    rows[of[chars_col]] = pa.array(size, rows[of[chars_col]].type)
                stays = pa.array([not c or n != "" for n, c in zip(new, cuts)], pa.bool_())
                yield pa.RecordBatch.from_arrays(rows, names=names).filter(stays)
        give_back()

    return keyed.join(runs, "ref", "left").select("doc_id", "ref", "text", "runs").mapInArrow(run, docs.schema)
