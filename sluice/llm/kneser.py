"""Interpolated modified Kneser-Ney language model, counted in Spark, kept as sorted hash arrays.

Counting jobs shuffle packed arrays, not single rows: each task counts its own texts, cuts the sorted result by
hash range and sends one array per range; the task of a range adds them up and writes its part of the model to the
shared folder.  Words are 64-bit hashes, taken from a slice's bytes all at once; a word's id is its rank among all sorted hashes.  Pairs are (context id, word id),
spread by a hash of the pair so that a frequent word's pairs lie in all parts.  An n-gram of three words or more is (place
of its context among all n-grams one word shorter, word id) and lies in the part of its context, so every order is counted
by one more shuffle of 64-bit keys.  The longest n-grams have raw counts, all shorter ones count the different words
before them.  Counts are kept in a byte each, with the few larger ones apart.  Scoring maps those files into memory and looks
words and pairs up by binary search; of longer n-grams the word ids alone are kept, by context, with where each context's
begin, so that a search goes over the words that follow one context.

The folder must be one that workers can open as files (a shared mount); pages are read as they are needed, so a
worker's own memory does not grow with the model.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import fold_of, new_folder, slices
from sluice.llm.wordhash import hashed

#: ORDER is what ``trained`` and ``scored`` take by themselves; the query asks for QUERY_ORDER.
ORDER, QUERY_ORDER, FOLDS, HELD = 2, 3, 5, 1
#: Distinct n-grams that a task holds before it merges them.
HOLD = 1 << 22
#: Text bytes counted or scored at once; larger slices repeat fewer look-ups.
SLICE = 4 << 20
_PAIR_MIX = np.uint64(0x9E3779B97F4A7C15)


def _file_path(uri: str) -> str:
    """The shared folder as a path that a worker can open."""
    path = uri.removeprefix("file://").removeprefix("file:") if uri.startswith("file:") else uri
    if "://" in path:
        raise ValueError(f"the model's folder must be mounted on all workers: {uri}")
    return path


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Write one array; a repeated task replaces it by an equal one."""
    os.makedirs(folder, exist_ok=True)
    temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
    array.tofile(temporary)
    os.replace(temporary, f"{folder}/{name}")


def _map(folder: str, name: str, kind: str) -> np.ndarray:
    path = f"{folder}/{name}"
    return np.memmap(path, dtype=kind, mode="r").view(np.ndarray) if os.path.getsize(path) else np.zeros(0, dtype=kind)


def _save_counts(folder: str, name: str, counts: np.ndarray) -> None:
    """Counts in a byte each; those of 255 and more are also written with their places, in order."""
    flat = counts.reshape(-1)
    large = np.flatnonzero(flat >= 255)
    _save(folder, f"{name}-large", np.stack([large, flat[large]], axis=1).astype("<i8"))
    _save(folder, name, np.minimum(flat, 255).astype("u1"))


class Counts:
    """What ``_save_counts`` wrote, mapped into memory as rows of 1, 2, 4 or 8 ``columns`` counts, each row one number."""

    def __init__(self, folder: str, name: str, columns: int):
        self.rows, self.columns = _map(folder, name, f"<u{columns}"), columns
        self.large = _map(folder, f"{name}-large", "<i8").reshape(-1, 2)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        found = self.rows.take(at).view("u1")
        out, large = found.astype(np.int64), np.flatnonzero(found == 255)
        if len(large):
            row, column = np.divmod(large, self.columns)
            out[large] = self.large[np.searchsorted(self.large[:, 0], at[row] * self.columns + column), 1]
        return out.reshape(-1, self.columns)


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys with added counts."""
    if not len(keys):
        return (keys, *counts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return (keys[first], *(np.add.reduceat(c[order], first) for c in counts))


def _sorted(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Values below 2^``bits`` in order, and where each stood: numbers that hold both are sorted faster than places are."""
    room = len(values).bit_length()
    if bits + room > 64:
        order = np.argsort(values, kind="stable")
        return values[order], order
    both = np.sort(values << np.uint64(room) | np.arange(len(values), dtype=np.uint64))
    return both >> np.uint64(room), (both & np.uint64((1 << room) - 1)).astype(np.int64)


def _distinct(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values below 2^``bits``, and which of them each is."""
    values, order = _sorted(values, bits)
    first = np.ones(len(values), dtype=bool)
    first[1:] = values[1:] != values[:-1]
    back = np.empty(len(values), dtype=np.int64)
    back[order] = np.cumsum(first) - 1
    return values[first], back


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane, which the shuffle's compression shortens."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=np.uint64)


_PARTS = "part int, keys binary, counts binary"


def _sent(part: np.ndarray, parts: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per part with that part's sorted keys; ``counts`` may have several columns."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        mine = order[bounds[p]:bounds[p + 1]]
        if len(mine):
            yield pa.RecordBatch.from_arrays(
                [pa.array([p], pa.int32()), pa.array([_packed(keys[mine])], pa.binary()),
                 pa.array([np.ascontiguousarray(counts[mine].astype("<u4").T).tobytes()], pa.binary())],
                names=["part", "keys", "counts"])


class _Tally:
    """Keys of a task, merged whenever too many are held; sent when the task ends or grows too large."""

    def __init__(self, parts: int, part_of: Callable[[np.ndarray], np.ndarray]):
        self.parts, self.part_of = parts, part_of
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > HOLD:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            keys, counts = _summed(np.concatenate(self.keys), np.concatenate(self.counts))
            yield from _sent(self.part_of(keys), self.parts, keys, counts)
        self.keys, self.counts, self.held = [], [], 0


def _received(batches: Iterator[pa.RecordBatch], columns: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per part its summed keys and counts (columns x keys).  Partitions hold whole parts, sorted by part."""
    current, keys, counts = -1, [], []

    def total() -> tuple[int, np.ndarray, np.ndarray]:
        k, *c = _summed(np.concatenate(keys), *np.concatenate(counts, axis=1))
        return current, k, np.stack(c)

    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.column(0)[i].as_py()
            if part != current and keys:
                yield total()
                keys, counts = [], []
            elif sum(map(len, keys)) > HOLD:
                _, k, c = total()
                keys, counts = [k], [c]
            current = part
            keys.append(_unpacked(batch.column(1)[i].as_py()))
            counts.append(np.frombuffer(batch.column(2)[i].as_py(), dtype="<u4").reshape(columns, -1).astype(np.int64))
    if keys:
        yield total()


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "part").sortWithinPartitions("part")


def _top(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key by its range: part p holds the keys from p/parts of all hashes on."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs, with the places where it does, in order."""
    if len(part):
        order = np.argsort(part.astype(np.uint16) if part.max() < 1 << 16 else part, kind="stable")
        first = np.flatnonzero(np.diff(part[order], prepend=-1))
        for mine in np.split(order, first[1:]):
            yield int(part[mine[0]]), mine


def _pair_part(keys: np.ndarray, parts: int) -> np.ndarray:
    return _top((keys ^ keys >> np.uint64(29)) * _PAIR_MIX, parts)


@dataclass
class Model:
    """Where the arrays lie, and the few numbers that belong to the whole corpus."""

    folder: str
    parts: int
    sizes: list[int]  # words in each part
    tokens: int
    pairs: int
    pair_discount: list[float]
    word_discount: list[float]
    word_counts: list[int]  # words with 1, 2 and more continuations
    levels: list[list[int]]  # n-grams of 2, 3, ... words in each part; empty for order 2
    discounts: list[list[float]]  # of n-grams of 3 words and more

    @property
    def words(self) -> int:
        return sum(self.sizes)


class Words:
    """Ids of words, from the mapped arrays of sorted hashes."""

    def __init__(self, folder: str, parts: int, sizes: list[int]):
        self.parts = parts
        self.start = np.cumsum([0, *sizes])
        self.hashes = [_map(folder, f"words-{p}", "<u8") if n else np.zeros(0, "<u8") for p, n in enumerate(sizes)]

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Id of each of the sorted hashes, -1 where training never saw it."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        for p, mine in _by_part(_top(hashes, self.parts)):
            have = self.hashes[p]
            if len(have):
                at = np.minimum(np.searchsorted(have, hashes[mine]), len(have) - 1)
                out[mine] = np.where(have[at] == hashes[mine], at + self.start[p], -1)
        return out

    def read(self, texts: pa.Array) -> Tokens:
        codes, sizes = hashed(texts)
        found = pa.array(codes).dictionary_encode()
        codes = found.dictionary.to_numpy()
        order = np.argsort(codes)
        rank = np.empty(len(codes), dtype=np.int64)
        rank[order] = np.arange(len(codes))
        return Tokens(self.look_up(codes[order]), rank[found.indices.to_numpy()], sizes)


@dataclass
class Tokens:
    """Words and ends of some texts: the different ids, which of them each token has, and each text's number of tokens."""

    different: np.ndarray
    at: np.ndarray
    sizes: np.ndarray

    @property
    def ids(self) -> np.ndarray:
        return self.different[self.at]

    @property
    def first(self) -> np.ndarray:
        """Where each text begins."""
        return np.cumsum(self.sizes) - self.sizes


def _word_counts(texts: DataFrame, folder: str, parts: int) -> DataFrame:
    """First job: sorted word hashes and their counts; gives (part, size, tokens)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(parts, lambda k: _top(k, parts))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield from tally.add(hashed(part.column("text"))[0])
        yield from tally.send()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, counts in _received(batches):
            _save(folder, f"words-{part}", keys.astype("<u8"))
            _save_counts(folder, f"word-counts-{part}", counts[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts[0].sum())], pa.int64())],
                names=["part", "size", "tokens"])

    return _dealt(texts.mapInArrow(count, _PARTS), parts).mapInArrow(write, "part int, size long, tokens long")


class Grams:
    """N-grams of ``length`` words in mapped arrays; a gram's place counts over all parts.

    Pairs are sorted keys.  Of longer ones there are the word ids, sorted by context and id, and where each context's begin.
    """

    def __init__(self, folder: str, length: int, sizes: list[int], words: int, shorter: Grams | None):
        self.length, self.shorter, self.parts, self.total = length, shorter, len(sizes), sum(sizes)
        self.start = np.cumsum([0, *sizes])
        arrays = lambda name, kind: [_map(folder, f"{name}-{p}", kind) if n else np.zeros(0, kind) for p, n in enumerate(sizes)]
        if shorter is None:
            self.keys = arrays(f"grams-{length}", "<u8")
        else:
            self.ids, self.begins = arrays(f"ids-{length}", "<u4"), arrays(f"begins-{length}", "<u4")
        self.bits = _bits(length, words, shorter)

    def find(self, keys: np.ndarray, counts: list[Counts | None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of pairs, given as sorted distinct keys, -1 where training never saw one, and their ``counts``.

        Both are in the order of the parts, so that places ascend; last comes which key each is of.
        """
        out, times = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys) if counts else 0, dtype=np.int64)
        order, i = np.zeros(len(keys), dtype=np.int64), 0
        for p, mine in _by_part(_pair_part(keys, self.parts)):
            have, asked = self.keys[p], keys[mine]
            order[i:i + len(mine)] = mine
            if len(have):
                at = np.minimum(np.searchsorted(have, asked), len(have) - 1)
                found = np.flatnonzero(have.take(at) == asked)
                self._found(p, i + found, at[found], out, times, counts)
            i += len(mine)
        return out, times, order

    def follow(self, context: np.ndarray, ids: np.ndarray, counts: list[Counts | None] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts of longer n-grams, given as ascending contexts and words that are known by themselves."""
        out, times = np.full(len(ids), -1, dtype=np.int64), np.zeros(len(ids) if counts else 0, dtype=np.int64)
        for p, mine in _by_part(_context_part(self.shorter, self.parts, context)):
            have, begins = self.ids[p], self.begins[p]
            if len(have):
                mine = slice(mine[0], mine[-1] + 1)
                local, word = context[mine] - self.shorter.start[p], ids[mine]
                low, end = begins.take(local).astype(np.int64), begins.take(local + 1).astype(np.int64)
                todo = np.flatnonzero(low < end)
                left, right, asked = low[todo], end[todo], word[todo]
                while len(todo):  # a binary search of all at once, each among its context's words
                    middle = left + right >> 1
                    below = have.take(middle) < asked
                    left, right = np.where(below, middle + 1, left), np.where(below, right, middle)
                    low[todo] = left
                    more = np.flatnonzero(left < right)
                    todo, left, right, asked = todo[more], left[more], right[more], asked[more]
                at = np.flatnonzero(low < end)
                at = at[have.take(low[at]) == word[at]]
                self._found(p, mine.start + at, low[at], out, times, counts)
        return out, times

    def _found(self, part: int, mine: np.ndarray, at: np.ndarray, out: np.ndarray, times: np.ndarray, counts: list[Counts | None] | None) -> None:
        out[mine] = at + self.start[part]
        if counts and counts[part] is not None:
            times[mine] = counts[part][at][:, 0]

    def places(self, contexts: np.ndarray, context_at: np.ndarray, words: np.ndarray, word_at: np.ndarray,
               counts: list[Counts | None] | None = None) -> tuple[np.ndarray, ...]:
        """Different places, the last of them -1, which of them each (context, word) has, and the ``counts`` of the places.

        The place is -1 if either or both together are unknown.  The known ones of ``contexts`` and ``words`` ascend.
        """
        asked = np.flatnonzero((contexts >= 0)[context_at] & (words >= 0)[word_at])
        bits = np.uint64(len(words).bit_length())
        pairs, back = _distinct(_keys(context_at[asked], word_at[asked], bits), len(contexts).bit_length() + int(bits))
        context = contexts[(pairs >> bits).astype(np.int64)]
        word = words[(pairs & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)]
        if self.shorter is None:
            found, times, order = self.find(_keys(context, word, self.bits), counts)
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            back = rank[back]
        else:
            found, times = self.follow(context, word, counts)
        at = np.full(len(word_at), len(found), dtype=np.int64)
        at[asked] = back
        return np.r_[found, -1], at, np.r_[times, 0]

    def each(self, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Place of each of some n-grams that are all known."""
        if self.shorter is None:
            keys, back = np.unique(_keys(context, ids, self.bits), return_inverse=True)
            found, _, order = self.find(keys)
        else:
            order, back = np.argsort(context), slice(None)
            found, _ = self.follow(context[order], ids[order])
        out = np.empty(len(found), dtype=np.int64)
        out[order] = found
        return out[back]

    def tallied(self, context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted different places of n-grams that are all known, and how many have each."""
        if self.shorter is not None:
            order = np.argsort(context)
            return np.unique(self.follow(context[order], ids[order])[0], return_counts=True)
        keys, n = np.unique(_keys(context, ids, self.bits), return_counts=True)
        places, _, order = self.find(keys)
        return places, n[order]


def _bits(length: int, words: int, shorter: Grams | None) -> np.uint64:
    """Bits of a key that hold its word."""
    if length == 2:
        return np.uint64(32)
    bits = words.bit_length()
    if shorter.total.bit_length() + bits > 64:
        raise ValueError(f"n-grams of {length} words need more than 64 bits; widen the keys")
    return np.uint64(bits)


def _keys(context: np.ndarray, ids: np.ndarray, bits: np.uint64) -> np.ndarray:
    return context.astype(np.uint64) << bits | ids.astype(np.uint64)


def _gram_part(shorter: Grams | None, bits: np.uint64, parts: int, keys: np.ndarray) -> np.ndarray:
    """Pairs go by their hash, longer n-grams to the part of their context; the context before a text to the last."""
    return _pair_part(keys, parts) if shorter is None else _context_part(shorter, parts, (keys >> bits).astype(np.int64))


def _context_part(shorter: Grams, parts: int, context: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(shorter.start, context, side="right") - 1, parts - 1)


def _levels(folder: str, sizes: list[list[int]], words: int) -> list[Grams]:
    out: list[Grams] = []
    for s in sizes:
        out.append(Grams(folder, len(out) + 2, s, words, out[-1] if out else None))
    return out


@dataclass
class Step:
    """N-grams of one length: different contexts and which of them each token has, then the same of their own places, with counts."""

    contexts: np.ndarray
    context_at: np.ndarray
    places: np.ndarray | None = None
    at: np.ndarray | None = None
    times: np.ndarray | None = None


def _steps(tokens: Tokens, words: int, levels: list[Grams], counts: list[list[Counts | None]] | None = None) -> Iterator[Step]:
    """For n-grams of 2 words, 3 words, ...: contexts, and places among ``levels``, with ``counts`` if there are any;
    past the levels there are contexts alone.

    The context of a text's first word is the place behind the last one.
    """
    first = tokens.first
    places, at, behind = tokens.different, tokens.at, words
    for k, level in enumerate([*levels, None]):
        step = Step(np.r_[places, behind], np.r_[len(places), at[:-1]])
        step.context_at[first] = len(places)
        if level:
            places, at, step.times = level.places(step.contexts, step.context_at, tokens.different, tokens.at, counts[k] if counts else None)
            step.places, step.at = places, at
            behind = level.total
        yield step


def _counted(texts: DataFrame, folder: str, parts: int, sizes: list[int], levels: list[list[int]]) -> DataFrame:
    """N-grams one word longer than those of ``levels``, counted in each task and dealt to their parts."""
    n_words = sum(sizes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shorter = Words(folder, parts, sizes), _levels(folder, levels, n_words)
        last = shorter[-1] if shorter else None
        bits = _bits(len(levels) + 2, n_words, last)
        tally = _Tally(parts, lambda k: _gram_part(last, bits, parts, k))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                tokens = words.read(part.column("text"))
                *_, step = _steps(tokens, n_words, shorter)
                yield from tally.add(_keys(step.contexts[step.context_at], tokens.ids, bits))
        yield from tally.send()

    return _dealt(texts.mapInArrow(count, _PARTS), parts)


def _kept_counts(folder: str, length: int, part: int, counts: np.ndarray) -> None:
    """Counts of a part's n-grams, and how many of them have 1, 2, 3 and 4."""
    _save_counts(folder, f"gram-counts-{length}-{part}", counts)
    _save(folder, f"counts-of-{length}-{part}", np.array([(counts == i).sum() for i in (1, 2, 3, 4)]).astype("<i8"))


def _kept_contexts(folder: str, length: int, part: int, begins: np.ndarray, counts: np.ndarray) -> None:
    """Total and how many words followed once, twice, more often, of a part's contexts; zeros where nothing follows."""
    def of_context(values: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(values, dtype=np.int64)][begins])

    stats = [of_context(x) for x in (counts, counts == 1, counts == 2, counts > 2)]
    _save_counts(folder, f"contexts-{length}-{part}", np.stack(stats, axis=1))


def _written(folder: str, parts: int, words: int, levels: list[list[int]], top: bool):
    """Writes the parts of n-grams of 3 words or more.  Returns of each (part, size), and of ``top`` ones what
    ``_continued`` takes: the places of the n-grams that are left without their first word, and how often."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _levels(folder, levels, words)
        shorter, length = grams[-1], len(levels) + 2
        bits = _bits(length, words, shorter)
        for part, keys, counts in _received(batches):
            context = (keys >> bits).astype(np.int64)
            ids = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            first, last = int(shorter.start[part]), int(shorter.start[part + 1]) + (part == parts - 1)
            begins = np.r_[0, np.cumsum(np.bincount(context - first, minlength=last - first))]
            if len(keys) >= 1 << 32:
                raise ValueError("2^32 n-grams or more in a part; take more parts")
            _save(folder, f"ids-{length}-{part}", ids.astype("<u4"))
            _save(folder, f"begins-{length}-{part}", begins.astype("<u4"))
            # What the context is without its first word, then the n-gram without its own.
            rest = np.full(len(keys), shorter.shorter.total if shorter.shorter else words, dtype=np.int64)
            inside = context < shorter.total
            local = context[inside] - shorter.start[part]
            if length == 3:
                rest[inside] = (shorter.keys[part][local] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            elif inside.any():
                rest[inside] = _map(folder, f"links-{length - 1}-{part}", "<i8")[local]
            if not top:
                _save(folder, f"links-{length}-{part}", shorter.each(rest, ids).astype("<i8"))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64())], names=["part", "size"])
                continue
            yield from _finished(folder, parts, shorter, length, part, begins, counts[0], *shorter.tallied(rest, ids))

    return write


def _finished(folder: str, parts: int, shorter: Grams, length: int, part: int, begins: np.ndarray, counts: np.ndarray,
              places: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts and contexts of a part's n-grams are written; sent on is how many of them end in each shorter one."""
    _kept_counts(folder, length, part, counts)
    _kept_contexts(folder, length, part, begins, counts)
    to = np.searchsorted(shorter.start, places, side="right") - 1
    yield from _sent(to, parts, places.astype(np.uint64), n[:, None])


def _continued(folder: str, parts: int, words: int, levels: list[list[int]]):
    """Takes how many longer n-grams end in each n-gram of the last of ``levels``, as its count, and goes on below."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _levels(folder, levels, words)
        own, length = grams[-1], len(levels) + 1
        for part, places, counts in _received(batches):
            if length == 2:  # each ends some longer n-gram, so places are all of the part's
                yield from _pair_sums(folder, parts, words, part, np.array(own.keys[part]), counts[0])
            else:
                links = np.unique(_map(folder, f"links-{length}-{part}", "<i8"), return_counts=True)
                yield from _finished(folder, parts, own.shorter, length, part, own.begins[part], counts[0], *links)

    return work


def _pair_sums(folder: str, parts: int, n_words: int, part: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Writes the counts of a part's pairs and sends what contexts and words need."""
    _save_counts(folder, f"gram-counts-2-{part}", counts)
    # Contexts: total, and how many words followed once, twice, more often.  Words: how many contexts, and
    # as many columns of pairs with 1, 2, 3, 4, which only have to be added up.
    context, word = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
    n = [(counts == i).astype(np.int64) for i in (1, 2, 3, 4)]
    of = _summed(context, counts, n[0], n[1], (counts > 2).astype(np.int64), *[np.zeros_like(counts)] * 3)
    to = _summed(word, *[np.zeros_like(counts)] * 4, np.ones_like(counts), n[2], n[3])
    k, *c = _summed(np.r_[of[0], to[0]], *(np.r_[x, y] for x, y in zip(of[1:], to[1:])))
    yield from _sent((k * np.uint64(parts) // np.uint64(n_words + 1)).astype(np.int64), parts, k, np.stack(c, axis=1))


def _gram_counts(texts: DataFrame, folder: str, parts: int, sizes: list[int], order: int) -> tuple[DataFrame, list[list[int]]]:
    """The other jobs: sorted n-grams with counts per part, then per word what contexts and continuations need.

    Gives (kind, one, two, three, four, total): how many pairs and how many words have 1, 2, 3 and 4 (continuations);
    and how many n-grams of each length but the longest a part has.
    """
    n_words = sum(sizes)

    def only_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, _ in _received(batches):
            _save(folder, f"grams-2-{part}", keys.astype("<u8"))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64())], names=["part", "size"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, counts in _received(batches):
            _save(folder, f"grams-2-{part}", keys.astype("<u8"))
            yield from _pair_sums(folder, parts, n_words, part, keys, counts[0])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, counts in _received(batches, 7):
            # Dense arrays over the ids of this range.
            first, last = (-(-p * (n_words + 1) // parts) for p in (part, part + 1))
            dense = np.zeros((5, last - first), dtype=np.int64)
            dense[:, keys.astype(np.int64) - first] = counts[:5]
            _save_counts(folder, f"contexts-{part}", dense[:4].T)
            _save_counts(folder, f"continuations-{part}", dense[4])
            ones, twos = int(counts[1].sum()), int(counts[2].sum())
            kinds = [("pair", ones, twos, int(counts[5].sum()), int(counts[6].sum()), int(counts[4].sum()))]
            kinds.append(("word", *(int((dense[4] == i).sum()) for i in (1, 2, 3, 4)), int((dense[4] > 0).sum())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x)) for x in zip(*kinds)], names=["kind", "one", "two", "three", "four", "total"])

    levels: list[list[int]] = []
    for length in range(2, order):
        step = only_keys if length == 2 else _written(folder, parts, n_words, list(levels), False)
        found = {r["part"]: r["size"] for r in
                 _counted(texts, folder, parts, sizes, list(levels)).mapInArrow(step, "part int, size long").collect()}  # a row per part
        levels.append([found.get(p, 0) for p in range(parts)])
    step = write if order == 2 else _written(folder, parts, n_words, list(levels), True)
    made = _counted(texts, folder, parts, sizes, list(levels)).mapInArrow(step, _PARTS)
    for below in range(len(levels), 0, -1):
        made = _dealt(made, parts).mapInArrow(_continued(folder, parts, n_words, levels[:below]), _PARTS)
    return _dealt(made, parts).mapInArrow(gather, "kind string, one long, two long, three long, four long, total long"), levels


def discounts(one: int, two: int, three: int, four: int) -> list[float]:
    """The three discounts of the modified rule; a count of counts that is zero leaves the simple form or 0.5."""
    y = one / (one + 2 * two) if one else 0.5
    steps = [(1, one, two), (2, two, three), (3, three, four)]
    found = [i - (i + 1) * y * b / a if a else i * y for i, a, b in steps]
    return [min(max(d, 0.05), i) for d, (i, _, _) in zip(found, steps)]


@contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Jobs made and run inside leave no shuffle files behind when they end; the model's own files are all that is kept."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def trained(texts: DataFrame, parts: int | None = None, order: int = ORDER) -> Model:
    """The model of the rows (text) of ``texts``; null and empty texts train one end each.

    ``order`` is the longest n-gram's number of words, 2 or more; a text's first words have starts before them.
    """
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = texts.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = _file_path(new_folder(spark, "kneser"))
    os.makedirs(folder, exist_ok=True)
    with _freed(spark):
        return _model(texts, folder, parts, order)


def _model(texts: DataFrame, folder: str, parts: int, order: int) -> Model:
    found = {r["part"]: r for r in _word_counts(texts, folder, parts).collect()}  # a row per part
    sizes = [found[p]["size"] if p in found else 0 for p in range(parts)]
    if sum(sizes) >= 1 << 32:
        raise ValueError("more than 2^32 distinct words; widen the pair keys")
    tokens = sum(r["tokens"] for r in found.values())
    sums, levels, high = {k: [0] * 5 for k in ("pair", "word")}, [], []
    if tokens:
        made, levels = _gram_counts(texts, folder, parts, sizes, order)
        for r in made.collect():
            sums[r["kind"]] = [a + b for a, b in zip(sums[r["kind"]], (r["one"], r["two"], r["three"], r["four"], r["total"]))]
        for length in range(3, order + 1):  # a few numbers of each part
            names = (f"counts-of-{length}-{p}" for p in range(parts))
            high.append(discounts(*sum((_map(folder, n, "<i8").astype(int) for n in names if os.path.exists(f"{folder}/{n}")), np.zeros(4, int)).tolist()))
        if levels:
            sizes_of = (os.path.getsize(f) // 4 if os.path.exists(f) else 0 for f in (f"{folder}/ids-{order}-{p}" for p in range(parts)))
            levels.append(list(sizes_of))
    w = sums["word"]
    return Model(folder, parts, sizes, tokens, sums["pair"][4], discounts(*sums["pair"][:4]), discounts(*w[:4]),
                 [w[0], w[1], w[4] - w[0] - w[1]], levels, high)


class Scorer:
    """Log probabilities of whole texts under a model whose arrays are mapped into memory."""

    def __init__(self, model: Model):
        self.model, n = model, model.words
        self.words = Words(model.folder, model.parts, model.sizes)
        files = [f"{model.folder}/grams-2-{p}" for p in range(model.parts)]
        self.levels = _levels(model.folder, model.levels or [[os.path.getsize(f) // 8 if os.path.exists(f) else 0 for f in files]], n)
        self.word_counts, self.contexts, self.continuations = self._counts("word-counts"), self._counts("contexts", 4), self._counts("continuations")
        self.gram_counts = [self._counts(f"gram-counts-{g.length}") for g in self.levels]
        self.range_first = np.array([-(-p * (n + 1) // model.parts) for p in range(model.parts + 1)])
        self.followed = [(self.range_first, self.contexts), *((g.shorter.start, self._counts(f"contexts-{g.length}", 4)) for g in self.levels[1:])]
        self.discount, self.lower = np.r_[0.0, model.pair_discount], np.r_[0.0, model.word_discount]
        left = sum(d * c for d, c in zip(model.word_discount, model.word_counts))
        self.unseen = (left / model.pairs if model.pairs else 1.0) / (n + 1)

    def _counts(self, name: str, columns: int = 1) -> list[Counts | None]:
        folder, names = self.model.folder, [f"{name}-{p}" for p in range(self.model.parts)]
        return [Counts(folder, x, columns) if os.path.exists(f"{folder}/{x}") else None for x in names]

    @staticmethod
    def _of(places: np.ndarray, first: np.ndarray, counts: list[Counts | None], columns: int = 1) -> np.ndarray:
        """Counts of ``places``, of which part p has those from ``first[p]`` on; 0 for -1."""
        out = np.zeros((len(places), columns), dtype=np.int64)
        seen = np.flatnonzero(places >= 0)
        for p, mine in _by_part(np.minimum(np.searchsorted(first, places[seen], side="right") - 1, len(counts) - 1)):
            if counts[p] is not None:
                out[seen[mine]] = counts[p][places[seen[mine]] - first[p]]
        return out

    def context_stats(self, level: int, context: np.ndarray) -> np.ndarray:
        """Total, and words that followed once, twice, more often, of contexts; 0 for -1."""
        return self._of(context, *self.followed[level], 4)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and log10 probability of each text."""
        m, n = self.model, self.model.words
        tokens = self.words.read(texts)
        first, at, ids = tokens.first, tokens.at, tokens.different
        count = self._of(ids, self.words.start, self.word_counts)[:, 0]
        base = np.log10((count + 0.5) / (m.tokens + 0.5 * (n + 1)))[at]
        cont = self._of(ids, self.range_first, self.continuations)[:, 0]
        prob = (np.maximum(cont - self.lower[np.minimum(cont, 3)], 0) / max(m.pairs, 1) + self.unseen)[at]
        if m.pairs:
            for level, step in zip(range(len(self.levels)), _steps(tokens, n, self.levels, self.gram_counts)):
                discount = np.r_[0.0, m.discounts[level - 1]] if level else self.discount
                times, stats = step.times, self.context_stats(level, step.contexts)
                total = np.maximum(stats[:, 0], 1)
                left = np.where(stats[:, 0] > 0, stats[:, 1:] @ discount[1:] / total, 1.0)
                own = np.maximum(times - discount[np.minimum(times, 3)], 0)
                prob = own[step.at] / total[step.context_at] + left[step.context_at] * prob
        add = lambda values: np.add.reduceat(values, first)
        return tokens.sizes, add((ids >= 0).astype(np.int64)[at]), add(base), add(np.log10(prob))


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Every whole document under the model, of ``order`` words, of the documents outside fold HELD.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity.  Null text counts as
    empty and has its end alone; without training rows every word has probability 1 / (0 + 1).  Repeated rows each give
    a row and each train.  Hashes are of 64 bits: some two words share one with a chance of about words^2 / 2^65.
    """
    fold = fold_of(F.col("doc_id"), FOLDS)
    base = docs.select("doc_id", "text", (fold == HELD).alias("held_out"))
    model = trained(base.where(~F.col("held_out")).select("text"), order=order)
    mapped: dict[int, Scorer] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = mapped.setdefault(0, Scorer(model))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                size, known, low, score = scorer.score(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(size), pa.array(known), pa.array([model.tokens] * len(size), pa.int64()),
                     pa.array(low), pa.array(score), pa.array(10 ** (-score / size))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                "base_score double, score double, perplexity double")
