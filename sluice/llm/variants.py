"""Spelling variants of the words of a corpus by a dictionary of trie-node pairs.

The distinct words are sorted, once as they are and once reversed, and every prefix and every suffix gets the number of
its trie node: a word opens as many new nodes as it is longer than what it shares with the word before it, so nodes are
numbered in order across all sorted ranges.  A word split at a position is the pair (prefix node, suffix node), a word
with one letter left out the pair (prefix node, node of the suffix behind the letter).  Two words differ by a replaced
letter where they leave out to one pair, by an inserted or deleted one where one leaves out to a split of the other.  A
pair holds at most one split and one word for each letter of the alphabet, so what meets in a pair is bounded and is
summed up there: no pair of words is emitted.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import column, parked, pieces

#: Letters a word has at least, occurrences it needs, and how much more frequent its form has to be.
LETTERS, OCCURRENCES, TIMES = 5, 3, 2
#: One in so many runs loses a letter.
DRAW = 97
#: Words that a task numbers before it hands their counts on.
CACHE = 1 << 18

RUNS = re.compile("[a-zÀ-ÿ]+")  # after A-Z are lower-cased
SPLIT, LEFT_OUT, LEFT_OUT_FIRST = 0, 1, 2


class _Vocabulary(dict):
    """Numbers words as they come, with the length and checksum of their UTF-8 bytes."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self._size: list[int] = []
        self._crc: list[int] = []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self.words)
        raw = word.encode()
        self.words.append(word)
        self._size.append(len(raw))
        self._crc.append(zlib.crc32(raw))
        return at

    def measured(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self._size, dtype=np.int64), np.array(self._crc, dtype=np.uint32)


def _shifts(start: int, sizes: np.ndarray) -> np.ndarray:
    """By what the checksum of ``start`` changes that of a word of each size behind it: checksums are linear."""
    known = {int(n): zlib.crc32(bytes(int(n)), start) ^ zlib.crc32(bytes(int(n))) for n in np.unique(sizes)}
    if not known:
        return np.zeros(0, dtype=np.uint32)
    keys = np.array(sorted(known))
    return np.array([known[k] for k in keys.tolist()], dtype=np.uint32)[np.searchsorted(keys, sizes)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words, bounded tables of them at a time."""
    words, counts, lost = _Vocabulary(), np.zeros(0, dtype=np.int64), {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(words.words), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(words.words[at:at + (1 << 16)], pa.string()), pa.array(counts[at:at + (1 << 16)])],
                                             names=["word", "n"])
        if lost:
            yield pa.RecordBatch.from_arrays([pa.array(list(lost), pa.string()), pa.array(list(lost.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for part, texts in pieces(batch, "text"):
            found, owners = [], []
            for owner, text in zip(column(part, "id"), texts):
                if text:
                    runs = RUNS.findall(text.encode().lower().decode())  # bytes: only A-Z change
                    found.append(np.fromiter(map(words.__getitem__, runs), dtype=np.int64, count=len(runs)))
                    owners.append(zlib.crc32(f"{owner}:".encode()))
            sizes, crcs = words.measured()
            counts = np.r_[counts, np.zeros(len(sizes) - len(counts), dtype=np.int64)]
            for owner, numbers in zip(owners, found):
                draw = _shifts(owner, sizes[numbers]) ^ crcs[numbers]
                hit = draw % DRAW == 0
                np.add.at(counts, numbers[~hit], 1)
                for number, h in zip(numbers[hit].tolist(), draw[hit].tolist()):
                    word = words.words[number]
                    at = h % len(word)
                    word = word[:at] + word[at + 1:]
                    lost[word] = lost.get(word, 0) + 1
            if len(words.words) + len(lost) > CACHE:
                yield from flushed()
                words, counts, lost = _Vocabulary(), np.zeros(0, dtype=np.int64), {}
    yield from flushed()


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of all texts: runs of letters up to U+00FF, A-Z lower-cased, one in DRAW short of a letter.

    The run that loses a letter, and which, follow from the checksum of the id and the run.  Null texts have no words; a
    null id counts as the empty text.  Words of fewer than LETTERS letters or OCCURRENCES occurrences are left out.
    """
    partial = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _counted, "word string, n long")
    return (partial.where((F.char_length("word") >= LETTERS) & (F.col("n") > 0)).groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= OCCURRENCES))


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path of every word in the trie of its sorted range: the nodes of its prefixes, numbered from 0 within the range."""
    part, last, path, opened = TaskContext.get().partitionId(), "", [], 0
    for batch in batches:
        for row in range(0, batch.num_rows, 4096):
            piece = batch.slice(row, 4096)
            words, paths = column(piece, "word"), []
            for word in words:
                keep = _shared(last, word)
                path = [*path[:keep], *range(opened, opened + len(word) - keep)]
                opened += len(word) - keep
                paths.append(path)
                last = word
            yield pa.RecordBatch.from_arrays([
                *piece.columns, pa.array(np.full(len(words), part, dtype=np.int32)), pa.array(paths, pa.list_(pa.int64()))],
                names=[*piece.schema.names, "part", "path"])


def numbered(words: DataFrame, out: str) -> DataFrame:
    """``words`` (word, ...) with ``out``: the nodes of the prefixes of ``word`` in one trie of all words, shortest first.

    Node 0 is the root, which has no place in the list.  Nodes are numbered in the order of sorted words, so the node of a
    whole word orders words as their code points do.  The driver holds one first and one last word of every sorted range.
    """
    local = parked(words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(
        _nodes, f"{words.schema.toDDL()}, part int, path array<long>"), "trie-ranges")
    ends = local.groupBy("part").agg(F.min(F.struct("word", "path")).alias("first"), F.max(F.struct("word", "path")).alias("last"),
                                     F.max(F.expr("array_max(path)")).alias("top")).collect()
    bases, inherited, before, base = [], [], ("", []), 1
    for r in sorted(ends, key=lambda r: r["part"]):
        first, (last, path) = r["first"], r["last"]
        # Nodes of the first word that the range before has opened already keep the numbers they have there.
        known = before[1][:_shared(before[0], first["word"])]
        bases.append((r["part"], base, known))
        there = [known[n] if n < len(known) else base + n for n in path]
        before, base = (last, there), base + r["top"] + 1
    # One row for each sorted range.
    table = words.sparkSession.createDataFrame(bases, "part int, base long, known array<long>")
    node = lambda x: F.when(x < F.size("known"), F.get("known", x.cast("int"))).otherwise(x + F.col("base"))
    return local.join(F.broadcast(table), "part").withColumn(out, F.transform("path", node)).drop("part", "path", "base", "known")


_PAIR = pa.schema([("prefix", pa.int64()), ("suffix", pa.int64()), ("kind", pa.int8()), ("id", pa.int64()), ("n", pa.int64())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word's splits and left-out letters as pairs of nodes."""
    for batch in batches:
        for row in range(0, batch.num_rows, 2048):
            piece = batch.slice(row, 2048)
            words, n = column(piece, "word"), piece.column(piece.schema.get_field_index("n")).to_numpy()
            ahead, behind = (piece.column(piece.schema.get_field_index(c)).flatten().to_numpy() for c in ("ahead", "behind"))
            size = np.array([len(w) for w in words], dtype=np.int64)
            start = np.cumsum(size) - size
            # With the roots: the prefix of i letters stands at (start + word number + i), the suffix of i letters likewise.
            fence = start + np.arange(len(words))
            prefix, suffix = np.zeros(len(ahead) + len(words), dtype=np.int64), np.zeros(len(ahead) + len(words), dtype=np.int64)
            inside = np.ones(len(prefix), dtype=bool)
            inside[fence] = False
            prefix[inside], suffix[inside] = ahead, behind
            own = ahead[start + size - 1]  # the node of the whole word
            at = np.repeat(np.arange(len(words)), size + 1)
            i = np.arange(len(prefix)) - fence[at]
            splits = (prefix[fence[at] + i], suffix[fence[at] + size[at] - i], np.zeros(len(at), dtype=np.int8), own[at], n[at])
            at = np.repeat(np.arange(len(words)), size)
            i = np.arange(len(at)) - start[at]
            letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
            # Leaving out any letter of a row of equal ones gives one word; only the first of them counts for deletions.
            fresh = (i == 0) | (letters != np.r_[letters[:1], letters[:-1]])
            left = (prefix[fence[at] + i], suffix[fence[at] + size[at] - i - 1], np.where(fresh, LEFT_OUT_FIRST, LEFT_OUT).astype(np.int8), own[at], n[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t.type) for c, t in zip(zip(splits, left), _PAIR)], schema=_PAIR)


_NEAR = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.int64())])


def _met(rows: list[np.ndarray]) -> pa.RecordBatch:
    """What the members of each pair learn there: how many near words, and the most frequent of them."""
    prefix, suffix, kind, own, n = rows
    first = np.r_[True, (prefix[1:] != prefix[:-1]) | (suffix[1:] != suffix[:-1])]
    group = np.cumsum(first) - 1
    alone = np.bincount(group)[group] == 1
    prefix, suffix, kind, own, n, group = (x[~alone] for x in (prefix, suffix, kind, own, n, group))
    order = np.lexsort((own, -n, kind == SPLIT, group))  # words of a pair by frequency, its split last
    kind, own, n, group = (x[order] for x in (kind, own, n, group))
    if not len(own):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, schema=_NEAR)
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    group = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
    place = np.arange(len(own)) - begin[group]
    split, fresh = kind == SPLIT, kind == LEFT_OUT_FIRST
    skips = np.bincount(group, weights=~split, minlength=len(begin)).astype(np.int64)
    heads = np.bincount(group, weights=fresh, minlength=len(begin)).astype(np.int64)
    # Replaced letters: the best of the others is the first, or the second for the first itself.
    near = np.where(split, heads[group], skips[group] - 1)
    rival = begin[group] + np.where(place == 0, 1, 0)
    has = ~split & (skips[group] > 1)
    rival = np.where(has, rival, 0)
    best_n, best = np.where(has, n[rival], 0), np.where(has, own[rival], 0)
    # Left-out letters: the split meets the best of those that count, each of which meets the split.
    far = np.iinfo(np.int64).max
    top = np.full(len(begin), far)
    np.minimum.at(top, group[fresh], np.flatnonzero(fresh))
    meets = split & (heads[group] > 0)
    best_n[meets], best[meets] = n[top[group[meets]]], own[top[group[meets]]]
    at_split = np.full(len(begin), -1)
    at_split[group[split]] = np.flatnonzero(split)
    deleted = fresh & (at_split[group] >= 0)
    other = at_split[group[deleted]]
    near[deleted] += 1
    better = (n[other] > best_n[deleted]) | ((n[other] == best_n[deleted]) & (own[other] < best[deleted]))
    where = np.flatnonzero(deleted)[better]
    best_n[where], best[where] = n[other[better]], own[other[better]]
    keep = near > 0
    return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (own, near, best_n, best)], schema=_NEAR)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pairs, whole ones at a time; a pair has a bounded number of rows, so what is carried over is bounded."""
    held = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(p) for p in zip(held, rows)]
        if not len(rows[0]):
            continue
        same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        held = [r[same] for r in rows]
        if not same.all():
            yield _met([r[~same] for r in rows])
    if held is not None:
        yield _met(held)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, id, near, best_n, best): how many words are near, and the frequency and id of the most frequent one.

    Near are words that differ by exactly one inserted, deleted or replaced code point; of equally frequent ones the first
    in code-point order counts.  Words without near ones have nulls.
    """
    ahead = numbered(words, "ahead")
    behind = numbered(words.select(F.reverse("word").alias("word")), "behind").select(F.reverse("word").alias("word"), "behind")
    paths = parked(ahead.join(behind, "word"), "trie-paths")
    pairs = paths.mapInArrow(_pairs, "prefix long, suffix long, kind byte, id long, n long")
    met = pairs.repartition("prefix", "suffix").sortWithinPartitions("prefix", "suffix").mapInArrow(
        _meetings, "id long, near long, best_n long, best long")
    best = met.groupBy("id").agg(F.sum("near").alias("near"), F.max(F.struct("best_n", (-F.col("best")).alias("least"))).alias("top")).select(
        "id", "near", "top.best_n", (-F.col("top.least")).alias("best"))
    return paths.select("word", "n", F.element_at("ahead", -1).alias("id")).join(best, "id", "left")


def _followed(steps: DataFrame) -> DataFrame:
    """(id, root) from (id, root) whose root is the next word: each round doubles the way, every round is written."""
    while True:
        ahead = steps.select(F.col("id").alias("root"), F.col("root").alias("further"))
        steps = parked(steps.select("id", "root").join(ahead, "root", "left").select(
            "id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        if steps.where("moved").isEmpty():
            return steps.select("id", "root")


def grouped(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n; distinct words without nulls).

    A word's form is its most frequent near word, if that is at least TIMES as frequent; its root the end of the way from
    form to form, which is finite since frequencies grow along it.  An empty table gives no rows.
    """
    near = parked(near_words(words), "variant-near")
    form: Column = F.when(F.col("best_n") >= TIMES * F.col("n"), F.col("best"))
    told = near.select("word", "n", "id", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), form.alias("form_id"))
    roots = _followed(told.where("form_id is not null").select("id", F.col("form_id").alias("root")))
    names = near.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    ends = near.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    return (told.join(names, "form_id", "left").join(roots.join(ends, "root").select("id", "root_word"), "id", "left")
            .select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"))


def variants(docs: DataFrame) -> DataFrame:
    """The spelling variants among the words of ``docs``; see ``counted`` and ``grouped``."""
    return grouped(parked(counted(docs), "variant-words"))
