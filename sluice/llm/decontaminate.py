"""Benchmark decontamination by suffix arrays over shards of the corpus.

A shard is a slice of whole documents in a task.  Its words become codes of the benchmark's vocabulary (0 for any
other word and between documents), and the positions with a code are sorted as suffixes.  Every benchmark suffix is
searched by binary search, one word deeper at a time, in all shards at once as they pass by; the interval it ends in
holds the locations of its match.  Neighbouring matches on one diagonal join into longest verbatim matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sluice.llm.common import column, pieces, widened

#: Words in a window, text bytes of the benchmark in one block, bytes split into words at once.
WINDOW, BLOCK_BYTES, PIECE = 10, 32 << 20, 1 << 20
#: Lower-cases A-Z and turns every other ASCII character but digits and letters into a blank.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in pieces of bounded size."""
    raw = (text or "").encode().translate(_FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


class Searches:
    """Distinct windows of a block of benchmark items, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.vocab: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], int] = {}
        self.places: list[list[tuple[str | None, int]]] = []  # of each window: (item, word position)
        for item, text in items:
            codes = [self.vocab.setdefault(w, len(self.vocab) + 1) for ws in words_of(text) for w in ws]
            for i in range(max(1, len(codes) - WINDOW + 1) if codes else 0):
                key = tuple(codes[i:i + WINDOW])
                if key not in windows:
                    windows[key] = len(windows)
                    self.places.append([])
                self.places[windows[key]].append((item, i))
        self.size = np.array([len(w) for w in windows], dtype=np.int64)
        self.codes = np.zeros((len(windows), WINDOW), dtype=np.int64)
        for i, w in enumerate(windows):
            self.codes[i, :len(w)] = w

    def code(self, text: str | None) -> np.ndarray:
        get = self.vocab.get
        parts = [np.fromiter((get(w, 0) for w in ws), dtype=np.int64, count=len(ws)) for ws in words_of(text)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


class Shard:
    """Suffixes of some documents, sorted by at least WINDOW words."""

    def __init__(self, codes: list[np.ndarray], most: int):
        self.sizes = np.array([len(c) for c in codes], dtype=np.int64)
        gap = np.zeros(1, dtype=np.int64)
        self.first = np.cumsum(np.r_[0, self.sizes[:-1] + 1])
        flat = np.concatenate([x for c in codes for x in (c, gap)]) if codes else gap
        self.flat = np.concatenate([flat, np.zeros(2 * WINDOW, dtype=np.int64)])
        pos = np.flatnonzero(flat)
        # Several words in one key, then doubling; ranks of positions without a code are 0.
        bits = max(1, int(most).bit_length())
        depth = min(WINDOW, 62 // bits)
        key = np.zeros(len(pos), dtype=np.int64)
        for k in range(depth):
            key = key << bits | self.flat[pos + k]
        order = np.argsort(key, kind="stable")
        while depth < WINDOW and len(pos):
            sorted_ = key[order]
            rank = np.zeros(len(self.flat) + WINDOW, dtype=np.int64)
            rank[pos[order]] = np.cumsum(np.r_[1, sorted_[1:] != sorted_[:-1]])
            key = rank[pos] * (len(pos) + 1) + rank[pos + depth]
            order = np.argsort(key, kind="stable")
            depth *= 2
        self.suffixes = pos[order]

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> np.ndarray:
        """First suffix of each interval whose word at ``depth`` is not below ``word``."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            mid = (low + high) >> 1
            below = self.flat[self.suffixes[np.minimum(mid, len(self.suffixes) - 1)] + depth] < word
            open_ = low < high
            low = np.where(open_ & below, mid + 1, low)
            high = np.where(open_ & ~below, mid, high)
        return low

    def find(self, searches: Searches) -> tuple[np.ndarray, np.ndarray]:
        """(window, word position in the shard) of every occurrence."""
        which = np.arange(len(searches.size))
        low, high = np.zeros(len(which), dtype=np.int64), np.full(len(which), len(self.suffixes))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for depth in range(WINDOW):
            word = searches.codes[which, depth]
            low, high = self._bound(low, high, depth, word), self._bound(low, high, depth, word + 1)
            open_ = low < high
            which, low, high = which[open_], low[open_], high[open_]
            ended = searches.size[which] == depth + 1
            done.append((which[ended], low[ended], high[ended]))
            which, low, high = which[~ended], low[~ended], high[~ended]
        which, low, high = (np.concatenate([d[i] for d in done]) for i in range(3))
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(which, n), self.suffixes[at]

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1


def _covered(shard: Shard, size: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Whether each word of the shard lies in an occurrence."""
    n = len(shard.flat) + 1
    edges = np.bincount(position, minlength=n) - np.bincount(position + size, minlength=n)
    return np.cumsum(edges) > 0


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _per_document(shard: Shard, searches: Searches) -> Iterator[tuple[int, list[tuple[int, int]], list[str | None]]]:
    """(words, hit word runs, items) of each document of a shard."""
    window, position = shard.find(searches)
    hit = _covered(shard, searches.size[window], position)
    count = max(1, len(searches.size))
    pairs = np.unique(shard.doc_of(position) * count + window) if len(position) else np.zeros(0, dtype=np.int64)
    bounds = np.searchsorted(pairs // count, np.arange(len(shard.sizes) + 1))
    for d, n in enumerate(shard.sizes.tolist()):
        mine = pairs[bounds[d]:bounds[d + 1]] % count
        found = {i for w in mine.tolist() for i, _ in searches.places[w]}
        items = [*sorted(found - {None}), *([None] if None in found else [])]
        yield n, _runs(hit[shard.first[d]:shard.first[d] + n]) if len(mine) else [], items


def _blocks(benchmark: DataFrame, unnamed: bool = False) -> tuple[int, Iterator[list[tuple[str | None, str | None]]]]:
    """How many blocks of bounded size the benchmark has, and one after another their items; ``unnamed`` ones if asked."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("id"), "text")
    rows = rows if unnamed else rows.where("id IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = total // BLOCK_BYTES + 1
    parts = (rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k) for k in range(count))
    return count, ([(r["id"], r["text"]) for r in part.collect()] for part in parts)


def _searched(docs: DataFrame, items: list, text_col: str, keep: list[str], schema: str, rows) -> DataFrame:
    """One Python pass of a block of items over whole documents; ``rows(shard, searches)`` gives a row's new values."""
    block = docs.sparkSession.sparkContext.broadcast(Searches(items))  # of at most BLOCK_BYTES of text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = block.value
        for batch in batches:
            for part, texts in pieces(batch, text_col):
                shard = Shard([searches.code(t) for t in texts], len(searches.vocab))
                new = list(zip(*rows(shard, searches)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(k)) for k in keep), *map(pa.array, new, types)],
                    names=kinds.names)

    kinds = widened(docs.select(*keep), schema)
    types = [to_arrow_type(f.dataType) for f in kinds.fields[len(keep):]]
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, kinds)


def _row(n: int, runs: list[tuple[int, int]], items: list[str | None]) -> tuple:
    named = ",".join(i for i in items if i is not None)
    return n, sum(b - a for a, b in runs), len(items), hashlib.sha256(named.encode()).hexdigest()


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text_col: str = "text",
                 unnamed: bool = False) -> DataFrame:
    """``keep`` (the id) with n_words, n_hit, n_items, items_sha256 of every whole document.

    Null and empty texts have no words.  Items without words have no window.  Items with a null id are left aside, or,
    if ``unnamed``, searched as one item, as the SQL does: counted in n_hit and n_items, not named in the digest.  Without
    items nothing is hit.  A benchmark beyond one block takes a pass per block, whose runs of hit words are united per
    row.  Repeated rows each give a row; an empty table gives none.
    """
    keep = keep or ["doc_id"]
    count, blocks = _blocks(benchmark, unnamed)
    if count == 1:
        return _searched(docs, next(blocks), text_col, keep, "n_words long, n_hit long, n_items long, items_sha256 string",
                         lambda shard, searches: (_row(*d) for d in _per_document(shard, searches)))

    def flat(shard: Shard, searches: Searches) -> Iterator[tuple]:
        for n, runs, items in _per_document(shard, searches):
            yield n, [x for run in runs for x in run], items

    docs = docs.withColumn("copy_key", F.xxhash64(text_col))
    keys = [*keep, "copy_key"]
    parts = [_searched(docs, b, text_col, keys, "n_words long, runs array<long>, items array<string>", flat)
             .withColumn("first", F.lit(int(i == 0))) for i, b in enumerate(blocks)]
    united = parts[0]
    for p in parts[1:]:
        united = united.union(p)
    rows = united.groupBy(*keys).agg(F.sum("first").alias("copies"), F.max("n_words").alias("n_words"),
                                     F.collect_set("runs").alias("runs"), F.collect_set("items").alias("items"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, runs, items in zip(*(column(batch, c) for c in ("n_words", "runs", "items"))):
                hit = np.zeros(n + 1, dtype=np.int64)
                for r in runs:
                    np.add.at(hit, r[::2], 1)
                    np.add.at(hit, r[1::2], -1)
                out.append(_row(n, _runs(np.cumsum(hit)[:n] > 0), sorted({i for x in items for i in x}, key=lambda i: (i is None, i or ""))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(k)) for k in (*keep, "copies")), *map(pa.array, zip(*out))],
                names=[*keep, "copies", "n_words", "n_hit", "n_items", "items_sha256"])

    schema = widened(rows.select(*keep, "copies"), "n_words long, n_hit long, n_items long, items_sha256 string")
    return rows.mapInArrow(unite, schema).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, matches): every longest verbatim match of at least a window, as item, its word, the document's word, words."""
    def rows(shard: Shard, searches: Searches) -> Iterator[tuple]:
        window, position = shard.find(searches)
        doc = shard.doc_of(position)
        found: dict[tuple[int, str, int], list[int]] = {}
        for w, x, d in zip(window.tolist(), position.tolist(), doc.tolist()):
            for item, p in searches.places[w]:
                found.setdefault((d, item, x - int(shard.first[d]) - p), []).append(p)
        out: list[list[dict]] = [[] for _ in shard.sizes]
        for (d, item, shift), starts in sorted(found.items()):
            starts.sort()
            begin = 0
            for i in range(1, len(starts) + 1):
                if i == len(starts) or starts[i] != starts[i - 1] + 1:
                    # A short item's only window is the item itself.
                    size = min(WINDOW, _item_size(searches, item)) + i - 1 - begin
                    out[d].append({"item": item, "item_word": starts[begin], "doc_word": starts[begin] + shift, "n_words": size})
                    begin = i
        return ((m,) for m in out)

    kind = "matches array<struct<item:string,item_word:long,doc_word:long,n_words:long>>"
    parts = [_searched(docs, b, "text", ["doc_id"], kind, rows) for b in _blocks(benchmark)[1]]
    united = parts[0]
    for p in parts[1:]:
        united = united.union(p)
    return united.where(F.size("matches") > 0)


def _item_size(searches: Searches, item: str) -> int:
    """Words of an item, as far as a window reaches."""
    if not hasattr(searches, "sizes"):
        searches.sizes = {i: int(searches.size[w]) for w, places in enumerate(searches.places) for i, _ in places}
    return searches.sizes[item]


#: The same rows by SQL: all windows of documents joined with the windows of items.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS words FROM bs),
ds AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
  FROM d CROSS JOIN (SELECT DISTINCT size FROM bw) WHERE len(w) >= size),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS words FROM ds),
m AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw USING (size, words)),
h AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM (SELECT DISTINCT doc_id, i, size FROM m)) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
