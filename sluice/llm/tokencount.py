"""Token counts by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a slice are laid out as one flat array of symbols.  In every round each sequence applies its own
lowest-ranked pair, at all places at once; sequences without a pair leave.  What survives is the token count.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sluice.llm.common import in_worker, pieces

#: Fixed values of the vocabulary's pre-tokenizer; the pattern itself is read from the file.
_NONE = np.iinfo(np.int64).max
#: Distinct pre-tokens a worker remembers.
CACHE = 400_000
_LOADED: dict[str, "WordMerges"] = {}


def _byte_letters() -> list[str]:
    """The printable stand-in that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b if b in set(shown) else next(extra)) for b in range(256)]


class WordMerges:
    """The merges of a word-end vocabulary file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # A pair listed twice keeps its last rank, as in a map built in file order.
        keys, last = np.unique(keys[::-1], return_index=True)
        self.keys, self.ranks = keys, len(pairs) - 1 - last
        self.made = made[self.ranks]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split)
        self.specials = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        self.cache: dict[str, int] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def survivors(self, words: list[bytes]) -> np.ndarray:
        """Number of symbols left of each word after all merges."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.final[flat[ends - 1]]
        seq = np.repeat(np.arange(len(words)), sizes)
        made_of = np.empty(len(self.ranks), dtype=np.int64)
        made_of[self.ranks] = self.made
        counts = np.zeros(len(words), dtype=np.int64)

        rank = np.full(len(symbols), _NONE)
        if len(symbols) > 1:
            rank[:-1] = np.where(seq[:-1] == seq[1:], self.rank_of(symbols[:-1], symbols[1:]), _NONE)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lengths = np.diff(np.r_[starts, len(symbols)])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            alive = lowest != _NONE
            if not alive.all():
                done = starts[~alive[starts]]
                counts[seq[done]] = lengths[~alive[starts]]
                symbols, seq, rank, lowest = symbols[alive], seq[alive], rank[alive], lowest[alive]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == lowest)
            # In a row of overlapping hits every second one gives way, from the left.
            fresh = np.r_[True, np.diff(hit) != 1]
            place = np.arange(len(hit)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            hit = hit[place % 2 == 0]
            symbols[hit] = made_of[rank[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))
            symbols, seq, rank = symbols[keep], seq[keep], rank[keep]
            touched = np.unique(np.r_[moved, moved[moved > 0] - 1])
            rank[touched] = _NONE
            touched = touched[touched < len(symbols) - 1]
            touched = touched[seq[touched] == seq[touched + 1]]
            rank[touched] = self.rank_of(symbols[touched], symbols[touched + 1])
        return counts

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """Special tokens in the text, and its pre-tokens."""
        parts = self.specials.split(text) if "<|" in text else [text]
        found: list[str] = []
        for part in parts:
            part = unicodedata.normalize("NFC", part)
            # Letter by letter, so a final sigma has no form of its own.
            found += self.words.findall(part.replace("Σ", "σ").lower())
        return len(parts) - 1, found

    def count(self, texts: list[str | None]) -> list[int]:
        split = [self.pieces(t) if t else (0, []) for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = list(set().union(*(w for _, w in split)).difference(self.cache))
        if new:
            self.cache.update(zip(new, self.survivors([w.encode() for w in new]).tolist()))
        size = self.cache.__getitem__
        return [n + sum(map(size, words)) for n, words in split]


def loaded(path: str) -> WordMerges:
    if path not in _LOADED:
        _LOADED[path] = WordMerges(path)
    return _LOADED[path]


def counted(docs: DataFrame, vocab: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_bytes, n_tokens and over_limit of every whole text.

    ``vocab`` is a file each worker can open.  Null text counts as empty (0 tokens); repeated rows each give a row; an
    empty table gives no rows; other columns are not read.  One Python pass without a shuffle: the slice of texts in
    hand and the remembered pre-tokens bound a worker's memory.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = in_worker(__name__).loaded(vocab)
        for batch in batches:
            for part, texts in pieces(batch, text_col):
                n_tokens = list(merges.count(texts))
                n_bytes = [len(t.encode()) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(id_col)), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                     pa.array([n > limit for n in n_tokens], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
