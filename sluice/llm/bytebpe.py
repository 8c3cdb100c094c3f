"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

A sequence of vocabulary entries is the encoding of its bytes exactly if every two neighbours are the encoding of
their own concatenation.  So a nondeterministic transducer needs to remember only the last entry and how far the next
one has been read.  Its determinisation is built as texts ask for it: a state is the set of open readings with the
entries each one still owes; what all of them owe alike is emitted at once, so an entry leaves after a bounded
lookahead.  At the end of a pre-token the one reading that stands between two entries gives the rest.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sluice.llm.common import column, give_back, in_worker, pieces

#: Pre-tokens, transducer states and entry pairs that a worker remembers; beyond it starts anew.
WORDS, STATES, PAIRS = 120_000, 100_000, 300_000
#: Below a trie node with so many entries at most, a reading is followed only if one of them may come.
FEW = 16
#: Entries decoded at a time.
CHUNK = 1 << 16
#: Letters of the first 256 characters but for the three that stand apart, and whatever is neither they nor ASCII.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_BEYOND_LATIN = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
_LOADED: dict[tuple[str, str], "Transducer"] = {}

Config = tuple[int, int, tuple[int, ...]]  # last entry or -1, trie node, entries owed


class Transducer:
    """The merges of a rank file, compiled as they are met."""

    def __init__(self, entries: dict[bytes, int], pattern: str):
        self.ranks = entries
        self.bytes_of = {i: b for b, i in entries.items()}
        self.split = regex.compile(pattern)
        # The same pattern for texts of ASCII and Latin letters alone, for the plain and faster engine.
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\t-\r {_LATIN}0-9]").replace(r"\p{L}", f"[{_LATIN}]").replace(r"\p{N}", "[0-9]")
        self.latin_split = re.compile(plain.replace(r"\s", r"[\t-\r ]").replace(r"\S", r"[^\t-\r ]"))
        self.table = [b""] * (1 + max(entries.values()))
        for b, i in entries.items():
            self.table[i] = b
        # The trie holds the entries that encode to themselves; others never come out of the merges.
        self.child: list[dict[int, int]] = [{}]
        self.entry: list[int] = [-1]
        # The last merge of each entry, and entries that merges would not reach: one that is a whole pre-token is
        # taken as it is all the same.
        self.halves: dict[int, tuple[int, int]] = {}
        self.whole: dict[bytes, int] = {}
        for b, i in entries.items():
            if not self._halve(b, i):
                self.whole[b] = i
                continue
            node = 0
            for x in b:
                if x not in self.child[node]:
                    self.child[node][x] = len(self.child)
                    self.child.append({})
                    self.entry.append(-1)
                node = self.child[node][x]
            self.entry[node] = i
        # The entries that lie below a node, where they are few.
        self.below: list[tuple[int, ...] | None] = [()] * len(self.child)
        for node in range(len(self.child) - 1, -1, -1):  # children come after their parents
            under: list[int] | None = []
            for to in self.child[node].values():
                more = self.below[to]
                if under is None or more is None:
                    under = None
                    break
                under += [*([self.entry[to]] if self.entry[to] >= 0 else []), *more]
            self.below[node] = tuple(under) if under is not None and len(under) <= FEW else None
        self.pairs: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})  # bounded by the vocabulary
        self.words = _Words(self)
        self.reset()

    def reset(self) -> None:
        start: tuple[Config, ...] = ((-1, 0, ()),)
        self.states: dict[tuple[Config, ...], int] = {start: 0}
        self.sets: list[tuple[Config, ...]] = [start]
        self.arcs: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.ahead: dict[int, int] = {}
        self.alike: dict[tuple[int, tuple[int, ...]], int] = {}

    def forget(self) -> None:
        """Give back what texts have made."""
        self.words, self.pairs, self.spines = _Words(self), {}, ({}, {})
        self.reset()

    def _open(self, last: int, node: int) -> int:
        """``last``, or an entry that the same entries below ``node`` may follow; -2 if none may."""
        below = self.below[node]
        if below is None or last < 0:
            return last
        key = last << 32 | node
        found = self.ahead.get(key)
        if found is None:
            if len(self.ahead) > PAIRS:
                self.ahead.clear()
                self.alike.clear()
            may = tuple(e for e in below if self.fits(last, e))
            found = self.ahead[key] = self.alike.setdefault((node, may), last) if may else -2
        return found

    def _halve(self, text: bytes, entry: int) -> bool:
        """Whether merging reaches the entry; notes the two entries that its last merge joins."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 40))
            if parts[best] + parts[best + 1] not in self.ranks:
                return False
            if len(parts) == 2:
                self.halves[entry] = self.ranks[parts[0]], self.ranks[parts[1]]
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return True

    def _spine(self, entry: int, side: int) -> list[tuple[int, bytes]]:
        """The entries at one end of an entry as its merges go on: rank of the merge that ends each, and its bytes."""
        found = self.spines[side].get(entry)
        if found is None:
            found, until, part = [], 1 << 40, entry
            while True:
                found.append((until, self.bytes_of[part]))
                if part not in self.halves:
                    break
                until, part = part, self.halves[part][side]
            self.spines[side][entry] = found
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether entry ``b`` may follow entry ``a``: no merge across the border comes before those that end its sides.

        Of equal merges the left one is first, so one inside ``a`` wins against the border and that one against ``b``.
        """
        right, rank = self._spine(b, 0), self.ranks.get
        for until_a, x in self._spine(a, 1):
            for until_b, y in right:
                across = rank(x + y)
                if across is not None and across < until_a and across <= until_b:
                    return False
        return True

    def neighbours(self, a: int, b: int) -> bool:
        """``fits``, remembered."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.fits(a, b)
        return known

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The arc for ``byte``: next state and the entries that are certain now."""
        child, entries, neighbours = self.child, self.entry, self.neighbours
        found: list[Config] = []  # in the order of where the open entry begins; the closed reading stands last
        closed: Config | None = None
        for last, node, owed in self.sets[state]:
            to = child[node].get(byte)
            if to is None:
                continue
            if child[to]:
                alike = self._open(last, to)
                if alike != -2:
                    found.append((alike, to, owed))
            entry = entries[to]
            if entry >= 0 and closed is None and (last < 0 or neighbours(last, entry)):
                closed = entry, 0, (*owed, entry)
        assert closed is not None  # every string of bytes has one encoding
        found.append(closed)
        out = found[0][2]
        if out:
            for c in found:
                size = min(len(out), len(c[2]))
                while out[:size] != c[2][:size]:
                    size -= 1
                out = out[:size]
            if out:
                found = [(last, node, owed[len(out):]) for last, node, owed in found]
        key = tuple(found)
        to_state = self.states.get(key)
        if to_state is None:
            to_state = self.states[key] = len(self.sets)
            self.sets.append(key)
            self.arcs.append({})
        self.arcs[state][byte] = to_state, out
        return to_state, out

    def run(self, text: bytes) -> list[int]:
        """Entries of one pre-token of any length."""
        if text in self.whole:
            return [self.whole[text]]
        if len(self.sets) > STATES:
            self.reset()
        out: list[int] = []
        state, arcs = 0, self.arcs
        for byte in text:
            try:
                state, more = arcs[state][byte]
            except KeyError:
                state, more = self.step(state, byte)
            if more:
                out += more
        out += self.sets[state][-1][2]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        split = self.split if _BEYOND_LATIN.search(text) else self.latin_split
        return b"".join(map(self.words.__getitem__, split.findall(text)))

    def decode(self, ids: bytes) -> Iterator[bytes]:
        """The bytes of the ids, in pieces, as a stream would deliver them."""
        for at in range(0, len(ids), 4 * CHUNK):
            part = np.frombuffer(ids[at:at + 4 * CHUNK], dtype="<u4")
            yield b"".join(map(self.table.__getitem__, part.data))

    def decoded_digest(self, ids: bytes) -> str:
        """SHA-256 of the bytes of the ids, which must arrive as whole UTF-8 characters."""
        seen, stream = hashlib.sha256(), Utf8Stream()
        for part in self.decode(ids):
            stream.feed(part)
            seen.update(part)
        stream.close()
        return seen.hexdigest()


class _Words(dict):
    """Ids of the pre-tokens met last, in two generations, so that frequent ones outlive the rest."""

    def __init__(self, fst: Transducer):
        super().__init__()
        self.fst, self.before = fst, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            found = self.fst.run(word.encode())
            ids = pack(f"<{len(found)}I", *found)
        if len(self) >= WORDS:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Utf8Stream:
    """Incremental UTF-8: gives whole characters and keeps an unfinished one until its bytes arrive.

    The state is the unfinished character's bytes, how many are still due and the range the next one must lie in.
    Bytes that cannot be UTF-8 raise a ValueError.
    """

    def __init__(self) -> None:
        self.held, self.due, self.low, self.high = b"", 0, 0x80, 0xBF

    def _byte(self, b: int) -> str:
        if self.due:
            if not self.low <= b <= self.high:
                raise ValueError("a continuation byte is missing")
            self.held, self.due, self.low, self.high = self.held + bytes([b]), self.due - 1, 0x80, 0xBF
        elif b < 0x80:
            return chr(b)
        elif 0xC2 <= b <= 0xF4:
            self.held, self.due = bytes([b]), 1 + (b >= 0xE0) + (b >= 0xF0)
            self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
            self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
        else:
            raise ValueError("not the first byte of a character")
        if self.due:
            return ""
        whole, self.held = self.held, b""
        return whole.decode()

    def feed(self, part: bytes) -> str:
        """Characters completed by ``part``; only the bytes around its edges go through the state one by one."""
        out, at = "", 0
        while self.due and at < len(part):
            out += self._byte(part[at])
            at += 1
        end = len(part)
        while end > at and end > len(part) - 3 and part[end - 1] & 0xC0 == 0x80:
            end -= 1
        if end > at and part[end - 1] >= 0xC0:  # the last character may be unfinished: its bytes go one by one
            end -= 1
        else:
            end = len(part)
        out += part[at:end].decode()
        for b in part[end:]:
            out += self._byte(b)
        return out

    def close(self) -> None:
        if self.due:
            raise ValueError("the text ends inside a character")


def read(path: str, pattern: str) -> Transducer:
    with open(path, "rb") as f:
        return Transducer({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def loaded(path: str, pattern: str) -> Transducer:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = read(path, pattern)
    return _LOADED[path, pattern]


def encoded(docs: DataFrame, vocab: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
            with_ids: bool = True, lasting: bool = True) -> DataFrame:
    """Id, n_tokens, token_ids, ids_sha256 and decoded_sha256 of every whole text; null text counts as empty.

    ids_sha256 is of the ids as little-endian 32-bit integers, decoded_sha256 of the bytes that streaming decoding gives
    back.  Repeated rows each give a row, an empty table gives no rows, other columns are not read.  One Python pass
    without a shuffle.  A ``lasting`` transducer stays in its worker and serves later tasks; otherwise each task builds its
    own and gives the memory back, for jobs whose workers go on to other stages.  Letters that Unicode added after the libraries' tables may split differently.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = in_worker(__name__)
        fst = (home.loaded if lasting else home.read)(vocab, pattern)
        for batch in batches:
            for part, texts in pieces(batch, text_col):
                ids = [fst.encode(t or "") for t in texts]
                sizes = np.array([len(i) // 4 for i in ids])
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").view("<i4"))
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), flat)] if with_ids else []
                digests = [pa.array(list(map(f, ids))) for f in (lambda i: hashlib.sha256(i).hexdigest(), fst.decoded_digest)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(id_col)), pa.array(sizes, pa.int64()), *lists, *digests],
                    names=[id_col, "n_tokens", *["token_ids"] * with_ids, "ids_sha256", "decoded_sha256"])
        if not lasting:
            fst.forget()
            give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    ids_kind = "token_ids array<int>, " if with_ids else ""
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, {ids_kind}ids_sha256 string, decoded_sha256 string")


def decoded(ids: DataFrame, vocab: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Id and text of rows with token_ids; ids that do not spell UTF-8 raise a ValueError, null ids are empty."""
    kind = ids.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = in_worker(__name__).loaded(vocab, pattern)
        for batch in batches:
            texts = []
            for row in column(batch, "token_ids"):
                stream = Utf8Stream()
                texts.append("".join(map(stream.feed, fst.decode(np.array(row or [], dtype="<u4").tobytes()))))
                stream.close()
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(id_col)), pa.array(texts, pa.string())], names=[id_col, "text"])

    return ids.select(id_col, "token_ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, vocab: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encoded`` without the ids themselves."""
    return encoded(docs, vocab, pattern, id_col, text_col, with_ids=False)
