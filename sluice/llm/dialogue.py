"""Repair of the turn structure of conversations by a run-length dynamic program.

Every row of a conversation becomes a symbol: the class of its role and its fault.  Equal consecutive symbols are
collapsed into runs.  What the edits of one row cost between the four states of a well-formed conversation (nothing yet,
after the system row, after a user, after an assistant) is a 4 x 4 min-plus matrix, and a run of n rows is its n-th
power, put together from cached binary powers.  The vectors of least costs that result at the ends of runs are then
unrolled from the front, always by the least letter that keeps the cost, which gives the audit.

Conversations up to LONG rows are repaired by one task each, rows arriving sorted.  A longer one is dealt out by ranges of
its rows and cut into bounded chunks; only the chunks' matrices and end states travel in order, so no task holds a
conversation and only the digest, which is sequential by definition, streams its repaired text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, groupby
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import parked

#: Costs of the edits, and of leaving a truncated row.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
#: Rows (before damage, with repeats) of a conversation that one task repairs; rows and characters of a chunk of longer ones.
LONG, CHUNK_ROWS, CHUNK_CHARS = 4096, 4096, 2 << 20
#: Rows of an inner stretch that are unrolled at once.
STRETCH = 1 << 14

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a row of initial s, u or a; None where none may follow.
NEXT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
INSERTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
WHITE = " \t\n\v\f\r"
INITIALS = "sua"
#: Symbol of a row that has to go; others are 1 + 2 * class + truncated, class 3 being any other role.
MUST_GO, SYMBOLS = 0, 9
FAR = 1 << 40

REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of two matrices."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def _inserts() -> np.ndarray:
    """Least cost of reaching a state by inserted rows alone."""
    step = np.full((4, 4), FAR, dtype=np.int64)
    np.fill_diagonal(step, 0)
    for a, b in INSERTED.items():
        step[a, b] = INSERT
    return product(product(step, step), step)


#: What is left to pay in each state after the last row.
AT_END = (_inserts() + np.array([0, FAR, FAR, 0])).min(axis=1)


def _edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row, without inserts, in the order of letters."""
    found = [("D", DELETE, state)]
    if symbol != MUST_GO:
        kind, cut = divmod(symbol - 1, 2)
        kept = NEXT[INITIALS[kind]][state] if kind < 3 else None
        if kept is not None:
            found.append(("K", cut * LEFT_TRUNCATED, kept))
        found.append(("R", REROLE + cut * LEFT_TRUNCATED, INSERTED[state]))
    return found


EDITS = [[_edits(symbol, state) for state in range(4)] for symbol in range(SYMBOLS)]


@lru_cache(maxsize=None)
def power(symbol: int, bit: int) -> np.ndarray:
    """Transition of 2 ** ``bit`` rows of one symbol, inserts before each included; one squaring of the power below."""
    if bit:
        half = power(symbol, bit - 1)
        return product(half, half)
    row = np.full((4, 4), FAR, dtype=np.int64)
    for state in range(4):
        for _, cost, after in EDITS[symbol][state]:
            row[state, after] = min(row[state, after], cost)
    return product(_inserts(), row)


def before_run(symbol: int, length: int, after: np.ndarray) -> np.ndarray:
    """Least costs in each state before a run, from those after it."""
    bit = 0
    while length >> bit:
        if length >> bit & 1:
            after = (power(symbol, bit) + after).min(axis=1)
        bit += 1
    return after


def run_matrix(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Transition of all runs in order."""
    columns = []
    for state in range(4):
        v = np.full(4, FAR, dtype=np.int64)
        v[state] = 0
        for s, n in zip(symbols[::-1].tolist(), lengths[::-1].tolist()):
            v = before_run(s, n, v)
        columns.append(np.minimum(v, FAR))
    return np.stack(columns, axis=1)


def _stretches(symbol: int, length: int, after: np.ndarray) -> Iterator[np.ndarray]:
    """Costs left after every row of a run, first row first, in bounded pieces."""
    for at in range(0, length, STRETCH):
        n = min(STRETCH, length - at)
        left = np.empty((n, 4), dtype=np.int64)
        left[0], have, bit = before_run(symbol, length - at - n, after), 1, 0
        while have < n:
            more = min(have, n - have)
            left[have:have + more] = (power(symbol, bit)[None, :, :] + left[:more, None, :]).min(axis=2)
            have, bit = have + more, bit + 1
        yield left[::-1]


def unrolled(symbols: np.ndarray, lengths: np.ndarray, after: np.ndarray, state: int, last: bool) -> tuple[str, int]:
    """Letters of the cheapest edits from ``state`` on, least in order among equals, and the state they end in.

    ``after`` holds the costs left behind the runs; with ``last`` the rows end there and what is missing is inserted.
    """
    ends = [after]
    for s, n in zip(symbols[:0:-1].tolist(), lengths[:0:-1].tolist()):
        ends.append(before_run(s, n, ends[-1]))
    audit: list[str] = []
    for s, n, end in zip(symbols.tolist(), lengths.tolist(), ends[::-1]):
        for left in _stretches(s, n, end):
            for follow in left.tolist():
                while True:  # letters in order D, I, K, R: an insert comes before keeping or a new role, not before a deletion
                    least = min(cost + follow[to] for _, cost, to in EDITS[s][state])
                    filled = INSERTED[state]
                    later = INSERT + min(cost + follow[to] for _, cost, to in EDITS[s][filled])
                    twice = 2 * INSERT + min(cost + follow[to] for _, cost, to in EDITS[s][INSERTED[filled]])
                    best = min(least, later, twice)
                    cost, to = EDITS[s][state][0][1:]
                    if cost + follow[to] == best:
                        audit.append("D")
                    elif min(later, twice) == best:
                        audit.append("I")
                        state = filled
                        continue
                    else:
                        letter, to = next((k, to) for k, cost, to in EDITS[s][state][1:] if cost + follow[to] == best)
                        audit.append(letter)
                    state = to
                    break
    if last:
        while state not in (START, ASSISTANT):
            audit.append("I")
            state = INSERTED[state]
    return "".join(audit), state


def applied(audit: str, state: int, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of every row that an audit leaves or inserts, from ``state`` on."""
    source = iter(rows)
    for letter in audit:
        if letter == "I":
            state = INSERTED[state]
            yield letter, ROLE_OF[state], ""
            continue
        role, text = next(source)
        if letter == "K":
            state = NEXT[role[:1]][state]
            yield letter, role, text
        elif letter == "R":
            state = INSERTED[state]
            yield letter, ROLE_OF[state], text


def runs(values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and lengths of the runs of equal values."""
    v = np.asarray(values, dtype=np.int64)
    if not len(v):
        return v, v
    at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    return v[at], np.diff(np.r_[at, len(v)])


class Faults:
    """Symbols and counts of rows in order; a row seen earlier is told by the caller or by the rows themselves."""

    def __init__(self) -> None:
        self.symbols: list[int] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.rows = 0
        self.first = self.last = ""
        self._seen: set[tuple[str, str]] = set()

    def add(self, role: str, text: str, copies: int, seen: bool | None = None) -> None:
        if copies < 1:
            return
        if seen is None:
            seen = (role, text) in self._seen
            self._seen.add((role, text))
        initial, bare = role[:1], text.strip(WHITE)
        if self.rows:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.illegal += copies - 1  # a repeat follows a row of its own role
        self.last, self.rows = initial, self.rows + copies
        if not bare:
            self.blank += copies
            self.symbols.extend([MUST_GO] * copies)
            return
        self.duplicate += copies - 1 + seen
        if seen:
            self.symbols.append(MUST_GO)
        else:
            cut = bare[-1] not in ".!?"
            self.truncated += cut
            kind = INITIALS.find(initial) if initial else -1
            self.symbols.append(1 + 2 * (kind if kind >= 0 else 3) + cut)
        self.symbols.extend([MUST_GO] * (copies - 1))


def gaps(least: int | None, most: int | None, distinct: int) -> int:
    """Missing turns; a span beyond 64 bits counts as the largest long."""
    return 0 if least is None else min(most - least + 1 - distinct, (1 << 63) - 1)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: the row is gone) of every row, damaged by the checksum of its key.

    Nulls count as one space, in the key as well.
    """
    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(draw == 1, F.lit("")).when(draw == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return conversations.select(
        "conv_id", "turn", F.when(draw == 4, F.lit("user")).otherwise(said("role")).alias("role"), text.alias("text"),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).cast("long").alias("copies"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted batches, a bounded piece at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns))


def _packed(records: Iterator[tuple], schema: pa.Schema, rows: int = 512, size: Callable[[tuple], int] = lambda r: 0) -> Iterator[pa.RecordBatch]:
    """Records as batches of bounded length and size."""
    held: list[tuple] = []
    weight = 0
    for r in records:
        held.append(r)
        weight += size(r)
        if len(held) >= rows or weight > CHUNK_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


_REPORT = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                     ("audit", pa.string()), ("repaired_sha256", pa.string())])
_MESSAGES = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("slice", pa.int64()), ("place", pa.int64()),
                       ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
MESSAGES = "conv_id long, part long, slice long, place long, edit string, role string, text string"


def _whole(group: Iterable[tuple]) -> tuple[Faults, list[int | None], list[tuple[str, str]]]:
    faults, turns, rows = Faults(), [], []
    for _, turn, role, text, copies in group:
        faults.add(role, text, copies)
        if copies:
            turns.append(turn)
        rows.extend([(role, text)] * copies)
    return faults, turns, rows


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[tuple]:
        for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
            faults, turns, rows = _whole(group)
            symbols, lengths = runs(faults.symbols)
            audit, _ = unrolled(symbols, lengths, AT_END, START, last=True)
            cost = AT_END
            for s, n in zip(symbols[::-1].tolist(), lengths[::-1].tolist()):
                cost = before_run(s, n, cost)
            known = {t for t in turns if t is not None}
            digest = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in applied(audit, START, rows)).encode())
            yield (conv, gaps(min(known, default=None), max(known, default=None), len(known)), faults.blank, faults.duplicate,
                   faults.truncated, faults.illegal, int(cost[START]), audit, digest.hexdigest())

    return _packed(records(), _REPORT)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[tuple]:
        for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
            faults, _, rows = _whole(group)
            audit, _ = unrolled(*runs(faults.symbols), AT_END, START, last=True)
            for place, row in enumerate(applied(audit, START, rows)):
                yield conv, 0, 0, place, *row

    return _packed(records(), _MESSAGES, size=lambda r: len(r[-1]))


# --- Conversations of more than LONG rows: bounded chunks of the ordered rows.

_CHUNKS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("slice", pa.int64()), ("roles", pa.list_(pa.string())),
    ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())), ("symbols", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int64())), ("matrix", pa.list_(pa.int64())), ("rows", pa.int64()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
    ("least", pa.int64()), ("most", pa.int64()), ("turns", pa.int64())])
CHUNKS = ("conv_id long, part long, slice long, roles array<string>, texts array<string>, copies array<long>, symbols array<long>, "
          "lengths array<long>, matrix array<long>, rows long, blank long, duplicate long, truncated long, illegal long, "
          "first string, last string, least long, most long, turns long")


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted cells as chunks.  A row of no copies before a cell says that its role and text occur here first."""
    def records() -> Iterator[tuple]:
        part, number = TaskContext.get().partitionId(), 0
        for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
            first_here: tuple | None = None
            open_: dict[str, Any] = {}

            def closed() -> tuple:
                nonlocal number
                number += 1
                f, turns = open_["faults"], open_["turns"]
                symbols, lengths = runs(f.symbols)
                known = [t for t, _ in groupby(turns) if t is not None]
                return (conv, part, number, open_["roles"], open_["texts"], open_["copies"], symbols.tolist(), lengths.tolist(),
                        run_matrix(symbols, lengths).reshape(-1).tolist(), f.rows, f.blank, f.duplicate, f.truncated, f.illegal,
                        f.first, f.last, known[0] if known else None, known[-1] if known else None, len(known))

            for _, turn, role, text, copies in group:
                if not copies:
                    first_here = (turn, role, text)
                    continue
                if not open_:
                    open_ = {"faults": Faults(), "turns": [], "roles": [], "texts": [], "copies": [], "chars": 0}
                open_["faults"].add(role, text, copies, seen=first_here != (turn, role, text))
                for name, value in (("turns", turn), ("roles", role), ("texts", text), ("copies", copies)):
                    open_[name].append(value)
                open_["chars"] += len(text)
                if open_["faults"].rows >= CHUNK_ROWS or open_["chars"] >= CHUNK_CHARS:
                    yield closed()
                    open_ = {}
            if open_:
                yield closed()

    return _packed(records(), _CHUNKS, rows=1)


def _costs_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs left behind every chunk; the chunks of a conversation arrive from the last to the first."""
    def records() -> Iterator[tuple]:
        for _, group in groupby(_rows(batches), key=lambda r: r[0]):
            v, last = AT_END, True
            for _, part, number, matrix in group:
                yield part, number, v.tolist(), last
                v, last = (np.array(matrix).reshape(4, 4) + v).min(axis=1), False

    return _packed(records(), pa.schema([("part", pa.int64()), ("slice", pa.int64()), ("after", pa.list_(pa.int64())), ("ends", pa.bool_())]))


def _four_audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and last state of every chunk for each state it may be entered in."""
    def records() -> Iterator[tuple]:
        for conv, part, number, symbols, lengths, after, ends in _rows(batches):
            found = [unrolled(np.array(symbols, dtype=np.int64), np.array(lengths, dtype=np.int64), np.array(after), state, ends)
                     for state in range(4)]
            yield conv, part, number, [a for a, _ in found], [s for _, s in found]

    return _packed(records(), pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("slice", pa.int64()),
                                         ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int64()))]), rows=8)


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which every chunk is entered; the chunks of a conversation arrive in order."""
    def records() -> Iterator[tuple]:
        for _, group in groupby(_rows(batches), key=lambda r: r[0]):
            state = START
            for _, part, number, exits in group:
                yield part, number, state
                state = exits[state]

    return _packed(records(), pa.schema([("part", pa.int64()), ("slice", pa.int64()), ("entry", pa.int64())]))


def _chunk_messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[tuple]:
        for conv, part, number, roles, texts, copies, audit, entry in _rows(batches):
            rows = chain.from_iterable([(r, t)] * n for r, t, n in zip(roles, texts, copies))
            for place, row in enumerate(applied(audit, entry, rows)):
                yield conv, part, number, place, *row

    return _packed(records(), _MESSAGES, size=lambda r: len(r[-1]))


def _chunk_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired lines of every chunk as one text, with the chunk's figures."""
    def records() -> Iterator[tuple]:
        for conv, part, number, roles, texts, copies, audit, entry, *figures in _rows(batches):
            rows = chain.from_iterable([(r, t)] * n for r, t, n in zip(roles, texts, copies))
            lines = [f"{role}:{text}" for _, role, text in applied(audit, entry, rows)]
            yield conv, part, number, audit, "\n".join(lines) if lines else None, *figures

    return _packed(records(), _PIECES, rows=4)


_FIGURES = ("rows", "blank", "duplicate", "truncated", "illegal", "first", "last", "least", "most", "turns", "after", "matrix")
_PIECES = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("slice", pa.int64()), ("audit", pa.string()), ("piece", pa.string()),
                     *((n, _CHUNKS.field(n).type if n != "after" else pa.list_(pa.int64())) for n in _FIGURES)])
PIECES = ("conv_id long, part long, slice long, audit string, piece string, rows long, blank long, duplicate long, truncated long, "
          "illegal long, first string, last string, least long, most long, turns long, after array<long>, matrix array<long>")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One report a conversation from its chunks in order; the text streams through the digest."""
    def records() -> Iterator[tuple]:
        for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
            counts, audits, digest, begun = np.zeros(4, dtype=np.int64), [], hashlib.sha256(), False
            cost, last, least, most, distinct = 0, None, None, None, 0
            for at, (_, _, _, audit, piece, _, blank, dup, cut, illegal, first, final, low, high, turns, after, matrix) in enumerate(group):
                if at == 0:
                    cost = int((np.array(matrix).reshape(4, 4) + np.array(after)).min(axis=1)[START])
                else:
                    illegal += last + first not in ("su", "ua", "au")
                counts += np.array([blank, dup, cut, illegal])
                last = final
                if low is not None:
                    distinct += turns - (most == low)
                    least, most = (low if least is None else least), high
                audits.append(audit)
                if piece is not None:
                    digest.update((b"\n" if begun else b"") + piece.encode())
                    begun = True
            yield conv, gaps(least, most, distinct), *counts.tolist(), cost, "".join(audits), digest.hexdigest()

    return _packed(records(), _REPORT)


def _chunks_of(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written chunks of long conversations, costs behind them, and the audit and entry state of each."""
    cell = ["conv_id", "turn", "role", "text"]
    cells = rows.where("copies > 0").groupBy(*cell).agg(F.sum("copies").alias("copies"))
    firsts = cells.groupBy("conv_id", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("t")).select(
        "conv_id", F.col("t.turn").alias("turn"), "role", "text", F.lit(0).cast("long").alias("copies"))
    order = [F.col(c).asc_nulls_first() for c in cell]
    # Ranges end at any turn, so a conversation of any length is spread over tasks; a cell and its mark stay together.
    # The sample of keys that cuts the ranges holds the first letters of texts only.
    ordered = cells.unionByName(firsts).repartitionByRange(*order[:3], F.left("text", F.lit(64))).sortWithinPartitions(*order, "copies")
    chunks = parked(ordered.mapInArrow(_chunked, CHUNKS), "dialogue-chunks")
    backwards = chunks.select("conv_id", "part", "slice", "matrix").repartition("conv_id").sortWithinPartitions(
        "conv_id", F.desc("part"), F.desc("slice"))
    after = parked(backwards.mapInArrow(_costs_after, "part long, slice long, after array<long>, ends boolean"), "dialogue-after")
    tried = parked(chunks.select("conv_id", "part", "slice", "symbols", "lengths").join(after, ["part", "slice"]).select(
        "conv_id", "part", "slice", "symbols", "lengths", "after", "ends").mapInArrow(
        _four_audits, "conv_id long, part long, slice long, audits array<string>, exits array<long>"), "dialogue-audits")
    entry = tried.select("conv_id", "part", "slice", "exits").repartition("conv_id").sortWithinPartitions(
        "conv_id", "part", "slice").mapInArrow(_entered, "part long, slice long, entry long")
    chosen = parked(tried.join(entry, ["part", "slice"]).select(
        "part", "slice", F.get("audits", F.col("entry").cast("int")).alias("audit"), "entry"), "dialogue-chosen")
    return chunks, after, chosen


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations up to LONG rows, sorted for one task each, and the rows of longer ones, if there are any."""
    rows = rows.select("conv_id", "turn", "role", "text", "copies")
    counted = rows.groupBy("conv_id").agg(F.sum(F.greatest("copies", F.lit(1))).alias("n"))
    long_ones = parked(counted.where(F.col("n") > LONG).select(F.col("conv_id").alias("long_id"), F.lit(True).alias("is_long")), "dialogue-long")
    if long_ones.isEmpty():
        short, rest = rows, None
    else:
        marked = rows.join(long_ones, F.col("conv_id").eqNullSafe(F.col("long_id")), "left")
        short, rest = (marked.where(w).select(*rows.columns) for w in ("is_long is null", "is_long"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return short.repartition("conv_id").sortWithinPartitions(*order), rest


def examined(rows: DataFrame) -> DataFrame:
    """One row a conversation: its faults, the cost of the cheapest repair, the audit, the digest of the repaired rows.

    ``rows`` have conv_id, turn, role, text (no nulls in the last two) and copies: how often the row stands there, 0 for a
    row that is gone.  Rows go by turn, null turns first; rows of one turn by role and text.  A null conv_id is a
    conversation of its own.  Without rows left all counts are zero, the audit is empty and the digest is that of the
    empty text; an empty table gives no rows.  Other columns are not read.  Texts are read whole, however long.
    """
    short, rest = _parts(rows)
    report = short.mapInArrow(_reported, REPORT)
    if rest is None:
        return report
    chunks, after, chosen = _chunks_of(rest)
    pieces = (chunks.join(after, ["part", "slice"]).join(chosen, ["part", "slice"])
              .select("conv_id", "part", "slice", "roles", "texts", "copies", "audit", "entry", *_FIGURES).mapInArrow(_chunk_pieces, PIECES))
    long_report = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "slice").mapInArrow(_summed, REPORT)
    # A long conversation that lost all its rows has no chunk.
    gone = rest.groupBy("conv_id").agg(F.max("copies").alias("copies")).where("copies = 0").select(
        "conv_id", *(F.lit(0).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.lit("").alias("audit"), F.lit(hashlib.sha256(b"").hexdigest()).alias("repaired_sha256"))
    return report.unionByName(long_report).unionByName(gone)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired messages themselves: conv_id, (part, slice, place) which order them, edit (K, R or I), role, text."""
    short, rest = _parts(rows)
    messages = short.mapInArrow(_told, MESSAGES)
    if rest is None:
        return messages
    chunks, _, chosen = _chunks_of(rest)
    return messages.unionByName(chunks.join(chosen, ["part", "slice"]).select(
        "conv_id", "part", "slice", "roles", "texts", "copies", "audit", "entry").mapInArrow(_chunk_messages, MESSAGES))
