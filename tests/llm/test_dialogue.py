"""Repair of conversations against a plain search over all edits."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from sluice.llm import dialogue, queries

from .fixtures import clashing

SCHEMA = "conv_id long, turn long, role string, text string"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FILL = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 1:
            text = ""
        if draw == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if draw == 4:
            role = "user"
        out.append((conv, turn, role, text, 0 if draw == 0 else 2 if draw == 3 else 1))
    return out


def plain_report(conv, rows):
    """``rows``: (turn, role, text) in order."""
    faults, seen, turns = [], set(), sorted({t for t, _, _ in rows if t is not None})
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(maxsize=None)
    def best(i, state, room):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if room:
            role, after = FILL[state]
            cost, audit, out = best(i, after, room - 1)
            found.append((5 + cost, "I" + audit, ((role, ""), *out)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, out = best(i + 1, state, 2)
            found.append((2 + cost, "D" + audit, out))
            if faults[i] not in ("blank", "duplicate"):
                left = 5 if faults[i] == "truncated" else 0
                after = STEP.get((state, role[:1]))
                if after is not None:
                    cost, audit, out = best(i + 1, after, 2)
                    found.append((left + cost, "K" + audit, ((role, text), *out)))
                fill, after = FILL[state]
                cost, audit, out = best(i + 1, after, 2)
                found.append((1 + left + cost, "R" + audit, ((fill, text), *out)))
        return min(found, key=lambda f: f[:2], default=(10 ** 9, "", ()))

    cost, audit, out = best(0, 0, 2)
    initials = [r[:1] for _, r, _ in rows]
    return (conv, turns[-1] - turns[0] + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(), out)


def plain(cells):
    found = {}
    for conv, turn, role, text, copies in sorted(cells, key=lambda c: (c[1] is not None, c[1] or 0, c[2], c[3])):
        found.setdefault(conv, []).extend([(turn, role, text)] * copies)
    return [plain_report(conv, rows) for conv, rows in found.items()]


def awkward_conversations(seed=5, count=150):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "user", "assistant"]
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t", None, " ", "a. ", "Nothing more.", "end?\n", "Été"]
    rows = []
    for conv in range(count):
        for turn in range(rnd.randint(1, 14)):
            at = rnd.choice([turn, turn, turn, turn * 3, None if rnd.random() < 0.3 else turn])
            rows.append((conv if conv else None, at, rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.6 else f"Turn {turn} of {conv}."))
    rows += rows[:40]  # repeated rows
    rows += [(-7, -5, "user", "x" * 300_000 + "."), (-7, 9, "assistant", "ok."), (None, None, None, None)]
    return rows


def fields(df):
    return sorted((tuple(r[n] for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
                   for r in df.collect()), key=repr)


def test_reports_equal_plain_search(spark, monkeypatch):
    rows = awkward_conversations()
    frame = dialogue.damaged(clashing(spark.createDataFrame(rows, SCHEMA)))
    want = sorted((r[:-1] for r in plain(plain_damage(rows))), key=repr)
    assert fields(dialogue.examined(frame)) == want
    # The same rows through chunks: every conversation counts as long, chunks hold a few rows.
    monkeypatch.setattr(dialogue, "LONG", 3)
    monkeypatch.setattr(dialogue, "CHUNK_ROWS", 4)
    assert fields(dialogue.examined(frame)) == want


@pytest.mark.parametrize("long", [1 << 20, 2])
def test_messages_are_the_digested_ones(spark, monkeypatch, long):
    monkeypatch.setattr(dialogue, "LONG", long)
    monkeypatch.setattr(dialogue, "CHUNK_ROWS", 3)
    rows = awkward_conversations(9, 40)
    frame = dialogue.damaged(spark.createDataFrame(rows, SCHEMA))
    found = {}
    for r in sorted(dialogue.repaired(frame).collect(), key=lambda r: (r["part"], r["slice"], r["place"])):
        found.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    want = {r[0]: list(r[-1]) for r in plain(plain_damage(rows)) if r[-1]}
    assert found == want


def test_long_runs_by_powers():
    rnd = random.Random(3)
    for _ in range(60):
        symbols = [s for _ in range(rnd.randint(1, 6)) for s in [rnd.randrange(9)] * rnd.choice([1, 2, 3, 17, 40])]
        s, n = dialogue.runs(symbols)
        ones = np.ones(len(symbols), dtype=np.int64)
        step, _ = dialogue.unrolled(np.array(symbols), ones, dialogue.AT_END, 0, True)
        assert dialogue.unrolled(s, n, dialogue.AT_END, 0, True)[0] == step
        v = dialogue.AT_END
        for x in reversed(symbols):
            v = (dialogue.power(x, 0) + v).min(axis=1)
        assert (np.minimum((dialogue.run_matrix(s, n) + dialogue.AT_END).min(axis=1), dialogue.FAR) == np.minimum(v, dialogue.FAR)).all()
    many, _ = dialogue.unrolled(*dialogue.runs([3, *[1 + 2 * 1] * 50_000, 5]), dialogue.AT_END, 0, True)
    assert len(many.replace("I", "")) == 50_002


def test_empty_and_gone(spark):
    none = dialogue.damaged(spark.createDataFrame([], SCHEMA))
    assert dialogue.examined(none).count() == 0 and dialogue.repaired(none).count() == 0
    gone = spark.createDataFrame([(3, 1, "user", "a.", 0), (None, None, "user", "b.", 0)], SCHEMA + ", copies long")
    empty = hashlib.sha256(b"").hexdigest()
    assert fields(dialogue.examined(gone)) == sorted([(3, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)], key=repr)


def test_query_covers_the_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert fields(queries.op11_conversation_repair(spark, path)) == sorted((r[:-1] for r in plain(plain_damage(rows))), key=repr)
