"""Fingerprints with positions: order, small common passages, repeats and short texts."""

import pytest
from pyspark.sql import functions as F

from sluice.llm import syncmers

from .fixtures import prose


def plain_likeness(a, b):
    """Anchors are (position, hash); the heaviest chain of runs at one offset, by trying all."""
    if a == b:
        return 1.0
    turns = []
    for marks in (a, b):
        seen = {}
        for p, h in sorted(marks):
            seen.setdefault(h >> 32, []).append(p)
        turns.append(seen)
    pairs = sorted(pair for h, ps in turns[0].items() for pair in zip(ps, turns[1].get(h, [])))
    runs = []
    for p, q in pairs:
        if runs and runs[-1][0] == q - p:
            runs[-1][2:] = [q, runs[-1][3] + 1]
        else:
            runs.append([q - p, q, q, 1])
    best = []
    for _, first, _, n in runs:
        best.append(n + max((w for w, r in zip(best, runs) if r[2] < first), default=0))
    c = max(best, default=0)
    return c / max(1, len(a) + len(b) - c)


P, Q, R = prose(1, 400), prose(2, 400), prose(3, 8)
LINE = "all rights reserved by the owner of this page "
CASES = [
    (P + " " + Q, Q + " " + P), (P + " " + Q, P + " one word more " + Q), (P + " " + R, R + " " + Q), (P, Q), (P, P),
    (LINE * 9 + P, Q + LINE * 5), (LINE * 3 + P + LINE * 4, P + LINE * 9), ("", P), ("", ""), ("one two three", "one two four"),
    ("one two three four", "five six seven eight"), ("a a a a a a a a", "a a a a a")]


def likeness_of(spark, cases):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a string, b string")
    for c in "ab":
        df = syncmers.with_anchors(df, c, f"{c}_marks").withColumn(f"{c}_packed", syncmers.packed(F.col(f"{c}_marks")))
    return syncmers.with_likeness(df, "a_packed", "b_packed", "like").orderBy("i").collect()


def test_likeness_equals_direct_computation(spark):
    rows = likeness_of(spark, CASES)
    marks = lambda r, c: [(m["position"], m["hash"]) for m in r[f"{c}_marks"]]
    for r in rows:
        assert r["like"] == pytest.approx(plain_likeness(marks(r, "a"), marks(r, "b")))
    like = [r["like"] for r in rows]
    assert like[0] < 0.4 and like[1] > 0.95 and 0 < like[2] < 0.05 and like[3] == 0 and like[4] == like[8] == 1
    assert 0 < like[9] < 1 and like[10] == 0


def test_a_passage_of_a_five_hundredth_is_seen(spark):
    shared = prose(50, 30)
    assert likeness_of(spark, [(prose(51, 9000) + " " + shared + " " + prose(52, 6000), prose(53, 4000) + " " + shared + " " + prose(54, 11000))])[0]["like"] > 0


def test_fingerprints_hold_every_anchor_with_its_position(spark):
    docs = spark.createDataFrame([(1, prose(7, 3000)), (2, prose(8, 50))], "doc_id long, text string")
    marks = {r["doc_id"]: r["m"] for r in syncmers.with_anchors(docs, "text", "m").collect()}
    for r in syncmers.fingerprinted(docs).collect():
        digits = r["fingerprint"]
        found = [(int(digits[i + 8:i + 16], 16), int(digits[i:i + 8], 16)) for i in range(0, len(digits), 16)]
        assert found == [(m["position"], m["hash"] >> 32 & 0xFFFFFFFF) for m in marks[r["doc_id"]]]
