"""Syncmer fingerprints and shards against plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sluice.llm import shards, syncmers
from sluice.llm.common import documents, range_of

from .fixtures import awkward, awkward_docs, clashing, empty_docs, prose

SF = "/root/testdata/sf0.01"


def edits(rows):
    """(text, edited text, next text) by ascending id."""
    texts = [t or "" for _, t in rows]
    after = [*texts[1:], *texts[:1]]
    return [(a, a[:len(a) - len(a) // 4] + b[:len(a) // 4], b) for a, b in zip(texts, after)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("range_rows", [2000, 7])
def test_edited_texts(spark, monkeypatch, range_rows):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", range_rows)
    docs = documents(spark, SF)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"]: r for r in syncmers.fingerprinted(docs.withColumn("range", F.lit(1))).collect()}
    prints = {}
    for (i, _), (text, edited, _) in zip(rows, edits(rows), strict=True):
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), sha(edited))
        assert prints.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
    ids = [i for i, _ in rows]
    for i, j in zip(ids, [*ids[1:], ids[0]]):
        same = got[i]["fingerprint"] == got[j]["fingerprint"]
        assert 0 <= got[i]["near_next"] <= 1 and same == (got[i]["near_next"] == 1)
    assert len(got) == len(rows)
    mean = sum(r["near_edited"] for r in got.values()) / len(got)
    assert mean > 0.5 > 0.05 > sum(r["near_next"] for r in got.values()) / len(got)


def test_fingerprints_of_awkward_rows(spark):
    got = syncmers.fingerprinted(clashing(awkward_docs(spark))).collect()
    assert sorted(r["n_chars"] for r in got) == sorted(len(r[1] or "") for r in awkward())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] != by_id[3]["fingerprint"]
    assert by_id[4]["fingerprint"] == "" and by_id[4]["edited_sha256"] == sha("")
    # Rows of one id follow each other by text; the last row's next is the first, with the null id.
    assert len([r for r in got if r["doc_id"] == 16]) == 2
    assert max(r["near_next"] for r in got if r["doc_id"] == 16) == 1.0
    assert syncmers.fingerprinted(empty_docs(spark)).count() == 0
    one = syncmers.fingerprinted(awkward_docs(spark).where("doc_id = 3")).first()
    text = prose(3, 80)
    assert one["near_next"] == 1.0 and one["edited_sha256"] == sha(text[:len(text) - len(text) // 4] + text[:len(text) // 4])


def test_anchors_depend_on_their_words_alone(spark):
    shared = prose(1, 60)
    rows = [(1, prose(2, 31) + " " + shared), (2, shared + " " + prose(3, 40)), (3, prose(4, 50))]
    df = syncmers.with_anchors(spark.createDataFrame(rows, "doc_id int, text string"), "text", "marks")
    marks = {r["doc_id"]: [(m["position"], m["hash"]) for m in r["marks"]] for r in df.collect()}
    inside = {h: p for p, h in marks[2] if p + syncmers.K <= 60}
    shifted = {h: p - 31 for p, h in marks[1] if p >= 31}
    assert inside and inside == shifted
    assert not set(inside) & {h for _, h in marks[3]}
    assert 0.4 < len(marks[3]) / (50 - syncmers.K + 1) < 0.95


def assert_shards(rows, docs_rows, total_shards=16):
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted(
        (repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs_rows)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(total_shards))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    return {k: sum(r["size"] for r in part) for k, part in by.items()}


def test_shards_are_even(spark):
    docs = documents(spark, SF)
    rows = shards.sharded(docs).collect()
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sums, longest = assert_shards(rows, plain), max(len((t or "").encode()) for _, t in plain) + 1
    ideal = sum(sums.values()) / 16
    assert len(sums) == 16 and all(abs(s - ideal) <= longest + ideal * shards.WHOLE_PART for s in sums.values())


def test_a_text_of_a_third_of_all_rows_is_subdivided(spark, monkeypatch):
    monkeypatch.setattr(shards, "LEAST_RANGES", 64)
    plain = [(i, "the same text " * 9 if i % 3 == 0 else prose(i, 12 + i % 7)) for i in range(3000)]
    rows = shards.sharded(spark.createDataFrame(plain, "doc_id long, text string").repartition(7)).collect()
    sums = assert_shards(rows, plain)
    ideal = sum(sums.values()) / 16
    assert all(abs(s - ideal) < 0.02 * ideal for s in sums.values())


def test_shards_of_awkward_rows(spark):
    docs = clashing(awkward_docs(spark))
    assert_shards(shards.sharded(docs).collect(), [(r[0], r[1]) for r in awkward()])
    assert shards.sharded(empty_docs(spark)).count() == 0
    again = [sorted(map(repr, shards.sharded(docs.repartition(n)).select("doc_id", "size", "shard").collect())) for n in (1, 5)]
    assert again[0] == again[1]


def test_range_lookup(spark):
    cuts = [(-5, 2), (-5, 3), (0, 0), (7, 1)]
    keys = [(-9, 9), (-5, 1), (-5, 2), (-5, 4), (0, -1), (0, 0), (7, 1), (8, 0)]
    df = spark.createDataFrame(keys, "k0 long, k1 long")
    got = [r["at"] for r in df.select("k0", "k1", range_of(F.struct("k0", "k1"), cuts).alias("at")).collect()]
    assert got == [sum(c <= k for c in cuts) for k in keys]
