"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from sluice.llm import queries, variants

from .fixtures import awkward, awkward_docs, clashing, empty_docs


def plain_counts(rows):
    """Of (doc_id, text)."""
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(counts):
    near = {w: [v for v in counts if v != w and one_apart(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def test_groups_equal_brute_force(spark):
    rnd = random.Random(4)
    words = {}
    for _ in range(60):
        w = "".join(rnd.choice("aabcé") for _ in range(rnd.randint(5, 9)))
        for _ in range(12):
            at, c = rnd.randrange(len(w) + 1), rnd.choice("aabcéÿ")
            w = rnd.choice([w[:at] + c + w[at:], w[:at] + w[at + 1:], w[:at] + c + w[at + 1:]])
            if len(w) >= 5:
                words[w] = rnd.choice([3, 4, 6, 6, 8, 16, 40, 10 ** 11])
    words["z" * 400] = 3
    words["z" * 401] = 9
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert got(variants.grouped(frame)) == plain_groups(words)


def test_nodes_are_one_trie(spark):
    rnd = random.Random(8)
    words = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))) for _ in range(300)}
    frame = spark.createDataFrame([(w,) for w in words], "word string").repartition(7)
    node = {}
    for r in variants.numbered(frame, "nodes").collect():
        assert len(r["nodes"]) == len(r["word"])
        for i, number in enumerate(r["nodes"]):
            assert node.setdefault(r["word"][:i + 1], number) == number
    assert len(set(node.values())) == len(node) and 0 not in node.values()
    ends = sorted(words)
    assert [node[w] for w in ends] == sorted(node[w] for w in ends)


def test_counts_with_small_tables(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in awkward()] * 3
    want = plain_counts(rows)
    docs = clashing(awkward_docs(spark))
    thrice = docs.unionAll(docs).unionAll(docs)
    assert {r["word"]: r["n"] for r in variants.counted(thrice).collect()} == want
    monkeypatch.setattr(variants, "CACHE", 50)
    assert {r["word"]: r["n"] for r in variants.counted(thrice.coalesce(1)).collect()} == want


def test_checksums_shift():
    sizes = np.array([0, 1, 3, 3, 40])
    start = zlib.crc32(b"123:")
    for size, shift in zip(sizes.tolist(), variants._shifts(start, sizes).tolist()):
        raw = bytes(range(size))
        assert shift ^ zlib.crc32(raw) == zlib.crc32(raw, start)


def test_empty(spark):
    assert variants.variants(empty_docs(spark)).count() == 0
    assert variants.grouped(spark.createDataFrame([("alone", 3)], "word string, n long")).collect()[0]["root"] == "alone"


def test_query_covers_the_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op12_spelling_variants(spark, path)) == plain_groups(plain_counts(rows))
