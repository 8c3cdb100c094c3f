"""Near-duplicate vectors against brute force."""

import numpy as np
import pytest

from sluice.llm import queries, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector)."""
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [i for i, (_, v) in enumerate(rows) if usable(v)]
    links = {i: set() for i in range(len(rows))}
    for dim in {len(rows[i][1]) for i in ok}:
        at = [i for i in ok if len(rows[i][1]) == dim]
        m = np.array([rows[i][1] for i in at], dtype=float)
        m /= np.abs(m).max(axis=1, keepdims=True)
        m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
        for x, y in zip(*np.nonzero(m @ m.T >= cosine)):
            if x != y:
                links[at[x]].add(at[y])
    group = {}
    for i in range(len(rows)):
        if i not in group:
            todo, group[i] = [i], i
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group[j] = i
                        todo.append(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[group[i]] = min(key, least.get(group[i], key))
    return sorted(((key, len(links[i]), least.get(group[i]), key == least.get(group[i])) for i, (key, _) in enumerate(rows)), key=repr)


def turned(rnd, v, cosine):
    """A vector at that cosine to ``v``."""
    other = rnd.standard_normal(len(v))
    other -= other @ v * v / (v @ v)
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine * cosine) * other / np.linalg.norm(other)


def mixed(seed=3, dim=32):
    """Lone vectors, tight and wide groups, chains, copies, scaled copies, useless vectors, another dimension."""
    rnd = np.random.default_rng(seed)
    found = [rnd.standard_normal(dim) for _ in range(120)]
    for spread in (0.9999, 0.99, 0.96, 0.93):
        centre = rnd.standard_normal(dim)
        found += [turned(rnd, centre, spread) for _ in range(40)]
    chain = rnd.standard_normal(dim)
    for _ in range(25):
        found.append(chain)
        chain = turned(rnd, chain, 0.955)
    found += [found[0]] * 5 + [found[130] * 3.0, found[131] * 1e-30, found[7] * 1e30]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(found)]
    rows += [(900, None), (901, []), (902, [0.0] * dim), (903, [float("nan")] * dim), (904, [float("inf")] * dim), (905, [None] * dim),
             (906, [1.0, 2.0]), (907, [1.0, 2.1]), (908, [-1.0, -2.0]), (909, [-0.0, 1.0]), (910, [0.0, 1.0]), (None, rows[3][1]), (None, None),
             (None, [5.0, -5.0]), (906, [1.0, 2.0]), (906, [1.0, 2.0]), (-4, rows[150][1])]
    rnd.shuffle(order := list(range(len(rows))))
    return [rows[i] for i in order]


def got(df):
    return sorted((tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in df.collect()), key=repr)


def frame(spark, rows):
    from pyspark.sql import functions as F
    return spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).withColumns({c: F.lit("mine") for c in ("ref", "pivot", "key", "core")})


@pytest.mark.parametrize("block", [1024, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = mixed()
    assert got(vectors.near_duplicates(frame(spark, rows))) == plain(rows)


def test_windows_smaller_than_groups(spark, monkeypatch):
    """Groups larger than the window keep all their links."""
    monkeypatch.setattr(vectors, "WINDOW", 3)
    rnd = np.random.default_rng(2)
    centre = rnd.standard_normal(64)
    rows = [(i, turned(rnd, centre, 0.99).tolist()) for i in range(300)]
    found = got(vectors.near_duplicates(frame(spark, rows)))
    assert {f[1:3] for f in found} == {(299, 0)}


def test_recall_of_lone_pairs(spark):
    """Pairs at the very cosine asked for, among many others: the share that the passes bring together."""
    rnd = np.random.default_rng(11)
    rows = []
    for i in range(3000):
        v = rnd.standard_normal(64)
        rows += [(2 * i, v.tolist()), (2 * i + 1, turned(rnd, v, 0.905).tolist())]
    links = sum(n for _, n, _, _ in got(vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))))
    assert links >= 0.95 * sum(n for _, n, _, _ in plain(rows))


def test_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got(vectors.near_duplicates(spark.createDataFrame([(1, None, None)], SCHEMA))) == [(1, 0, 1, True)]


def test_query_covers_the_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(queries.op13_embedding_duplicates(spark, path)) == plain(rows)
