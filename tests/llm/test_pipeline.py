"""Every stage of the pipeline against brute force, and the registered queries against their SQL."""

import hashlib

import pytest

import corpus_pipeline
from __spark_entry__ import queries
from sluice.llm import langid, simhash
from sluice.llm import queries as llm
from sluice.llm.common import documents
from tools.compare import duck, rows_of

from .fixtures import awkward_docs, clashing, empty_docs
from .test_duplicates import plain_components, plain_fingerprint, plain_hits, plain_removal

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {f"{k.split('_')[0]}_" for k in llm.QUERIES}
    assert {*llm.QUERIES, "pipeline"} <= set(queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "decontamination", "tokens"]


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_equals_sql(spark, name):
    df = queries()[name](spark, SF)
    cur = duck(SF).execute(llm.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_stages_decide_as_brute_force_does(spark):
    docs = documents(spark, SF)
    named = STAGE["language_id"](spark, docs, SF)
    rejected = {r["doc_id"] for r in langid.identified(docs).where("rejected").collect()}
    assert sorted(texts_of(named)) == sorted(r for r in texts_of(docs) if r[0] not in rejected)

    single = STAGE["near_duplicates"](spark, named, SF)
    rows = sorted(texts_of(named))
    label = plain_components([plain_fingerprint(t) for _, t in rows])
    assert sorted(texts_of(single)) == [r for k, r in enumerate(rows) if label[k] == k]

    cut = STAGE["repeated_passages"](spark, single, SF)
    rows = sorted(texts_of(single))
    removal = plain_removal([t.encode() for _, t in rows], 200)
    got = dict(texts_of(cut))
    for (i, t), (size, removed, _, digest) in zip(rows, removal, strict=True):
        if removed == size and size:
            assert i not in got
        elif not removed:
            assert got.pop(i) == t
        else:
            left = got.pop(i)
            assert len(left.encode()) <= size - removed < len(left.encode()) + 4 * 2 * 99
            if len(left.encode()) == size - removed:
                assert hashlib.sha256(left.encode()).hexdigest() == digest
    assert not got
    assert all(r["n_chars"] == len(r["text"]) for r in cut.join(docs.select("doc_id").where("n_chars = length(text)"), "doc_id").collect())

    clean = STAGE["decontamination"](spark, cut, SF)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {i for i, _, n, *_ in plain_hits(texts_of(cut), items) if n}
    assert sorted(texts_of(clean)) == sorted(r for r in texts_of(cut) if r[0] not in hit)

    out = STAGE["tokens"](spark, clean, SF).collect()
    assert {(r["doc_id"], r["decoded_sha256"]) for r in out} == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts_of(clean)}
    assert all(len(r["token_ids"]) == r["n_tokens"] for r in out)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, out))


def test_stages_with_awkward_rows(spark):
    for docs in (clashing(awkward_docs(spark)), clashing(empty_docs(spark))):
        for name, stage in corpus_pipeline.STAGES[:4]:
            after = stage(spark, docs, SF)
            assert after.columns == docs.columns
            docs = spark.createDataFrame(after.collect(), docs.schema)
        out = STAGE["tokens"](spark, docs, SF)
        assert out.count() == docs.count()


def test_one_row_of_a_group_stays(spark):
    docs = awkward_docs(spark)
    left = texts_of(STAGE["near_duplicates"](spark, docs, SF))
    ids = [i for i, _ in left]
    assert ids.count(16) == 1 and 2 not in ids and ids.count(11) == 2
    groups = simhash.near_duplicates(docs).select("component_id").distinct().count()
    assert len(left) >= groups
