"""Benchmark items without an id against the query's own SQL."""

import duckdb
import pytest

from sluice.llm import decontaminate, stages

from .fixtures import prose, rows_of

NAMES = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256")
LONG = prose(60, 40)
ITEMS = [(1, prose(61, 30)), (None, LONG), (None, "tiny thing"), (2, LONG), (None, None)]
DOCS = [(1, prose(62, 20) + " " + LONG), (2, "a Tiny thing"), (3, prose(63, 30)), (4, prose(61, 30) + " tiny thing"), (5, None)]


@pytest.mark.parametrize("block", [32 << 20, 200])
def test_items_without_id_equal_the_sql(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", items)):
        df.write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    want = con.execute(f"SELECT {', '.join(NAMES)} FROM ({decontaminate.SQL})").fetchall()
    assert rows_of(decontaminate.contaminated(docs, items, unnamed=True), *NAMES) == sorted(want, key=repr)
    assert [r["doc_id"] for r in stages.uncontaminated(docs, items).orderBy("doc_id").collect()] == [3, 5]
