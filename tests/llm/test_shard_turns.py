"""Ranges that need many turns until none is overfull."""

from sluice.llm import shards

from .fixtures import prose
from .test_native import assert_shards


def test_no_row_is_lost_when_each_turn_adds_one_cut(spark, monkeypatch):
    real, calls = shards._splitters, []

    def one(*args, **more):
        calls.append(more)
        return real(*args, **more)[:1]

    monkeypatch.setattr(shards, "_splitters", one)
    monkeypatch.setattr(shards, "LEAST_RANGES", 32)
    plain = [(i, prose(i, 20)) for i in range(600)]
    rows = shards.sharded(spark.createDataFrame(plain, "doc_id long, text string")).collect()
    sums = assert_shards(rows, plain)
    assert len(calls) > 5 and len(sums) == 16
    ideal = sum(sums.values()) / 16
    assert all(abs(s - ideal) < 0.1 * ideal for s in sums.values())
