"""Committed appends: two writers, a crash before the commit, repeated batches, months of many files."""

import datetime as dt

import pytest

from sluice.operators import commits, ledger

SCHEMA = "series_id string, session date, value long"
KEYS = ["series_id", "session"]


def rows_of(spark, *rows):
    return spark.createDataFrame([(s, dt.date.fromisoformat(d), v) for s, d, v in rows], SCHEMA)


def filed(spark, path):
    return sorted((r["series_id"], r["session"].isoformat(), r["value"]) for r in ledger.table_at(path, rows_of(spark)).collect())


def told(df):
    return {(r["series_id"], r["session"].isoformat()): r["status"] for r in df.collect()}


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "ledger")


def between(monkeypatch, work):
    """Run ``work`` once, after the first append has written its rows and before it commits."""
    written, left = commits._written, [work]

    def first(fresh, path):
        out = written(fresh, path)
        if left:
            left.pop()()
        return out

    monkeypatch.setattr(commits, "_written", first)


def test_of_two_writers_one_files_a_key(spark, path, monkeypatch):
    ours = rows_of(spark, ("a", "2026-01-05", 1), ("b", "2026-01-05", 2), ("c", "2026-01-06", 3))
    theirs = rows_of(spark, ("a", "2026-01-05", 9), ("c", "2026-01-06", 3))
    seen = {}
    between(monkeypatch, lambda: seen.update(told(ledger.append_table(theirs, path, KEYS))))
    mine = told(ledger.append_table(ours, path, KEYS))
    assert set(seen.values()) == {"appended"}
    assert mine == {("a", "2026-01-05"): "conflict", ("b", "2026-01-05"): "appended", ("c", "2026-01-06"): "present"}
    assert filed(spark, path) == [("a", "2026-01-05", 9), ("b", "2026-01-05", 2), ("c", "2026-01-06", 3)]
    assert [c.version for c in commits.latest(spark, path).commits] == [1, 2]
    assert len(commits.unnamed(spark, path)) == 1  # what was written before the decision was taken anew


def test_writers_of_other_months_only_take_the_next_version(spark, path, monkeypatch):
    between(monkeypatch, lambda: ledger.append_table(rows_of(spark, ("a", "2026-02-02", 9)), path, KEYS))
    ledger.append_table(rows_of(spark, ("a", "2026-01-05", 1)), path, KEYS)
    assert filed(spark, path) == [("a", "2026-01-05", 1), ("a", "2026-02-02", 9)]
    assert not commits.unnamed(spark, path)  # nothing was written twice


def test_a_crash_before_the_commit_leaves_nothing(spark, path, monkeypatch):
    ledger.append_table(rows_of(spark, ("a", "2026-01-05", 1)), path, KEYS)
    with monkeypatch.context() as m:
        m.setattr(commits, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            ledger.append_table(rows_of(spark, ("a", "2026-01-06", 2)), path, KEYS)
    assert filed(spark, path) == [("a", "2026-01-05", 1)]
    assert set(told(ledger.append_table(rows_of(spark, ("a", "2026-01-06", 2)), path, KEYS)).values()) == {"appended"}
    assert filed(spark, path) == [("a", "2026-01-05", 1), ("a", "2026-01-06", 2)]


def test_a_version_is_taken_once(spark, path):
    one, two = (commits.Commit(1, f, ()) for f in ("x", "y"))
    assert commits.commit(spark, path, one) and not commits.commit(spark, path, two)
    assert [c.folder for c in commits.latest(spark, path).commits] == ["x"]


def test_a_batch_is_filed_once(spark, path):
    batch = rows_of(spark, ("a", "2026-01-05", 1), ("a", "2026-01-05", 2), ("b", "2026-01-05", 2))
    assert told(ledger.append_table(batch, path, KEYS, writer="w", batch=4)) == {
        ("a", "2026-01-05"): "conflict", ("b", "2026-01-05"): "appended"}
    assert set(told(ledger.append_table(batch, path, KEYS, writer="w", batch=4)).values()) == {"repeated"}
    assert set(told(ledger.append_table(batch, path, KEYS, writer="w", batch=5)).values()) == {"conflict", "present"}
    assert len(filed(spark, path)) == 1


def test_a_month_is_written_by_many_tasks(spark, path, monkeypatch):
    monkeypatch.setattr(commits, "FILE_ROWS", 1000)
    many = spark.range(20_000).selectExpr("cast(id as string) AS series_id", "DATE '2026-01-05' AS session", "id AS value")
    ledger.append_table(many, path, KEYS)
    assert len(spark.read.parquet(f"{path}/rows").inputFiles()) > 4
    assert ledger.table_at(path, many).count() == 20_000


def test_null_keys_and_sessions(spark, path):
    odd = spark.createDataFrame([(None, dt.date(2026, 1, 5), 1), ("a", None, 2), (None, None, None)], SCHEMA)
    assert {r["status"] for r in ledger.append_table(odd, path, KEYS).collect()} == {"appended"}
    assert {r["status"] for r in ledger.append_table(odd, path, KEYS).collect()} == {"present"}
    assert ledger.table_at(path, odd).count() == 3
    assert ledger.append_table(rows_of(spark), path, KEYS).count() == 0


def chain(spark, *rows):
    return spark.createDataFrame([(s, dt.date.fromisoformat(d), i, p, dt.date.fromisoformat(e)) for s, d, i, p, e in rows],
                                 "series_id string, effective_session date, artifact_id string, prior_artifact_id string, training_end date")


def test_chains_are_filed_without_gaps(spark, path, monkeypatch):
    whole = [("s", "2026-01-05", "a1", ledger.GENESIS, "2026-01-02"), ("s", "2026-02-05", "a2", "a1", "2026-02-02"),
             ("s", "2026-03-05", "a3", "a2", "2026-03-02"), ("t", "2026-01-05", "b1", ledger.GENESIS, "2026-01-02")]
    status = lambda df: {r["new_id"]: r["status"] for r in df.collect()}
    broken = [whole[0], ("s", "2026-02-05", "x2", "zz", "2026-02-02"), ("s", "2026-03-05", "x3", "x2", "2026-03-02"), whole[3]]
    assert status(ledger.file_artifacts(chain(spark, *broken), path)) == {"a1": "new", "x2": "broken_chain", "x3": "held_back", "b1": "new"}
    # Another writer files the second link while ours is under way: ours becomes a conflict, and what follows it breaks.
    rival = chain(spark, ("s", "2026-02-05", "r2", "a1", "2026-02-02"))
    between(monkeypatch, lambda: ledger.file_artifacts(rival, path))
    assert status(ledger.file_artifacts(chain(spark, *whole), path)) == {"a1": "same", "a2": "conflict", "a3": "broken_chain", "b1": "same"}
    ids = {r["artifact_id"] for r in ledger.table_at(path, chain(spark)).collect()}
    assert ids == {"a1", "r2", "b1"}
