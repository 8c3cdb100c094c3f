"""Only changed histories are fitted, and the outcome is that of fitting all."""

import pytest
from pyspark.sql import functions as F

from sluice.operators import commits, fit as m
from sluice.operators.recalibrate import recalibrated
from sluice.session import durable

from .helpers import panel, synthetic, train

NAMES = ("A", "B", "C", "D")


@pytest.fixture(scope="module")
def history(spark):
    parts = [synthetic(spark, 120, seed=i, series=s) for i, s in enumerate(NAMES)]
    parts.append(panel(spark, [("E", "2003-03-03", 2.0, 2.1)]))  # has no pair at all
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return durable(out)


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "calibrations")


class Counted:
    """The calibration, noting which series it was given."""

    def __init__(self, spark):
        self.spark, self.given = spark, []

    def __call__(self, history):
        self.given.append(sorted(r[0] or "" for r in history.select("series_id").distinct().collect()))
        return m.group_thresholds(m.last_rows(train(self.spark, history)), ["series_id"])

    def fitted(self):
        out, self.given = [g for g in self.given if g], []
        return out


def rows(df):
    return sorted((tuple(r) for r in df.drop("refitted").collect()), key=repr)


def refitted(df):
    return sorted(r["series_id"] for r in df.where("refitted").collect())


def revised(history, series):
    """The last response of one series is corrected."""
    last = history.where(F.col("series_id") == series).agg(F.max("session")).first()[0]
    hit = (F.col("series_id") == series) & (F.col("session") == F.lit(last))
    return history.withColumn("response", F.when(hit, F.col("response") + 0.01).otherwise(F.col("response")))


def test_one_changed_series_is_fitted_alone(spark, history, path, tmp_path):
    calibrate = Counted(spark)
    first = recalibrated(history, path, calibrate, "v1")
    assert calibrate.fitted() == [[*NAMES, "E"]] and refitted(first) == [*NAMES, "E"]
    again = recalibrated(history, path, calibrate, "v1")
    assert calibrate.fitted() == [] and refitted(again) == [] and rows(again) == rows(first)
    new = revised(history, "C")
    second = recalibrated(new, path, calibrate, "v1")
    assert calibrate.fitted() == [["C"]] and refitted(second) == ["C"]
    assert rows(second) == rows(recalibrated(new, str(tmp_path / "other"), calibrate, "v1"))
    calibrate.fitted()
    back = recalibrated(history, path, calibrate, "v1")
    assert calibrate.fitted() == [] and rows(back) == rows(first)


def test_another_method_counts_for_itself(spark, history, path):
    calibrate = Counted(spark)
    recalibrated(history, path, calibrate, "v1")
    calibrate.fitted()
    recalibrated(history, path, calibrate, "v2")
    assert calibrate.fitted() == [[*NAMES, "E"]]
    recalibrated(history, path, calibrate, "v1")
    assert calibrate.fitted() == []


def test_a_series_without_a_fit_is_kept_and_not_tried_again(spark, history, path):
    calibrate = Counted(spark)
    got = {r["series_id"]: r for r in recalibrated(history, path, calibrate, "v1").collect()}
    assert got["E"]["hike"] is None and got["E"]["rows"] is None and got["A"]["hike"] is not None


def test_a_run_that_ends_before_its_commit_is_done_anew(spark, history, path, monkeypatch):
    calibrate = Counted(spark)
    with monkeypatch.context() as broken:
        broken.setattr(commits, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            recalibrated(history, path, calibrate, "v1")
    calibrate.fitted()
    assert refitted(recalibrated(history, path, calibrate, "v1")) == [*NAMES, "E"]
    assert calibrate.fitted() == [[*NAMES, "E"]]


def test_two_runs_side_by_side_file_each_series_once(spark, history, path, monkeypatch):
    calibrate, written, left = Counted(spark), commits._written, [1]

    def first(fresh, at):
        out = written(fresh, at)
        if left:
            left.pop()
            recalibrated(history, path, calibrate, "v1")
        return out

    monkeypatch.setattr(commits, "_written", first)
    got = recalibrated(history, path, calibrate, "v1")
    assert got.count() == 5 and refitted(got) == []


def test_null_ids_and_empty_history(spark, history, path):
    calibrate = Counted(spark)
    nameless = history.where("series_id = 'A'").withColumn("series_id", F.lit(None).cast("string"))
    one = recalibrated(nameless, path, calibrate, "v1").collect()
    assert len(one) == 1 and one[0]["refitted"] and one[0]["hike"] is not None
    assert not recalibrated(nameless, path, calibrate, "v1").first()["refitted"]
    assert recalibrated(history.where("false"), path, calibrate, "v1").count() == 0
