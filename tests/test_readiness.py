"""Every series answers: with a result or with the reason why there is none."""

import numpy as np
import pytest

from sluice.operators import audits, evaluate as ev, readiness as rd
from tests.helpers import day, pair_frame, panel

RNG = np.random.default_rng(11)


def pairs(spark, **lengths):
    """Series of the given lengths; one that starts with ``bad`` moves against its driver, ``flat`` has no driver."""
    out = None
    for name, n in lengths.items():
        x = np.zeros(n) if name.startswith("flat") else RNG.normal(0, 3, n)
        y = (-0.7 if name.startswith("bad") else 0.7) * x + RNG.normal(0, 0.5, n)
        rows = pair_frame(spark, x, y, name)
        out = rows if out is None else out.unionByName(rows)
    return out


def reasons(df):
    return {r["series_id"]: r["reason"] for r in df.collect()}


def named(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "series_id string")


def test_walk_forward_totals_or_reason(spark):
    train = pairs(spark, long=340, edge=311, short=310, bad=330).cache()
    out = {r["series_id"]: r for r in rd.walk_forward(named(spark, "long", "edge", "short", "bad", "none"), train).collect()}
    assert {k: r["reason"] for k, r in out.items()} == {
        "long": None, "edge": None, "short": "short_history", "bad": "no_fold_fitted", "none": "short_history"}
    assert out["none"]["pairs"] == 0 and out["short"]["pairs"] == 310 and out["short"]["needed"] == 311
    folds = [r for r in ev.walk_forward(train).collect() if r["series_id"] == "long"]
    long = out["long"]
    assert long["folds"] == len(folds) == 6 and long["alerts"] == sum(r["alerts"] for r in folds)
    assert long["total_savings"] == pytest.approx(sum(r["total_savings"] for r in folds))
    assert long["precision"] == pytest.approx(long["correct"] / long["alerts"])
    assert out["bad"]["alerts"] is None


def test_holdout_and_interval(spark):
    train = pairs(spark, long=140, short=99, tiny=30, bad=140, flat=140).cache()
    names = named(spark, "long", "short", "tiny", "bad", "flat")
    assert reasons(rd.holdout(names, train)) == {
        "long": None, "short": "short_history", "tiny": "short_history", "bad": "no_fit", "flat": "no_fit"}
    assert reasons(rd.threshold_interval(names, train)) == {
        "long": None, "short": None, "tiny": "short_history", "bad": "few_replicates", "flat": "few_replicates"}


def test_tail_reasons(spark):
    def waits(n):
        x = np.r_[np.full(n, -6.0), np.full(300 - n, 0.0), 6.0] + RNG.normal(0, 0.01, 301)
        return x, 0.8 * x + RNG.normal(0, 0.05, 301)
    train = pairs(spark, tiny=20, bad=200)
    for name, n in (("few", 12), ("thin", 30), ("full", 120)):
        train = train.unionByName(pair_frame(spark, *waits(n), name))
    got = {r["series_id"]: r for r in rd.tail_risk(named(spark, "tiny", "bad", "few", "thin", "full"), train).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        "tiny": "short_history", "bad": "no_fit", "few": "few_waits", "thin": "thin_tail", "full": None}
    assert got["few"]["waits"] == 12 and got["thin"]["waits"] == 30 and got["bad"]["waits"] is None
    assert got["full"]["tail_n"] >= 4


def test_grid_needs_its_embargo(spark):
    import datetime as dt
    def prices(name, n):
        walk = 2 + np.cumsum(RNG.normal(0, 0.02, n))
        return [(name, (day("2001-01-01") + dt.timedelta(days=i)).isoformat(), v, v + 0.1) for i, v in enumerate(walk)]
    frame = panel(spark, prices("long", 515) + prices("edge", 514) + prices("check", 510) + prices("short", 509)).cache()
    out = {r["series_id"]: r for r in rd.grid_check(frame).collect()}
    assert {k: r["reason"] for k, r in out.items()} == {
        "long": None, "edge": "short_history", "check": "short_history", "short": "short_history"}
    assert out["check"]["draws"] and out["edge"]["draws"] and out["short"]["draws"] is None
    best = {(r["win"], r["hp"], r["dp"]) for r in audits.embargoed_folds(frame).where("best AND series_id = 'long'").collect()}
    assert (out["long"]["win"], out["long"]["hp"], out["long"]["dp"]) == min(best)
