"""Permuted days against moving every day's outcomes one by one."""

import datetime as dt
import hashlib

import numpy as np
import pytest

from sluice.operators import resample as rs

BASE = dt.date(2001, 1, 1)


def log_of(spark, rows):
    data = [(s, BASE + dt.timedelta(days=d), a, y) for s, d, a, y in rows]
    return spark.createDataFrame(data, "series_id string, session date, dir int, y double")


def plain(rows, reps, seed):
    """Totals of all replicates, days moving among days with the same series."""
    days = {}
    for s, d, a, y in rows:
        days.setdefault(d, {})[s] = (a, y)
    strata = {}
    for d in sorted(days):
        strata.setdefault(frozenset(days[d]), []).append(d)
    out = []
    for rep in range(1, reps + 1):
        key = lambda d: hashlib.md5(f"{seed}|{rep}|{BASE + dt.timedelta(days=d)}".encode()).hexdigest()
        moved = [(d, donor) for mine in strata.values() for d, donor in zip(mine, sorted(mine, key=key))]
        out.append(sum(days[d][s][0] * days[donor][s][1] for d, donor in moved for s in days[d]))
    return np.array(out)


@pytest.mark.parametrize("vectors", [1024, 3])
def test_equals_moving_days_one_by_one(spark, monkeypatch, vectors):
    monkeypatch.setattr(rs, "VECTORS", vectors)
    rng = np.random.default_rng(3)
    rows = [(f"s{i}", d, int(rng.integers(-1, 2)), float(rng.normal()))
            for d in range(24) for i in range(6) if (d % 5 or i < 4) and (d != 7 or i == 0)]  # three sets of series, one of a single day
    got = rs.date_block_permutation(log_of(spark, rows), 60, "seed").first()
    want, real = plain(rows, 60, "seed"), sum(a * y for _, _, a, y in rows)
    assert got["permutations"] == 60 and got["duplicate_sessions"] == 0
    assert got["real_savings"] == pytest.approx(real) and got["null_mean"] == pytest.approx(want.mean())
    assert got["as_extreme"] == (want >= real - 1e-9).sum()
    assert got["p_value"] == pytest.approx((got["as_extreme"] + 1) / 61)


def test_a_series_twice_on_one_day_is_told(spark):
    rows = [("a", 0, 1, 1.0), ("a", 0, 1, 1.0), ("a", 1, -1, 2.0)]
    got = rs.date_block_permutation(log_of(spark, rows), 5, "seed").first()
    assert got["duplicate_sessions"] == 1 and got["permutations"] == 5


def test_no_rows(spark):
    got = rs.date_block_permutation(log_of(spark, []), 5, "seed").first()
    assert got["permutations"] == 0 and got["real_savings"] is None
