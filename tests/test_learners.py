import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions.distributions import beta_cdf, beta_quantile, f_upper, normal_two_sided, t_two_sided
from sluice.operators import learners as ln
from tests.helpers import synthetic, train


def joint_loss(a, b, s, z, y):
    r = np.abs(y - a - b * z) / s
    h = np.where(r <= ln.HUBER_EPSILON, r ** 2, 2 * ln.HUBER_EPSILON * r - ln.HUBER_EPSILON ** 2)
    return (s + h * s).sum() + ln.HUBER_ALPHA * b * b


def test_huber_resists_outliers_and_minimises_its_loss():
    rng = np.random.default_rng(9)
    x = rng.normal(0, 4, 360)
    y = 0.3 + 0.7 * x + rng.normal(0, 0.5, 360)
    y[::20] += 30
    a, b, settled = ln.huber_lines(x[None], y[None], np.ones((1, 360), bool))
    assert settled.all()
    assert b[0] == pytest.approx(0.7, abs=0.05) and a[0] == pytest.approx(0.3, abs=0.3)
    mean, sd = x.mean(), x.std()
    z = (x - mean) / sd
    a0, b0 = a[0] + b[0] * mean, b[0] * sd
    r = np.abs(y - a0 - b0 * z)
    grid = np.linspace(0.3, 3, 2000)
    scale = grid[np.argmin([joint_loss(a0, b0, s, z, y) for s in grid])]
    best = joint_loss(a0, b0, scale, z, y)
    assert r.size == 360
    for da, db in ((0.02, 0), (-0.02, 0), (0, 0.02), (0, -0.02)):
        assert joint_loss(a0 + da, b0 + db, scale, z, y) >= best - 1e-6


def test_rolling_huber_equals_a_single_window(spark):
    t = train(spark, synthetic(spark, 520))
    rows = {r["ord"]: r for r in ln.rolling_huber(t).collect()}
    pdf = t.orderBy("ord").toPandas()
    x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
    assert min(rows) == 122
    for o in (122, 300, len(x)):
        lo, hi = max(0, o - 362), o - 2
        a, b, _ = ln.huber_lines(x[None, lo:hi], y[None, lo:hi], np.ones((1, hi - lo), bool))
        assert rows[o]["slope"] == pytest.approx(b[0], abs=1e-8)


def test_sealed_forecast_agrees_with_the_rolling_fit(spark):
    t = train(spark, synthetic(spark, 560))
    row = ln.sealed_forecast(t).first()
    last = ln.rolling_huber(t).orderBy("ord", ascending=False).first()
    assert row["slope"] == pytest.approx(last["slope"], abs=1e-8)
    assert row["point"] == pytest.approx(last["point"], abs=1e-7)
    assert row["fit_end"] < row["session"] and row["calibration_end"] < row["session"]
    assert 0 < row["p_up"] < 1 and row["p_up"] + row["p_down"] <= 1 + 1e-9


def test_ridge_matches_normal_equations(spark):
    from sluice.operators import forecast as fc
    t = train(spark, synthetic(spark, 420))
    got = {r["session"]: r["point"] for r in ln.rolling_ridge(t).collect()}
    pdf = fc.causal_features(t).where("e_base IS NOT NULL").orderBy("ord").toPandas()
    i = len(pdf) - 1
    part = pdf.iloc[max(0, i - 1 - 360):i - 1]
    f, e = part[ln.FEATURES].to_numpy(), part["e_base"].to_numpy()
    mu, sd = f.mean(0), f.std(0)
    sd = np.where(sd > 1e-12, sd, 1.0)
    z = (f - mu) / sd
    beta = np.linalg.solve(z.T @ z + 10 * np.eye(8), z.T @ (e - e.mean()))
    want = pdf["p_base"].iloc[i] + e.mean() + ((pdf[ln.FEATURES].iloc[i].to_numpy() - mu) / sd) @ beta
    assert got[pdf["session"].iloc[i]] == pytest.approx(want, abs=1e-8)


def test_beta_distribution():
    assert beta_cdf(2, 3, 0.5) == pytest.approx(0.6875)
    assert beta_cdf(1, 1, 0.3) == pytest.approx(0.3)
    q = beta_quantile(15, 3, 0.025)
    assert beta_cdf(15, 3, q) == pytest.approx(0.025, abs=1e-9)


def test_beta_values_of_arrays_and_edges():
    x = np.linspace(-0.5, 1.5, 21)
    assert np.allclose(beta_cdf(1, 4, x), 1 - (1 - np.clip(x, 0, 1)) ** 4)
    assert np.isnan(beta_cdf([0.0, -1.0, 2.0], 1, [0.5, 0.5, np.nan])).all()
    assert beta_cdf(40_000, 40_000, 0.5) == pytest.approx(0.5, abs=1e-9)
    assert np.allclose(beta_quantile(1, 1, [0.1, 0.5, 0.9]), [0.1, 0.5, 0.9])


def test_tail_values_have_their_closed_forms(spark):
    df = spark.createDataFrame([(float(v),) for v in (0.0, 0.3, 1.0, 2.5, 7.0, 40.0)], "v double")
    rows = df.select("v", t_two_sided("v", F.lit(1)).alias("t1"), t_two_sided("v", F.lit(2)).alias("t2"),
                     normal_two_sided(F.col("v")).alias("z"), f_upper(F.col("v"), F.lit(2), F.lit(9)).alias("f")).collect()
    for r in rows:
        v = r["v"]
        assert r["t1"] == pytest.approx(1 - 2 / math.pi * math.atan(v), abs=1e-12)
        assert r["t2"] == pytest.approx(1 - v / math.sqrt(2 + v * v), abs=1e-12)
        assert r["z"] == pytest.approx(math.erfc(v / math.sqrt(2)), abs=1e-15)
        assert r["f"] == pytest.approx((1 + 2 * v / 9) ** -4.5, abs=1e-12)


def test_pooled_huber_follows_the_common_line(spark):
    t = train(spark, synthetic(spark, 420, series="A").unionByName(synthetic(spark, 420, seed=6, series="B")))
    rows = ln.pooled_huber(t).toPandas()
    b, a = np.polyfit(rows["x"], rows["point"], 1)
    assert np.allclose(a + b * rows["x"], rows["point"], atol=1e-9)
    assert b == pytest.approx(0.7, abs=0.02) and len(rows) == 720


def plain_boosting(f, e, here, trees, leaf, rate, bins):
    """One window, loop by loop."""
    n, features = f.shape
    edges = [sorted(f[:, k])[n * j // bins] for k in range(features) for j in range(1, bins)]
    code = lambda v, k: sum(v >= x for x in edges[k * (bins - 1):(k + 1) * (bins - 1)])
    codes = [[code(row[k], k) for k in range(features)] for row in f]
    own = [code(here[k], k) for k in range(features)]
    point = sum(e) / n
    r = [v - point for v in e]

    def cut(rows):
        best, found = 0.0, None
        total = sum(r[i] for i in rows)
        for k in range(features):
            for b in range(bins - 1):
                left = [i for i in rows if codes[i][k] <= b]
                if len(left) < leaf or len(rows) - len(left) < leaf:
                    continue
                s = sum(r[i] for i in left)
                gain = s * s / len(left) + (total - s) ** 2 / (len(rows) - len(left)) - total ** 2 / len(rows)
                if gain > 1e-12 and round(gain, 9) > best:
                    best, found = round(gain, 9), (k, b)
        return found

    def grown(rows, depth):
        at = cut(rows) if depth else None
        if at is None:
            return sum(r[i] for i in rows) / len(rows)
        sides = [[i for i in rows if (codes[i][at[0]] > at[1]) == s] for s in (False, True)]
        return at, [grown(x, depth - 1) for x in sides]

    def value(tree, row):
        while isinstance(tree, tuple):
            (k, b), sides = tree
            tree = sides[int(row[k] > b)]
        return tree

    for _ in range(trees):
        tree = grown(range(n), 2)
        r = [x - rate * value(tree, codes[i]) for i, x in enumerate(r)]
        point += rate * value(tree, own)
    return point


def test_boosted_corrections_equal_a_plain_loop(monkeypatch):
    monkeypatch.setattr(ln, "BINS", 9)
    monkeypatch.setattr(ln, "BOOST", {"trees": 7, "leaf": 12, "rate": 0.2})
    rng = np.random.default_rng(5)
    f = rng.normal(size=(6, 90, 3))
    f[:, :, 1] = np.round(f[:, :, 1])  # ties
    f[2, :, 2] = 1.0  # a feature without values to cut at
    e = np.sin(2 * f[:, :, 0]) + f[:, :, 1] * (f[:, :, 2] > 0) + 0.1 * rng.normal(size=(6, 90))
    mask = np.ones((6, 90), dtype=bool)
    mask[3, :40] = False
    mask[4, :70] = False  # too few rows for any cut
    here = rng.normal(size=(6, 3))
    got = ln.boosted_corrections(f, e, mask, here)
    want = [plain_boosting(f[i][mask[i]], e[i][mask[i]], here[i], 7, 12, 0.2, 9) for i in range(6)]
    assert got == pytest.approx(want, abs=1e-8)
    assert got[4] == pytest.approx(e[4][mask[4]].mean())


def test_boosted_correction_scores_every_origin_and_never_looks_ahead(spark, monkeypatch):
    monkeypatch.setitem(ln.BOOST, "trees", 6)
    t = train(spark, synthetic(spark, 560))
    whole = {r["session"]: r["point"] for r in ln.boosted_correction(t).collect()}
    ridge = {r["session"] for r in ln.rolling_ridge(t).collect()}
    assert set(whole) == ridge and len(whole) > 250
    cut = sorted(whole)[len(whole) // 2]
    part = {r["session"]: r["point"] for r in ln.boosted_correction(t.where(F.col("session") <= F.lit(cut))).collect()}
    assert len(part) > 100 and all(whole[d] == pytest.approx(p, abs=1e-9) for d, p in part.items())


def test_learners_meet_on_identical_dates(spark, monkeypatch):
    monkeypatch.setitem(ln.BOOST, "trees", 4)
    rows = ln.learner_rows(train(spark, synthetic(spark, 760))).collect()
    assert rows and all(r[name]["point"] is not None for r in rows for name in ln.LEARNERS)
    assert all(0 < r[name]["p_up"] < 1 for r in rows for name in ln.LEARNERS)


def test_sealed_forecasts_of_all_sessions_end_with_the_newest(spark):
    t = train(spark, synthetic(spark, 620))
    newest = ln.sealed_forecast(t).first()
    rows = {r["session"]: r["huber"] for r in ln.sealed_forecasts(t).collect()}
    assert rows[newest["session"]]["point"] == pytest.approx(newest["point"], abs=1e-7)
    assert rows[newest["session"]]["p_up"] == pytest.approx(newest["p_up"], abs=1e-9)
    assert rows[newest["session"]]["dir"] == newest["direction"]
