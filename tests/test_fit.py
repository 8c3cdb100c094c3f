import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import evaluate as ev, fit as m, forecast as fc
from tests.helpers import pair_frame, synthetic, train


def test_fit_equals_numpy_on_a_noisy_line(spark):
    rng = np.random.default_rng(17)
    x = rng.uniform(-18, 22, 1700)
    y = -1.3 + 0.82 * x + rng.laplace(0, 1.6, x.size)
    got = m.group_thresholds(pair_frame(spark, x, y), ["series_id"]).first()
    b, a = np.polyfit(x, y, 1)
    resid = y - (a + b * x)
    assert (got["slope"], got["intercept"]) == (pytest.approx(b, rel=1e-9), pytest.approx(a, rel=1e-9))
    assert got["sigma"] == pytest.approx(np.sqrt((resid ** 2).sum() / (x.size - 2)), rel=1e-9)
    low, high = np.quantile(resid, [0.25, 0.75])
    bounded = lambda v, lo, hi: min(max(v, lo), hi)
    assert got["hike"] == pytest.approx(max(bounded((-low - a) / b, 0.3, 8), 0.6), abs=1e-9)
    assert got["drop_"] == pytest.approx(min(bounded((-high - a) / b, -8, -0.3), -0.6), abs=1e-9)


def test_thresholds_are_clamped_and_floored(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 10, 400)
    wide = m.group_thresholds(pair_frame(spark, x, 0.05 * x + rng.normal(0, 5, 400)), ["series_id"], target=0.9).first()
    assert (wide["hike"], wide["drop_"]) == (8.0, -8.0)
    tight = m.group_thresholds(pair_frame(spark, x, 5 * x + rng.normal(0, 0.01, 400)), ["series_id"], target=0.6, floor=0.0).first()
    assert tight["hike"] == pytest.approx(0.3) and tight["drop_"] == pytest.approx(-0.3)


def test_inverted_and_short_series_are_refused(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 10, 100)
    bad = m.group_thresholds(pair_frame(spark, x, -x), ["series_id"]).first()
    assert bad["fit_error"] == "inverted_slope" and bad["hike"] is None
    short = m.group_thresholds(pair_frame(spark, x[:30], x[:30]), ["series_id"]).first()
    assert short["fit_error"] == "too_few_rows"


def test_payoff_totals_follow_the_signs(spark):
    moves = [(2.5, 1.25), (2.4, 8.0), (-7.0, 0.0), (-2.6, 3.5), (11.0, -0.75), (-30.0, -6.0)]
    df = spark.createDataFrame(moves, "x double, y double")
    row = df.agg(*m.payoff_aggregates(m.signal(F.col("x"), F.lit(2.5), F.lit(-2.5)), F.col("y"))).first()
    earned = [y if x > 0 else -y for x, y in moves if abs(x) >= 2.5]
    assert row["alerts"] == len(earned) and row["total_savings"] == pytest.approx(sum(earned))
    # An outcome that does not move is no success.
    assert row["correct"] == sum(e > 0 for e in earned) == 2


@pytest.mark.parametrize("action,side", [("BUY_NOW", 1), ("LEAN_BUY", 1), ("WAIT", -1), ("LEAN_WAIT", -1), ("NO_EDGE", 0)])
def test_economic_value_per_action(spark, action, side):
    gallons, buy, wait = 6200.0, 0.8, 1.1
    df = spark.createDataFrame([(action, e) for e in (-4.7, -0.3, 0.0, 2.2)], "a string, e double")
    v = m.economic_value(F.col("a"), F.col("e"), F.lit(gallons), F.lit(buy), F.lit(wait))
    for r in df.withColumns(v).collect():
        edge = side * r["e"] - (buy if side > 0 else wait if side < 0 else 0.0)
        assert r["net_edge_cents"] == pytest.approx(edge if side else 0.0)
        assert r["net_value_dollars"] == pytest.approx(r["net_edge_cents"] / 100 * gallons)
        assert r["economically_positive"] is (r["net_edge_cents"] > 0)


def test_economic_value_refuses_no_gallons(spark):
    v = m.economic_value(F.lit("WAIT"), F.lit(1.0), F.lit(-1.0), F.lit(0.2), F.lit(0.2))
    row = spark.range(1).withColumns(v).first()
    assert row["input_error"] == "gallons_not_positive" and row["net_edge_cents"] is None


def test_tail_mean_of_squares(spark):
    y = np.arange(3, 83, dtype=float) ** 2
    frame = pair_frame(spark, np.full(len(y), -5.0), y)
    drops = spark.createDataFrame([("A", -1.0)], "series_id string, drop_ double")
    row = m.tail_risk(frame, drops, reps=200).first()
    tail = y[y >= np.quantile(y, 0.95)]
    assert row["cvar"] == pytest.approx(tail.mean()) and row["sample_n"] == len(y) and row["tail_n"] == len(tail)
    assert row["cvar_low"] <= tail.mean() <= row["cvar_high"] and row["probability_adverse"] == 1.0


def test_block_interval_matches_numpy(spark):
    """Same draws, refitted with NumPy."""
    import hashlib
    frame = train(spark, synthetic(spark, 200))
    pdf = frame.orderBy("ord").toPandas()
    x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
    n, reps, block = len(x), 120, 5
    hikes = []
    for rep in range(1, reps + 1):
        idx = []
        for j in range(int(np.ceil(n / block))):
            h = hashlib.md5(f"threshold|A|{rep}|{j}".encode()).hexdigest()[:8]
            s = int(h, 16) % (n - block + 1)
            idx += range(s, s + block)
        idx = np.array(idx[:n])
        b, a = np.polyfit(x[idx], y[idx], 1)
        q = np.quantile(y[idx] - (a + b * x[idx]), 0.25)
        hikes.append(max(min(max((-q - a) / b, 0.3), 8.0), 0.6))
    got = m.block_threshold_interval(frame, reps=reps).first()
    low, high = np.percentile(hikes, [2.5, 97.5])
    assert got["hike_low"] == pytest.approx(low, abs=1e-9) and got["hike_high"] == pytest.approx(high, abs=1e-9)


def test_running_sums_equal_direct_fits(spark):
    frame = train(spark, synthetic(spark, 460))
    pdf = frame.orderBy("ord").toPandas()
    rows = m.rolling_line(frame, 360, 1).orderBy("ord").collect()
    weighted = m.rolling_line(frame, 360, 1, "w_", fc.WEIGHT).orderBy("ord").collect()
    x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
    for i in (100, 361, len(x) - 1):
        lo, hi = max(0, i - 361), i - 1
        b, a = np.polyfit(x[lo:hi], y[lo:hi], 1)
        assert rows[i]["slope"] == pytest.approx(b, abs=1e-9) and rows[i]["intercept"] == pytest.approx(a, abs=1e-9)
        w = np.exp2(-np.arange(hi - lo - 1, -1, -1) / 90)
        b, a = np.polyfit(x[lo:hi], y[lo:hi], 1, w=np.sqrt(w))
        assert weighted[i]["w_slope"] == pytest.approx(b, abs=1e-8)


def as_map(rows, *cols):
    return {(r["series_id"], r["session"]): tuple(r[c] for c in cols) for r in rows.collect()}


def test_later_outcomes_never_change_earlier_results(spark):
    before = train(spark, synthetic(spark, 520))
    after = train(spark, synthetic(spark, 520, outcome_shift=500))
    cut = before.where("ord = 470").first()["session"]
    for run, cols in ((lambda t: ev.daily_origin(t), ("expected", "hike", "p_up")),
                      (lambda t: ev.rolling_scores(t), ("hike", "drop_")),
                      (lambda t: fc.prequential(t).where("p_base IS NOT NULL"), ("p_base", "p_short", "p_weighted"))):
        a = as_map(run(before).where(F.col("session") <= F.lit(cut)), *cols)
        b = as_map(run(after).where(F.col("session") <= F.lit(cut)), *cols)
        assert a and a.keys() == b.keys()
        for key in a:
            assert a[key] == pytest.approx(b[key], abs=1e-9)


def test_purged_row_is_outside_the_fit(spark):
    rows = ev.fold_rows(train(spark, synthetic(spark, 420))).where("fold = 0")
    test = rows.where("NOT is_train").agg(F.min("ord"), F.count("*")).first()
    fit = rows.where("is_train").agg(F.max("ord")).first()
    assert test[1] == 45 and fit[0] == test[0] - 2
