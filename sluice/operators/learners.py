"""Robust and regularised learners fitted at every origin of a series.

Neighbouring origins share almost all of their rows, so rows are grouped by
runs of ``RUN`` origins with the window they need in front: each group holds
at most ``RUN + window + purge`` rows, a series spreads over many tasks, and a
task fits all windows of its run at once on stacked arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sluice.functions.exprs import settle, spread
from sluice.operators import fit as m, forecast as fc
from sluice.operators.align import by_session, in_series

# Fixed values of the learners.
HUBER_EPSILON, HUBER_ALPHA = 1.35, 1e-4
RIDGE_ALPHA, CORRECTION_MIN = 10.0, 80
BOOST = {"trees": 60, "leaf": 30, "rate": 0.05}
#: Bins of a feature in a window.
BINS = 64
FEATURES = ["x", "abs_x", "prior_basis", "prior_error", "prior_error_missing",
            "prior_20_std", "season_sin", "season_cos"]
RUN = 64


def run_rows(rows: DataFrame, window: int, purge: int) -> DataFrame:
    """Rows tagged with every run of origins that reads them."""
    own = F.floor((F.col("ord") - 1) / RUN)
    last = F.least(F.floor((F.col("n") - 1) / RUN), F.floor((F.col("ord") - 1 + window + purge) / RUN))
    tagged = rows.withColumn("run", F.explode(F.sequence(own, last)))
    return spread(tagged, "series_id", "run")


def windows_of(values: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(origins, window) stacked values before each end, and their mask."""
    index = ends[:, None] + np.arange(-window, 0)
    mask = index >= 0
    return values[np.clip(index, 0, None)], mask


def huber_lines(x: np.ndarray, y: np.ndarray, mask: np.ndarray,
                rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intercepts and slopes of Huber fits with a jointly fitted scale, and whether each has converged.

    The driver is standardised first.  Weights and scale are the stationary
    conditions of the joint loss, iterated until the scale settles.
    """
    w0 = mask.astype(float)
    n = w0.sum(1)
    mean = (w0 * x).sum(1) / n
    sd = np.sqrt((w0 * (x - mean[:, None]) ** 2).sum(1) / n)
    sd = np.where(sd > 0, sd, 1.0)
    z = (x - mean[:, None]) / sd[:, None]
    a, b = (w0 * y).sum(1) / n, np.zeros(len(x))
    scale = np.sqrt((w0 * (y - a[:, None]) ** 2).sum(1) / n) + 1e-12
    for _ in range(rounds):
        r = y - a[:, None] - b[:, None] * z
        inside = (np.abs(r) <= HUBER_EPSILON * scale[:, None]) & mask
        w = np.where(inside, 1.0, HUBER_EPSILON * scale[:, None] / np.maximum(np.abs(r), 1e-300)) * w0
        sw, sz, sy = w.sum(1), (w * z).sum(1), (w * y).sum(1)
        szz, szy = (w * z * z).sum(1) + HUBER_ALPHA * scale, (w * z * y).sum(1)
        det = sw * szz - sz * sz
        b = (sw * szy - sz * sy) / det
        a = (sy - b * sz) / sw
        r = y - a[:, None] - b[:, None] * z
        inside = (np.abs(r) <= HUBER_EPSILON * scale[:, None]) & mask
        free = n - (mask & ~inside).sum(1) * HUBER_EPSILON ** 2
        new = np.sqrt((np.where(inside, r, 0.0) ** 2).sum(1) / np.maximum(free, 1e-9)) + 1e-12
        settled = np.abs(new - scale) / scale < 1e-10
        scale = new
        if settled.all():
            break
    slope = b / sd
    return a - slope * mean, slope, settled


def per_run(fit: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]) -> Callable:
    """Sort a run's rows and hand over the positions of its own origins."""
    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").reset_index(drop=True)
        own = np.flatnonzero((pdf["ord"].to_numpy() - 1) // RUN == pdf["run"].iloc[0])
        return fit(pdf, own)
    return apply


def rolling_huber(train: DataFrame, window: int = fc.WINDOW, purge: int = fc.PURGE,
                  minimum: int = fc.BASE_MIN) -> DataFrame:
    """Huber line of the window before each row, and its forecast."""
    def fit(pdf: pd.DataFrame, own: np.ndarray) -> pd.DataFrame:
        ends = own - purge
        x, mask = windows_of(pdf["x"].to_numpy(), ends, window)
        y, _ = windows_of(pdf["y"].to_numpy(), ends, window)
        keep = mask.sum(1) >= minimum
        out = pdf.loc[own[keep], ["series_id", "session", "ord", "x", "y"]].copy()
        if keep.any():
            a, b, settled = huber_lines(x[keep], y[keep], mask[keep])
        else:
            a, b, settled = np.empty(0), np.empty(0), np.empty(0, dtype=bool)
        out["intercept"], out["slope"], out["converged"] = a, b, settled
        out["point"] = out["intercept"] + out["slope"] * out["x"]
        return out

    tagged = run_rows(train, window, purge).select("series_id", "run", "session", "ord", "x", "y")
    return tagged.groupBy("series_id", "run").applyInPandas(
        per_run(fit), "series_id string, session date, ord int, x double, y double, "
                      "intercept double, slope double, converged boolean, point double")


#: From windows of features (origins x rows x features), earlier errors and their mask, and the features of the rows to
#: correct: a correction for each.
Corrector = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def rolling_correction(train: DataFrame, corrector: Corrector, window: int = fc.WINDOW, purge: int = fc.PURGE) -> DataFrame:
    """Baseline forecast plus a correction learned anew at every origin from the earlier errors of its series.

    One shuffle deals the rows to runs of origins; every row behind ``CORRECTION_MIN`` usable ones gets a point.
    """
    feats = fc.causal_features(train).where("e_base IS NOT NULL AND prior_20_std IS NOT NULL AND prior_basis IS NOT NULL")
    feats = (feats.withColumn("first", F.row_number().over(by_session()))
             .withColumn("session_ord", F.col("ord")).withColumn("ord", F.col("first"))
             .withColumn("n", F.count("*").over(in_series())))

    def fit(pdf: pd.DataFrame, own: np.ndarray) -> pd.DataFrame:
        cols = pdf[FEATURES].to_numpy()
        index = (own - purge)[:, None] + np.arange(-window, 0)
        mask = index >= 0
        keep = mask.sum(1) >= CORRECTION_MIN
        out = pdf.loc[own[keep], ["series_id", "session", "y", "p_base"]].copy()
        index, mask = np.clip(index[keep], 0, None), mask[keep]
        fixed = corrector(cols[index], pdf["e_base"].to_numpy()[index], mask, cols[own[keep]]) if keep.any() else np.empty(0)
        out["point"] = out["p_base"] + fixed
        return out

    tagged = run_rows(feats, window, purge).select(
        "series_id", "run", "session", "ord", "y", "p_base", "e_base", *FEATURES)
    return tagged.groupBy("series_id", "run").applyInPandas(
        per_run(fit), "series_id string, session date, y double, p_base double, point double")


def ridge_corrections(f: np.ndarray, e: np.ndarray, mask: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Ridge regression on standardised features."""
    w = mask.astype(float)
    n = w.sum(1)
    mean = (w[:, :, None] * f).sum(1) / n[:, None]
    sd = np.sqrt((w[:, :, None] * (f - mean[:, None]) ** 2).sum(1) / n[:, None])
    sd = np.where(sd > 1e-12, sd, 1.0)
    z = (f - mean[:, None]) / sd[:, None] * w[:, :, None]
    bar = (w * e).sum(1) / n
    gram = np.einsum("oik,oil->okl", z, z) + RIDGE_ALPHA * np.eye(f.shape[2])
    beta = np.linalg.solve(gram, np.einsum("oik,oi->ok", z, e - bar[:, None])[:, :, None])[:, :, 0]
    return bar + ((here - mean) / sd * beta).sum(1)


def _bins(f: np.ndarray, mask: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of every value of a window between BINS quantiles of its feature there, and of the values to correct."""
    ordered = np.sort(np.where(mask[:, :, None], f, np.inf), axis=1)
    at = mask.sum(1)[:, None] * np.arange(1, BINS) // BINS
    edges = np.take_along_axis(ordered, np.repeat(at[:, :, None], f.shape[2], axis=2), axis=1)
    codes, own = np.zeros(f.shape, dtype=np.int64), np.zeros(here.shape, dtype=np.int64)
    for j in range(BINS - 1):
        codes += f >= edges[:, None, j]
        own += here >= edges[:, j]
    return codes, own


def _best_cuts(sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature and last bin of the left side, of the cut that takes most squared error; bin BINS where none may be made.

    ``sums`` and ``counts`` are (nodes, features, bins); of equal cuts the first counts.
    """
    left, n_left = sums.cumsum(axis=2)[:, :, :-1], counts.cumsum(axis=2)[:, :, :-1]
    total, n = sums.sum(axis=2)[:, :, None], counts.sum(axis=2)[:, :, None]
    n_right = n - n_left
    allowed = (n_left >= BOOST["leaf"]) & (n_right >= BOOST["leaf"])
    gain = left ** 2 / np.maximum(n_left, 1) + (total - left) ** 2 / np.maximum(n_right, 1) - total ** 2 / np.maximum(n, 1)
    gain = np.where(allowed & (gain > 1e-12), np.round(gain, 9), -1.0).reshape(len(sums), -1)
    best = gain.argmax(axis=1)
    possible = gain[np.arange(len(gain)), best] >= 0
    return best // (BINS - 1), np.where(possible, best % (BINS - 1), BINS)


def boosted_corrections(f: np.ndarray, e: np.ndarray, mask: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Boosted trees of depth 2 on histograms, of all windows at once.

    A tree is three cuts a window: the sums of residuals by (window, feature, bin) give the first, the same sums by side
    the other two.
    """
    origins, rows, features = f.shape
    codes, own = _bins(f, mask, here)
    w, each = mask.astype(float), np.arange(origins)
    cell = (each[:, None, None] * features + np.arange(features)) * BINS + codes
    cells = origins * features * BINS
    point = (w * e).sum(1) / w.sum(1)
    r = (e - point[:, None]) * w

    def histogram(where: np.ndarray, values: np.ndarray, nodes: int) -> np.ndarray:
        spread_out = np.broadcast_to(values[:, :, None], where.shape).ravel()
        return np.bincount(where.ravel(), weights=spread_out, minlength=nodes * features * BINS).reshape(nodes, features, BINS)

    whole = histogram(cell, w, origins)
    for _ in range(BOOST["trees"]):
        k, cut = _best_cuts(histogram(cell, r, origins), whole)
        side = np.take_along_axis(codes, k[:, None, None], axis=2)[:, :, 0] > cut[:, None]
        own_side = own[each, k] > cut
        both = cell + side[:, :, None] * cells
        k2, cut2 = _best_cuts(histogram(both, r, 2 * origins), histogram(both, w, 2 * origins))
        k2, cut2 = k2.reshape(2, origins), cut2.reshape(2, origins)
        node = side.astype(np.int64)
        mine = np.take_along_axis(codes, k2[node, each[:, None]][:, :, None], axis=2)[:, :, 0]
        leaf = each[:, None] * 4 + 2 * node + (mine > cut2[node, each[:, None]])
        o = own_side.astype(np.int64)
        own_leaf = each * 4 + 2 * o + (own[each, k2[o, each]] > cut2[o, each])
        total, n = (np.bincount(leaf.ravel(), weights=v.ravel(), minlength=4 * origins) for v in (r, w))
        value = BOOST["rate"] * total / np.maximum(n, 1)
        r = (r - value[leaf]) * w
        point = point + value[own_leaf]
    return point


def rolling_ridge(train: DataFrame, window: int = fc.WINDOW, purge: int = fc.PURGE) -> DataFrame:
    """Baseline forecast plus a ridge correction learned from earlier errors."""
    return rolling_correction(train, ridge_corrections, window, purge)


def boosted_correction(train: DataFrame, window: int = fc.WINDOW, purge: int = fc.PURGE) -> DataFrame:
    """Baseline forecast plus a boosted correction learned from earlier errors, per series and origin."""
    return rolling_correction(train, boosted_corrections, window, purge)


LEARNERS = ("production", "prequential_360", "huber", "ridge", "boosted")


def with_probabilities(train: DataFrame, points: dict[str, DataFrame]) -> DataFrame:
    """(series_id, session, x, <name>...): each learner's forecast with what its earlier errors say about it.

    A pair counts once every learner has a point and all ``ERRORS`` earlier errors.
    """
    rows = train.select("series_id", "session", "x", "y")
    for name, df in points.items():
        rows = rows.join(df.select("series_id", "session", F.col("point").alias(f"p_{name}")), ["series_id", "session"], "left")
    past = fc.earlier(fc.ERRORS)
    rows = rows.withColumns({f"l_{k}": F.collect_list(F.col("y") - F.col(f"p_{k}")).over(past) for k in points})
    for k in points:
        rows = rows.where(F.col(f"p_{k}").isNotNull() & (F.size(f"l_{k}") == fc.ERRORS))
    rows = settle(rows.drop("y"), **{f"s_{k}": F.sort_array(f"l_{k}") for k in points}).drop(*[f"l_{k}" for k in points])
    rows = settle(rows, **{f"d_{k}": F.struct(*[v.alias(n) for n, v in fc.error_distribution(
        F.col(f"p_{k}"), F.col(f"s_{k}")).items()]) for k in points})
    made = {k: fc.challenger(F.col(f"p_{k}"), {n: F.col(f"d_{k}.{n}") for n in ("p_up", "p_down", "low", "high")}, F.col("x"))
            for k in points}
    return settle(rows, **made).select("series_id", "session", *points)


def learner_rows(train: DataFrame) -> DataFrame:
    """Forecasts of the fitted line, the prequential line and the three learners on identical dates."""
    points = {"huber": rolling_huber(train), "ridge": rolling_ridge(train), "boosted": boosted_correction(train)}
    base = fc.forecast_rows(train).select("series_id", "session", "ord", "x", "y", *LEARNERS[:2])
    return base.join(with_probabilities(train, points), ["series_id", "session"]).select(
        "series_id", "session", "ord", "x", "y", *LEARNERS)


def sealed_forecasts(train: DataFrame) -> DataFrame:
    """The sealed forecast of every session, (series_id, session, huber).

    Its line is the rolling fit of the sealed window and its errors are those of the same rolling fits before it, so
    one pass gives for all sessions what :func:`sealed_forecast` gives for the newest.
    """
    return with_probabilities(train, {"huber": rolling_huber(train)})


def pooled_huber(train: DataFrame) -> DataFrame:
    """One robust line over every series' last window, fitted by Spark ML."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(m.last_rows(train))
    model = LinearRegression(labelCol="y", loss="huber", epsilon=HUBER_EPSILON, regParam=HUBER_ALPHA,
                             predictionCol="point", maxIter=200, tol=1e-8).fit(rows)
    return model.transform(rows).select("series_id", "session", "x", "y", "point")


def sealed_forecast(train: DataFrame, window: int = 360, calibration: int = 120, purge: int = 1) -> DataFrame:
    """Forecast of each series' newest move from its sealed last 482 pairs.

    The nested prequential fits are the same rolling series, so 121 windows are
    fitted together instead of one by one inside each forecast.
    """
    needed = window + calibration + 2 * purge
    sealed = (train.where((F.col("ord") >= F.col("n") - needed) & (F.col("n") > needed))
              .groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("ord", "session", "x", "y"))).alias("p")))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for sid, pairs in zip(pdf["series_id"], pdf["p"]):
            day = [r["session"] for r in pairs]
            x = np.array([r["x"] for r in pairs], float)
            y = np.array([r["y"] for r in pairs], float)
            past, move = needed, x[-1]
            end = past - purge
            ends = np.append(np.arange(end - calibration, end) - purge, end)
            wx, mask = windows_of(x[:past], ends, window)
            wy, _ = windows_of(y[:past], ends, window)
            a, b, settled = huber_lines(wx, wy, mask)
            at = np.arange(end - calibration, end)
            errors = y[at] - (a[:-1] + b[:-1] * x[at])
            point = a[-1] + b[-1] * move
            p_up = ((errors > -point).sum() + 1) / (calibration + 2)
            p_down = ((errors < -point).sum() + 1) / (calibration + 2)
            low, high = np.quantile(errors, [0.1, 0.9]) + point
            p = p_up if point > 0 else p_down
            flat = abs(move) < m.NOISE_FLOOR or point == 0 or p < m.LEAN_TARGET
            out.append((sid, day[-1], move, point, p_up, p_down, low, high,
                        0 if flat else (1 if point > 0 else -1),
                        "FLAT" if flat else ("FULL" if p >= m.TARGET else "LEAN"), b[-1], a[-1],
                        day[end - window], day[end - 1], day[end - calibration], day[end - 1], bool(settled.all())))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SEALED.split(", ")])

    return spread(sealed, "series_id").mapInPandas(lambda it: (fit(p) for p in it), SEALED)


SEALED = ("series_id string, session date, move double, point double, p_up double, p_down double, low double, "
          "high double, direction int, band string, slope double, intercept double, fit_start date, fit_end date, "
          "calibration_start date, calibration_end date, converged boolean")
