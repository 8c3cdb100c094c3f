"""Affine pass-through fits, residual probabilities and decision thresholds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.functions.draws import hashed_draws
from sluice.functions.exprs import array_quantile, clip, count_if, draw, ratio, replicate_chunks, replicates, settle

# Fixed policy values.
TARGET, LEAN_TARGET = 0.75, 0.65
NOISE_FLOOR, FALLBACK_FLOOR = 0.6, 1.2
MIN_ABS, MAX_ABS = 0.3, 8.0
MIN_FIT_ROWS, FIT_WINDOW = 40, 360
GRID_POINTS = 101
TRUCK_GALLONS = 8500.0


RUNNING = {"c_n": "1D", "c_x": "x", "c_y": "y", "c_xx": "x*x", "c_xy": "x*y", "c_yy": "y*y"}


def rolling_line(rows: DataFrame, window: int, purge: int, prefix: str = "",
                 weight: str | None = None) -> DataFrame:
    """Fit of the ``window`` rows that end one purge gap before each row.

    Sums over a moving window are differences of running sums, so a fit per
    row costs the same however long the window is.  Moves are centred near
    zero, which keeps the differences exact to about 1e-12.  A weight that
    grows with the row number may be given: a common factor of all weights of
    a window cancels in the fit.
    """
    order = Window.partitionBy("series_id").orderBy("ord")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    term = lambda e: F.expr(e if weight is None else f"({weight})*({e})")
    rows = rows.withColumns({k: F.sum(term(e)).over(upto) for k, e in RUNNING.items()})
    rows = rows.withColumn("c_k", F.count("x").over(upto))
    end = lambda k: F.coalesce(F.lag(k, 1 + purge).over(order), F.lit(0))
    start = lambda k: F.coalesce(F.lag(k, 1 + purge + window).over(order), F.lit(0))
    names = [*RUNNING, "c_k"]
    rows = rows.withColumns({f"w{k[1:]}": end(k) - start(k) for k in names}).drop(*names)
    sxx = F.col("w_xx") - F.col("w_x") * F.col("w_x") / F.col("w_n")
    sxy = F.col("w_xy") - F.col("w_x") * F.col("w_y") / F.col("w_n")
    slope = sxy / F.nullif(sxx, F.lit(0.0))
    filled = F.col("w_k") > 1
    rows = rows.withColumns({f"{prefix}slope": F.when(filled, slope), f"{prefix}rows": F.col("w_k")})
    rows = rows.withColumn(f"{prefix}intercept", F.when(
        filled, (F.col("w_y") - F.col(f"{prefix}slope") * F.col("w_x")) / F.col("w_n")))
    return rows.drop(*[f"w{k[1:]}" for k in names])


def last_rows(train: DataFrame, window: int = FIT_WINDOW) -> DataFrame:
    return train.where(F.col("ord") > F.col("n") - window)


def fit_aggregates(x: Column, y: Column, over: Window | None = None) -> dict[str, Column]:
    """Least squares of y on x, grouped or over a window frame."""
    wrap = (lambda c: c) if over is None else (lambda c: c.over(over))
    return {"slope": wrap(F.regr_slope(y, x)), "intercept": wrap(F.regr_intercept(y, x)),
            "r2": wrap(F.regr_r2(y, x)), "rows": wrap(F.regr_count(y, x)),
            "syy": wrap(F.regr_syy(y, x))}


def sigma() -> Column:
    """Residual deviation with n - 2 degrees of freedom."""
    return F.sqrt(F.col("syy") * (1 - F.col("r2")) / (F.col("rows") - 2))


def with_fit(df: DataFrame, keys: Sequence[str], train: Column | None = None) -> DataFrame:
    """Add the group's fit and each training row's residual.

    Window aggregates over the group keep one shuffle for fit and residuals;
    ``train`` limits the fit to some rows of the group.
    """
    w = Window.partitionBy(*keys)
    x, y = F.col("x"), F.col("y")
    if train is not None:
        x, y = F.when(train, x), F.when(train, y)
    df = df.withColumns(fit_aggregates(x, y, w))
    return df.withColumn("resid", y - (F.col("intercept") + F.col("slope") * x))


def quantile_targets(target: float = TARGET, lean: float = LEAN_TARGET) -> Column:
    return F.array(*[F.lit(v) for v in (1 - target, target, 1 - lean, lean)])


def bounded_threshold(q: Column, up: bool) -> Column:
    """Driver move at which the residual quantile ``q`` is just outweighed."""
    raw = (-q - F.col("intercept")) / F.nullif(F.col("slope"), F.lit(0.0))
    return clip(raw, MIN_ABS, MAX_ABS) if up else clip(raw, -MAX_ABS, -MIN_ABS)


def noise_floored(threshold: Column, floor: float, up: bool) -> Column:
    return F.greatest(threshold, F.lit(floor)) if up else F.least(threshold, F.lit(-floor))


def with_thresholds(fits: DataFrame, q: Column, floor: float = NOISE_FLOOR) -> DataFrame:
    """hike, drop_, lean_hike, lean_drop from quantiles [1-p, p, 1-l, l].

    A non-positive slope or too few rows refuses the fit: thresholds are null
    and ``fit_error`` says why.  A lean threshold never lies beyond a full one.
    """
    error = (F.when(F.col("rows") < MIN_FIT_ROWS, "too_few_rows")
             .when(F.col("slope").isNull(), "constant_driver")
             .when(F.col("slope") <= 0, "inverted_slope"))
    ok = F.col("fit_error").isNull()
    at = lambda i, up: F.when(ok, noise_floored(bounded_threshold(q[i], up), floor, up))
    fits = settle(fits.withColumn("fit_error", error), hike=at(0, True), drop_=at(1, False),
                  _lh=at(2, True), _ld=at(3, False))
    return (fits.withColumn("lean_hike", F.least("_lh", "hike"))
            .withColumn("lean_drop", F.greatest("_ld", "drop_")).drop("_lh", "_ld"))


def group_thresholds(df: DataFrame, keys: Sequence[str], train: Column | None = None,
                     floor: float = NOISE_FLOOR, target: float = TARGET,
                     lean: float = LEAN_TARGET, extra: Sequence[Column] = ()) -> DataFrame:
    """One row per group: fit, residual quantiles and thresholds."""
    fitted = with_fit(df, keys, train)
    first = [F.max(c).alias(c) for c in ("slope", "intercept", "r2", "rows", "syy")]
    grouped = fitted.groupBy(*keys).agg(
        *first, F.percentile("resid", quantile_targets(target, lean)).alias("q"), *extra)
    return with_thresholds(grouped.withColumn("sigma", sigma()), F.col("q"), floor).drop("q", "syy")


def rank_probability(not_above: Column, n: Column) -> Column:
    """Share of residuals not above a value, never quite 0 or 1."""
    floor = 1.0 / (n + 2)
    return F.greatest(floor, F.least(1.0 - floor, not_above / n))


def probability_up(resid: Column, x: Column) -> Column:
    """P(response rises) from an array of residuals and the fit columns."""
    below = F.size(F.filter(resid, lambda r: r <= -(F.col("intercept") + F.col("slope") * x)))
    return 1.0 - rank_probability(below, F.size(resid).cast("double"))


def probability_correct(p_up: Column, x: Column) -> Column:
    return F.when(x >= 0, p_up).otherwise(1.0 - p_up)


def signal(x: Column, hike: Column, drop: Column) -> Column:
    """+1 buy, -1 wait, 0 no alert."""
    return F.when(x >= hike, 1).when(x <= drop, -1).otherwise(0)


def payoff_aggregates(direction: Column, y: Column) -> list[Column]:
    """Alert count, hits, precision and savings of a signal column.

    A zero move is wrong for either direction.
    """
    pay = direction * y
    alert = direction != 0
    n, hit = count_if(alert), count_if(alert & (pay > 0))
    total = F.coalesce(F.sum(F.when(alert, pay)), F.lit(0.0))
    return [n.alias("alerts"), hit.alias("correct"), ratio(hit, n).alias("precision"),
            total.alias("total_savings"), ratio(total, n).alias("mean_savings")]


def quantile_grid(resid: Column, points: int = GRID_POINTS) -> Column:
    """Evenly spaced residual quantiles, four decimals."""
    grid = F.percentile(resid, F.array(*[F.lit(i / (points - 1)) for i in range(points)]))
    return F.transform(grid, lambda v: F.round(v, 4) + 0.0)


def economic_value(action: Column, expected: Column, gallons: Column,
                   buy_cost: Column, wait_cost: Column) -> dict[str, Column]:
    """Net cents and dollars of acting, with the reason a row is rejected."""
    buy, wait = action.isin("BUY_NOW", "LEAN_BUY"), action.isin("WAIT", "LEAN_WAIT")
    error = (F.when(expected.isNull() | F.isnan(expected), "non_finite")
             .when(gallons <= 0, "gallons_not_positive")
             .when((buy_cost < 0) | (wait_cost < 0), "negative_cost"))
    gross = F.when(buy, expected).when(wait, -expected).otherwise(0.0)
    cost = F.when(buy, buy_cost).when(wait, wait_cost).otherwise(0.0)
    net = gross - cost
    keep = lambda c: F.when(error.isNull(), c)
    return {"input_error": error, "gross_edge_cents": keep(gross), "action_cost_cents": keep(cost),
            "net_edge_cents": keep(net), "net_value_dollars": keep(net / 100.0 * gallons),
            "economically_positive": keep(net > 0.0)}


def block_threshold_interval(recent: DataFrame, reps: int = 500, block: int = 5,
                             floor: float = NOISE_FLOOR, target: float = TARGET,
                             seed: str = "threshold", chunks: int = 16) -> DataFrame:
    """Moving-block bootstrap interval of both thresholds per series.

    A series' fit window is at most ``FIT_WINDOW`` pairs, so it travels as one
    bounded array.  Replicates are split into ``chunks`` before the shuffle, so
    even a single series spreads over several tasks, and every replicate is
    drawn, refitted and turned into thresholds inside its row: nothing of size
    replicates x pairs is ever shuffled.
    """
    rows = recent.groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct("ord", "x", "y"))).alias("p"))
    work = replicates(rows.withColumn("m", F.size("p")).where(F.col("m") >= MIN_FIT_ROWS),
                      reps, chunks)
    needed = F.ceil(F.col("m") / F.lit(block)).cast("int")
    work = settle(work, s=F.transform(F.sequence(F.lit(0), needed - 1), lambda j: draw(
        F.concat_ws("|", F.lit(seed), F.col("series_id"), F.col("rep"), j), 0,
        F.col("m") - block + 1).cast("int")))
    pick = lambda i: F.get(F.col("p"), F.get(F.col("s"), F.floor(i / block).cast("int")) + i % block)
    work = settle(work, b=F.transform(F.sequence(F.lit(0), F.col("m") - 1), pick))
    total = lambda f: F.aggregate("b", F.lit(0.0), lambda acc, r: acc + f(r))
    work = settle(work, mx=total(lambda r: r["x"]) / F.col("m"),
                  my=total(lambda r: r["y"]) / F.col("m"))
    work = settle(work, sxx=total(lambda r: (r["x"] - F.col("mx")) * (r["x"] - F.col("mx"))),
                  sxy=total(lambda r: (r["x"] - F.col("mx")) * (r["y"] - F.col("my"))))
    slope = F.col("sxy") / F.nullif(F.col("sxx"), F.lit(0.0))
    work = settle(work, slope=slope, intercept=F.col("my") - slope * F.col("mx")).where("slope > 0")
    work = settle(work, resid=F.sort_array(F.transform("b", lambda r: r["y"] - (
        F.col("intercept") + F.col("slope") * r["x"]))))
    work = (work.withColumn("hike", noise_floored(bounded_threshold(
                array_quantile(F.col("resid"), 1 - target), True), floor, True))
            .withColumn("drop_", noise_floored(bounded_threshold(
                array_quantile(F.col("resid"), target), False), floor, False)))
    ends = F.array(F.lit(0.025), F.lit(0.975))
    out = work.select("series_id", "hike", "drop_").groupBy("series_id").agg(
        F.percentile("hike", ends).alias("h"), F.percentile("drop_", ends).alias("d"),
        F.count("*").alias("replicates"))
    need = max(80, int(reps * 0.8))
    return (out.where(F.col("replicates") >= need)
            .select("series_id", F.col("h")[0].alias("hike_low"), F.col("h")[1].alias("hike_high"),
                    F.col("d")[0].alias("drop_low"), F.col("d")[1].alias("drop_high"),
                    "replicates"))


def tail_risk(train: DataFrame, drops: DataFrame, reps: int = 2000, level: float = 0.95,
              min_sample: int = 20, min_tail: int = 4, seed: str = "tail",
              chunks: int = 16) -> DataFrame:
    """Tail mean of the response on wait signals, with an iid bootstrap interval.

    Uses every pair of the series, not only the fit window.  A series holds at
    most one pair per business day, so its wait moves form a bounded array; the
    replicates are split as in :func:`block_threshold_interval`.
    """
    waits = (train.join(drops.select("series_id", "drop_"), "series_id")
             .where("x <= drop_").groupBy("series_id")
             .agg(F.sort_array(F.collect_list("y")).alias("w")))
    waits = waits.withColumn("sample_n", F.size("w")).where(F.col("sample_n") >= min_sample)
    tail_of = lambda arr, cut: F.filter(arr, lambda v: v >= cut)
    mean_of = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, v: a + v) / F.size(arr)
    base = settle(waits, cutoff=array_quantile(F.col("w"), level))
    base = (settle(base, t=tail_of(F.col("w"), F.col("cutoff")))
            .withColumn("tail_n", F.size("t")).where(F.col("tail_n") >= min_tail))

    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sid, chunk, w in zip(batch["series_id"], batch["chunk"], batch["w"]):
                out = []
                for rep in range(chunk + 1, reps + 1, chunks):
                    sample = w[hashed_draws(f"{seed}|{sid}|{rep}", len(w), len(w))]
                    out.append(sample[sample >= np.quantile(sample, level)].mean())
                yield pd.DataFrame({"series_id": sid, "m": out})

    work = replicate_chunks(base.select("series_id", "w"), chunks)
    boot = work.mapInPandas(means, "series_id string, m double").groupBy("series_id").agg(
        F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    adverse = F.size(F.filter("w", lambda v: v > 0)) / F.col("sample_n")
    return base.join(boot, "series_id").select(
        "series_id", mean_of(F.col("t")).alias("cvar"), F.col("ci")[0].alias("cvar_low"),
        F.col("ci")[1].alias("cvar_high"), "tail_n", "sample_n", "cutoff",
        adverse.alias("probability_adverse"), array_quantile(F.col("w"), 0.5).alias("median_move"))
