"""Competing one-session forecasts scored on identical dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions.exprs import array_quantile, count_if, ratio, settle
from sluice.operators import fit as m
from sluice.operators.align import by_session, in_series

# Fixed values of the comparison.
WINDOW, PURGE, BASE_MIN, ERRORS, SHORT, HALF_LIFE = 360, 1, 120, 120, 180, 90
EVALUATION_START = WINDOW + PURGE
WEIGHT = f"pow(2D, ord / {HALF_LIFE}D)"
CANDIDATES = ("production", "prequential_360", "short_180", "weighted_360")


def earlier(rows: int) -> object:
    """The ``rows`` rows that end one purge row before the current one."""
    return by_session().rowsBetween(-(rows + PURGE), -(1 + PURGE))


def weighted_sums(frame) -> dict[str, Column]:
    """Recency-weighted moments of a frame."""
    w = F.expr(WEIGHT)
    terms = {"w": w, "wx": w * F.col("x"), "wy": w * F.col("y"),
             "wxx": w * F.col("x") * F.col("x"), "wxy": w * F.col("x") * F.col("y")}
    return {k: F.sum(v).over(frame) for k, v in terms.items()}


def weighted_line() -> tuple[Column, Column]:
    c = F.col
    slope = (c("wxy") - c("wx") * c("wy") / c("w")) / F.nullif(
        c("wxx") - c("wx") * c("wx") / c("w"), F.lit(0.0))
    return slope, (c("wy") - slope * c("wx")) / c("w")


def weighted_fit(train: DataFrame) -> DataFrame:
    """Weighted fit of each series' last window; residuals stay unweighted."""
    rows = m.last_rows(train).withColumns(weighted_sums(in_series()))
    slope, intercept = weighted_line()
    rows = rows.withColumn("slope", slope).withColumn("intercept", intercept)
    rows = rows.withColumn("resid", F.col("y") - (F.col("intercept") + F.col("slope") * F.col("x")))
    g = rows.groupBy("series_id").agg(
        F.max("slope").alias("slope"), F.max("intercept").alias("intercept"),
        F.count("*").alias("rows"), F.sum(F.col("resid") ** 2).alias("sse"),
        (F.var_pop("y") * F.count("*")).alias("syy"),
        F.percentile("resid", m.quantile_targets()).alias("q"))
    g = (g.withColumn("sigma", F.sqrt(F.col("sse") / (F.col("rows") - 2)))
         .withColumn("r2", F.when(F.col("syy") > 0, 1 - F.col("sse") / F.col("syy")).otherwise(0.0)))
    return m.with_thresholds(g, F.col("q"))


def prequential(train: DataFrame) -> DataFrame:
    """Earlier-only points of every candidate and their errors, per row.

    Weights halve every ``HALF_LIFE`` rows of age.  Counting age from the start
    of the series instead of the end of the window scales all weights of a
    window by one factor, which cancels, so running sums serve here too.
    """
    x, y = F.col("x"), F.col("y")
    rows = m.rolling_line(train, WINDOW, PURGE)
    rows = m.rolling_line(rows, SHORT, PURGE, "s_")
    rows = m.rolling_line(rows, WINDOW, PURGE, "w_", WEIGHT)
    known = F.col("rows") >= BASE_MIN
    points = {"p_base": F.col("intercept") + F.col("slope") * x,
              "p_short": F.col("s_intercept") + F.col("s_slope") * x,
              "p_weighted": F.col("w_intercept") + F.col("w_slope") * x}
    rows = rows.withColumns({k: F.when(known, v) for k, v in points.items()})
    return rows.withColumns({k.replace("p_", "e_"): y - F.col(k) for k in points}).drop(
        *[f"{p}_{c}" for p in "sw" for c in ("slope", "intercept", "rows")])


def error_distribution(point: Column, errors: Column) -> dict[str, Column]:
    """P(up), P(down) and an 80% band from earlier out-of-sample errors."""
    n = F.size(errors)
    above = F.size(F.filter(errors, lambda e: e > -point))
    below = F.size(F.filter(errors, lambda e: e < -point))
    return {"p_up": (above + 1) / (n + 2), "p_down": (below + 1) / (n + 2),
            "low": array_quantile(errors, 0.1) + point, "high": array_quantile(errors, 0.9) + point}


def probability_action(point: Column, p_up: Column, p_down: Column, x: Column) -> tuple[Column, Column]:
    """Direction and band from a probability, with the noise floor first."""
    p = F.when(point > 0, p_up).otherwise(p_down)
    flat = (F.abs(x) < m.NOISE_FLOOR) | (point == 0) | (p < m.LEAN_TARGET)
    return (F.when(flat, 0).when(point > 0, 1).otherwise(-1),
            F.when(flat, "FLAT").when(p >= m.TARGET, "FULL").otherwise("LEAN"))


def production_action(x: Column) -> tuple[Column, Column]:
    c = F.col
    full = (x >= c("hike")) | (x <= c("drop_"))
    lean = (x >= c("lean_hike")) | (x <= c("lean_drop"))
    side = (F.when(x >= c("hike"), 1).when(x <= c("drop_"), -1)
            .when(x >= c("lean_hike"), 1).when(x <= c("lean_drop"), -1).otherwise(0))
    return side, F.when(full, "FULL").when(lean, "LEAN").otherwise("FLAT")


def challenger(point: Column, d: dict[str, Column], x: Column) -> Column:
    """A candidate's forecast: its point, what earlier errors say about it, and the action."""
    side, band = probability_action(point, d["p_up"], d["p_down"], x)
    return F.struct(point.alias("point"), *[d[k].alias(k) for k in ("p_up", "p_down", "low", "high")],
                    side.alias("dir"), band.alias("band"))


def forecast_rows(train: DataFrame) -> DataFrame:
    """One row per evaluated pair; ``f`` maps each candidate to its forecast.

    Every candidate sits in the same row, so all are scored on identical dates
    and comparisons against a control need no join.
    """
    rows = prequential(train)
    errors = earlier(ERRORS)
    lists = {f"l_{k}": F.collect_list(f"e_{k}").over(errors) for k in ("base", "short", "weighted")}
    pts = F.collect_list(F.struct("x", "y")).over(earlier(WINDOW))
    rows = rows.withColumns({**lists, "pts": pts}).where(F.col("ord") > EVALUATION_START)
    rows = settle(rows, rs=F.sort_array(F.transform("pts", lambda p: p["y"] - (
        F.col("intercept") + F.col("slope") * p["x"]))),
        **{k: F.sort_array(k.replace("s_", "l_")) for k in ("s_base", "s_short", "s_weighted")}).drop(
        "pts", *lists)
    t, ln = m.TARGET, m.LEAN_TARGET
    rows = settle(rows, q=F.array(*[array_quantile(F.col("rs"), v) for v in (1 - t, t, 1 - ln, ln)]))
    rows = m.with_thresholds(rows, F.col("q"))
    rows = settle(rows, pu=m.probability_up(F.col("rs"), F.col("x")))
    x = F.col("x")

    names = ("base", "short", "weighted")
    rows = settle(rows, **{f"d_{k}": F.struct(*[v.alias(n) for n, v in error_distribution(
        F.col(f"p_{k}"), F.col(f"s_{k}")).items()]) for k in names}).drop(*[f"s_{k}" for k in names], "rs")

    def of(name: str) -> Column:
        return challenger(F.col(f"p_{name}"), {k: F.col(f"d_{name}.{k}") for k in ("p_up", "p_down", "low", "high")}, x)

    side, band = production_action(x)
    production = F.struct(
        F.col("p_base").alias("point"), F.col("pu").alias("p_up"), (1 - F.col("pu")).alias("p_down"),
        F.col("d_base.low").alias("low"), F.col("d_base.high").alias("high"), side.alias("dir"), band.alias("band"))
    rows = settle(rows, production=production, prequential_360=of("base"),
                  short_180=of("short"), weighted_360=of("weighted"))
    return rows.select("series_id", "session", "ord", "x", "y", *CANDIDATES)


def losses(rows: DataFrame, candidates: tuple[str, ...] = CANDIDATES) -> DataFrame:
    """Long form: one row per pair and candidate with losses and gains."""
    y = F.col("y")
    up = (y > 0).cast("double")

    def entry(name: str) -> Column:
        c = lambda f: F.col(f"{name}.{f}")
        err = lambda n: F.abs(F.col(f"{n}.point") - y)
        brier = lambda n: F.pow(F.col(f"{n}.p_up") - up, F.lit(2.0))
        pay = lambda n: F.col(f"{n}.dir") * y
        gains = []
        for tag, control in (("prod", "production"), ("ols", "prequential_360")):
            gains += [(err(control) - err(name)).alias(f"mae_gain_{tag}"),
                      (brier(control) - brier(name)).alias(f"brier_gain_{tag}"),
                      (pay(name) - pay(control)).alias(f"payoff_gain_{tag}")]
        return F.struct(
            F.lit(name).alias("candidate"), err(name).alias("abs_error"), brier(name).alias("brier"),
            c("low").alias("low"), c("high").alias("high"), c("dir").alias("dir"),
            pay(name).alias("pay"), (c("dir") != F.col("production.dir")).alias("changed"), *gains)

    return rows.select("series_id", "session", "y", F.inline(F.array(*[entry(n) for n in candidates])))


def scorecard(long: DataFrame, *keys: str) -> DataFrame:
    """Accuracy, interval and action summary per candidate (and ``keys``)."""
    y, low, high = F.col("y"), F.col("low"), F.col("high")
    active = F.col("dir") != 0
    zero = F.lit(0.0)
    gains = [f"{k}_gain_{t}" for t in ("prod", "ols") for k in ("mae", "brier", "payoff")]
    return long.groupBy("series_id", "candidate", *keys).agg(
        F.count("*").alias("sessions"), F.avg("abs_error").alias("mae"),
        F.sqrt(F.avg(F.col("abs_error") ** 2)).alias("rmse"), F.avg("brier").alias("brier"),
        F.avg(((y >= low) & (y <= high)).cast("int")).alias("coverage"),
        F.avg(high - low).alias("width"),
        F.avg(high - low + 10 * F.greatest(low - y, zero) + 10 * F.greatest(y - high, zero)).alias("interval_score"),
        count_if(active).alias("alerts"),
        ratio(count_if(active & (F.col("pay") > 0)), count_if(active)).alias("precision"),
        count_if(F.col("dir") == -1).alias("wait_alerts"),
        count_if((F.col("dir") == -1) & (y > 0)).alias("wrong_waits"),
        F.min(F.when(active, F.col("pay"))).alias("worst_payoff"),
        F.avg("pay").alias("payoff_per_session"), count_if(F.col("changed")).alias("changed_actions"),
        *[F.avg(g).alias(g) for g in gains])


def causal_features(train: DataFrame) -> DataFrame:
    """Predictors known before the session, one row per pair.

    A value "of the prior session" is taken only if the pair before really ends
    on that session; nothing is shifted across a gap.
    """
    rows = prequential(train)
    prior_error = F.when(F.lag("session").over(by_session()) == F.col("prior_session"),
                         F.lag("e_base").over(by_session()))
    past = by_session().rowsBetween(-20, -1)
    season = 2 * F.pi() * (F.dayofyear("session") - 1) / 365.25
    return (rows.withColumn("prior_error", prior_error).select(
        "series_id", "session", "ord", "x", "y", "p_base", "e_base", F.abs("x").alias("abs_x"),
        ((F.col("prior_response") - F.col("prior_driver")) * 100).alias("prior_basis"),
        F.coalesce("prior_error", F.lit(0.0)).alias("prior_error"),
        F.col("prior_error").isNull().cast("double").alias("prior_error_missing"),
        F.when(F.count("x").over(past) == 20, F.stddev_samp("x").over(past)).alias("prior_20_std"),
        F.sin(season).alias("season_sin"), F.cos(season).alias("season_cos")))
