"""Out-of-sample evaluation: folds, rolling origins, calibration, audits.

Origins are ordinals inside a series, so the rows a fit needs follow from
arithmetic: each row names the origins it trains and the one it tests.  A row
is repeated once per origin it serves and shuffled once by (series, origin);
no range join is involved and no group exceeds window + step rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.functions.exprs import array_quantile, count_if, draws, replicates, settle, spread
from sluice.operators import fit as m
from sluice.operators.align import by_session, in_series

# Fixed values of the evaluations.
FOLD_ROWS, FOLDS, PURGE = 45, 6, 1
FIRST_ORIGIN, STEP = 120, 10
HOLDOUT_ROWS, PERMUTATIONS = 60, 5000
CHECK_FLOOR = 1.2


def fold_rows(train: DataFrame, test_rows: int = FOLD_ROWS, folds: int = FOLDS,
              purge: int = PURGE, window: int = m.FIT_WINDOW) -> DataFrame:
    """Rows tagged with (fold, is_train); fold 0 is the newest.

    A series too short for every fold plus a minimum fit is left out.
    """
    needed = folds * test_rows + purge + m.MIN_FIT_ROWS
    rows = train.where(F.col("n") >= needed).withColumn("back", F.col("n") - F.col("ord"))
    first = (F.col("f") + 1) * test_rows
    is_test = (F.col("back") >= first - test_rows) & (F.col("back") < first)
    is_train = (F.col("back") >= first + purge) & (F.col("back") < first + purge + window)
    tagged = (rows.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
              .where(is_test | is_train).withColumn("is_train", is_train)
              .withColumnRenamed("f", "fold"))
    return spread(tagged, "series_id", "fold")


def origin_rows(train: DataFrame, first: int = FIRST_ORIGIN, step: int = STEP,
                window: int = m.FIT_WINDOW) -> DataFrame:
    """Rows tagged with (block, is_train) for origins first, first+step, ...

    With zero-based positions, block k fits positions [first+step*k-window,
    first+step*k) and scores the next ``step`` positions.
    """
    i = F.col("ord") - 1
    last = F.floor((F.col("n") - 1 - first) / step)
    own = F.floor((i - first) / step)
    lo = F.greatest(F.lit(0), own + 1)
    hi = F.least(last, F.floor((i + window - first) / step))
    trains = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    roles = F.concat(
        F.transform(trains, lambda k: F.struct(k.alias("block"), F.lit(True).alias("is_train"))),
        F.when(own >= 0, F.array(F.struct(own.alias("block"), F.lit(False).alias("is_train"))))
        .otherwise(F.array().cast("array<struct<block:bigint,is_train:boolean>>")))
    tagged = (train.where(F.col("n") > first).withColumn("role", F.explode(roles))
              .select("*", "role.block", "role.is_train").drop("role"))
    return spread(tagged, "series_id", "block")


def scored_rows(tagged: DataFrame, key: str, floor: float, target: float = m.TARGET,
                lean: float = m.LEAN_TARGET) -> DataFrame:
    """Test rows with the thresholds of their own fit and the signal ``dir``."""
    keys = ["series_id", key]
    fitted = m.with_fit(tagged, keys, F.col("is_train"))
    q = F.percentile("resid", m.quantile_targets(target, lean)).over(Window.partitionBy(*keys))
    fitted = m.with_thresholds(fitted.withColumn("q", q), F.col("q"), floor)
    return (fitted.where(~F.col("is_train") & F.col("fit_error").isNull())
            .withColumn("dir", m.signal(F.col("x"), F.col("hike"), F.col("drop_"))))


def walk_forward(train: DataFrame, floor: float = m.NOISE_FLOOR) -> DataFrame:
    """Purged folds: thresholds and alert summary of each (series, fold)."""
    rows = scored_rows(fold_rows(train), "fold", floor)
    return rows.groupBy("series_id", "fold").agg(
        F.min("session").alias("test_start"), F.max("session").alias("test_end"),
        F.max("hike").alias("hike"), F.max("drop_").alias("drop_"),
        *m.payoff_aggregates(F.col("dir"), F.col("y")))


def rolling_scores(train: DataFrame, window: int = m.FIT_WINDOW,
                   floor: float = m.NOISE_FLOOR) -> DataFrame:
    return scored_rows(origin_rows(train, window=window), "block", floor)


def quoted_probabilities(train: DataFrame, window: int = 240) -> DataFrame:
    """Test rows of a rolling origin with the quoted P(correct) and the outcome."""
    keys = ["series_id", "block"]
    fitted = m.with_fit(origin_rows(train, window=window), keys, F.col("is_train"))
    # At most ``window`` residuals per block, gathered once and joined to its few
    # test rows; both sides are dealt by the same keys already.
    resid = fitted.where("resid IS NOT NULL").groupBy(*keys).agg(F.collect_list("resid").alias("rs"))
    rows = (fitted.where(~F.col("is_train") & (F.col("rows") >= m.MIN_FIT_ROWS)).join(resid, keys)
            .withColumn("p_up", m.probability_up(F.col("rs"), F.col("x"))))
    right = F.when(F.col("x") >= 0, F.col("y") > 0).otherwise(F.col("y") < 0)
    return (rows.withColumn("quoted", m.probability_correct(F.col("p_up"), F.col("x")))
            .withColumn("hit", right.cast("double")).drop("rs"))


def calibration_summary(q: DataFrame) -> DataFrame:
    """Gap, Brier score, constant-rate Brier and skill per series."""
    base = F.avg("hit").over(in_series())
    return (q.withColumn("base", base).groupBy("series_id").agg(
        F.count("*").alias("n"), F.avg("quoted").alias("quoted"), F.avg("hit").alias("realised"),
        F.avg((F.col("quoted") - F.col("hit")) ** 2).alias("brier"),
        F.avg((F.col("base") - F.col("hit")) ** 2).alias("reference"))
        .withColumn("gap", F.col("realised") - F.col("quoted"))
        .withColumn("skill", F.when(F.col("reference") > 0,
                                    1 - F.col("brier") / F.col("reference")).otherwise(0.0)))


def reliability_bins(q: DataFrame, bins: int = 5, min_rows: int = 5) -> DataFrame:
    """Equal bins of [0.5, 1]; the last bin is closed, thin bins are dropped."""
    b = F.least(F.floor((F.col("quoted") - 0.5) / (0.5 / bins)), F.lit(bins - 1))
    return (q.where("quoted >= 0.5").groupBy("series_id", b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("quoted").alias("quoted"), F.avg("hit").alias("realised"))
        .where(F.col("n") >= min_rows))


def full_fit_scores(train: DataFrame, floor: float = CHECK_FLOOR) -> DataFrame:
    """Every pair scored with thresholds fitted on the whole series (in sample)."""
    fitted = m.with_fit(train, ["series_id"])
    q = F.percentile("resid", m.quantile_targets()).over(in_series())
    return (m.with_thresholds(fitted.withColumn("q", q), F.col("q"), floor)
            .where(F.col("fit_error").isNull())
            .withColumn("dir", m.signal(F.col("x"), F.col("hike"), F.col("drop_"))))


def holdout_permutation(train: DataFrame, reps: int = PERMUTATIONS, chunks: int = 16,
                        seed: str = "holdout") -> DataFrame:
    """Frozen holdout of the last rows against shuffled outcomes.

    Only the 60 holdout rows of a series are permuted: they travel as a bounded
    array, replicates spread over ``chunks`` tasks per series.
    """
    test = F.col("ord") > F.col("n") - HOLDOUT_ROWS
    rows = train.where(F.col("n") >= HOLDOUT_ROWS + m.MIN_FIT_ROWS).withColumn("is_train", ~test)
    rows = rows.withColumn("g", F.lit(0))
    scored = scored_rows(rows, "g", CHECK_FLOOR)
    base = scored.groupBy("series_id").agg(
        F.max("hike").alias("hike"), F.max("drop_").alias("drop_"),
        F.sort_array(F.collect_list(F.struct("ord", "dir", "y"))).alias("t"),
        *m.payoff_aggregates(F.col("dir"), F.col("y")))
    work = replicates(base.select("series_id", "t", "total_savings"), reps, chunks)
    size = F.size("t")
    order = F.transform(F.sort_array(F.transform(
        F.sequence(F.lit(0), size - 1), lambda i: F.struct(
            F.md5(F.concat_ws("|", F.lit(seed), "series_id", "rep", i).cast("binary")).alias("h"),
            i.alias("i")))), lambda s: s["i"])
    work = settle(work, o=order)
    total = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0.0), lambda acc, i: acc + (
        F.get("t", i)["dir"] * F.get(F.col("t"), F.get("o", i))["y"]))
    # Replicates that reproduce the observed order must tie despite rounding.
    null = (work.withColumn("null_total", total).groupBy("series_id").agg(
        count_if(F.col("null_total") >= F.col("total_savings") - 1e-9).alias("as_extreme"),
        F.count("*").alias("permutations"), F.avg("null_total").alias("null_mean")))
    return base.drop("t").join(null, "series_id").withColumn(
        "p_value", (F.col("as_extreme") + 1) / (F.col("permutations") + 1))


def residual_autocorrelation(train: DataFrame) -> DataFrame:
    """Lag-1 correlation and Durbin-Watson ratio of the full-series residuals."""
    rows = m.with_fit(train, ["series_id"]).withColumn("prev", F.lag("resid").over(by_session()))
    return rows.groupBy("series_id").agg(
        F.corr("resid", "prev").alias("lag1"),
        (F.sum((F.col("resid") - F.col("prev")) ** 2) / F.sum(F.col("resid") ** 2)).alias("dw"),
        F.count("*").alias("n"))


def benchmark_signs(scored: DataFrame, reps: int = 2000, chunks: int = 16,
                    seed: str = "coin") -> DataFrame:
    """Value per decision against following the driver's sign on every row."""
    pay, y = F.col("dir") * F.col("y"), F.col("y")
    active = F.col("dir") != 0
    sign_pay = F.when(F.col("x") >= 0, y).otherwise(-y)
    base = scored.groupBy("series_id").agg(
        count_if(active).alias("decisions"), F.sum(F.when(active, pay)).alias("model_total"),
        F.avg(F.when(active, pay)).alias("per_decision"),
        F.avg(F.when(active, (pay > 0).cast("int"))).alias("model_precision"),
        F.count("*").alias("sign_decisions"), F.avg(sign_pay).alias("sign_per_decision"),
        F.avg((sign_pay > 0).cast("int")).alias("sign_precision"),
        F.sort_array(F.collect_list(F.when(active, F.struct("ord", "y")))).alias("a"))
    work = replicates(base.select("series_id", "a", "model_total"), reps, chunks)
    prefix = F.concat_ws("|", F.lit(seed), "series_id", "rep")
    work = settle(work.where(F.size("a") > 0), c=draws(prefix, F.size("a"), F.lit(2)))
    total = F.aggregate(F.arrays_zip("a", "c"), F.lit(0.0), lambda acc, p: acc + F.when(
        p["c"] == 0, p["a"]["y"]).otherwise(-p["a"]["y"]))
    null = (work.withColumn("t", total).groupBy("series_id").agg(
        count_if(F.col("t") >= F.col("model_total")).alias("as_extreme"),
        F.count("*").alias("draws")))
    return base.drop("a").join(null, "series_id").withColumn(
        "p_value", (F.col("as_extreme") + 1) / (F.col("draws") + 1))


def regime_split(scored: DataFrame) -> DataFrame:
    """Alert summary below and above the median absolute driver move."""
    cut = F.percentile(F.abs("x"), 0.5).over(in_series())
    rows = scored.withColumn("cut", cut).withColumn(
        "regime", F.when(F.abs("x") <= F.col("cut"), "calm").otherwise("volatile"))
    return rows.groupBy("series_id", "regime").agg(
        F.max("cut").alias("cut"), *m.payoff_aggregates(F.col("dir"), F.col("y")))


def daily_origin(train: DataFrame, window: int = m.FIT_WINDOW, purge: int = PURGE) -> DataFrame:
    """A fit per row on the ``window`` rows before a purge gap.

    Daily origins share almost all of their rows, so the fit comes from running
    sums and only the residual statistics read the window's points (a bounded
    array of ``window`` entries).
    """
    frame = by_session().rowsBetween(-(window + purge), -(1 + purge))
    x = F.col("x")
    rows = m.rolling_line(train, window, purge).withColumn(
        "pts", F.collect_list(F.struct("x", "y")).over(frame))
    rows = rows.where(F.col("ord") > window + purge)
    resid = F.sort_array(F.transform("pts", lambda p: p["y"] - (
        F.col("intercept") + F.col("slope") * p["x"])))
    rows = settle(rows, rs=resid).drop("pts")
    t, ln = m.TARGET, m.LEAN_TARGET
    q = F.array(*[array_quantile(F.col("rs"), v) for v in (1 - t, t, 1 - ln, ln)])
    rows = settle(rows, q=q, p_up=m.probability_up(F.col("rs"), x)).drop("rs")
    rows = m.with_thresholds(rows, F.col("q"), m.NOISE_FLOOR).drop("q")
    return (rows.withColumn("expected", F.col("intercept") + F.col("slope") * x)
            .withColumn("p_correct", m.probability_correct(F.col("p_up"), x)))


def two_band_signal(x: Column) -> Column:
    """Full thresholds first, then lean ones: direction."""
    c = F.col
    return (F.when(x >= c("hike"), 1).when(x <= c("drop_"), -1)
            .when(x >= c("lean_hike"), 1).when(x <= c("lean_drop"), -1).otherwise(0))
