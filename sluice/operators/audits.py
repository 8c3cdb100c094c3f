"""Historical audits of the percentile-threshold rule.

The rule places a hike threshold at a low percentile of the driver's rises on
days both prices rose, and a drop threshold at a high percentile of its falls
on days both fell.  Audits apply it to plain row-to-row moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.functions.exprs import array_quantile, count_if, draws, ratio, replicates, settle, spread
from sluice.operators import fit as m
from sluice.operators.align import by_session, in_series
from sluice.operators.decide import z_band

# Fixed values of the rule and of the audits.
HIKE_PCT, DROP_PCT, LEGACY_WINDOW = 0.15, 0.85, 120
LEGACY_MIN, LEGACY_MAX, LEGACY_ROWS = 0.3, 3.0, 5
FIXED_HIKE, FIXED_DROP = 1.93, -0.76
GRID_WINDOWS, GRID_HIKE, GRID_DROP = (120, 180, 240), (0.15, 0.20), (0.80, 0.85)
GRID_FOLDS, GRID_TEST = 3, 90

UP = "CASE WHEN x > 0 AND y > 0 THEN x END"
DOWN = "CASE WHEN x < 0 AND y < 0 THEN x END"


def consecutive_moves(panel: DataFrame) -> DataFrame:
    """Row-to-row moves in cents with the row number and count per series."""
    prior = lambda c: F.lag(c).over(by_session())
    return (spread(panel, "series_id")
            .withColumn("x", (F.col("driver") - prior("driver")) * 100)
            .withColumn("y", (F.col("response") - prior("response")) * 100)
            .withColumn("rn", F.row_number().over(by_session()))
            .withColumn("n", F.count("*").over(in_series())))


def clamped(q: Column, count: Column, up: bool) -> Column:
    inside = (F.greatest(F.lit(LEGACY_MIN), F.least(q, F.lit(LEGACY_MAX))) if up
              else F.greatest(F.lit(-LEGACY_MAX), F.least(q, F.lit(-LEGACY_MIN))))
    return F.when(count >= LEGACY_ROWS, inside).otherwise(F.lit(1.0 if up else -1.0))


def rolling_legacy(moves: DataFrame, window: int = LEGACY_WINDOW, hike: float = HIKE_PCT,
                   drop: float = DROP_PCT, prefix: str = "") -> DataFrame:
    """Thresholds from the ``window`` rows before each row, and its signal.

    A slice of ``window`` rows holds ``window - 1`` moves of its own.
    """
    frame = by_session().rowsBetween(-(window - 1), -1)
    up, down = F.expr(UP), F.expr(DOWN)
    h = clamped(F.percentile(up, hike).over(frame), F.count(up).over(frame), True)
    d = clamped(F.percentile(down, drop).over(frame), F.count(down).over(frame), False)
    out = (moves.withColumn(f"{prefix}hike", h).withColumn(f"{prefix}drop_", d)
           .withColumn("sd", F.stddev_samp("x").over(frame)))
    out = out.withColumn(f"{prefix}dir", m.signal(
        F.col("x"), F.col(f"{prefix}hike"), F.col(f"{prefix}drop_")))
    return out


def legacy_scored(panel: DataFrame) -> DataFrame:
    """Rows past the first window with signal, payoff and conviction band."""
    rows = rolling_legacy(consecutive_moves(panel)).where(F.col("rn") > LEGACY_WINDOW)
    z = F.col("x") / F.nullif(F.col("sd"), F.lit(0.0))
    return rows.withColumn("z", z).withColumn("band", z_band(z)).withColumn(
        "pay", F.col("dir") * F.col("y"))


def payoff_asymmetry(rows: DataFrame) -> DataFrame:
    win = F.when(F.col("pay") > 0, F.col("pay"))
    loss = F.when((F.col("dir") != 0) & (F.col("pay") < 0), -F.col("pay"))
    g = rows.groupBy("series_id", F.year("session").alias("y")).agg(
        F.count(win).alias("wins"), F.count(loss).alias("losses"),
        F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"))
    return (g.withColumn("asymmetry", F.col("avg_win") - F.col("avg_loss"))
            .withColumn("win_loss_ratio", F.coalesce(ratio(F.col("avg_win"), F.col("avg_loss")), F.lit(0.0)))
            .withColumn("precision", F.coalesce(ratio(
                F.col("wins"), F.col("wins") + F.col("losses")), F.lit(0.0))))


def losing_streaks(rows: DataFrame) -> DataFrame:
    """Longest run of wrong alerts, overall and within each band.

    Runs are islands: inside a run the difference of two row numbers is
    constant.  Alerts count as rows of their own sequence.
    """
    alerts = rows.where("dir <> 0").select(
        "series_id", "session", (F.col("pay") <= 0).alias("lost"),
        F.explode(F.array(F.lit("all"), F.col("band"))).alias("scope"))
    seq = Window.partitionBy("series_id", "scope").orderBy("session")
    runs = Window.partitionBy("series_id", "scope", "lost").orderBy("session")
    island = F.row_number().over(seq) - F.row_number().over(runs)
    sized = (alerts.withColumn("island", island)
             .groupBy("series_id", "scope", "lost", "island").agg(F.count("*").alias("c")))
    return sized.groupBy("series_id", "scope").agg(
        F.sum("c").alias("alerts"),
        F.max(F.when(F.col("lost"), F.col("c")).otherwise(0)).alias("longest"))


def signal_decay(panel: DataFrame) -> DataFrame:
    """Response level 1, 2 and 3 rows after a buy signal, against the signal row."""
    ahead = {f"m{k}": (F.lead("response", k).over(by_session()) - F.col("response")) * 100
             for k in (1, 2, 3)}
    rows = rolling_legacy(consecutive_moves(panel)).withColumns(ahead)
    rows = rows.where((F.col("rn") > LEGACY_WINDOW) & F.col("m3").isNotNull() & (F.col("dir") == 1))
    return rows.groupBy("series_id").agg(F.count("*").alias("signals"), *[
        F.avg(f"m{k}").alias(f"move_{k}") for k in (1, 2, 3)])


def seasonal_comparison(panel: DataFrame) -> DataFrame:
    """One parameter pair all year against a stricter pair outside April-September."""
    rows = rolling_legacy(consecutive_moves(panel), prefix="u_")
    rows = rolling_legacy(rows, hike=HIKE_PCT + 0.05, drop=DROP_PCT - 0.05, prefix="w_")
    summer = F.month("session").between(4, 9)
    rows = rows.where(F.col("rn") > LEGACY_WINDOW).withColumn(
        "s_dir", F.when(summer, F.col("u_dir")).otherwise(F.col("w_dir")))
    parts = []
    for tag, d in (("unified", "u_dir"), ("seasonal", "s_dir")):
        parts += [count_if(F.col(d) != 0).alias(f"{tag}_alerts"),
                  F.sum(F.col(d) * F.col("y")).alias(f"{tag}_savings")]
    return rows.groupBy("series_id").agg(*parts)


def parameter_sweep(panel: DataFrame, hikes: Sequence[float], drops: Sequence[float]) -> DataFrame:
    """Savings over a grid of percentile pairs, and their spread.

    A buy and a wait never overlap, so savings of a pair are the sum of two
    independent parts: 13 + 13 sums per series serve all 169 pairs, and rows
    are never multiplied by the grid.
    """
    moves = consecutive_moves(panel).where("x IS NOT NULL")
    calm = (F.weekday("session") != 0) & (F.dayofmonth("session") > 5)
    up, down = F.when(calm, F.expr(UP)), F.when(calm, F.expr(DOWN))
    lits = lambda v: F.array(*[F.lit(i) for i in v])
    w = in_series()
    rows = (moves.withColumn("hq", F.percentile(up, lits(hikes)).over(w))
            .withColumn("hn", F.count(up).over(w))
            .withColumn("dq", F.percentile(down, lits(drops)).over(w))
            .withColumn("dn", F.count(down).over(w)))
    sums = rows.groupBy("series_id").agg(
        *[F.sum(F.when(F.col("x") >= clamped(F.col("hq")[i], F.col("hn"), True), F.col("y"))
                .otherwise(0.0)).alias(f"h{i}") for i in range(len(hikes))],
        *[F.sum(F.when(F.col("x") <= clamped(F.col("dq")[i], F.col("dn"), False), -F.col("y"))
                .otherwise(0.0)).alias(f"d{i}") for i in range(len(drops))])
    pairs = (sums.select("series_id",
                         F.explode(F.array(*[f"h{i}" for i in range(len(hikes))])).alias("h"),
                         F.array(*[f"d{i}" for i in range(len(drops))]).alias("ds"))
             .select("series_id", "h", F.explode("ds").alias("d")))
    out = pairs.groupBy("series_id").agg(
        F.count("*").alias("pairs"), F.avg(F.col("h") + F.col("d")).alias("mean_savings"),
        F.stddev_samp(F.col("h") + F.col("d")).alias("sd_savings"),
        F.min(F.col("h") + F.col("d")).alias("min_savings"),
        F.max(F.col("h") + F.col("d")).alias("max_savings"))
    return out.withColumn("variation", F.coalesce(
        ratio(F.col("sd_savings"), F.abs("mean_savings")), F.lit(999.0)))


def roll_share(panel: DataFrame) -> DataFrame:
    """Savings on the first five days of a month against the rest, Mondays out."""
    rows = consecutive_moves(panel).where("x IS NOT NULL AND weekday(session) <> 0")
    d = m.signal(F.col("x"), F.lit(FIXED_HIKE), F.lit(FIXED_DROP))
    early = F.dayofmonth("session") <= 5
    pay = d * F.col("y")
    g = rows.groupBy("series_id").agg(
        count_if(early & (d != 0)).alias("roll_alerts"), count_if(~early & (d != 0)).alias("normal_alerts"),
        F.sum(F.when(early, pay).otherwise(0.0)).alias("roll_savings"),
        F.sum(F.when(~early, pay).otherwise(0.0)).alias("normal_savings"))
    return g.withColumn("roll_pct", F.coalesce(100 * ratio(
        F.col("roll_savings"), F.col("roll_savings") + F.col("normal_savings")), F.lit(0.0)))


def variance_ratio(panel: DataFrame, span: int = 20) -> DataFrame:
    """Residual variance in the volatile half over the calm half."""
    moves = consecutive_moves(panel).where("x IS NOT NULL")
    rows = m.with_fit(moves, ["series_id"])
    recent = by_session().rowsBetween(-(span - 1), 0)
    vol = F.when(F.count("x").over(recent) == span, F.stddev_samp("x").over(recent))
    rows = rows.withColumn("vol0", vol)
    # Rows before the first full span take its value.
    first = F.min_by("vol0", F.when(F.col("vol0").isNotNull(), F.col("session"))).over(in_series())
    rows = rows.withColumn("vol", F.coalesce("vol0", first))
    rows = rows.withColumn("mid", F.percentile("vol", 0.5).over(in_series()))
    high = F.col("vol") >= F.col("mid")
    part = lambda c: F.when(c, F.col("resid"))
    return rows.groupBy("series_id").agg(
        count_if(high).alias("high_n"), count_if(~high).alias("low_n"),
        F.var_pop(part(high)).alias("high_var"), F.var_pop(part(~high)).alias("low_var")
    ).withColumn("f_ratio", F.col("high_var") / F.col("low_var"))


def savings_ratio(panel: DataFrame, holdout: int = 60) -> DataFrame:
    """Mean over population deviation of alert payoffs on the last rows."""
    rows = consecutive_moves(panel).where("x IS NOT NULL")
    test = F.col("n") - F.col("rn") < holdout
    up, down = F.when(~test, F.expr(UP)), F.when(~test, F.expr(DOWN))
    w = in_series()
    rows = (rows.withColumn("hike", clamped(F.percentile(up, HIKE_PCT).over(w), F.count(up).over(w), True))
            .withColumn("drop_", clamped(F.percentile(down, DROP_PCT).over(w), F.count(down).over(w), False))
            .where(test).withColumn("dir", m.signal(F.col("x"), F.col("hike"), F.col("drop_"))))
    pay = F.when(F.col("dir") != 0, F.col("dir") * F.col("y"))
    return rows.groupBy("series_id").agg(
        F.max("hike").alias("hike"), F.max("drop_").alias("drop_"), F.count(pay).alias("alerts"),
        F.avg(pay).alias("mean_savings"), F.stddev_pop(pay).alias("sd_savings")
    ).withColumn("savings_ratio", ratio(F.col("mean_savings"), F.col("sd_savings")))


def confusion(rows: DataFrame, band: float = 0.1) -> DataFrame:
    """Direction counts with a dead band, and the report's own error classes."""
    d, y = F.col("dir"), F.col("y")
    return rows.groupBy("series_id").agg(
        count_if((d == 1) & (y > band)).alias("correct_hikes"),
        count_if((d == 1) & ~(y > band)).alias("false_hikes"),
        count_if((d == -1) & (y < -band)).alias("correct_drops"),
        count_if((d == -1) & ~(y < -band)).alias("false_drops"),
        count_if((d == 0) & (F.abs("y") > band)).alias("missed_moves"),
        count_if((d != 0) & (y == 0)).alias("false_flat"),
        count_if(d * y < 0).alias("false_wrong_dir"),
        count_if((d == 0) & (F.abs("y") > 0)).alias("report_missed"))


def expanding_blocks(panel: DataFrame, first: int = 200, step: int = 30) -> DataFrame:
    """Rows scored in blocks under thresholds of everything before the block.

    Thresholds are needed once per block, so they are taken once per block: a
    series' moves are one array (bounded by its sessions), of which each block
    sorts the part before it.
    """
    rows = consecutive_moves(panel).withColumn("block", F.floor((F.col("rn") - 1 - first) / step).cast("int"))
    arrays = rows.groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct("rn", F.expr(UP).alias("up"), F.expr(DOWN).alias("down")))).alias("a"),
        F.max("block").alias("last")).where("last >= 0")
    blocks = arrays.select("series_id", "a", F.explode(F.sequence(F.lit(0), "last")).alias("block"))

    def past(name: str) -> Column:
        seen = F.slice(F.col("a"), F.lit(1), F.col("block") * step + first)
        return F.sort_array(F.filter(F.transform(seen, lambda r: r[name]), lambda v: v.isNotNull()))

    blocks = settle(blocks, ups=past("up"), downs=past("down"))
    bound = lambda arr, q, up: clamped(F.when(F.size(arr) > 0, array_quantile(F.col(arr), q)), F.size(arr), up)
    limits = blocks.select("series_id", "block", bound("ups", HIKE_PCT, True).alias("hike"),
                           bound("downs", DROP_PCT, False).alias("drop_"))
    return rows.where("block >= 0").join(limits, ["series_id", "block"]).withColumn(
        "dir", m.signal(F.col("x"), F.col("hike"), F.col("drop_")))


def lag_window_search(panel: DataFrame, windows: Sequence[int] = (90, 120, 180, 240, 365),
                      max_lag: int = 2, min_rows: int = 20) -> DataFrame:
    """Level R-squared per (window, lag); window 0 stands for the whole series."""
    rows = (panel.withColumn("back", F.count("*").over(in_series()) - F.row_number().over(by_session()))
            .withColumn("n", F.count("*").over(in_series()))
            .withColumn("win", F.explode(F.array(*[F.lit(w) for w in (*windows, 0)])))
            .where("win = 0 OR (n >= win AND back < win)"))
    w = Window.partitionBy("series_id", "win").orderBy("session")
    lags = {f"l{k}": F.lag("driver", k).over(w) for k in range(max_lag + 1)}
    g = rows.withColumns(lags).groupBy("series_id", "win").agg(F.array(*[
        F.struct(F.lit(k).alias("lag"), F.regr_count("response", f"l{k}").alias("rows"),
                 F.regr_r2("response", f"l{k}").alias("r2")) for k in range(max_lag + 1)]).alias("c"))
    flat = g.select("series_id", "win", F.inline("c")).where(F.col("rows") >= min_rows)
    best = F.max_by(F.struct("lag", "win"), "r2").over(in_series())
    return (flat.withColumn("b", best)
            .withColumn("best", (F.col("b.lag") == F.col("lag")) & (F.col("b.win") == F.col("win")))
            .drop("b"))


def split_slopes(train: DataFrame) -> DataFrame:
    """Pass-through of rises and of falls, fitted apart."""
    up, down = F.when(F.col("x") > 0, F.col("x")), F.when(F.col("x") < 0, F.col("x"))
    return train.groupBy("series_id").agg(
        F.count(up).alias("up_n"), F.regr_slope("y", up).alias("up_slope"),
        F.count(down).alias("down_n"), F.regr_slope("y", down).alias("down_slope"))


def grid_scores(panel: DataFrame, embargo: int = 0) -> DataFrame:
    """Test rows of every fold under every grid point, with their payoff ``r``."""
    rows = consecutive_moves(panel).withColumn("back", F.col("n") - F.col("rn")).where(
        F.col("n") >= GRID_TEST * GRID_FOLDS + max(GRID_WINDOWS) + embargo)
    lits = lambda v: F.array(*[F.lit(i) for i in v])
    start = (F.col("fold") + 1) * GRID_TEST + embargo
    tagged = (rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(GRID_FOLDS - 1))))
              .withColumn("win", F.explode(lits(GRID_WINDOWS)))
              .where((F.col("back") >= start) & (F.col("back") <= start + F.col("win") - 2)))
    up, down = F.expr(UP), F.expr(DOWN)
    th = tagged.groupBy("series_id", "fold", "win").agg(
        F.percentile(up, lits(GRID_HIKE)).alias("hq"), F.count(up).alias("hn"),
        F.percentile(down, lits(GRID_DROP)).alias("dq"), F.count(down).alias("dn"))
    points = F.array(*[F.struct(F.lit(h).alias("hp"), F.lit(d).alias("dp"),
                                clamped(F.col("hq")[i], F.col("hn"), True).alias("hike"),
                                clamped(F.col("dq")[j], F.col("dn"), False).alias("drop_"))
                       for i, h in enumerate(GRID_HIKE) for j, d in enumerate(GRID_DROP)])
    th = th.select("series_id", "fold", "win", F.inline(points))
    test = rows.withColumn("fold", F.floor(F.col("back") / GRID_TEST).cast("int")).where(
        F.col("fold") < GRID_FOLDS)
    return test.join(th, ["series_id", "fold"]).withColumn(
        "r", m.signal(F.col("x"), F.col("hike"), F.col("drop_")) * F.col("y"))


def embargoed_folds(panel: DataFrame, embargo: int = 5) -> DataFrame:
    folds = grid_scores(panel, embargo).groupBy("series_id", "win", "hp", "dp", "fold").agg(
        F.sum("r").alias("s"))
    out = folds.groupBy("series_id", "win", "hp", "dp").agg(
        F.percentile("s", 0.5).alias("median_savings"))
    top = F.max("median_savings").over(in_series())
    return out.withColumn("best", F.col("median_savings") == top)


def reality_check(panel: DataFrame, reps: int = 1000, chunks: int = 16, seed: str = "grid") -> DataFrame:
    """Best mean payoff of the grid against the bootstrap maximum of centred means.

    270 test rows x 12 grid points per series make one bounded matrix.
    """
    rows = grid_scores(panel)
    per_row = rows.groupBy("series_id", "back").agg(F.transform(F.sort_array(F.collect_list(
        F.struct("win", "hp", "dp", "r"))), lambda s: s["r"]).alias("rs"))
    mat = per_row.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(
        F.struct("back", "rs"))), lambda s: s["rs"]).alias("m"))
    k = len(GRID_WINDOWS) * len(GRID_HIKE) * len(GRID_DROP)
    size = F.size("m")
    column_mean = lambda i: F.aggregate("m", F.lit(0.0), lambda a, r: a + r[i]) / size
    mat = settle(mat, mu=F.array(*[column_mean(i) for i in range(k)]))
    mat = settle(mat, best_mean=F.array_max("mu"), m0=F.transform("m", lambda r: F.transform(
        r, lambda v, i: v - F.get("mu", i)))).drop("m")
    work = replicates(mat.withColumn("size", F.size("m0")), reps, chunks)
    work = settle(work, d=draws(F.concat_ws("|", F.lit(seed), "series_id", "rep"),
                                F.col("size"), F.col("size")))
    drawn_mean = lambda i: F.aggregate(
        "d", F.lit(0.0), lambda a, j: a + F.get(F.col("m0"), j)[i]) / F.col("size")
    top = F.array_max(F.array(*[drawn_mean(i) for i in range(k)]))
    null = work.withColumn("top", top).groupBy("series_id").agg(
        count_if(F.col("top") >= F.col("best_mean")).alias("as_extreme"),
        F.count("*").alias("draws"), F.avg("top").alias("null_mean"))
    return mat.select("series_id", "best_mean", F.size("m0").alias("rows")).join(
        null, "series_id").withColumn("p_value", (F.col("as_extreme") + 1) / (F.col("draws") + 1))
