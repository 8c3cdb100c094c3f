"""Forecast comparison and resampling queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window, functions as F

from sluice.functions.exprs import r6
from sluice.operators import evaluate as ev, forecast as fc, resample as rs
from sluice.plans.base import train_of
from sluice.plans.ctes import TRAIN, mixed_draw, thresholds
from sluice.plans.fit_queries import origin_sql, rounded
from sluice.plans.registry import query, with_ctes
from sluice.session import durable

WFIT = """
lw AS (SELECT *, pow(2.0::DOUBLE, (ord - n)/90.0::DOUBLE) AS w FROM train WHERE ord > n - 360),
ws AS (SELECT series_id, count(*) AS rows, sum(w) AS w, sum(w*x) AS wx, sum(w*y) AS wy, sum(w*x*x) AS wxx, sum(w*x*y) AS wxy,
  var_pop(y)*count(*) AS syy FROM lw GROUP BY 1),
wb AS (SELECT *, (wxy - wx*wy/w)/(wxx - wx*wx/w) AS slope FROM ws),
wf AS (SELECT *, (wy - slope*wx)/w AS intercept FROM wb),
wr AS (SELECT lw.series_id, y - (intercept + slope*x) AS resid, wf.* EXCLUDE (series_id) FROM lw JOIN wf USING (series_id)),
wq AS (SELECT series_id, max(slope) AS slope, max(intercept) AS intercept, max(rows) AS rows, sum(resid^2) AS sse, max(syy) AS syy,
  quantile_cont(resid, [0.25, 0.75]) AS q FROM wr GROUP BY 1)"""


@query("weighted_fit", with_ctes(TRAIN, WFIT, """
SELECT series_id, rows, round(slope, 6) AS slope, round(intercept, 6) + 0.0 AS intercept, round(sqrt(sse/(rows-2)), 6) AS sigma,
  round(1 - sse/syy, 6) AS r2, round(greatest(greatest(0.3, least(8.0, (-q[1] - intercept)/slope)), 0.6), 6) AS hike,
  round(least(greatest(-8.0, least(-0.3, (-q[2] - intercept)/slope)), -0.6), 6) AS drop_ FROM wq"""))
def weighted_fit(spark, sf_dir):
    cols = ("slope", "intercept", "sigma", "r2", "hike", "drop_")
    return rounded(fc.weighted_fit(train_of(spark, sf_dir)), *cols).select("series_id", "rows", *cols)


# Per-row fits by self-join on ordinals, then errors, then candidates.
PREQ = """
pj AS (SELECT a.series_id, a.ord AS o, b.ord AS bo, b.x, b.y, pow(2.0::DOUBLE, (b.ord - a.ord)/90.0::DOUBLE) AS w FROM train a
  JOIN train b ON b.series_id = a.series_id AND b.ord BETWEEN a.ord - 361 AND a.ord - 2),
pf AS (SELECT series_id, o AS ord, count(*) AS rows, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
  regr_slope(y, x) FILTER (WHERE bo >= o - 181) AS b2, regr_intercept(y, x) FILTER (WHERE bo >= o - 181) AS a2,
  (sum(w*x*y) - sum(w*x)*sum(w*y)/sum(w)) / (sum(w*x*x) - sum(w*x)*sum(w*x)/sum(w)) AS b3,
  sum(w) AS w, sum(w*x) AS wx, sum(w*y) AS wy FROM pj GROUP BY 1, 2 HAVING count(*) >= 120),
pq AS (SELECT t.*, pf.slope, pf.intercept, pf.intercept + pf.slope*t.x AS p_base, a2 + b2*t.x AS p_short,
  (wy - b3*wx)/w + b3*t.x AS p_weighted FROM train t LEFT JOIN pf USING (series_id, ord)),
pe AS (SELECT *, y - p_base AS e_base, y - p_short AS e_short, y - p_weighted AS e_weighted FROM pq)"""


@query("causal_features", with_ctes(TRAIN, PREQ, """
f AS (SELECT p.*, (prior_response - prior_driver)*100 AS basis, (SELECT e_base FROM pe q WHERE q.series_id = p.series_id AND q.session = p.prior_session) AS pe0,
  CASE WHEN count(x) OVER w = 20 THEN stddev_samp(x) OVER w END AS sd, 2*pi()*(dayofyear(session) - 1)/365.25 AS season
  FROM pe p WINDOW w AS (PARTITION BY series_id ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""", """
SELECT series_id, session, round(abs(x), 6) AS abs_x, round(basis, 5) AS prior_basis, round(coalesce(pe0, 0), 6) + 0.0 AS prior_error,
  (pe0 IS NULL)::INT::DOUBLE AS prior_error_missing, round(sd, 6) AS prior_20_std, round(sin(season), 6) + 0.0 AS season_sin, round(cos(season), 6) + 0.0 AS season_cos FROM f"""))
def causal_features(spark, sf_dir):
    f = fc.causal_features(train_of(spark, sf_dir))
    f = rounded(f, "abs_x", "prior_error", "prior_20_std", "season_sin", "season_cos")
    return f.withColumn("prior_basis", F.round("prior_basis", 5)).select(
        "series_id", "session", "abs_x", "prior_basis", "prior_error", "prior_error_missing",
        "prior_20_std", "season_sin", "season_cos")


def adapter_sql(tag: str) -> str:
    """Error distribution of one candidate by self-join: p_up, p_down, low, high."""
    return f"""
ed_{tag} AS (SELECT a.series_id, a.ord, count(*) FILTER (WHERE b.e_{tag} > -a.p_{tag}) AS up, count(*) FILTER (WHERE b.e_{tag} < -a.p_{tag}) AS dn,
  count(b.e_{tag}) AS k, quantile_cont(b.e_{tag}, [0.1, 0.9]) AS q FROM pe a JOIN pe b ON b.series_id = a.series_id AND b.ord BETWEEN a.ord - 121 AND a.ord - 2
  WHERE a.ord > 361 GROUP BY 1, 2),
ea_{tag} AS (SELECT p.series_id, p.session, p.ord, p.x, p.y, p.p_{tag} AS point, (up+1)/(k+2) AS p_up, (dn+1)/(k+2) AS p_down, q[1] + p.p_{tag} AS low, q[2] + p.p_{tag} AS high
  FROM ed_{tag} e JOIN pe p USING (series_id, ord)),
ec_{tag} AS (SELECT *, CASE WHEN point > 0 THEN p_up ELSE p_down END AS pr FROM ea_{tag}),
eo_{tag} AS (SELECT series_id, session, ord, x, y, point, p_up, p_down, low, high,
  CASE WHEN abs(x) < 0.6 OR point = 0 OR pr < 0.65 THEN 0 WHEN point > 0 THEN 1 ELSE -1 END AS dir,
  CASE WHEN abs(x) < 0.6 OR point = 0 OR pr < 0.65 THEN 'FLAT' WHEN pr >= 0.75 THEN 'FULL' ELSE 'LEAN' END AS band FROM ec_{tag})"""


PROD = """
dtr AS (SELECT a.ord AS start, b.series_id, b.x, b.y FROM train a JOIN train b ON b.series_id = a.series_id
  AND b.ord BETWEEN a.ord - 361 AND a.ord - 2 WHERE a.ord > 361),""" + thresholds("d", "dtr", "series_id, start") + """,
dk AS (SELECT t.series_id, t.ord, count(*) FILTER (WHERE r.resid <= -(r.intercept + r.slope*t.x)) AS k FROM train t
  JOIN d_r r ON r.series_id = t.series_id AND r.start = t.ord GROUP BY 1, 2),
eo_prod AS (SELECT e.series_id, e.session, e.ord, e.x, e.y, e.point, 1 - greatest(1/362, least(361/362, k/360)) AS p_up,
  greatest(1/362, least(361/362, k/360)) AS p_down, low, high,
  CASE WHEN x >= hike THEN 1 WHEN x <= drop_ THEN -1 WHEN x >= lean_hike THEN 1 WHEN x <= lean_drop THEN -1 ELSE 0 END AS dir,
  CASE WHEN x >= hike OR x <= drop_ THEN 'FULL' WHEN x >= lean_hike OR x <= lean_drop THEN 'LEAN' ELSE 'FLAT' END AS band
  FROM eo_base e JOIN d ON d.series_id = e.series_id AND d.start = e.ord JOIN dk ON dk.series_id = e.series_id AND dk.ord = e.ord)"""


@query("prequential_dist", with_ctes(TRAIN, PREQ, adapter_sql("base"), """
SELECT series_id, session, round(point, 6) + 0.0 AS point, round(p_up, 6) AS p_up, round(p_down, 6) AS p_down, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high FROM eo_base"""))
def prequential_dist(spark, sf_dir):
    c = ("point", "p_up", "p_down", "low", "high")
    rows = fc.forecast_rows(train_of(spark, sf_dir))
    return rows.select("series_id", "session", *[r6(f"prequential_360.{k}").alias(k) for k in c])


@query("policy_actions", with_ctes(TRAIN, PREQ, adapter_sql("base"), PROD, """
SELECT b.series_id, b.session, p.dir AS production_dir, p.band AS production_band, b.dir AS probability_dir, b.band AS probability_band
FROM eo_base b JOIN eo_prod p USING (series_id, ord)"""))
def policy_actions(spark, sf_dir):
    rows = fc.forecast_rows(train_of(spark, sf_dir))
    return rows.select("series_id", "session", F.col("production.dir").alias("production_dir"),
                       F.col("production.band").alias("production_band"),
                       F.col("prequential_360.dir").alias("probability_dir"),
                       F.col("prequential_360.band").alias("probability_band"))


ALL_C = PREQ + "," + ",".join(adapter_sql(t) for t in ("base", "short", "weighted")) + "," + PROD + """,
un AS (SELECT 'production' AS candidate, * FROM eo_prod UNION ALL SELECT 'prequential_360', * FROM eo_base
  UNION ALL SELECT 'short_180', * FROM eo_short UNION ALL SELECT 'weighted_360', * FROM eo_weighted),
ls AS (SELECT candidate, u.series_id, u.session, u.y, u.low, u.high, u.dir, u.dir*u.y AS pay, abs(u.point - u.y) AS ae, (u.p_up - (u.y > 0)::INT)^2 AS br,
  abs(p.point - p.y) AS ae_p, (p.p_up - (p.y > 0)::INT)^2 AS br_p, p.dir*p.y AS pay_p, p.dir AS dir_p,
  abs(b.point - b.y) AS ae_o, (b.p_up - (b.y > 0)::INT)^2 AS br_o, b.dir*b.y AS pay_o
  FROM un u JOIN eo_prod p ON p.series_id = u.series_id AND p.ord = u.ord JOIN eo_base b ON b.series_id = u.series_id AND b.ord = u.ord)"""

SCORE = """count(*) AS sessions, round(avg(ae), 6) AS mae, round(sqrt(avg(ae^2)), 6) AS rmse, round(avg(br), 6) AS brier,
  round(avg((y >= low AND y <= high)::INT), 6) AS coverage, round(avg(high - low), 6) AS width,
  round(avg(high - low + 10*greatest(low - y, 0) + 10*greatest(y - high, 0)), 6) AS interval_score, count(*) FILTER (WHERE dir <> 0) AS alerts,
  round(count(*) FILTER (WHERE pay > 0)/nullif(count(*) FILTER (WHERE dir <> 0), 0), 6) AS precision, count(*) FILTER (WHERE dir = -1) AS wait_alerts,
  count(*) FILTER (WHERE dir = -1 AND y > 0) AS wrong_waits, min(pay) FILTER (WHERE dir <> 0) AS worst_payoff, round(avg(pay), 6) AS payoff_per_session,
  count(*) FILTER (WHERE dir <> dir_p) AS changed_actions, round(avg(ae_p - ae), 6) + 0.0 AS mae_gain_prod, round(avg(br_p - br), 6) + 0.0 AS brier_gain_prod,
  round(avg(pay - pay_p), 6) + 0.0 AS payoff_gain_prod, round(avg(ae_o - ae), 6) + 0.0 AS mae_gain_ols, round(avg(br_o - br), 6) + 0.0 AS brier_gain_ols,
  round(avg(pay - pay_o), 6) + 0.0 AS payoff_gain_ols"""
SCORE_ROUND = ("mae", "rmse", "brier", "coverage", "width", "interval_score", "precision", "payoff_per_session",
               "mae_gain_prod", "brier_gain_prod", "payoff_gain_prod", "mae_gain_ols", "brier_gain_ols", "payoff_gain_ols")


@query("scorecard", with_ctes(TRAIN, ALL_C, f"SELECT series_id, candidate, {SCORE} FROM ls GROUP BY 1, 2"))
def scorecard(spark, sf_dir):
    return rounded(fc.scorecard(fc.losses(fc.forecast_rows(train_of(spark, sf_dir)))), *SCORE_ROUND)


@query("subperiods", with_ctes(TRAIN, ALL_C, """
rk AS (SELECT *, dense_rank() OVER (PARTITION BY series_id ORDER BY session DESC) AS dr FROM ls),
sl AS (SELECT *, unnest(CASE WHEN dr <= 90 THEN ['all', 'recent_90'] ELSE ['all', 'earlier'] END) AS period FROM rk)""",
    f"SELECT series_id, candidate, period, {SCORE} FROM sl GROUP BY 1, 2, 3"))
def subperiods(spark, sf_dir):
    long = fc.losses(fc.forecast_rows(train_of(spark, sf_dir)))
    age = F.dense_rank().over(Window.partitionBy("series_id").orderBy(F.col("session").desc()))
    period = F.when(F.col("age") <= 90, "recent_90").otherwise("earlier")
    long = long.withColumn("age", age).withColumn("period", F.explode(F.array(F.lit("all"), period)))
    return rounded(fc.scorecard(long, "period"), *SCORE_ROUND)


GAIN_COLUMNS = ["prequential_360", "short_180", "weighted_360"]


def gain_matrix(spark, sf_dir):
    """Absolute-error gain over production, one column per challenger."""
    rows = fc.forecast_rows(train_of(spark, sf_dir))
    err = lambda n: F.abs(F.col(f"{n}.point") - F.col("y"))
    return durable(rows.select("series_id", "session", *[
        (err("production") - err(c)).alias(c) for c in GAIN_COLUMNS]))


GAINS = ALL_C + """,
gw AS (SELECT series_id, session, candidate, ae_p - ae AS g, row_number() OVER (PARTITION BY series_id, candidate ORDER BY session) - 1 AS i,
  count(*) OVER (PARTITION BY series_id, candidate) AS n FROM ls WHERE candidate <> 'production'),
gm AS (SELECT series_id, candidate, avg(g) AS mean_gain, max(n) AS n FROM gw GROUP BY 1, 2),
gc AS (SELECT series_id, candidate, i + 1 AS pos, sum(g) OVER (PARTITION BY series_id, candidate ORDER BY i) AS c FROM gw
  UNION ALL SELECT series_id, candidate, 0, 0 FROM gm)"""


def block_sql(name: str, block: int, reps: int, seed: str) -> str:
    """Resampled means by block starts: CTE {name}_d(series_id, candidate, rep, m)."""
    return f"""
{name}_s AS (SELECT series_id, n, rep, j, {mixed_draw(f"'{seed}|{block}|' || series_id || '|' || rep", 'j', f'n - {block} + 1')} AS st
  FROM (SELECT DISTINCT series_id, n FROM gm), range(1, {reps} + 1) r(rep), range(2000) b(j) WHERE j < ceil(n/{block})),
{name}_e AS (SELECT *, st + least({block}, n - j*{block}) AS en FROM {name}_s),
{name}_d AS (SELECT e.series_id, b.candidate, e.rep, sum(b.c - a.c)/max(e.n) AS m FROM {name}_e e JOIN gc a ON a.series_id = e.series_id AND a.pos = e.st
  JOIN gc b ON b.series_id = e.series_id AND b.pos = e.en AND b.candidate = a.candidate GROUP BY 1, 2, 3)"""


@query("paired_blocks", with_ctes(TRAIN, GAINS, block_sql("pb", 10, 2000, "paired"), """
SELECT series_id, candidate, round(max(mean_gain), 6) + 0.0 AS mean_gain, round(quantile_cont(m, 0.025), 6) + 0.0 AS low, round(quantile_cont(m, 0.975), 6) + 0.0 AS high
FROM pb_d JOIN gm USING (series_id, candidate) GROUP BY 1, 2"""))
def paired_blocks(spark, sf_dir):
    g = gain_matrix(spark, sf_dir)
    ci = rs.block_intervals(g, "session", GAIN_COLUMNS, 10, 2000, "paired")
    return rounded(ci.withColumnRenamed("column", "candidate").join(
        column_means(g), ["series_id", "candidate"]), "mean_gain", "low", "high")


def column_means(g):
    wide = g.groupBy("series_id").agg(*[F.avg(c).alias(c) for c in GAIN_COLUMNS])
    return wide.select("series_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("candidate"), F.col(c).alias("mean_gain")) for c in GAIN_COLUMNS])))


FAMILY_REPS = 20000
FAMILY_CONFIDENCE = 1 - 0.05 / 6
_A = (1 - FAMILY_CONFIDENCE) / 2


def _family_sql(block: int) -> str:
    return f"""SELECT series_id, candidate, {block} AS block, quantile_cont(m, {_A!r}) AS low,
  quantile_cont(m, {1 - _A!r}) AS high FROM f{block}_d GROUP BY 1, 2"""


@query("family_inference", with_ctes(TRAIN, GAINS, *[block_sql(f"f{b}", b, FAMILY_REPS, "family") for b in (5, 10, 20)], """
fa AS (""" + " UNION ALL ".join(_family_sql(b) for b in (5, 10, 20)) + ")", """
SELECT series_id, candidate, block::INT AS block, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high,
  bool_and(low > 0) OVER (PARTITION BY series_id, candidate) AS positive_at_all_lengths FROM fa"""))
def family_inference(spark, sf_dir):
    """Bonferroni-corrected intervals at three block lengths."""
    g = gain_matrix(spark, sf_dir)
    parts = [rs.block_intervals(g, "session", GAIN_COLUMNS, b, FAMILY_REPS, "family",
                                FAMILY_CONFIDENCE).withColumn("block", F.lit(b)) for b in (5, 10, 20)]
    out = reduce(lambda a, b: a.unionByName(b), parts).withColumnRenamed("column", "candidate")
    whole = Window.partitionBy("series_id", "candidate")
    out = out.withColumn("positive_at_all_lengths", F.bool_and(F.col("low") > 0).over(whole))
    return rounded(out, "low", "high")


@query("payoff_bootstrap", with_ctes(TRAIN, origin_sql(360), f"""
a AS (SELECT series_id, dir*y AS v, row_number() OVER (PARTITION BY series_id ORDER BY dir*y) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n
  FROM o_s WHERE dir <> 0),
sz AS (SELECT DISTINCT series_id, n FROM a),
dd AS (SELECT series_id, n, rep, {mixed_draw("'payoff|' || series_id || '|' || rep", 'k', 'n')} AS i FROM sz, range(1, 4001) r(rep), range(20000) s(k) WHERE k < n),
mm AS (SELECT d.series_id, rep, sum(v)/max(d.n) AS m FROM dd d JOIN a ON a.series_id = d.series_id AND a.i = d.i GROUP BY 1, 2),
st AS (SELECT series_id, count(*) AS alerts, avg(v) AS mean_savings, avg(v) FILTER (WHERE v > 0) AS avg_win, -avg(v) FILTER (WHERE v < 0) AS avg_loss FROM a GROUP BY 1)""", """
SELECT series_id, max(alerts) AS alerts, round(max(mean_savings), 6) AS mean_savings, round(max(avg_win), 6) AS avg_win, round(max(avg_loss), 6) AS avg_loss,
  round(quantile_cont(m, 0.025), 6) AS mean_low, round(quantile_cont(m, 0.975), 6) AS mean_high FROM mm JOIN st USING (series_id) GROUP BY 1"""))
def payoff_bootstrap(spark, sf_dir):
    scored = ev.rolling_scores(train_of(spark, sf_dir)).where("dir <> 0")
    pays = durable(scored.select("series_id", (F.col("dir") * F.col("y")).alias("v")))
    v = F.col("v")
    stats = pays.groupBy("series_id").agg(
        F.count("*").alias("alerts"), F.avg(v).alias("mean_savings"),
        F.avg(F.when(v > 0, v)).alias("avg_win"), (-F.avg(F.when(v < 0, v))).alias("avg_loss"))
    return rounded(stats.join(rs.iid_mean_interval(pays, 4000, "payoff"), "series_id"),
                   "mean_savings", "avg_win", "avg_loss", "mean_low", "mean_high")
