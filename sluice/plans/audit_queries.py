"""Audits of the percentile rule over the proxy panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.distributions import f_upper
from sluice.functions.exprs import r6
from sluice.operators import audits as au, fit as m
from sluice.plans.base import train_of
from sluice.plans.ctes import PANEL, TRAIN, f_density, fit, mixed_draw, payoff, simpson
from sluice.plans.fit_queries import PAY, rounded
from sluice.plans.registry import query, with_ctes
from sluice.sources.panel import daily_panel, weekdays

MOVES = PANEL + """,
mv AS (SELECT series_id, session, driver, response, (driver - lag(driver) OVER w)*100 AS x,
  (response - lag(response) OVER w)*100 AS y, row_number() OVER w AS rn, count(*) OVER (PARTITION BY series_id) AS n
  FROM wk WINDOW w AS (PARTITION BY series_id ORDER BY session))"""


def legacy_sql(hp: float = 0.15, dp: float = 0.85, name: str = "lg") -> str:
    return f"""
{name}0 AS (SELECT *, quantile_cont(CASE WHEN x>0 AND y>0 THEN x END, {hp}) OVER f AS hq, count(CASE WHEN x>0 AND y>0 THEN x END) OVER f AS hn,
  quantile_cont(CASE WHEN x<0 AND y<0 THEN x END, {dp}) OVER f AS dq, count(CASE WHEN x<0 AND y<0 THEN x END) OVER f AS dn,
  stddev_samp(x) OVER f AS sd FROM mv WINDOW f AS (PARTITION BY series_id ORDER BY session ROWS BETWEEN 119 PRECEDING AND 1 PRECEDING)),
{name}1 AS (SELECT *, CASE WHEN hn >= 5 THEN greatest(0.3, least(hq, 3.0)) ELSE 1.0 END AS hike,
  CASE WHEN dn >= 5 THEN greatest(-3.0, least(dq, -0.3)) ELSE -1.0 END AS drop_ FROM {name}0 WHERE rn > 120),
{name}2 AS (SELECT *, CASE WHEN x >= hike THEN 1 WHEN x <= drop_ THEN -1 ELSE 0 END AS dir, x / nullif(sd, 0) AS z FROM {name}1),
{name} AS (SELECT *, dir*y AS pay, CASE WHEN abs(z) >= 1.5 THEN 'High' WHEN abs(z) >= 1.0 THEN 'Moderate' ELSE 'Low' END AS band FROM {name}2)"""


LEG = legacy_sql()


def weekday_panel(spark, sf_dir):
    return weekdays(daily_panel(spark, sf_dir))


def scored(spark, sf_dir):
    return au.legacy_scored(weekday_panel(spark, sf_dir))


def pay_columns():
    return m.payoff_aggregates(F.col("dir"), F.col("y"))


@query("legacy_thresholds", with_ctes(MOVES, LEG, """
SELECT series_id, session, round(hike, 6) AS hike, round(drop_, 6) AS drop_, dir FROM lg"""))
def legacy_thresholds(spark, sf_dir):
    return rounded(scored(spark, sf_dir), "hike", "drop_").select(
        "series_id", "session", "hike", "drop_", "dir")


@query("yearly_holdout", with_ctes(MOVES, LEG, f"""
SELECT series_id, year(session)::INT AS y, {payoff('dir', 'lg.y')} FROM lg GROUP BY 1, 2"""))
def yearly_holdout(spark, sf_dir):
    return rounded(scored(spark, sf_dir).withColumn("yr", F.year("session")).groupBy(
        "series_id", "yr").agg(*pay_columns()).withColumnRenamed("yr", "y"), *PAY)


@query("payoff_asymmetry", with_ctes(MOVES, LEG, """
g AS (SELECT series_id, year(session)::INT AS yr, count(*) FILTER (WHERE pay > 0) AS wins, count(*) FILTER (WHERE dir <> 0 AND pay < 0) AS losses,
  coalesce(avg(pay) FILTER (WHERE pay > 0), 0) AS avg_win, coalesce(avg(-pay) FILTER (WHERE dir <> 0 AND pay < 0), 0) AS avg_loss FROM lg GROUP BY 1, 2)""", """
SELECT series_id, yr AS y, wins, losses, round(avg_win, 6) AS avg_win, round(avg_loss, 6) AS avg_loss,
  round(avg_win - avg_loss, 6) + 0.0 AS asymmetry, round(coalesce(avg_win / nullif(avg_loss, 0), 0), 6) AS win_loss_ratio,
  round(coalesce(wins / nullif(wins + losses, 0), 0), 6) AS precision FROM g"""))
def payoff_asymmetry(spark, sf_dir):
    return rounded(au.payoff_asymmetry(scored(spark, sf_dir)), "avg_win", "avg_loss",
                   "asymmetry", "win_loss_ratio", "precision")


@query("band_performance", with_ctes(MOVES, LEG, f"SELECT series_id, band, {payoff()} FROM lg WHERE dir <> 0 GROUP BY 1, 2"))
def band_performance(spark, sf_dir):
    return rounded(scored(spark, sf_dir).where("dir <> 0").groupBy("series_id", "band").agg(
        *pay_columns()), *PAY)


@query("band_year_rollup", with_ctes(MOVES, LEG, f"""
SELECT year(session)::INT AS yr, band, {payoff()} FROM lg WHERE dir <> 0 GROUP BY ROLLUP (year(session)::INT, band)"""))
def band_year_rollup(spark, sf_dir):
    return rounded(scored(spark, sf_dir).where("dir <> 0").withColumn("yr", F.year("session")).rollup(
        "yr", "band").agg(*pay_columns()), *PAY)


@query("losing_streak", with_ctes(MOVES, LEG, """
a AS (SELECT series_id, session, pay <= 0 AS lost, unnest(['all', band]) AS scope FROM lg WHERE dir <> 0),
i AS (SELECT *, sum((NOT lost)::INT) OVER (PARTITION BY series_id, scope ORDER BY session) AS g FROM a),
r AS (SELECT series_id, scope, g, count(*) FILTER (WHERE lost) AS c, count(*) AS k FROM i GROUP BY 1, 2, 3)""", """
SELECT series_id, scope, sum(k)::BIGINT AS alerts, max(c) AS longest FROM r GROUP BY 1, 2"""))
def losing_streak(spark, sf_dir):
    return au.losing_streaks(scored(spark, sf_dir))


@query("signal_decay", with_ctes(MOVES, LEG, """
l AS (SELECT series_id, session, (lead(response, 1) OVER w - response)*100 AS m1, (lead(response, 2) OVER w - response)*100 AS m2,
  (lead(response, 3) OVER w - response)*100 AS m3 FROM mv WINDOW w AS (PARTITION BY series_id ORDER BY session))""", """
SELECT series_id, count(*) AS signals, round(avg(m1), 6) + 0.0 AS move_1, round(avg(m2), 6) + 0.0 AS move_2, round(avg(m3), 6) + 0.0 AS move_3
FROM lg JOIN l USING (series_id, session) WHERE dir = 1 AND m3 IS NOT NULL GROUP BY 1"""))
def signal_decay(spark, sf_dir):
    return rounded(au.signal_decay(weekday_panel(spark, sf_dir)), "move_1", "move_2", "move_3")


@query("weekday_perf", with_ctes(MOVES, LEG, f"""
SELECT series_id, isodow(session)::INT - 1 AS weekday, {payoff()} FROM lg WHERE dir <> 0 GROUP BY 1, 2"""))
def weekday_perf(spark, sf_dir):
    return rounded(scored(spark, sf_dir).where("dir <> 0").groupBy(
        "series_id", F.weekday("session").alias("weekday")).agg(*pay_columns()), *PAY)


@query("seasonal_thresholds", with_ctes(MOVES, LEG, legacy_sql(0.20, 0.80, "wn"), """
j AS (SELECT lg.series_id, lg.y, lg.dir AS u, CASE WHEN month(lg.session) BETWEEN 4 AND 9 THEN lg.dir ELSE wn.dir END AS s
  FROM lg JOIN wn USING (series_id, session))""", """
SELECT series_id, count(*) FILTER (WHERE u <> 0) AS unified_alerts, round(sum(u*y), 6) + 0.0 AS unified_savings,
  count(*) FILTER (WHERE s <> 0) AS seasonal_alerts, round(sum(s*y), 6) + 0.0 AS seasonal_savings FROM j GROUP BY 1"""))
def seasonal_thresholds(spark, sf_dir):
    return rounded(au.seasonal_comparison(weekday_panel(spark, sf_dir)),
                   "unified_savings", "seasonal_savings")


HIKES = [round(0.05 + 0.02 * i, 2) for i in range(13)]
DROPS = [round(0.70 + 0.02 * i, 2) for i in range(13)]


@query("param_sweep", with_ctes(MOVES, f"""
tq AS (SELECT series_id, quantile_cont(x, {HIKES}) FILTER (WHERE x > 0 AND y > 0) AS hq, count(*) FILTER (WHERE x > 0 AND y > 0) AS hn,
  quantile_cont(x, {DROPS}) FILTER (WHERE x < 0 AND y < 0) AS dq, count(*) FILTER (WHERE x < 0 AND y < 0) AS dn
  FROM mv WHERE x IS NOT NULL AND isodow(session) <> 1 AND day(session) > 5 GROUP BY 1),
tg AS (SELECT series_id, h, d, CASE WHEN hn >= 5 THEN greatest(0.3, least(hq[h], 3.0)) ELSE 1.0 END AS hike,
  CASE WHEN dn >= 5 THEN greatest(-3.0, least(dq[d], -0.3)) ELSE -1.0 END AS drop_ FROM tq, range(1, 14) a(h), range(1, 14) b(d)),
ts AS (SELECT tg.series_id, h, d, sum(CASE WHEN x >= hike THEN y WHEN x <= drop_ THEN -y ELSE 0 END) AS s
  FROM tg JOIN mv ON mv.series_id = tg.series_id AND x IS NOT NULL GROUP BY 1, 2, 3)""", """
SELECT series_id, count(*) AS pairs, round(avg(s), 6) AS mean_savings, round(stddev_samp(s), 6) AS sd_savings, round(min(s), 6) AS min_savings,
  round(max(s), 6) AS max_savings, round(coalesce(stddev_samp(s)/nullif(abs(avg(s)), 0), 999), 6) AS variation FROM ts GROUP BY 1"""))
def param_sweep(spark, sf_dir):
    return rounded(au.parameter_sweep(weekday_panel(spark, sf_dir), HIKES, DROPS),
                   "mean_savings", "sd_savings", "min_savings", "max_savings", "variation")


@query("roll_share", with_ctes(MOVES, """
d AS (SELECT series_id, y, day(session) <= 5 AS early, CASE WHEN x >= 1.93 THEN 1 WHEN x <= -0.76 THEN -1 ELSE 0 END AS dir
  FROM mv WHERE x IS NOT NULL AND isodow(session) <> 1),
g AS (SELECT series_id, count(*) FILTER (WHERE early AND dir <> 0) AS roll_alerts, count(*) FILTER (WHERE NOT early AND dir <> 0) AS normal_alerts,
  sum(CASE WHEN early THEN dir*y ELSE 0 END) AS rs, sum(CASE WHEN early THEN 0 ELSE dir*y END) AS ns FROM d GROUP BY 1)""", """
SELECT series_id, roll_alerts, normal_alerts, round(rs, 6) + 0.0 AS roll_savings, round(ns, 6) + 0.0 AS normal_savings,
  round(coalesce(100*rs/nullif(rs+ns, 0), 0), 6) + 0.0 AS roll_pct FROM g"""))
def roll_share(spark, sf_dir):
    return rounded(au.roll_share(weekday_panel(spark, sf_dir)),
                   "roll_savings", "normal_savings", "roll_pct")


VARIANCES = ("m2 AS (SELECT * FROM mv WHERE x IS NOT NULL)", fit("vf", "m2", "series_id"), """
v0 AS (SELECT series_id, session, resid, CASE WHEN count(x) OVER f = 20 THEN stddev_samp(x) OVER f END AS v FROM vf_r
  WINDOW f AS (PARTITION BY series_id ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
v1 AS (SELECT *, coalesce(v, first_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY session ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS vol FROM v0),
v2 AS (SELECT *, vol >= quantile_cont(vol, 0.5) OVER (PARTITION BY series_id) AS high FROM v1)""")


@query("variance_ratio", with_ctes(MOVES, *VARIANCES, """
SELECT series_id, count(*) FILTER (WHERE high) AS high_n, count(*) FILTER (WHERE NOT high) AS low_n,
  round(var_pop(resid) FILTER (WHERE high), 6) AS high_var, round(var_pop(resid) FILTER (WHERE NOT high), 6) AS low_var,
  round(var_pop(resid) FILTER (WHERE high) / var_pop(resid) FILTER (WHERE NOT high), 6) AS f_ratio FROM v2 GROUP BY 1"""))
def variance_ratio(spark, sf_dir):
    return rounded(au.variance_ratio(weekday_panel(spark, sf_dir)), "high_var", "low_var", "f_ratio")


@query("variance_p_value", with_ctes(MOVES, *VARIANCES, """
v3 AS (SELECT series_id, (count(*) FILTER (WHERE high) - 1)::DOUBLE AS d1, (count(*) FILTER (WHERE NOT high) - 1)::DOUBLE AS d2,
  var_pop(resid) FILTER (WHERE high) / var_pop(resid) FILTER (WHERE NOT high) AS f FROM v2 GROUP BY 1)""", f"""
SELECT series_id, round(greatest(0, 1 - {simpson(f_density('d1', 'd2'), 'f')}), 6) AS p_value FROM v3, range(2001) r(i) GROUP BY 1"""))
def variance_p_value(spark, sf_dir):
    """Upper-tail p of the variance ratio; the SQL integrates the density."""
    v = au.variance_ratio(weekday_panel(spark, sf_dir))
    return v.select("series_id", r6(f_upper(
        F.col("f_ratio"), F.col("high_n") - 1, F.col("low_n") - 1)).alias("p_value"))


@query("savings_ratio", with_ctes(MOVES, """
q AS (SELECT series_id, quantile_cont(x, 0.15) FILTER (WHERE x > 0 AND y > 0) AS hq, count(*) FILTER (WHERE x > 0 AND y > 0) AS hn,
  quantile_cont(x, 0.85) FILTER (WHERE x < 0 AND y < 0) AS dq, count(*) FILTER (WHERE x < 0 AND y < 0) AS dn FROM mv WHERE n - rn >= 60 GROUP BY 1),
t AS (SELECT series_id, CASE WHEN hn >= 5 THEN greatest(0.3, least(hq, 3.0)) ELSE 1.0 END AS hike,
  CASE WHEN dn >= 5 THEN greatest(-3.0, least(dq, -0.3)) ELSE -1.0 END AS drop_ FROM q),
s AS (SELECT series_id, hike, drop_, CASE WHEN x >= hike THEN y WHEN x <= drop_ THEN -y END AS pay FROM mv JOIN t USING (series_id) WHERE n - rn < 60)""", """
SELECT series_id, round(max(hike), 6) AS hike, round(max(drop_), 6) AS drop_, count(pay) AS alerts, round(avg(pay), 6) AS mean_savings,
  round(stddev_pop(pay), 6) AS sd_savings, round(avg(pay)/nullif(stddev_pop(pay), 0), 6) AS savings_ratio FROM s GROUP BY 1"""))
def savings_ratio(spark, sf_dir):
    return rounded(au.savings_ratio(weekday_panel(spark, sf_dir)), "hike", "drop_",
                   "mean_savings", "sd_savings", "savings_ratio")


@query("confusion", with_ctes(MOVES, LEG, """
SELECT series_id, count(*) FILTER (WHERE dir = 1 AND y > 0.1) AS correct_hikes, count(*) FILTER (WHERE dir = 1 AND NOT y > 0.1) AS false_hikes,
  count(*) FILTER (WHERE dir = -1 AND y < -0.1) AS correct_drops, count(*) FILTER (WHERE dir = -1 AND NOT y < -0.1) AS false_drops,
  count(*) FILTER (WHERE dir = 0 AND abs(y) > 0.1) AS missed_moves, count(*) FILTER (WHERE dir <> 0 AND y = 0) AS false_flat,
  count(*) FILTER (WHERE dir*y < 0) AS false_wrong_dir, count(*) FILTER (WHERE dir = 0 AND abs(y) > 0) AS report_missed FROM lg GROUP BY 1"""))
def confusion(spark, sf_dir):
    return au.confusion(scored(spark, sf_dir))


@query("expanding_confusion", with_ctes(MOVES, """
b AS (SELECT DISTINCT series_id, (rn - 201)//30 AS block, 201 + 30*((rn - 201)//30) AS start FROM mv WHERE rn > 200),
q AS (SELECT b.series_id, b.block, quantile_cont(x, 0.15) FILTER (WHERE x > 0 AND y > 0) AS hq, count(*) FILTER (WHERE x > 0 AND y > 0) AS hn,
  quantile_cont(x, 0.85) FILTER (WHERE x < 0 AND y < 0) AS dq, count(*) FILTER (WHERE x < 0 AND y < 0) AS dn FROM b JOIN mv ON mv.series_id = b.series_id AND mv.rn < b.start GROUP BY 1, 2),
s AS (SELECT mv.series_id, y, CASE WHEN x >= CASE WHEN hn >= 5 THEN greatest(0.3, least(hq, 3.0)) ELSE 1.0 END THEN 1 WHEN x <= CASE WHEN dn >= 5 THEN greatest(-3.0, least(dq, -0.3)) ELSE -1.0 END THEN -1 ELSE 0 END AS dir
  FROM mv JOIN q ON q.series_id = mv.series_id AND q.block = (mv.rn - 201)//30 WHERE mv.rn > 200)""", """
SELECT series_id, count(*) FILTER (WHERE dir = 1 AND y > 0.1) AS correct_hikes, count(*) FILTER (WHERE dir = 1 AND NOT y > 0.1) AS false_hikes,
  count(*) FILTER (WHERE dir = -1 AND y < -0.1) AS correct_drops, count(*) FILTER (WHERE dir = -1 AND NOT y < -0.1) AS false_drops,
  count(*) FILTER (WHERE dir = 0 AND abs(y) > 0.1) AS missed_moves FROM s GROUP BY 1"""))
def expanding_confusion(spark, sf_dir):
    return au.confusion(au.expanding_blocks(weekday_panel(spark, sf_dir))).select(
        "series_id", "correct_hikes", "false_hikes", "correct_drops", "false_drops", "missed_moves")


@query("lag_window_search", with_ctes(MOVES, """
g AS (SELECT mv.series_id, mv.session, w.win, mv.response, mv.driver FROM mv, (VALUES (90),(120),(180),(240),(365),(0)) w(win)
  WHERE w.win = 0 OR (n >= w.win AND n - rn < w.win)),
l AS (SELECT series_id, win, k AS lag, response, CASE k WHEN 0 THEN driver WHEN 1 THEN lag(driver, 1) OVER w ELSE lag(driver, 2) OVER w END AS d
  FROM g, range(3) k(k) WINDOW w AS (PARTITION BY series_id, win, k ORDER BY session)),
s AS (SELECT series_id, win, lag, regr_count(response, d) AS rows, regr_r2(response, d) AS r2 FROM l GROUP BY 1, 2, 3)""", """
SELECT series_id, win::INT AS win, lag::INT AS lag, rows::BIGINT AS rows, round(r2, 6) AS r2, r2 = max(r2) OVER (PARTITION BY series_id) AS best FROM s WHERE rows >= 20"""))
def lag_window_search(spark, sf_dir):
    return rounded(au.lag_window_search(weekday_panel(spark, sf_dir)), "r2")


@query("split_slopes", with_ctes(TRAIN, """
SELECT series_id, count(*) FILTER (WHERE x > 0) AS up_n, round(regr_slope(y, x) FILTER (WHERE x > 0), 6) AS up_slope,
  count(*) FILTER (WHERE x < 0) AS down_n, round(regr_slope(y, x) FILTER (WHERE x < 0), 6) AS down_slope FROM train GROUP BY 1"""))
def split_slopes(spark, sf_dir):
    return rounded(au.split_slopes(train_of(spark, sf_dir)), "up_slope", "down_slope")


def grid_sql(embargo: int) -> str:
    return f"""
gp AS (SELECT * FROM (VALUES (120),(180),(240)) a(win), (VALUES (0.15::DOUBLE),(0.20::DOUBLE)) b(hp), (VALUES (0.80::DOUBLE),(0.85::DOUBLE)) c(dp), range(3) f(fold)),
gq AS (SELECT series_id, fold, win, quantile_cont(x, [0.15, 0.20]) FILTER (WHERE x > 0 AND y > 0) AS hq, count(*) FILTER (WHERE x > 0 AND y > 0) AS hn,
  quantile_cont(x, [0.80, 0.85]) FILTER (WHERE x < 0 AND y < 0) AS dq, count(*) FILTER (WHERE x < 0 AND y < 0) AS dn
  FROM mv, range(3) f(fold), (VALUES (120),(180),(240)) a(win)
  WHERE n - rn >= (fold+1)*90 + {embargo} AND n - rn <= (fold+1)*90 + {embargo} + win - 2 GROUP BY 1, 2, 3),
gt AS (SELECT series_id, gp.*, CASE WHEN hn >= 5 THEN greatest(0.3, least(hq[CASE WHEN hp < 0.18 THEN 1 ELSE 2 END], 3.0)) ELSE 1.0 END AS hike,
  CASE WHEN dn >= 5 THEN greatest(-3.0, least(dq[CASE WHEN dp < 0.82 THEN 1 ELSE 2 END], -0.3)) ELSE -1.0 END AS drop_ FROM gp JOIN gq USING (fold, win)),
gr AS (SELECT mv.series_id, gt.fold, win, hp, dp, n - rn AS back, CASE WHEN x >= hike THEN y WHEN x <= drop_ THEN -y ELSE 0 END AS r
  FROM gt JOIN mv ON mv.series_id = gt.series_id AND n - rn >= gt.fold*90 AND n - rn < (gt.fold+1)*90)"""


@query("embargo_wf", with_ctes(MOVES, grid_sql(5), """
s AS (SELECT series_id, win, hp, dp, fold, sum(r) AS s FROM gr GROUP BY ALL),
q AS (SELECT series_id, win, hp, dp, quantile_cont(s, 0.5) AS med FROM s GROUP BY ALL)""", """
SELECT series_id, win::INT AS win, hp, dp, round(med, 6) AS median_savings, med = max(med) OVER (PARTITION BY series_id) AS best FROM q"""))
def embargo_wf(spark, sf_dir):
    return rounded(au.embargoed_folds(weekday_panel(spark, sf_dir)), "median_savings")


@query("reality_check", with_ctes(MOVES, grid_sql(0), f"""
gm AS (SELECT series_id, win, hp, dp, avg(r) AS mu, count(*) AS size FROM gr GROUP BY ALL),
gb AS (SELECT series_id, max(mu) AS best_mean, max(size) AS size FROM gm GROUP BY 1),
gd AS (SELECT series_id, size, rep, i, {mixed_draw("'grid|' || series_id || '|' || rep", 'i', 'size')} AS j
  FROM gb, range(1, 1001) r(rep), range(270) s(i)),
cnt AS (SELECT series_id, rep, j, count(*) AS c FROM gd GROUP BY 1, 2, 3),
ix AS (SELECT gr.series_id, win, hp, dp, dense_rank() OVER (PARTITION BY gr.series_id ORDER BY back) - 1 AS j, r - mu AS r0
  FROM gr JOIN gm USING (series_id, win, hp, dp)),
bm AS (SELECT c.series_id, rep, win, hp, dp, sum(c*r0)/270 AS v FROM cnt c JOIN ix ON ix.series_id = c.series_id AND ix.j = c.j GROUP BY ALL),
top AS (SELECT series_id, rep, max(v) AS top FROM bm GROUP BY 1, 2)""", """
SELECT series_id, round(max(best_mean), 6) AS best_mean, max(size)::INT AS rows, count(*) FILTER (WHERE top >= best_mean) AS as_extreme,
  count(*) AS draws, round(avg(top), 6) AS null_mean, round((count(*) FILTER (WHERE top >= best_mean) + 1)/(count(*) + 1), 6) AS p_value
FROM top JOIN gb USING (series_id) GROUP BY 1"""))
def reality_check(spark, sf_dir):
    return rounded(au.reality_check(weekday_panel(spark, sf_dir)), "best_mean", "null_mean", "p_value")
