"""Evaluations of every line grade, with the reason where a series has no result."""

from __future__ import annotations

from sluice.functions.calendar import business_calendar
from sluice.operators import readiness as rd, trial as tr
from sluice.operators.align import one_session_deltas, training_pairs
from sluice.plans.audit_queries import MOVES, grid_sql
from sluice.plans.ctes import DIR, TRAIN, payoff, thresholds
from sluice.plans.fit_queries import CI_SQL, FOLDS, HOLD, LAST, TAIL, THRESH, rounded
from sluice.plans.registry import ORACLES, query, with_ctes
from sluice.plans.series_queries import GRADE, by_grade, panel_by
from sluice.plans.trial_queries import START, forecasts_of
from sluice.session import durable

SERIES = """
sr AS (SELECT series_id, coalesce(pairs, 0) AS pairs FROM (SELECT DISTINCT series_id FROM wk) LEFT JOIN (SELECT series_id, count(*) AS pairs FROM train GROUP BY 1) USING (series_id))"""


def reasons(there: str, needed: int, later: str) -> str:
    return f"pairs, {needed} AS needed, CASE WHEN {there} IS NOT NULL THEN NULL WHEN pairs < {needed} THEN 'short_history' ELSE {later} END AS reason"


def grades(spark, sf_dir):
    """Panel and training pairs of the line grades, each written once; the lines are read once."""
    panel = durable(panel_by(spark, sf_dir, GRADE))
    return panel, durable(training_pairs(one_session_deltas(panel, business_calendar(spark))))


@query("grade_walk_forward_report", with_ctes(by_grade(TRAIN), SERIES, FOLDS, thresholds("wt", "ft", "series_id, fold"), f"""
ws AS (SELECT fs.series_id, fs.fold, y, hike, drop_, {DIR} AS dir FROM fs JOIN wt USING (series_id, fold) WHERE fit_error IS NULL),
wf AS (SELECT series_id, count(DISTINCT fold) AS folds, {payoff()} FROM ws GROUP BY 1)""", f"""
SELECT series_id, {reasons('folds', 311, "'no_fold_fitted'")}, folds, alerts, correct, precision, total_savings, mean_savings FROM sr LEFT JOIN wf USING (series_id)"""))
def grade_walk_forward_report(spark, sf_dir):
    panel, train = grades(spark, sf_dir)
    return rounded(rd.walk_forward(panel, train), "precision", "total_savings", "mean_savings")


@query("grade_holdout_report", with_ctes(by_grade(TRAIN), SERIES, HOLD, f"""
nul AS (SELECT series_id, count(*) FILTER (WHERE t >= total - 1e-9) AS as_extreme, count(*) AS permutations FROM hn JOIN ho USING (series_id) GROUP BY 1),
obs AS (SELECT series_id, {payoff()} FROM hs GROUP BY 1)""", f"""
SELECT series_id, {reasons('as_extreme', 100, "'no_fit'")}, alerts, total_savings, as_extreme, permutations, round((as_extreme + 1)/(permutations + 1), 6) AS p_value
FROM sr LEFT JOIN obs USING (series_id) LEFT JOIN nul USING (series_id)"""))
def grade_holdout_report(spark, sf_dir):
    out = rounded(rd.holdout(*grades(spark, sf_dir)), "total_savings", "p_value")
    return out.select("series_id", "pairs", "needed", "reason", "alerts", "total_savings", "as_extreme", "permutations", "p_value")


@query("grade_interval_report", with_ctes(by_grade(TRAIN), SERIES, *CI_SQL[:-1], f"ci AS ({CI_SQL[-1]})", f"""
SELECT series_id, {reasons('replicates', 40, "'few_replicates'")}, hike_low, hike_high, drop_low, drop_high, replicates FROM sr LEFT JOIN ci USING (series_id)"""))
def grade_interval_report(spark, sf_dir):
    return rounded(rd.threshold_interval(*grades(spark, sf_dir)), "hike_low", "hike_high", "drop_low", "drop_high")


@query("grade_tail_report", with_ctes(by_grade(TRAIN), SERIES, THRESH, TAIL, """
tl AS (SELECT series_id, cvar, tail_n, adverse FROM wc JOIN wt USING (series_id) WHERE tail_n >= 4),
nw AS (SELECT series_id, CASE WHEN drop_ IS NOT NULL THEN (SELECT count(*) FROM train tr WHERE tr.series_id = t.series_id AND x <= drop_) END AS waits FROM t)""", f"""
SELECT series_id, {reasons('tail_n', 40, "CASE WHEN waits IS NULL THEN 'no_fit' WHEN waits < 20 THEN 'few_waits' ELSE 'thin_tail' END")},
  waits, round(cvar, 6) AS cvar, tail_n, round(adverse, 6) AS probability_adverse FROM sr LEFT JOIN nw USING (series_id) LEFT JOIN tl USING (series_id)"""))
def grade_tail_report(spark, sf_dir):
    out = rounded(rd.tail_risk(*grades(spark, sf_dir)), "cvar", "probability_adverse")
    return out.select("series_id", "pairs", "needed", "reason", "waits", "cvar", "tail_n", "probability_adverse")


@query("grade_grid_report", with_ctes(by_grade(MOVES), grid_sql(5), """
ng AS (SELECT series_id, count(*) AS pairs FROM wk GROUP BY 1),
s AS (SELECT series_id, win, hp, dp, fold, sum(r) AS s FROM gr JOIN ng USING (series_id) WHERE pairs >= 515 GROUP BY ALL),
q AS (SELECT series_id, win, hp, dp, quantile_cont(s, 0.5) AS med FROM s GROUP BY ALL),
bp AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY med DESC, win, hp, dp) = 1)""", f"""
SELECT series_id, {reasons('med', 515, "'no_fold'")}, win::INT AS win, hp, dp, round(med, 6) AS median_savings FROM ng LEFT JOIN bp USING (series_id)"""))
def grade_grid_report(spark, sf_dir):
    """The best embargoed grid point; whether the reality check ran is in the tests."""
    out = rounded(rd.grid_check(durable(panel_by(spark, sf_dir, GRADE))), "median_savings")
    return out.select("series_id", "pairs", "needed", "reason", "win", "hp", "dp", "median_savings")


_REVIEW = ORACLES["trial_review"]
_CUT = _REVIEW.rindex("\nSELECT gm.series_id")


@query("trial_review_report", f"""{_REVIEW[:_CUT]},
fin AS ({_REVIEW[_CUT:].strip()}),
sr AS (SELECT series_id, count(pe) FILTER (WHERE status = 'eligible') AS pairs FROM pl GROUP BY 1)
SELECT sr.series_id, {reasons('fin.n', 320, "'no_interval'")}, mean_gain, passes FROM sr LEFT JOIN fin ON fin.series_id = sr.series_id""")
def trial_review_report(spark, sf_dir):
    f = durable(forecasts_of(spark, sf_dir))
    uncaptured = tr.status(f, business_calendar(spark), START).select("series_id", "uncaptured")
    return rounded(rd.formal_review(f, uncaptured), "mean_gain").select("series_id", "pairs", "needed", "reason", "mean_gain", "passes")
