"""Alignment queries: pairs, stamping convention, lag diagnostics, re-dating."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sluice.functions.calendar import business_calendar
from sluice.functions.distributions import t_two_sided
from sluice.functions.exprs import r6
from sluice.operators import align
from sluice.operators.fit import with_fit
from sluice.plans.base import pairs_of, train_of
from sluice.plans.ctes import CAL, PAIRS, PANEL, TRAIN, fit, simpson, t_density
from sluice.plans.registry import query, with_ctes
from sluice.session import durable
from sluice.sources.panel import daily_panel, weekdays

# First day stamped under the live convention in the re-dating queries.
ERA_START = "1997-01-06"
LIVE_START = "1996-09-02"


@query("aligned_deltas", with_ctes(PAIRS, """
SELECT series_id, session, prior_session, x, y, session_gap FROM pairs"""))
def aligned_deltas(spark, sf_dir):
    return pairs_of(spark, sf_dir).select(
        "series_id", "session", "prior_session", "x", "y", "session_gap")


@query("training_pairs", with_ctes(TRAIN, "SELECT series_id, session, x, y, ord, n FROM train"))
def training_pairs(spark, sf_dir):
    return train_of(spark, sf_dir).select("series_id", "session", "x", "y", "ord", "n")


@query("basis", with_ctes(PANEL, """
SELECT series_id, session, (response - driver) * 100 AS basis_cents FROM wk"""))
def basis(spark, sf_dir):
    return weekdays(daily_panel(spark, sf_dir)).select(
        "series_id", "session", ((F.col("response") - F.col("driver")) * 100).alias("basis_cents"))


def stamped_panel(spark, sf_dir):
    """Panel as a late-stamping importer would have written it.

    Before ``LIVE_START`` a row carries the stamp of the next calendar day: its
    response belongs to the session, its driver to the stamp date (absent on a
    weekend).  A few drivers are missing from the file.
    """
    panel = weekdays(daily_panel(spark, sf_dir))
    late = F.col("session") < F.lit(LIVE_START).cast("date")
    stamp = F.when(late, F.date_add("session", 1)).otherwise(F.col("session"))
    rows = panel.select("series_id", stamp.alias("session"), "response")
    drivers = panel.select("series_id", "session", "driver")
    return rows.join(drivers, ["series_id", "session"], "left")


STAMPED = PANEL + f""",
stamped AS (SELECT r.series_id, r.stamp AS session, d.driver, r.response FROM
 (SELECT series_id, CASE WHEN session < DATE '{LIVE_START}' THEN session + 1 ELSE session END AS stamp, response FROM wk) r
 LEFT JOIN wk d ON d.series_id = r.series_id AND d.session = r.stamp),
weeks AS (SELECT series_id, date_trunc('week', session)::DATE AS week, bool_or(isodow(session) = 6) AS sat,
  bool_or(isodow(session) = 1) AS mon, count(*) AS days FROM stamped GROUP BY 1, 2),
kinds0 AS (SELECT *, CASE WHEN sat AND mon THEN 'interleaved' WHEN sat THEN 'legacy' WHEN mon THEN 'live'
  ELSE 'ambiguous' END AS raw_kind FROM weeks),
kinds AS (SELECT *, CASE WHEN raw_kind = 'ambiguous' AND week < (SELECT min(week) FROM kinds0 k
  WHERE k.series_id = kinds0.series_id AND raw_kind = 'live') THEN 'legacy' ELSE raw_kind END AS kind FROM kinds0),
external AS (SELECT series_id, session, driver FROM wk
  WHERE substr(md5(series_id || '|' || CAST(session AS VARCHAR)), 1, 1) <> '0')"""


def external_settles(spark, sf_dir):
    """Outside source of drivers, with one key in sixteen absent."""
    key = F.concat_ws("|", "series_id", F.col("session").cast("string"))
    return weekdays(daily_panel(spark, sf_dir)).where(
        F.substring(F.md5(key.cast("binary")), 1, 1) != "0")


@query("week_classes", with_ctes(STAMPED, """
SELECT series_id, week, raw_kind, kind, days FROM kinds"""))
def week_classes(spark, sf_dir):
    return align.week_classes(stamped_panel(spark, sf_dir)).select(
        "series_id", "week", "raw_kind", "kind", "days")


ADJ = """
adj AS (SELECT * FROM (SELECT *, lag(x) OVER w AS z, lag(session) OVER w AS last_s,
   lag(prior_session) OVER w AS first_s FROM pairs WINDOW w AS (PARTITION BY series_id ORDER BY session))
   WHERE prior_session = last_s)"""


def lag_fit_sql(name: str, src: str, keys: str) -> str:
    return f"""{name}_m AS (SELECT {keys}, count(*) AS n, var_pop(x)*count(*) AS cxx, var_pop(z)*count(*) AS czz,
  covar_pop(x,z)*count(*) AS cxz, covar_pop(x,y)*count(*) AS cxy, covar_pop(z,y)*count(*) AS czy,
  var_pop(y)*count(*) AS cyy FROM {src} GROUP BY {keys}),
{name}_b AS (SELECT *, CASE WHEN n >= 30 THEN (cxy*czz - czy*cxz)/(cxx*czz - cxz*cxz) END AS b0,
  CASE WHEN n >= 30 THEN (czy*cxx - cxy*cxz)/(cxx*czz - cxz*cxz) END AS b1 FROM {name}_m),
{name} AS (SELECT {keys}, n, b0, b1, abs(b1)/abs(b0) AS ratio,
  b1 / sqrt((cyy - b0*cxy - b1*czy)/(n - 3) * cxx/(cxx*czz - cxz*cxz)) AS t_b1 FROM {name}_b)"""


# Two-sided t quantile by its expansion in 1/dof, exact to 1e-6 for dof >= 27.
def t_crit_sql(z: float) -> str:
    return (f"({z} + ({z}^3 + {z})/(4*(n-3)) + (5*{z}^5 + 16*{z}^3 + 3*{z})/(96*(n-3)^2)"
            f" + (3*{z}^7 + 19*{z}^5 + 17*{z}^3 - 15*{z})/(384*(n-3)^3))")


T01, T05 = t_crit_sql(2.575829303548901), t_crit_sql(1.959963984540054)


@query("lag_diag", with_ctes(PAIRS, ADJ, lag_fit_sql("lagf", "adj", "series_id"), """
SELECT series_id, n, round(b0, 6) AS b0, round(b1, 6) + 0.0 AS b1, round(ratio, 6) AS ratio,
   round(t_b1, 5) + 0.0 AS t_b1, ratio > 0.08 AS material FROM lagf"""))
def lag_diag(spark, sf_dir):
    d = align.lag_diagnostics(pairs_of(spark, sf_dir))
    return d.select("series_id", "n", r6("b0").alias("b0"), r6("b1").alias("b1"),
                    r6("ratio").alias("ratio"), (F.round("t_b1", 5) + 0.0).alias("t_b1"),
                    (F.col("ratio") > align.MAX_LAG_RATIO).alias("material"))


@query("lag_p_value", with_ctes(PAIRS, ADJ, lag_fit_sql("lagf", "adj", "series_id"), f"""
SELECT series_id, n, round(greatest(0, 1 - 2 * {simpson(t_density('n - 3'), 'abs(t_b1)')}), 6) AS p_b1
FROM lagf, range(2001) r(i) GROUP BY 1, 2"""))
def lag_p_value(spark, sf_dir):
    """Two-sided p of the lag coefficient; the SQL integrates the density."""
    d = align.lag_diagnostics(pairs_of(spark, sf_dir))
    return d.select("series_id", "n", r6(t_two_sided("t_b1", F.col("n") - 3)).alias("p_b1"))


def gate_sql(stamped: str) -> tuple[str, ...]:
    """Parts of the gate's SQL over the rows of ``STAMPED`` as given."""
    return (stamped, CAL, """
smoved AS (SELECT *, lag(session) OVER w AS prior_session, (driver - lag(driver) OVER w) * 100 AS x,
   (response - lag(response) OVER w) * 100 AS y FROM stamped
   WHERE driver IS NOT NULL AND response IS NOT NULL AND isodow(session) < 6
   WINDOW w AS (PARTITION BY series_id ORDER BY session)),
pairs AS (SELECT m.* FROM smoved m JOIN cal c ON c.d = m.session WHERE prior_session = c.prev_bd)""",
            ADJ, lag_fit_sql("lagf", "adj", "series_id"), """
shares AS (SELECT series_id, count(*) FILTER (WHERE sat) / nullif(count(*) FILTER (WHERE sat OR mon), 0) AS legacy_share
   FROM weeks GROUP BY 1)""", f"""
SELECT series_id, n, n >= 30 AND NOT (ratio > 0.08 AND abs(t_b1) > {T01}) AS aligned,
  round(legacy_share, 6) AS legacy_share, legacy_share <= 0.15 AS structure_ok,
  n >= 30 AND NOT (ratio > 0.08 AND abs(t_b1) > {T01}) AND legacy_share <= 0.15 AS passed
FROM lagf JOIN shares USING (series_id)""")


def gate_columns(gate):
    return gate.select("series_id", "n", "aligned", r6("legacy_share").alias("legacy_share"), "structure_ok", "passed")


@query("alignment_gate", with_ctes(*gate_sql(STAMPED)))
def alignment_gate(spark, sf_dir):
    """Regression check on weekdays and structural check on all stamped days."""
    stamped = durable(stamped_panel(spark, sf_dir))
    return gate_columns(align.alignment_gate(stamped, business_calendar(spark)))


@query("alignment_gate_era", with_ctes(*gate_sql(STAMPED.replace(
    "ON d.series_id = r.series_id AND d.session = r.stamp)", f"ON d.series_id = r.series_id AND d.session = r.stamp WHERE r.stamp >= DATE '{ERA_START}')"))))
def alignment_gate_era(spark, sf_dir):
    """The same checks on the calibration era alone."""
    stamped = durable(stamped_panel(spark, sf_dir))
    return gate_columns(align.alignment_gate(stamped, business_calendar(spark), ERA_START))


@query("era_scan", with_ctes(PAIRS, ADJ, """
starts AS (SELECT series_id, start FROM (SELECT DISTINCT series_id FROM wk), (SELECT unnest(generate_series(
   date_trunc('month', min(session)), date_trunc('month', max(session)), INTERVAL 1 MONTH))::DATE AS start FROM wk)),
era AS (SELECT s.start, a.* FROM starts s JOIN adj a ON a.series_id = s.series_id AND a.first_s >= s.start)""",
    lag_fit_sql("lagf", "era", "series_id, start"), f"""
each AS (SELECT starts.*, lagf.* EXCLUDE (series_id, start), lagf.n >= 30 AND abs(t_b1) <= {T05} AS ok
   FROM starts LEFT JOIN lagf USING (series_id, start))""", """
SELECT series_id, start, coalesce(n, 0) AS n, round(b0, 6) AS b0, round(b1, 6) + 0.0 AS b1, round(t_b1, 4) + 0.0 AS t_b1,
  bool_and(coalesce(ok, false)) OVER (PARTITION BY start) AS clean FROM each"""))
def era_scan(spark, sf_dir):
    scan = align.era_scan(pairs_of(spark, sf_dir), weekdays(daily_panel(spark, sf_dir)))
    p = t_two_sided("t_b1", F.col("n") - 3)
    scan = scan.withColumn("ok", F.coalesce((F.col("n") >= align.MIN_LAG_PAIRS)
                                            & (p >= align.ERA_P), F.lit(False)))
    return scan.select(
        "series_id", "start", F.col("n").cast("long").alias("n"), r6("b0").alias("b0"),
        r6("b1").alias("b1"), (F.round("t_b1", 4) + 0.0).alias("t_b1"),
        F.bool_and("ok").over(Window.partitionBy("start")).alias("clean"))


REDATE = STAMPED + "," + CAL + f""",
planned0 AS (SELECT s.*, s.session AS stamp, k.kind,
  CASE WHEN s.session < DATE '{ERA_START}' AND kind = 'legacy' AND isodow(s.session - 1) < 6 THEN s.session - 1
       ELSE s.session END AS target
  FROM stamped s JOIN kinds k ON k.series_id = s.series_id AND k.week = date_trunc('week', s.session)::DATE),
planned AS (SELECT p.series_id, p.stamp, p.target AS session, p.kind,
  CASE WHEN target = stamp THEN 'kept' WHEN d.driver IS NOT NULL THEN 'internal' WHEN e.driver IS NOT NULL THEN 'external'
       WHEN NOT c.is_bd THEN 'holiday_no_settle' ELSE 'missing' END AS source,
  CASE WHEN target = stamp THEN p.driver ELSE coalesce(d.driver, e.driver) END AS driver, p.response
  FROM planned0 p LEFT JOIN stamped d ON d.series_id = p.series_id AND d.session = p.target
  LEFT JOIN external e ON e.series_id = p.series_id AND e.session = p.target LEFT JOIN cal c ON c.d = p.target)"""


def planned(spark, sf_dir):
    return align.redate_plan(durable(stamped_panel(spark, sf_dir)),
                             external_settles(spark, sf_dir), business_calendar(spark), ERA_START)


@query("redate_plan", with_ctes(REDATE, """
SELECT series_id, stamp, session, kind, source, driver, response,
  CASE WHEN session = stamp THEN 'keep' WHEN source = 'missing' THEN 'unresolved' ELSE 'redate' END AS action FROM planned"""))
def redate_plan(spark, sf_dir):
    return planned(spark, sf_dir)


@query("redate_gates", with_ctes(REDATE, f"""
fixed AS (SELECT p.*, w.driver AS true_driver FROM planned p LEFT JOIN wk w USING (series_id, session)),
keyed AS (SELECT series_id, session, count(*) AS c FROM planned GROUP BY 1, 2),
counts AS (SELECT series_id, count(*) AS rows_after FROM planned GROUP BY 1),
before_ AS (SELECT series_id, count(*) AS rows_before FROM stamped GROUP BY 1),
racks AS (SELECT series_id, count(*) AS c FROM ((SELECT series_id, response FROM stamped EXCEPT ALL SELECT series_id, response FROM planned)
   UNION ALL (SELECT series_id, response FROM planned EXCEPT ALL SELECT series_id, response FROM stamped)) GROUP BY 1),
era AS (SELECT series_id, count(*) AS c FROM (SELECT series_id, session, driver, response FROM stamped WHERE session >= DATE '{ERA_START}'
   EXCEPT ALL SELECT series_id, session, driver, response FROM planned) GROUP BY 1)""", """
SELECT series_id, rows_before, rows_after,
  (SELECT round(max(abs(driver - true_driver)), 9) FROM fixed f WHERE f.series_id = counts.series_id AND stamp <> session) AS max_deviation,
  (SELECT count(*) FROM keyed k WHERE k.series_id = counts.series_id AND c > 1) AS collisions,
  coalesce((SELECT c FROM racks r WHERE r.series_id = counts.series_id), 0) AS response_changes,
  coalesce((SELECT c FROM era e WHERE e.series_id = counts.series_id), 0) AS era_changes
FROM counts JOIN before_ USING (series_id)"""))
def redate_gates(spark, sf_dir):
    stamped = durable(stamped_panel(spark, sf_dir))
    panel = weekdays(daily_panel(spark, sf_dir))
    plan = durable(align.redate_plan(stamped, external_settles(spark, sf_dir),
                                     business_calendar(spark), ERA_START))
    return align.redate_gates(stamped, plan, panel, ERA_START).withColumn(
        "max_deviation", F.round("max_deviation", 9))


@query("roll_offset", with_ctes(PAIRS, fit("pf", "pairs", "series_id"), """
ords AS (SELECT month, max(bd_ord) FILTER (WHERE is_bd) AS ltd_ord FROM cal2 GROUP BY 1),
flagged AS (SELECT k, r.series_id, abs(resid) AS ar, c.is_bd AND c.bd_ord = o.ltd_ord - k + 1 AS hit
  FROM pf_r r JOIN cal2 c ON c.d = r.session JOIN ords o USING (month), (VALUES (1),(2),(3)) t(k)),
per AS (SELECT k, series_id, avg(ar) FILTER (WHERE hit) AS flagged, avg(ar) FILTER (WHERE NOT hit) AS unflagged FROM flagged GROUP BY 1, 2),
scored AS (SELECT k, min(flagged / unflagged) AS min_ratio FROM per GROUP BY 1)""", """
SELECT k, round(min_ratio, 6) AS min_ratio, k = (SELECT arg_max(k, min_ratio) FROM scored) AS best FROM scored"""))
def roll_offset(spark, sf_dir):
    fitted = with_fit(pairs_of(spark, sf_dir), ["series_id"])
    return align.roll_offsets(fitted, business_calendar(spark)).select(
        "k", r6("min_ratio").alias("min_ratio"), "best")
