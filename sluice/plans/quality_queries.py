"""Validators and provenance checks on proxy ledgers with known defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.calendar import business_calendar, contract_symbol
from sluice.functions.exprs import count_if
from sluice.operators import decide, ledger, quality as ql
from sluice.operators.align import by_session
from sluice.operators.ledger import byte_of
from sluice.plans.base import artifacts_of, cut_train
from sluice.plans.ctes import ARTIFACTS, CAL, LOG, PANEL, byte
from sluice.plans.registry import query, with_ctes
from sluice.session import durable
from sluice.sources.panel import daily_panel, read, weekdays

B = lambda i: byte(i, "series_id", "session")


def b(i):
    return byte_of(i, "series_id", "session")


def by_rule(v, *keys):
    return v.groupBy(*keys, "rule").agg(F.count("*").alias("violations"))


DIRTY = PANEL + f""",
dr AS (SELECT series_id, session, CASE WHEN {B(11)} < 4 THEN NULL WHEN {B(12)} = 0 THEN -driver WHEN {B(12)} = 1 THEN driver + 9.5 WHEN {B(12)} = 2 THEN driver + 1.5 ELSE driver END AS driver, CASE WHEN {B(15)} = 3 THEN response + 1.25 WHEN {B(15)} = 4 THEN NULL ELSE response END AS response,
  (session - DATE '1990-01-01')*10 - CASE WHEN {B(13)} < 2 THEN 305 ELSE 0 END AS line0, CASE WHEN {B(10)} < 2 THEN 2 ELSE 1 END AS copies FROM panel
  WHERE NOT (series_id = 'F' AND session BETWEEN DATE '1998-03-02' AND DATE '1998-03-13')),
dirty AS (SELECT series_id, session, driver, response, line0 + c AS line_no FROM dr, range(2) r(c) WHERE c < copies)"""


def dirty_history(spark, sf_dir):
    """The panel as a file with nulls, bad prices, repeats, a hole and disorder."""
    p = daily_panel(spark, sf_dir).where(
        "NOT (series_id = 'F' AND session BETWEEN DATE '1998-03-02' AND DATE '1998-03-13')")
    driver = (F.when(b(11) < 4, F.lit(None)).when(b(12) == 0, -F.col("driver"))
              .when(b(12) == 1, F.col("driver") + 9.5).when(b(12) == 2, F.col("driver") + 1.5)
              .otherwise(F.col("driver")))
    line = F.datediff("session", F.lit("1990-01-01").cast("date")) * 10 - F.when(b(13) < 2, 305).otherwise(0)
    copies = F.sequence(F.lit(0), F.when(b(10) < 2, 1).otherwise(0))
    response = F.when(b(15) == 3, F.col("response") + 1.25).when(b(15) != 4, F.col("response"))
    return p.select("series_id", "session", driver.alias("driver"), response.alias("response"), line.alias("l"),
                    F.explode(copies).alias("c")).withColumn("line_no", F.col("l") + F.col("c")).drop("l", "c")


@query("history_violations", with_ctes(DIRTY, CAL, """
a AS (SELECT *, count(*) OVER (PARTITION BY series_id, session) AS copies, lag(session) OVER (PARTITION BY series_id ORDER BY line_no) AS prev FROM dirty),
pd AS (SELECT series_id, line_no, lag(driver) OVER (PARTITION BY series_id ORDER BY line_no) AS pdv FROM dirty WHERE driver IS NOT NULL),
pr AS (SELECT series_id, line_no, lag(response) OVER (PARTITION BY series_id ORDER BY line_no) AS prv FROM dirty WHERE response IS NOT NULL),
j AS (SELECT a.*, pdv, prv, is_holiday_alt, dow FROM a LEFT JOIN pd USING (series_id, line_no) LEFT JOIN pr USING (series_id, line_no) LEFT JOIN cal1 ON cal1.d = a.session),
v AS (SELECT series_id, 'duplicate_date' AS rule FROM j WHERE copies > 1 UNION ALL SELECT series_id, 'unsorted' FROM j WHERE session < prev
  UNION ALL SELECT series_id, 'gap_over_7_days' FROM j WHERE session - prev > 7 UNION ALL SELECT series_id, 'not_positive' FROM j WHERE driver <= 0 OR response <= 0
  UNION ALL SELECT series_id, 'out_of_bounds' FROM j WHERE (driver > 0 AND (driver < 1 OR driver > 10)) OR (response > 0 AND (response < 1 OR response > 10))
  UNION ALL SELECT series_id, 'jump_over_1' FROM j WHERE driver IS NOT NULL AND abs(driver - pdv) > 1 UNION ALL SELECT series_id, 'response_jump_over_1' FROM j WHERE response IS NOT NULL AND abs(response - prv) > 1
  UNION ALL SELECT series_id, 'missing_on_trading_day' FROM j WHERE dow < 5 AND NOT is_holiday_alt AND driver IS NULL
  UNION ALL SELECT '*', 'mismatched_presence' FROM (SELECT session FROM dirty GROUP BY 1 HAVING count(driver) > 0 AND count(driver) < count(*)))""", """
SELECT series_id, rule, count(*) AS violations FROM v GROUP BY 1, 2"""))
def history_violations(spark, sf_dir):
    raw = durable(dirty_history(spark, sf_dir))
    v = ql.history_violations(raw, business_calendar(spark))
    return by_rule(v.unionByName(ql.parity_violations(raw)), "series_id")


@query("history_file_violations", with_ctes(PANEL, f"""
t AS (SELECT CASE WHEN {B(13)} = 5 THEN '2020-13-45' ELSE CAST(session AS VARCHAR) END AS s, CASE WHEN {B(11)} = 5 THEN 'err' WHEN {B(11)} = 6 THEN ' N/A ' ELSE CAST(driver AS VARCHAR) END AS d,
  CASE WHEN {B(12)} = 5 THEN '1.2.3' WHEN {B(12)} = 6 THEN '' ELSE CAST(response AS VARCHAR) END AS r FROM panel),
v AS (SELECT 'whole' AS file, unnest(['session', 'driver', 'response']) AS "column", unnest(['invalid_date', 'non_numeric', 'non_numeric']) AS rule, unnest([count(*) FILTER (WHERE s = '2020-13-45'), count(*) FILTER (WHERE d = 'err'), count(*) FILTER (WHERE r = '1.2.3')]) AS lines FROM t
  UNION ALL SELECT 'narrow', 'response', 'missing_column', NULL UNION ALL SELECT 'narrow', 'driver', 'non_numeric', count(*) FILTER (WHERE d = 'err') FROM t
  UNION ALL SELECT 'narrow', 'session', 'invalid_date', count(*) FILTER (WHERE s = '2020-13-45') FROM t UNION ALL SELECT 'empty', '*', 'empty_file', 0)""", """
SELECT file, "column", rule, lines::BIGINT AS lines FROM v WHERE lines IS NULL OR lines > 0 OR rule = 'empty_file'"""))
def history_file_violations(spark, sf_dir):
    """Three price files as text: one with unreadable values, one without a column, one without lines."""
    as_text = lambda c: F.col(c).cast("string")
    whole = durable(daily_panel(spark, sf_dir).select(
        F.when(b(13) == 5, "2020-13-45").otherwise(as_text("session")).alias("session"),
        F.when(b(11) == 5, "err").when(b(11) == 6, " N/A ").otherwise(as_text("driver")).alias("driver"),
        F.when(b(12) == 5, "1.2.3").when(b(12) == 6, "").otherwise(as_text("response")).alias("response")))
    return (ql.file_violations(whole, "whole").unionByName(ql.file_violations(whole.drop("response"), "narrow"))
            .unionByName(ql.file_violations(whole.where("false"), "empty")))


LOGV = LOG + f""",
tl AS (SELECT * EXCLUDE (label, move, z, hike), {B(14)} AS tb,
  CASE WHEN {B(14)} = 0 THEN 'High confidence (99%) | p=0.6000' WHEN {B(14)} = 1 THEN 'High conviction' ELSE label END AS label,
  CASE WHEN {B(14)} = 2 THEN move + 0.5 ELSE move END AS move, CASE WHEN {B(14)} = 3 THEN z + 1 ELSE z END AS z,
  CASE WHEN {B(14)} = 4 THEN hike + 0.05 ELSE hike END AS hike, CASE WHEN {B(14)} = 5 THEN repeat('0', 64) WHEN {B(14)} = 6 THEN 'metrics' ELSE artifact_id END AS calibration_id,
  CASE WHEN {B(14)} = 7 THEN 'SIDEWAYS' WHEN modeled_action IN ('BUY_NOW','LEAN_BUY') THEN 'HIKE' WHEN modeled_action IN ('WAIT','LEAN_WAIT') THEN 'DROP' ELSE 'FLAT' END AS modeled_direction,
  CASE modeled_action WHEN 'BUY_NOW' THEN hike WHEN 'LEAN_BUY' THEN lean_hike WHEN 'WAIT' THEN drop_ WHEN 'LEAN_WAIT' THEN lean_drop ELSE 0 END AS modeled_threshold FROM log),
tj AS (SELECT tl.*, a.effective_session AS a_session, a.hike AS a_hike, a.drop_ AS a_drop, a.daily_std AS a_std, (signal_price - baseline_price)*100 AS pm,
  TRY_CAST(nullif(regexp_extract(label, ' \\| p=(0\\.[0-9]+|1\\.0+)$', 1), '') AS DOUBLE) AS lp, regexp_extract(label, '^(.+?) \\| p=', 1) AS lt, tl.baseline_source <> 'exchange_close' AS kn
  FROM tl LEFT JOIN arts a ON a.series_id = tl.series_id AND a.artifact_id = tl.calibration_id),
tk AS (SELECT *, CASE WHEN pm >= hike THEN 'BUY_NOW' WHEN pm <= drop_ THEN 'WAIT' WHEN pm >= lean_hike THEN 'LEAN_BUY' WHEN pm <= lean_drop THEN 'LEAN_WAIT' ELSE 'NO_EDGE' END AS act FROM tj),
tq AS (SELECT *, CASE act WHEN 'BUY_NOW' THEN hike WHEN 'LEAN_BUY' THEN lean_hike WHEN 'WAIT' THEN drop_ WHEN 'LEAN_WAIT' THEN lean_drop ELSE 0 END AS eth,
  CASE WHEN act IN ('BUY_NOW','LEAN_BUY') THEN 'HIKE' WHEN act IN ('WAIT','LEAN_WAIT') THEN 'DROP' ELSE 'FLAT' END AS edir,
  CASE WHEN lp >= 0.9 THEN 'High' WHEN lp >= 0.75 THEN 'Moderate' ELSE 'Low' END || ' confidence (' || round(lp*100)::INT || '%)' AS elabel FROM tk),
v AS (SELECT 'direction_enum' AS rule FROM tq WHERE modeled_direction NOT IN ('HIKE','DROP','FLAT') UNION ALL SELECT 'label_malformed' FROM tq WHERE lp IS NULL
  UNION ALL SELECT 'label_mismatch' FROM tq WHERE lp IS NOT NULL AND lt <> elabel UNION ALL SELECT 'artifact_format' FROM tq WHERE NOT regexp_matches(calibration_id, '^[0-9a-f]{{64}}$')
  UNION ALL SELECT 'artifact_unknown' FROM tq WHERE regexp_matches(calibration_id, '^[0-9a-f]{{64}}$') AND a_session IS NULL UNION ALL SELECT 'artifact_session' FROM tq WHERE a_session <> effective_session
  UNION ALL SELECT 'artifact_fields' FROM tq WHERE a_session IS NOT NULL AND (abs(hike - CASE WHEN kn THEN a_hike ELSE greatest(a_hike, 1.2) END) > 0.00011
     OR abs(drop_ - CASE WHEN kn THEN a_drop ELSE least(a_drop, -1.2) END) > 0.00011 OR abs(daily_std - a_std) > 0.00011)
  UNION ALL SELECT 'std_not_positive' FROM tq WHERE daily_std <= 0 UNION ALL SELECT 'move_mismatch' FROM tq WHERE abs(pm - move) > 0.011
  UNION ALL SELECT 'z_mismatch' FROM tq WHERE abs(z - move/nullif(daily_std, 0)) > 0.005
  UNION ALL SELECT 'direction_mismatch' FROM tq WHERE modeled_direction IN ('HIKE','DROP','FLAT') AND modeled_direction <> edir
  UNION ALL SELECT 'threshold_mismatch' FROM tq WHERE abs(modeled_threshold - eth) > 0.011)"""


@query("log_violations", with_ctes(LOGV, "SELECT rule, count(*) AS violations FROM v GROUP BY 1"))
def log_violations(spark, sf_dir):
    train = cut_train(spark, sf_dir)
    arts = durable(ledger.artifacts(train))
    log = ledger.decision_log(train, arts)
    t, c = b(14), F.col
    used = decide.threshold_used(F.col("modeled_action"))
    recorded = log.withColumn("modeled_threshold", used).withColumns({
        "label": F.when(t == 0, "High confidence (99%) | p=0.6000").when(t == 1, "High conviction").otherwise(c("label")),
        "move": F.when(t == 2, c("move") + 0.5).otherwise(c("move")),
        "z": F.when(t == 3, c("z") + 1).otherwise(c("z")),
        "hike": F.when(t == 4, c("hike") + 0.05).otherwise(c("hike")),
        "calibration_id": F.when(t == 5, F.repeat(F.lit("0"), 64)).when(t == 6, "metrics").otherwise(c("artifact_id")),
        "modeled_direction": F.when(t == 7, "SIDEWAYS").otherwise(decide.direction_of(c("modeled_action")))})
    return by_rule(ql.log_violations(recorded, arts))


PROV = CAL + "," + PANEL + f""",
pv0 AS (SELECT session, CASE WHEN {B(15)} = 0 THEN 'CL' WHEN series_id = 'F' THEN 'RB' ELSE 'HO' END AS commodity, CASE WHEN {B(15)} = 1 THEN -driver ELSE driver END AS price,
  CASE WHEN {B(15)} = 2 THEN 'RBX' WHEN {B(15)} = 3 THEN '/CLF99' ELSE '/' || CASE WHEN (series_id = 'F') = ({B(15)} <> 4) THEN 'RB' ELSE 'HO' END
    || substr('FGHJKMNQUVXZ', month(front_refined)::INT, 1) || lpad((year(front_refined) % 100)::VARCHAR, 2, '0') END AS symbol,
  CASE WHEN {B(15)} = 5 THEN 'checked' WHEN {B(15)} BETWEEN 6 AND 11 THEN 'unknown' ELSE 'verified' END AS status, CASE WHEN {B(15)} = 12 THEN 2 ELSE 1 END AS copies FROM wk JOIN cal ON cal.d = session),
pv AS (SELECT * EXCLUDE (copies), count(*) OVER (PARTITION BY session, commodity) AS k, regexp_matches(symbol, '^/(RB|HO)[FGHJKMNQUVXZ][0-9]{{2}}$') AS ok FROM pv0, range(2) r(c) WHERE c < copies),
v AS (SELECT commodity, 'duplicate_key' AS rule FROM pv WHERE k > 1 UNION ALL SELECT commodity, 'commodity_enum' FROM pv WHERE commodity NOT IN ('RB','HO')
  UNION ALL SELECT commodity, 'status_enum' FROM pv WHERE status NOT IN ('verified','unknown') UNION ALL SELECT commodity, 'price_not_positive' FROM pv WHERE price <= 0
  UNION ALL SELECT commodity, 'symbol_format' FROM pv WHERE status = 'verified' AND NOT ok
  UNION ALL SELECT commodity, 'symbol_commodity' FROM pv WHERE status = 'verified' AND ok AND NOT starts_with(symbol, '/' || commodity))"""


def front_symbols(spark, panel):
    """Panel rows with their product prefix and quoted contract."""
    cal = business_calendar(spark).select(F.col("d").alias("session"), "front_refined")
    return panel.join(F.broadcast(cal), "session").withColumn(
        "prefix", F.when(F.col("series_id") == "F", "RB").otherwise("HO"))


@query("provenance_violations", with_ctes(PROV, "SELECT commodity, rule, count(*) AS violations FROM v GROUP BY 1, 2"))
def provenance_violations(spark, sf_dir):
    rows = front_symbols(spark, weekdays(daily_panel(spark, sf_dir)))
    t = b(15)
    other = F.when(F.col("prefix") == "RB", "HO").otherwise("RB")
    symbol = (F.when(t == 2, "RBX").when(t == 3, "/CLF99").otherwise(contract_symbol(
        F.when(t == 4, other).otherwise(F.col("prefix")), F.col("front_refined"))))
    prov = rows.select(
        "session", F.when(t == 0, "CL").otherwise(F.col("prefix")).alias("commodity"),
        F.when(t == 1, -F.col("driver")).otherwise(F.col("driver")).alias("price"), symbol.alias("symbol"),
        F.when(t == 5, "checked").when(t.between(6, 11), "unknown").otherwise("verified").alias("status"),
        F.explode(F.sequence(F.lit(0), F.when(t == 12, 1).otherwise(0))).alias("copy")).drop("copy")
    return by_rule(ql.provenance_violations(prov), "commodity")


_D = lambda i: byte(i, "session")


@query("daily_violations", with_ctes(PANEL, f"""
w AS (SELECT session, {_D(3)} AS t, max(driver) FILTER (WHERE series_id = 'F') AS rb, max(driver) FILTER (WHERE series_id = 'O') AS ho FROM wk GROUP BY 1, 2),
v AS (SELECT 'bad_date' AS rule FROM w WHERE t = 0 UNION ALL SELECT 'no_timezone' FROM w WHERE t = 1 UNION ALL SELECT 'rb_price' FROM w WHERE t = 2 AND rb IS NOT NULL
  UNION ALL SELECT 'ho_contract' FROM w WHERE t = 3 AND ho IS NOT NULL)""", "SELECT rule, count(*) AS violations FROM v GROUP BY 1"))
def daily_violations(spark, sf_dir):
    """Settlement records of every session as JSON, some of them defective."""
    price = lambda s: F.max(F.when(F.col("series_id") == s, F.col("driver")))
    w = weekdays(daily_panel(spark, sf_dir)).groupBy("session").agg(price("F").alias("rb"), price("O").alias("ho"))
    t, day = byte_of(3, "session"), F.col("session").cast("string")
    # Version 1 records carry no contract and need none.
    version = F.when(t < 64, 2).otherwise(1)
    record = F.struct(
        F.when(t == 0, "soon").otherwise(day).alias("date"),
        F.concat(day, F.when(t == 1, "T13:30:00").otherwise("T13:30:00-06:00")).alias("captured_at"),
        version.alias("settlement_schema_version"),
        F.when(t == 2, -F.col("rb")).otherwise(F.col("rb")).alias("rb_settlement"),
        F.when(version == 2, "/RBF00").alias("rb_contract"), F.col("ho").alias("ho_settlement"),
        F.when(t == 3, "HO").when(version == 2, "/HOF00").alias("ho_contract"))
    return by_rule(ql.daily_violations(w.select("session", F.to_json(record).alias("record")), "record"))


@query("artifact_chain", with_ctes(ARTIFACTS, f"""
tm AS (SELECT series_id, block, effective_session, training_start, training_end, rows, prior_artifact_id, artifact_id, CASE WHEN block % 9 = 4 THEN hike + 0.01 ELSE hike END AS h2, hike,
  CASE WHEN block % 11 = 5 THEN repeat('a', 64) ELSE prior_artifact_id END AS p2, CASE WHEN block % 13 = 6 THEN effective_session ELSE training_end END AS te2, core FROM arts),
lg AS (SELECT *, lag(artifact_id, 1, 'bootstrap_config') OVER w AS last_id, lag(te2) OVER w AS last_end FROM tm WINDOW w AS (PARTITION BY series_id ORDER BY effective_session)),
v AS (SELECT series_id, 'date_order' AS rule FROM lg WHERE te2 >= effective_session UNION ALL SELECT series_id, 'content_id' FROM lg WHERE h2 <> hike OR p2 <> prior_artifact_id OR te2 <> training_end
  UNION ALL SELECT series_id, 'chain_broken' FROM lg WHERE p2 <> last_id UNION ALL SELECT series_id, 'training_moved_back' FROM lg WHERE te2 < last_end)""", """
SELECT series_id, rule, count(*) AS violations FROM v GROUP BY 1, 2"""))
def artifact_chain(spark, sf_dir):
    """The chain with edited thresholds, links and training ends."""
    k, c = F.col("block"), F.col
    arts = artifacts_of(spark, sf_dir).withColumns({
        "hike": F.when(k % 9 == 4, c("hike") + 0.01).otherwise(c("hike")),
        "prior_artifact_id": F.when(k % 11 == 5, F.repeat(F.lit("a"), 64)).otherwise(c("prior_artifact_id")),
        "training_end": F.when(k % 13 == 6, c("effective_session")).otherwise(c("training_end"))})
    return by_rule(ql.artifact_violations(arts), "series_id")


# Execution records: one per order, and a correction for every tenth key.
EXEC = """
ex0 AS (SELECT o_orderkey AS k, md5(o_orderkey::VARCHAR) AS record_id, NULL::VARCHAR AS supersedes, o_orderkey*2 AS seq, CAST(o_orderdate AS DATE) AS signal_date, o_orderstatus AS series_id,
  CASE WHEN o_orderkey % 101 = 0 THEN 0 ELSE 1000 + o_orderkey % 8000 END AS gallons, o_orderkey, o_custkey, o_totalprice FROM orders),
ex1 AS (SELECT k, md5('c' || k) AS record_id, CASE WHEN k % 170 = 0 THEN md5('x' || k) ELSE md5(k::VARCHAR) END AS supersedes, k*2 + 1 AS seq, CASE WHEN k % 190 = 0 THEN signal_date + 1 ELSE signal_date END AS signal_date, series_id, gallons + 10 AS gallons, o_orderkey, o_custkey, o_totalprice
  FROM ex0 WHERE k % 10 = 0),
ex2 AS (SELECT * FROM ex0 UNION ALL SELECT * FROM ex1 UNION ALL SELECT k, md5('d' || k), md5(k::VARCHAR), k*2 + 2, signal_date, series_id, gallons, o_orderkey, o_custkey, o_totalprice FROM ex0 WHERE k % 230 = 0),
ex AS (SELECT *, ['HIKE','DROP','FLAT','UP'][(k % 47 = 0)::INT*3 + CASE WHEN k % 47 = 0 THEN 1 ELSE (o_custkey % 3 + 1)::INT END] AS recommendation,
  ['DISPATCHED_SAME_DAY','WAITED','NO_ACTION'][(k % 3 + 1)::INT] AS action, CASE WHEN k % 3 = 0 THEN signal_date + (k % 53 = 0)::INT WHEN k % 3 = 1 THEN signal_date + (k % 59 <> 0)::INT END AS load_date,
  CASE WHEN k % 2 = 0 THEN 2 + (k % 100)/100.0::DOUBLE END AS paid, CASE WHEN k % 2 = 0 AND k % 61 <> 0 THEN 2.1::DOUBLE + (o_custkey % 100)/100.0::DOUBLE END AS counterfactual FROM ex2),
exr AS (SELECT *, (counterfactual - paid)*gallons + CASE WHEN k % 67 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS realized FROM ex)"""


def executions(spark, sf_dir):
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    k = F.col("o_orderkey")
    md5 = lambda *p: F.md5(F.concat(*p).cast("binary"))
    base = o.select(
        k.alias("k"), "o_custkey", F.to_date("o_orderdate").alias("d"), F.col("o_orderstatus").alias("series_id"),
        F.when(k % 101 == 0, 0).otherwise(1000 + k % 8000).alias("g"))
    k = F.col("k")
    key = k.cast("string")
    rec = lambda rid, sup, seq, day, gal: F.struct(
        rid.alias("record_id"), sup.cast("string").alias("supersedes"), seq.alias("seq"),
        day.alias("signal_date"), gal.cast("long").alias("gallons"))
    first = rec(md5(key), F.lit(None), k * 2, F.col("d"), F.col("g"))
    fix = rec(md5(F.lit("c"), key), F.when(k % 170 == 0, md5(F.lit("x"), key)).otherwise(md5(key)), k * 2 + 1,
              F.when(k % 190 == 0, F.date_add("d", 1)).otherwise(F.col("d")), F.col("g") + 10)
    again = rec(md5(F.lit("d"), key), md5(key), k * 2 + 2, F.col("d"), F.col("g"))
    rows = base.select("k", "o_custkey", "series_id", F.inline(F.array_compact(F.array(
        first, F.when(k % 10 == 0, fix), F.when(k % 230 == 0, again)))))
    day, flag = F.col("signal_date"), lambda c: c.cast("int")
    rows = rows.withColumns({
        "recommendation": F.when(k % 47 == 0, "UP").otherwise(F.element_at(
            F.array(F.lit("HIKE"), F.lit("DROP"), F.lit("FLAT")), (F.col("o_custkey") % 3 + 1).cast("int"))),
        "action": F.element_at(F.array(F.lit("DISPATCHED_SAME_DAY"), F.lit("WAITED"), F.lit("NO_ACTION")),
                               (k % 3 + 1).cast("int")),
        "load_date": F.when(k % 3 == 0, F.date_add(day, flag(k % 53 == 0))).when(
            k % 3 == 1, F.date_add(day, flag(k % 59 != 0))),
        "paid": F.when(k % 2 == 0, 2 + (k % 100) / 100.0),
        "counterfactual": F.when((k % 2 == 0) & (k % 61 != 0), 2.1 + (F.col("o_custkey") % 100) / 100.0)})
    gain = (F.col("counterfactual") - F.col("paid")) * F.col("gallons")
    return rows.withColumn("realized", gain + F.when(k % 67 == 0, 1.0).otherwise(0.0))


@query("execution_violations", with_ctes(EXEC, """
fx AS (SELECT a.*, t.seq AS t_seq, t.signal_date AS td, t.series_id AS tsr, row_number() OVER (PARTITION BY a.supersedes ORDER BY a.seq) AS cn FROM exr a LEFT JOIN exr t ON t.record_id = a.supersedes WHERE a.supersedes IS NOT NULL),
v AS (SELECT 'gallons' AS rule FROM exr WHERE gallons <= 0 UNION ALL SELECT 'recommendation_enum' FROM exr WHERE recommendation NOT IN ('HIKE','DROP','FLAT')
  UNION ALL SELECT 'same_day_date' FROM exr WHERE action = 'DISPATCHED_SAME_DAY' AND load_date IS DISTINCT FROM signal_date UNION ALL SELECT 'wait_date' FROM exr WHERE action = 'WAITED' AND load_date <= signal_date
  UNION ALL SELECT 'incomplete_prices' FROM exr WHERE (paid IS NULL) <> (counterfactual IS NULL) OR (paid IS NULL) <> (realized IS NULL)
  UNION ALL SELECT 'savings_mismatch' FROM exr WHERE abs(realized - (counterfactual - paid)*gallons) > 0.011
  UNION ALL SELECT 'supersedes_unknown' FROM fx WHERE t_seq IS NULL OR t_seq >= seq UNION ALL SELECT 'supersedes_twice' FROM fx WHERE cn > 1
  UNION ALL SELECT 'identity_changed' FROM fx WHERE t_seq IS NOT NULL AND (td <> signal_date OR tsr <> series_id))""", """
SELECT rule, count(*) AS violations FROM v GROUP BY 1"""))
def execution_violations(spark, sf_dir):
    return by_rule(ql.execution_violations(executions(spark, sf_dir)))


@query("execution_summary", with_ctes(EXEC, """
act AS (SELECT * FROM exr WHERE record_id NOT IN (SELECT supersedes FROM exr WHERE supersedes IS NOT NULL)),
dup AS (SELECT series_id, count(*) AS c FROM (SELECT series_id, signal_date FROM act GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)""", """
SELECT series_id, count(*) AS records, count(realized) AS priced, sum(gallons)::BIGINT AS gallons, round(coalesce(sum(realized), 0), 2) AS realized_dollars, count(*) - count(realized) AS unpriced,
  coalesce(max(c), 0) AS crowded_days FROM act LEFT JOIN dup USING (series_id) GROUP BY 1"""))
def execution_summary(spark, sf_dir):
    """Economics of the records no correction replaced, and days with several."""
    active = ledger.current_rows(executions(spark, sf_dir))
    # Per day first, so one status holding a third of all records spreads out.
    day = active.groupBy("series_id", "signal_date").agg(
        F.count("*").alias("records"), F.count("realized").alias("priced"), F.sum("gallons").alias("gallons"),
        F.sum("realized").alias("dollars"))
    return day.groupBy("series_id").agg(
        F.sum("records").alias("records"), F.sum("priced").alias("priced"), F.sum("gallons").alias("gallons"),
        F.round(F.coalesce(F.sum("dollars"), F.lit(0.0)), 2).alias("realized_dollars"),
        (F.sum("records") - F.sum("priced")).alias("unpriced"),
        count_if(F.col("records") > 1).alias("crowded_days"))


_RH = "sha256(session::VARCHAR || '|' || round(driver*1e6)::BIGINT || '|' || round(response*1e6)::BIGINT)"


@query("prefix_integrity", with_ctes(PANEL, f"""
n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY session) AS ord FROM wk),
st AS (SELECT series_id, ord, {_RH} AS h FROM n WHERE session < DATE '2001-01-01'),
cu AS (SELECT series_id, ord, CASE WHEN {B(17)} = 0 THEN sha256('edited') ELSE {_RH} END AS h FROM n WHERE series_id = 'F' OR session < DATE '2000-12-15')""", """
SELECT series_id, CASE WHEN st.h IS NULL THEN 'appended' WHEN cu.h IS NULL THEN 'truncated' WHEN st.h <> cu.h THEN 'changed' ELSE 'ok' END AS status, count(*) AS rows,
  min(ord) AS first_ord FROM st FULL JOIN cu USING (series_id, ord) GROUP BY 1, 2"""))
def prefix_integrity(spark, sf_dir):
    """Recorded hashes to the end of 2000 against an edited, partly cut ledger."""
    rows = durable(weekdays(daily_panel(spark, sf_dir)).withColumn("ord", F.row_number().over(by_session())))
    h = ql.row_hash("session", "driver", "response")
    stored = rows.where("session < DATE '2001-01-01'").withColumn("h", h)
    current = rows.where("series_id = 'F' OR session < DATE '2000-12-15'").withColumn(
        "h", F.when(b(17) == 0, F.sha2(F.lit("edited"), 256)).otherwise(h))
    return ql.prefix_integrity(stored, current).groupBy("series_id", "status").agg(
        F.count("*").alias("rows"), F.min("ord").alias("first_ord"))


HASHES = f"""
hh AS (SELECT series_id, sha256(string_agg({_RH}, '' ORDER BY session)) AS history_hash, count(*) AS rows, max(session) AS last_session FROM wk GROUP BY 1)"""


@query("history_hash", with_ctes(PANEL, HASHES, "SELECT * FROM hh"))
def history_hash(spark, sf_dir):
    return ql.history_hash(weekdays(daily_panel(spark, sf_dir)))


VEND = f"""
vn AS (SELECT series_id, session, s AS symbol, driver + CASE s WHEN 'near' THEN 0.0 WHEN 'mid' THEN CASE WHEN {B(18)} < 3 THEN 0.0 ELSE 0.10 END WHEN 'far' THEN 0.20 END::DOUBLE AS close
  FROM wk, (VALUES ('near'), ('mid'), ('far')) t(s)),
sd AS (SELECT series_id, session, driver + CASE WHEN {B(18)} BETWEEN 8 AND 15 THEN 0.10 ELSE 0.0 END::DOUBLE AS stored,
  CASE WHEN {B(18)} BETWEEN 16 AND 23 THEN NULL WHEN {B(18)} BETWEEN 24 AND 27 THEN driver + 0.05 WHEN {B(18)} IN (0, 1) THEN driver - 0.0 ELSE driver END AS continuous FROM wk)"""


def vendor_closes(panel):
    """Closes of three listed contracts; two coincide now and then."""
    off = F.array(F.struct(F.lit("near").alias("symbol"), F.lit(0.0).alias("o")),
                  F.struct(F.lit("mid").alias("symbol"), F.when(b(18) < 3, 0.0).otherwise(0.10).alias("o")),
                  F.struct(F.lit("far").alias("symbol"), F.lit(0.20).alias("o")))
    return panel.select("series_id", "session", "driver", F.inline(off)).select(
        "series_id", "session", "symbol", (F.col("driver") + F.col("o")).alias("close"))


@query("contract_audit", with_ctes(PANEL, VEND, """
j AS (SELECT sd.*, count(*) FILTER (WHERE abs(close - stored) <= 0.00015) AS stored_matches, count(*) FILTER (WHERE abs(close - continuous) <= 0.00015) AS active_matches
  FROM sd JOIN vn USING (series_id, session) GROUP BY ALL),
s AS (SELECT *, CASE WHEN continuous IS NULL THEN 'unverifiable' WHEN abs(stored - continuous) <= 0.00015 THEN 'verified' ELSE 'mismatch' END AS status FROM j)""", """
SELECT series_id, session, status, stored_matches::INT AS stored_matches, active_matches::INT AS active_matches, status = 'mismatch' AND active_matches = 1 AS correction_eligible FROM s"""))
def contract_audit(spark, sf_dir):
    panel = weekdays(daily_panel(spark, sf_dir))
    t = b(18)
    stored = panel.select(
        "series_id", "session", (F.col("driver") + F.when(t.between(8, 15), 0.10).otherwise(0.0)).alias("stored"),
        F.when(t.between(16, 23), F.lit(None)).when(t.between(24, 27), F.col("driver") + 0.05)
        .otherwise(F.col("driver")).alias("continuous"))
    return ql.contract_audit(stored, vendor_closes(panel))


@query("contract_status", with_ctes(CAL, PANEL, f"""
s AS (SELECT w.series_id, {B(19)} AS t, c.front_refined AS f, p.front_refined AS pf FROM wk w JOIN cal c ON c.d = w.session JOIN cal p ON p.d = c.prev_bd),
x AS (SELECT series_id, CASE WHEN t < 4 THEN NULL ELSE f END AS act, CASE WHEN t BETWEEN 4 AND 7 THEN NULL ELSE pf END AS base, CASE WHEN t BETWEEN 8 AND 11 THEN f + 31 ELSE f END AS snap, t % 2 = 0 AS used FROM s)""", """
SELECT series_id, CASE WHEN act IS NULL OR base IS NULL THEN 'unavailable' WHEN act <> base THEN 'mismatch_suppressed' WHEN used AND snap <> act THEN 'mismatch_suppressed' ELSE 'verified' END AS status, count(*) AS verdicts FROM x GROUP BY 1, 2"""))
def contract_status(spark, sf_dir):
    cal = business_calendar(spark)
    panel = weekdays(daily_panel(spark, sf_dir))
    prior = cal.select(F.col("d").alias("prev_bd"), F.col("front_refined").alias("pf"))
    days = cal.select(F.col("d").alias("session"), "prev_bd", "front_refined").join(F.broadcast(prior), "prev_bd")
    t = b(19)
    rows = panel.join(F.broadcast(days), "session")
    status = ql.contract_status(
        F.when(t >= 4, F.col("front_refined")), F.when(~t.between(4, 7), F.col("pf")),
        F.when(t.between(8, 11), F.date_add("front_refined", 31)).otherwise(F.col("front_refined")), t % 2 == 0)
    return rows.groupBy("series_id", status.alias("status")).agg(F.count("*").alias("verdicts"))


@query("baseline_pick", with_ctes(CAL, PANEL, f"""
dy AS (SELECT w.series_id, w.session, c.prev_bd, c.is_roll, c.front_refined AS active FROM wk w JOIN cal c ON c.d = w.session),
pv AS (SELECT series_id, session, driver AS price, c.front_refined AS symbol FROM wk JOIN cal c ON c.d = session WHERE {B(20)} < 160),
vd AS (SELECT w.series_id, w.session, p.driver + CASE WHEN {byte(20, 'w.series_id', 'w.session')} % 5 = 0 THEN 0.08 ELSE 0.002 END::DOUBLE AS close FROM wk w JOIN cal c ON c.d = w.session JOIN wk p ON p.series_id = w.series_id AND p.session = c.prev_bd
   WHERE {byte(21, 'w.series_id', 'w.session')} >= 32),
hs AS (SELECT * FROM wk WHERE {B(21)} % 16 <> 1),
j AS (SELECT dy.*, pv.price AS pp, pv.symbol = dy.active AS same, hs.driver AS hp, vd.close AS vp FROM dy LEFT JOIN pv ON pv.series_id = dy.series_id AND pv.session = dy.prev_bd
  LEFT JOIN hs ON hs.series_id = dy.series_id AND hs.session = dy.prev_bd LEFT JOIN vd ON vd.series_id = dy.series_id AND vd.session = dy.session),
k AS (SELECT *, pp IS NOT NULL AND same AS sm, CASE WHEN pp IS NOT NULL AND same THEN pp WHEN hp IS NOT NULL AND NOT is_roll THEN hp END AS rec FROM j),
l AS (SELECT *, rec IS NOT NULL AND (vp IS NULL OR abs(rec - vp) <= 0.05) AS fits FROM k)""", """
SELECT series_id, session, CASE WHEN fits AND sm THEN 'provenance_verified' WHEN fits THEN 'history_same_contract' WHEN vp IS NOT NULL THEN 'exchange_close' WHEN hp IS NOT NULL THEN 'history_unverified' ELSE 'none' END AS source,
  CASE WHEN fits THEN rec ELSE coalesce(vp, hp) END AS baseline FROM l"""))
def baseline_pick(spark, sf_dir):
    cal = business_calendar(spark)
    panel = durable(weekdays(daily_panel(spark, sf_dir)))
    days = cal.select(F.col("d").alias("session"), "prev_bd", "is_roll", F.col("front_refined").alias("active"))
    rows = panel.select("series_id", "session").join(F.broadcast(days), "session")
    prov = (panel.where(b(20) < 160).join(F.broadcast(days.select("session", F.col("active").alias("symbol"))), "session")
            .withColumnRenamed("driver", "price"))
    prior = panel.select("series_id", F.col("session").alias("prev_bd"), F.col("driver").alias("p"))
    vendor = (rows.join(prior, ["series_id", "prev_bd"]).where(b(21) >= 32)
              .select("series_id", "session", (F.col("p") + F.when(b(20) % 5 == 0, 0.08).otherwise(0.002)).alias("close")))
    return ql.baseline_pick(rows, prov, panel.where(b(21) % 16 != 1), vendor)


@query("calibration_current", with_ctes(CAL, PANEL, HASHES, """
pb AS (SELECT series_id, CASE WHEN series_id = 'F' THEN history_hash ELSE sha256('older') END AS old_hash, 'passthrough_v2' AS method, next_bd AS occupied FROM hh JOIN cal ON cal.d = last_session)""", """
SELECT hh.series_id, old_hash = history_hash AND occupied >= c.next_bd AS current, CASE WHEN old_hash = history_hash AND occupied >= c.next_bd THEN occupied WHEN occupied >= c.next_bd THEN o.next_bd ELSE c.next_bd END AS effective_session
FROM hh JOIN pb USING (series_id) JOIN cal c ON c.d = last_session JOIN cal o ON o.d = occupied"""))
def calibration_current(spark, sf_dir):
    """One series is unchanged; the other's history differs from its artifact."""
    cal = business_calendar(spark)
    fresh = durable(ql.history_hash(weekdays(daily_panel(spark, sf_dir))))
    days = cal.select(F.col("d").alias("last_session"), F.col("next_bd").alias("occupied"))
    published = fresh.join(F.broadcast(days), "last_session").select(
        "series_id", F.when(F.col("series_id") == "F", F.col("history_hash")).otherwise(
            F.sha2(F.lit("older"), 256)).alias("old_hash"), F.lit("passthrough_v2").alias("method"), "occupied")
    return ql.calibration_current(fresh, published, cal, "passthrough_v2")


@query("artifact_asof", with_ctes(LOG, """
SELECT l.series_id, l.session, e.artifact_id AS exact_id, (SELECT arg_max(a.artifact_id, a.effective_session) FROM arts a WHERE a.series_id = l.series_id AND a.effective_session <= l.session) AS asof_id
FROM log l LEFT JOIN arts e ON e.series_id = l.series_id AND e.effective_session = l.session"""))
def artifact_asof(spark, sf_dir):
    train = cut_train(spark, sf_dir)
    arts = durable(ledger.artifacts(train).select("series_id", "effective_session", "artifact_id"))
    return ql.artifact_lookup(train.where(F.col("ord") > ledger.ARTIFACT_FIRST), arts)


@query("training_cut", with_ctes(ARTIFACTS, """
SELECT a.series_id, a.effective_session, count(*) AS eligible_rows, max(t.session) AS last_eligible, bool_and(training_end < a.effective_session) AS no_leak, max(t.session) = max(training_end) AS uses_latest
FROM arts a JOIN train t ON t.series_id = a.series_id AND t.session < a.effective_session GROUP BY 1, 2"""))
def training_cut(spark, sf_dir):
    train = cut_train(spark, sf_dir)
    return ql.training_cut(train, ledger.artifacts(train)).withColumn(
        "eligible_rows", F.col("eligible_rows").cast("long"))
