"""Sources, ledgers and posted text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sluice.functions.calendar import MONTH_CODES, central_time, session_date
from sluice.functions.exprs import count_if, r6, tick_order
from sluice.operators import ledger, postings as po
from sluice.operators.ledger import byte_of
from sluice.plans.base import artifacts_of, log_of
from sluice.plans.ctes import ARTIFACTS, LOG, PANEL, byte
from sluice.plans.registry import query, with_ctes
from sluice.session import durable, shared_folder
from sluice.sources import records as rec
from sluice.sources.panel import daily_panel, read, weekdays

B = lambda i: byte(i, "series_id", "session")


def key_byte(i):
    return byte_of(i, "series_id", "session")


@query("log_append_absent", with_ctes(LOG, """
SELECT series_id, session, direction, signal_price + CASE WHEN """ + byte(11, "series_id", "session") + """ < 8 THEN 0.01 ELSE 0 END AS signal_price,
  """ + byte(11, "series_id", "session") + """ < 8 AS conflict FROM log WHERE session >= DATE '2000-01-01'"""))
def log_append_absent(spark, sf_dir):
    """A whole log delivered again and twice over: only unknown keys append, and
    those whose two deliveries differ are conflicts."""
    log = log_of(spark, sf_dir).select("series_id", "session", "direction", "signal_price")
    stored = log.where("session < DATE '2000-01-01'")
    changed = F.col("signal_price") + F.when(key_byte(11) < 8, 0.02).otherwise(0.0)
    moved = F.col("signal_price") + F.when(key_byte(11) < 8, 0.01).otherwise(0.0)
    twice = log.withColumn("signal_price", moved).unionByName(log.withColumn("signal_price", changed))
    return ledger.append_absent(stored, twice, ["series_id", "session"])


@query("artifact_append_status", with_ctes(ARTIFACTS, """
i AS (SELECT series_id, effective_session, prior_artifact_id AS prior, artifact_id AS orig, CASE WHEN block % 7 = 0 THEN sha256(artifact_id || 'edited') ELSE artifact_id END AS new_id, block % 11 = 5 AS twice FROM arts),
s AS (SELECT i.*, CASE WHEN effective_session BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' THEN orig END AS old_id FROM i),
m AS (SELECT *, max(CASE WHEN old_id IS NOT NULL THEN effective_session END) OVER (PARTITION BY series_id) AS newest FROM s),
sound AS (SELECT series_id, effective_session, coalesce(old_id, new_id) AS id FROM m WHERE old_id IS NOT NULL OR (NOT twice AND (newest IS NULL OR effective_session > newest))),
x AS (SELECT m.*, coalesce((SELECT arg_max(id, effective_session) FROM sound s WHERE s.series_id = m.series_id AND s.effective_session < m.effective_session), 'bootstrap_config') AS before FROM m),
y AS (SELECT * FROM x UNION ALL SELECT * REPLACE (sha256(orig || 'again') AS new_id) FROM x WHERE twice)""", """
SELECT series_id, effective_session, old_id, new_id, CASE WHEN old_id = new_id THEN 'same' WHEN old_id IS NOT NULL OR twice THEN 'conflict' WHEN effective_session < newest THEN 'out_of_order'
  WHEN prior <> before THEN 'broken_chain' ELSE 'new' END AS status FROM y"""))
def artifact_append_status(spark, sf_dir):
    """All artifacts against a ledger of one year; some are edited, some arrive with two ids."""
    arts = durable(artifacts_of(spark, sf_dir).select(
        "series_id", "block", "effective_session", "artifact_id", "prior_artifact_id", "training_end"))
    stored = arts.where("effective_session BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")
    other = lambda word: F.sha2(F.concat("artifact_id", F.lit(word)), 256)
    incoming = arts.withColumn("artifact_id", F.when(F.col("block") % 7 == 0, other("edited")).otherwise(F.col("artifact_id")))
    again = arts.where("block % 11 = 5").withColumn("artifact_id", other("again"))
    return ledger.append_status(stored, incoming.unionByName(again), "effective_session")


@query("log_table_rerun", with_ctes(LOG, """
d AS (SELECT 1 AS delivery, series_id, session FROM log WHERE session < DATE '1998-01-01' UNION ALL SELECT 2, series_id, session FROM log),
s AS (SELECT delivery, CASE WHEN delivery = 2 AND session < DATE '1998-01-01' THEN CASE WHEN """ + byte(12, "series_id", "session") + """ < 8 THEN 'conflict' ELSE 'present' END ELSE 'appended' END AS status FROM d
  UNION ALL SELECT 3, CASE WHEN session < DATE '1998-01-01' AND """ + byte(12, "series_id", "session") + """ < 8 THEN 'conflict' ELSE 'present' END FROM log)""", """
SELECT delivery, status, count(*) AS keys, (SELECT count(*) FROM log) AS filed FROM s GROUP BY 1, 2"""))
def log_table_rerun(spark, sf_dir):
    """Three deliveries into one ledger table: a part, all with some rows changed, the same again."""
    log = log_of(spark, sf_dir).select("series_id", "session", "direction", "signal_price")
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    early = F.col("session") < F.lit("1998-01-01").cast("date")
    changed = F.col("signal_price") + F.when(early & (key_byte(12) < 8), 0.01).otherwise(0.0)
    second = log.withColumn("signal_price", changed)
    told = [ledger.append_table(rows, path, ["series_id", "session"]).withColumn("delivery", F.lit(k))
            for k, rows in enumerate((log.where(early), second, second), 1)]
    filed = ledger.table_at(path, log).agg(F.count("*").alias("filed"))
    every = told[0].unionByName(told[1]).unionByName(told[2])
    return every.groupBy("delivery", "status").agg(F.count("*").alias("keys")).join(F.broadcast(filed))


@query("artifact_ledger_filed", with_ctes(ARTIFACTS, """
e AS (SELECT series_id, effective_session AS es, block % 13 = 7 AS ed, lag(block) OVER (PARTITION BY series_id ORDER BY effective_session) % 13 = 7 AS after_ed, effective_session < DATE '1998-01-01' AS early FROM arts),
f AS (SELECT series_id, min(CASE WHEN ed AND NOT early THEN es END) AS cut FROM e GROUP BY 1),
g AS (SELECT e.*, cut, cut IS NULL OR es <= cut AS before, es = (SELECT min(es) FROM e x WHERE x.series_id = e.series_id AND x.es > cut) AS next FROM e JOIN f USING (series_id)),
s AS (SELECT 1 AS delivery, series_id, 'new' AS status FROM g WHERE early
  UNION ALL SELECT 2, series_id, CASE WHEN early AND ed THEN 'conflict' WHEN early THEN 'same' WHEN before THEN 'new' WHEN after_ed THEN 'broken_chain' ELSE 'held_back' END FROM g
  UNION ALL SELECT 3, series_id, CASE WHEN es = cut THEN 'conflict' WHEN early OR before THEN 'same' WHEN next THEN 'broken_chain' ELSE 'held_back' END FROM g)""", """
SELECT delivery, series_id, status, count(*) AS artifacts, (SELECT count(*) FROM g WHERE g.series_id = s.series_id AND (early OR before)) AS filed FROM s GROUP BY 1, 2, 3"""))
def artifact_ledger_filed(spark, sf_dir):
    """Three deliveries into one chained ledger: a part, all with some ids edited, all as they were."""
    arts = durable(artifacts_of(spark, sf_dir).select(
        "series_id", "block", "effective_session", "artifact_id", "prior_artifact_id", "training_end"))
    other = F.sha2(F.concat("artifact_id", F.lit("edited")), 256)
    edited = arts.withColumn("artifact_id", F.when(F.col("block") % 13 == 7, other).otherwise(F.col("artifact_id")))
    path = f"{shared_folder(spark)}/artifacts-{uuid.uuid4().hex}"
    early = arts.where("effective_session < DATE '1998-01-01'")
    told = [ledger.file_artifacts(rows.drop("block"), path).withColumn("delivery", F.lit(k))
            for k, rows in enumerate((early, edited, arts), 1)]
    filed = ledger.table_at(path, arts.drop("block")).groupBy("series_id").agg(F.count("*").alias("filed"))
    every = told[0].unionByName(told[1]).unionByName(told[2])
    return every.groupBy("delivery", "series_id", "status").agg(F.count("*").alias("artifacts")).join(filed, "series_id")


@query("write_once_records", with_ctes(PANEL, f"""
r AS (SELECT 'input' AS kind, session FROM wk GROUP BY 2 UNION ALL SELECT 'forecast', session FROM wk GROUP BY 2 HAVING max({byte(13, 'session')}) < 200)""", f"""
SELECT kind, CASE WHEN {byte(14, 'session')} < 24 THEN 'conflict' ELSE 'present' END AS status, count(*) AS records FROM r GROUP BY 1, 2"""))
def write_once_records(spark, sf_dir):
    """Sealed records keyed by (kind, session): a second delivery files nothing and may not differ."""
    days = weekdays(daily_panel(spark, sf_dir)).groupBy("session").agg(F.sum("driver").alias("total"))
    body = F.sha2(F.round("total", 9).cast("string"), 256)
    record = lambda kind, rows: rows.select(F.lit(kind).alias("kind"), "session", body.alias("body"))
    first = durable(record("input", days).unionByName(record("forecast", days.where(byte_of(13, "session") < 200))))
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    ledger.append_table(first, path, ["kind", "session"])
    again = first.withColumn("body", F.when(byte_of(14, "session") < 24, F.sha2("body", 256)).otherwise(F.col("body")))
    told = ledger.append_table(again, path, ["kind", "session"])
    return told.groupBy("kind", "status").agg(F.count("*").alias("records"))


@query("settle_priority_pick", with_ctes(LOG, f"""
c AS (SELECT series_id, session, 1 AS priority, CASE WHEN {B(6)} >= 32 THEN driver END AS price, 'daily_file' AS source FROM wk WHERE {B(6)} < 96
  UNION ALL SELECT series_id, session, 2, signal_price, 'log_snapshot' FROM log UNION ALL SELECT series_id, session, 3, driver, 'history' FROM wk)""", """
SELECT series_id, session, min(priority) AS priority, arg_min(price, priority) AS price, arg_min(source, priority) AS source FROM c WHERE price IS NOT NULL GROUP BY 1, 2"""))
def settle_priority_pick(spark, sf_dir):
    panel = weekdays(daily_panel(spark, sf_dir))
    cand = lambda df, k, price, name: df.select(
        "series_id", "session", F.lit(k).alias("priority"), F.col(price).alias("price"), F.lit(name).alias("source"))
    # The daily file holds some sessions without a price.
    daily = panel.where(key_byte(6) < 96).withColumn("driver", F.when(key_byte(6) >= 32, F.col("driver")))
    return rec.priority_pick(
        cand(daily, 1, "driver", "daily_file")
        .unionByName(cand(log_of(spark, sf_dir), 2, "signal_price", "log_snapshot"))
        .unionByName(cand(panel, 3, "driver", "history")), ["series_id", "session"], "price")


@query("null_only_backfill", with_ctes(PANEL, f"""
o AS (SELECT series_id, session, CASE WHEN {B(7)} < 32 THEN NULL ELSE driver END AS old FROM wk),
e AS (SELECT series_id, session, driver + 0.01::DOUBLE AS ext FROM wk WHERE {B(8)} >= 32)""", """
SELECT series_id, session, coalesce(old, ext) AS driver, CASE WHEN old IS NOT NULL THEN 'kept' WHEN ext IS NOT NULL THEN 'filled' ELSE 'missing' END AS status FROM o LEFT JOIN e USING (series_id, session)"""))
def null_only_backfill(spark, sf_dir):
    panel = weekdays(daily_panel(spark, sf_dir))
    old = panel.select("series_id", "session", F.when(key_byte(7) >= 32, F.col("driver")).alias("old"))
    ext = panel.where(key_byte(8) >= 32).select("series_id", "session", (F.col("driver") + 0.01).alias("ext"))
    return old.join(ext, ["series_id", "session"], "left").select(
        "series_id", "session", F.coalesce("old", "ext").alias("driver"),
        F.when(F.col("old").isNotNull(), "kept").when(F.col("ext").isNotNull(), "filled").otherwise("missing").alias("status"))


@query("config_overlay", """
WITH a AS (SELECT l_suppkey, count(*) AS n, max(l_discount) AS md FROM lineitem GROUP BY 1),
l AS (SELECT s_suppkey, 0 AS rank, unnest(['TARGET', 'NOISE_FLOOR', 'BUY_COST_CENTS_PER_GAL']) AS name, unnest([0.75, 0.6, 0.0]::DOUBLE[]) AS value FROM supplier
  UNION ALL SELECT s_suppkey, 1, 'BUY_COST_CENTS_PER_GAL', 0.5 FROM supplier WHERE s_acctbal < 0
  UNION ALL SELECT s_suppkey, 1, 'NOISE_FLOOR', 1.2 FROM supplier WHERE s_acctbal > 5000
  UNION ALL SELECT l_suppkey, 2, 'NOISE_FLOOR', md FROM a WHERE l_suppkey % 3 = 0
  UNION ALL SELECT l_suppkey, 2, 'LINES', n FROM a)
SELECT s_suppkey, name, arg_max(value, rank) AS value, max(rank) AS rank FROM l GROUP BY 1, 2""")
def config_overlay(spark, sf_dir):
    """Per-supplier parameters: defaults < configuration < generated cache."""
    supplier = read(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal")
    cache = read(spark, sf_dir, "lineitem", "l_suppkey", "l_discount").groupBy(
        F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count("*").cast("double").alias("n"), F.max("l_discount").alias("md"))
    row = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"))
    layer = lambda df, rank, *rows: df.select("s_suppkey", F.lit(rank).alias("rank"), F.inline(F.array(*rows)))
    cost = "BUY_COST_CENTS_PER_GAL"
    layers = [
        layer(supplier, 0, row("TARGET", F.lit(0.75)), row("NOISE_FLOOR", F.lit(0.6)), row(cost, F.lit(0.0))),
        layer(supplier.where("s_acctbal < 0"), 1, row(cost, F.lit(0.5))),
        layer(supplier.where("s_acctbal > 5000"), 1, row("NOISE_FLOOR", F.lit(1.2))),
        layer(cache.where("s_suppkey % 3 = 0"), 2, row("NOISE_FLOOR", F.col("md"))),
        # The cache also carries a stale statistic and a copied policy key.
        layer(cache, 2, row("LINES", F.col("n")), row("LINES_historical_win_rate", F.col("md")), row(cost, F.lit(9.0)))]
    both = layers[0]
    for part in layers[1:]:
        both = both.unionByName(part)
    return rec.overlay(both, ["s_suppkey"], ("_COST_CENTS_PER_GAL",), ("_historical_win_rate", "_average_savings"), 2)


TICKS = """
tick AS (SELECT event_id, event_type AS instrument, ts, 2 + value/500 AS px, value, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS lt FROM events),
tk AS (SELECT *, CASE WHEN hour(lt) >= 17 THEN CAST(lt AS DATE) + 1 ELSE CAST(lt AS DATE) END AS session FROM tick),
bars AS (SELECT instrument, session, first(px ORDER BY ts, event_id) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY ts, event_id) AS close, count(*) AS ticks FROM tk GROUP BY 1, 2)"""


def ticks_of(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "ts", "event_type", "value")
    lt = central_time(F.col("ts"))
    return e.select("event_id", F.col("event_type").alias("instrument"), "ts", "value",
                    (2 + F.col("value") / 500).alias("px"), lt.alias("lt"), session_date(lt).alias("session"))


@query("session_ohlc", with_ctes(TICKS, """
SELECT *, max(close) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS high_5, min(close) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS low_5,
  round(avg(close) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 9) AS mean_30, CASE WHEN row_number() OVER w > 3 THEN round(avg(close) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 9) END AS sma_3,
  CASE WHEN row_number() OVER w > 10 THEN round(avg(close) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 9) END AS sma_10, lag(close) OVER w AS prior_close
FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY session)"""))
def session_ohlc(spark, sf_dir):
    b = rec.bar_context(rec.session_bars(ticks_of(spark, sf_dir)))
    return b.withColumns({c: F.round(c, 9) for c in ("mean_30", "sma_3", "sma_10")})


@query("tick_upsert", with_ctes(TICKS, """
SELECT instrument, session, date_trunc('hour', lt) AS stamp, arg_max(px, event_id) AS px, count(*) AS writes FROM tk GROUP BY 1, 2, 3"""))
def tick_upsert(spark, sf_dir):
    return rec.upsert_ticks(ticks_of(spark, sf_dir), F.date_trunc("hour", "lt").cast("timestamp_ntz"))


@query("swing_alerts", with_ctes(TICKS, """
po AS (SELECT instrument, session, CAST(lt AS DATE) AS day, (hour(lt)*12 + minute(lt)//5)::INT AS slot, last(px ORDER BY ts, event_id) AS px, strftime(max(lt) + INTERVAL 10 DAY + INTERVAL 12 HOUR, '%Y-%m') AS contract FROM tk GROUP BY 1, 2, 3, 4),
pi AS (SELECT *, row_number() OVER (PARTITION BY instrument, session ORDER BY day, slot) AS i FROM po),
br AS (SELECT instrument, session, coalesce(lag(close) OVER (PARTITION BY instrument ORDER BY session), open) AS base FROM bars),
st AS (SELECT pi.*, base, (px - base)/base*100 AS swing, NULL::DOUBLE AS ap, '' AS ac FROM pi JOIN br ON br.instrument = pi.instrument AND br.session = pi.session WHERE i = 1
  UNION ALL SELECT instrument, session, day, slot, px, contract, i, base, (px - ref)/ref*100, ap, ac FROM (
   SELECT p.*, r.base, r.ap, r.ac, CASE WHEN r.ac = p.contract THEN r.ap ELSE r.base END AS ref FROM
    (SELECT instrument, session, i, base, CASE WHEN abs(swing) >= 1.5 THEN round(px, 4) ELSE ap END AS ap, CASE WHEN abs(swing) >= 1.5 THEN contract ELSE ac END AS ac FROM st) r
    JOIN pi p ON p.instrument = r.instrument AND p.session = r.session AND p.i = r.i + 1))""", """
SELECT instrument, session, day, slot, contract, px, round(swing, 6) AS swing FROM st WHERE abs(swing) >= 1.5"""))
def swing_alerts(spark, sf_dir):
    ticks = ticks_of(spark, sf_dir)
    bars = rec.bar_context(rec.session_bars(ticks))
    return rec.swing_alerts(rec.polls(ticks), bars).withColumn("swing", r6("swing"))


@query("candle_explode", with_ctes(TICKS, """
c AS (SELECT instrument, CAST(ts AS DATE) AS session, last(CASE WHEN value < 5 THEN NULL ELSE px END ORDER BY ts, event_id) AS close FROM tk GROUP BY 1, 2)""", """
SELECT * FROM c WHERE close IS NOT NULL"""))
def candle_explode(spark, sf_dir):
    """Candle arrays as a vendor returns them, flattened; one entry per day."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    candle = F.max_by(F.when(F.col("value") >= 5, F.col("px")), tick_order())
    daily = ticks_of(spark, sf_dir).groupBy("instrument", day.alias("day")).agg(candle.alias("close"))
    millis = F.unix_millis(F.to_utc_timestamp(F.col("day").cast("timestamp"), F.current_timezone()))
    payload = daily.groupBy("instrument").agg(F.to_json(F.sort_array(F.collect_list(F.struct(
        millis.alias("datetime"), F.col("close"))))).alias("candles"))
    return rec.candle_closes(payload, "candles")


@query("quote_active_symbol", """
WITH o AS (SELECT o_orderkey % 5 AS tier, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
  substr('FGHJKMNQUVXZ', month(o_orderdate)::INT, 1) || lpad((year(o_orderdate) % 100)::VARCHAR, 2, '0') AS code FROM orders)
SELECT month, CASE WHEN tier IN (0, 1, 2) THEN '/RB' || code END AS symbol, count(*) AS quotes FROM o GROUP BY 1, 2""")
def quote_active_symbol(spark, sf_dir):
    """Active contract out of nested quote responses, one response per order.

    The responses exercise every tier: declared on the root, declared once
    elsewhere, declared twice differently but flagged once, flagged twice, and
    malformed.
    """
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    tier = F.col("o_orderkey") % 5
    code = F.concat(F.substring(F.lit(MONTH_CODES), F.month("o_orderdate"), F.lit(1)),
                    F.lpad((F.year("o_orderdate") % 100).cast("string"), 2, "0"))
    entry = lambda key, active, flag, quote: F.concat(
        F.lit(f'"{key}":{{"reference":{{"futureActiveSymbol":'), active, F.lit(',"futureIsActive":'), flag,
        F.lit('},"quote":{"symbol":'), quote, F.lit("}}"))
    null, text = F.lit("null"), lambda *p: F.concat(F.lit('"'), *p, F.lit('"'))
    later = F.lpad(((F.year("o_orderdate") + 1) % 100).cast("string"), 2, "0")
    sym, other = text(F.lit("/RB"), code), text(F.lit("/RBF"), later)
    body = (F.when(tier == 0, entry("/RB", text(F.lit("rb"), F.lower(code), F.lit(":XNYM")), null, null))
            .when(tier == 1, F.concat(entry("a", sym, null, null), F.lit(","), entry("b", sym, null, null)))
            .when(tier == 2, F.concat(entry("a", sym, F.lit("true"), sym), F.lit(","), entry("b", other, F.lit('"false"'), other)))
            .when(tier == 3, F.concat(entry("a", null, F.lit('"True"'), sym), F.lit(","), entry("b", null, F.lit("true"), other)))
            .otherwise(entry("/RB", text(F.lit("XX")), null, null)))
    parsed = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), rec.QUOTE_SCHEMA)
    return o.select(F.to_date(F.trunc(F.to_date("o_orderdate"), "MM")).alias("month"),
                    rec.active_symbol(parsed, "RB").alias("symbol")).groupBy("month", "symbol").agg(
        F.count("*").alias("quotes"))


@query("snapshot_complete_pairs", with_ctes(LOG, """
v AS (SELECT * FROM log WHERE prediction_source = 'live' AND snapshot_based AND baseline_source <> 'exchange_close' AND signal_price > 0),
k AS (SELECT session FROM v GROUP BY 1 HAVING count(DISTINCT series_id) = (SELECT count(DISTINCT series_id) FROM log))""", """
SELECT session, series_id, round(max(signal_price), 6) AS price FROM v JOIN k USING (session) GROUP BY 1, 2"""))
def snapshot_complete_pairs(spark, sf_dir):
    """Sessions whose verified snapshots cover every series."""
    ok = ((F.col("prediction_source") == "live") & ledger.settlement_based(F.col("settlement_source"))
          & (F.col("baseline_source") != "exchange_close") & (F.col("signal_price") > 0))
    log = log_of(spark, sf_dir)
    total = log.agg(F.countDistinct("series_id").alias("total"))  # one row
    prices = log.where(ok).groupBy("session", "series_id").agg(F.max("signal_price").alias("price"))
    complete = (prices.groupBy("session").agg(F.count("*").alias("k")).join(F.broadcast(total))
                .where("k = total").select("session"))
    return prices.join(complete, "session").select("session", "series_id", r6("price").alias("price"))


@query("malformed_quarantine", """
WITH l AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN substr(md5(o_orderkey::VARCHAR), 1, 1) = '0' THEN 'short'
  WHEN substr(md5(o_orderkey::VARCHAR), 1, 1) = '1' THEN 'text' ELSE 'good' END AS kind FROM orders)
SELECT year(d)::INT AS y, count(*) AS lines, count(*) FILTER (WHERE kind <> 'good') AS quarantined, coalesce(sum(o_custkey) FILTER (WHERE kind = 'good'), 0)::BIGINT AS key_sum FROM l GROUP BY 1""")
def malformed_quarantine(spark, sf_dir):
    """Order lines as delimited text; broken ones may stand anywhere."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    h = F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 1)
    day = F.to_date("o_orderdate").cast("string")
    key = F.col("o_orderkey").cast("string")
    line = (F.when(h == "0", F.concat_ws(",", key, day))
            .when(h == "1", F.concat_ws(",", key, day, F.lit("n/a")))
            .otherwise(F.concat_ws(",", key, day, F.col("o_custkey").cast("string"))))
    rows = rec.split_malformed(o.select(F.year("o_orderdate").alias("y"), line.alias("line")),
                               "line", "k BIGINT, d DATE, c BIGINT")
    return rows.groupBy("y").agg(
        F.count("*").alias("lines"), count_if(F.col("quarantined")).alias("quarantined"),
        F.coalesce(F.sum(F.when(~F.col("quarantined"), F.col("c"))), F.lit(0)).alias("key_sum"))


@query("record_stem_check", with_ctes(PANEL, f"""
r AS (SELECT series_id, session, date_trunc('month', session)::DATE AS m, {B(9)} < 8 AS bad FROM wk)""", """
SELECT series_id, count(*) AS records, count(*) FILTER (WHERE bad) AS misfiled FROM r GROUP BY 1"""))
def record_stem_check(spark, sf_dir):
    """Records filed by month; a few were filed under the wrong one."""
    panel = weekdays(daily_panel(spark, sf_dir))
    month = F.trunc("session", "MM")
    stem = F.when(key_byte(9) < 8, F.add_months(month, 1)).otherwise(month).cast("string")
    back = rec.write_and_check_stems(panel.select("series_id", "session", "driver", stem.alias("stem")),
                                     "stem", F.col("stem") == month.cast("string"))
    return back.groupBy("series_id").agg(F.count("*").alias("records"),
                                         count_if(~F.col("stem_ok")).alias("misfiled"))


@query("jsonl_ledger", with_ctes(ARTIFACTS, """
l AS (SELECT series_id, CASE WHEN block % 6 = 1 THEN 'unreadable' WHEN block % 6 = 2 THEN 'missing_field' WHEN block % 6 = 3 THEN 'bad_date' ELSE 'ok' END AS status FROM arts)""", """
SELECT series_id, status, count(*) AS lines FROM l GROUP BY 1, 2"""))
def jsonl_ledger(spark, sf_dir):
    """Artifact lines as JSON text, checked line by line."""
    arts = artifacts_of(spark, sf_dir)
    day = F.when(F.col("block") % 6 == 3, "someday").otherwise(F.col("effective_session").cast("string"))
    record = F.struct(F.when(F.col("block") % 6 != 2, F.col("artifact_id")).alias("artifact_id"),
                      day.alias("effective_session"), F.col("training_end").cast("string").alias("training_end"),
                      F.struct("hike", "drop_").alias("calibration"))
    text = F.to_json(record)
    lines = arts.select("series_id", F.when(F.col("block") % 6 == 1, F.substring(text, 1, 40)).otherwise(text).alias("line"))
    return rec.checked_lines(lines, "line").groupBy("series_id", "status").agg(F.count("*").alias("lines"))


# --- posted text -----------------------------------------------------------

_P = lambda c: f"(floor(({c})*1e4)::BIGINT // 10000)::VARCHAR || '.' || lpad((floor(({c})*1e4)::BIGINT % 10000)::VARCHAR, 4, '0')"
_PK = lambda i: byte(i, "session")

POSTINGS = PANEL + f""",
pw AS (SELECT session, arg_min(response, series_id) AS u, arg_max(response, series_id) AS d FROM wk GROUP BY 1 HAVING count(*) > 1),
pt AS (SELECT 'p' || session::VARCHAR AS posting_id, session AS true_session, u, d, 'Daily notice' || chr(10) || '  E10 -  Unleaded : $' || {_P('u')} || chr(10)
  || CASE WHEN {_PK(0)} < 16 THEN 'Premium on request' ELSE 'E10 - PREMIUM, ' || {_P('u + CASE WHEN ' + _PK(0) + ' < 24 THEN 9.0 ELSE 0.2 END::DOUBLE')} END || chr(10)
  || 'CLEAR DIESEL/' || {_P('d')} || CASE WHEN {_PK(1)} < 64 THEN '' ELSE chr(10) || 'Good  from ' || month(session) || '/' || day(session) || '/' || year(session) END AS body,
  CASE WHEN {_PK(2)} < 128 THEN session::TIMESTAMP + INTERVAL 18 HOUR WHEN {_PK(2)} < 192 THEN session::TIMESTAMP + INTERVAL 31 HOUR ELSE session::TIMESTAMP + INTERVAL 35 HOUR END AS header_ts FROM pw),
docs AS (SELECT 'd' || doc_id AS posting_id, text AS body FROM documents)"""


def postings_of(spark, sf_dir):
    """One posting per session, some incomplete, undated or late."""
    panel = weekdays(daily_panel(spark, sf_dir))
    # The first and the last series that are priced on a day stand for two products.
    rows = panel.groupBy("session").agg(
        F.min_by("response", "series_id").alias("u"), F.max_by("response", "series_id").alias("d"),
        F.count("*").alias("k")).where("k > 1")

    def text(c):
        k = F.floor(c * 1e4)
        return F.concat(F.floor(k / 10000).cast("string"), F.lit("."), F.lpad((k % 10000).cast("string"), 4, "0"))

    b = lambda i: byte_of(i, "session")
    premium = F.when(b(0) < 16, "Premium on request").otherwise(F.concat(
        F.lit("E10 - PREMIUM, "), text(F.col("u") + F.when(b(0) < 24, 9.0).otherwise(0.2))))
    dated = F.concat(F.lit("\nGood  from "), F.month("session"), F.lit("/"), F.dayofmonth("session"),
                     F.lit("/"), F.year("session"))
    body = F.concat(F.lit("Daily notice\n  E10 -  Unleaded : $"), text(F.col("u")), F.lit("\n"), premium,
                    F.lit("\nCLEAR DIESEL/"), text(F.col("d")), F.when(b(1) < 64, "").otherwise(dated))
    start = F.to_timestamp_ntz(F.col("session").cast("string"), F.lit("yyyy-MM-dd"))
    hours = F.when(b(2) < 128, 18).when(b(2) < 192, 31).otherwise(35)
    return rows.select(F.concat(F.lit("p"), F.col("session").cast("string")).alias("posting_id"),
                       body.alias("body"), (start + F.make_dt_interval(F.lit(0), hours)).alias("header_ts"))


def texts_of(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text").select(
        F.concat(F.lit("d"), "doc_id").alias("posting_id"), F.col("text").alias("body"))
    return postings_of(spark, sf_dir).select("posting_id", "body").unionByName(docs)


_LINES = r"list_transform(string_split_regex(body, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{0085}\x{2028}\x{2029}]'), lambda l: regexp_replace(l, '[\s\x{00a0}]+', ' ', 'g'))"


def _near(label: str) -> str:
    return (f"TRY_CAST(list_filter(list_transform(lines, lambda l: regexp_extract(regexp_extract(l, '(?i){label}(.{{0,60}})', 1), "
            f"'\\$?([0-9]+\\.[0-9]{{2,5}})', 1)), lambda p: p <> '')[1] AS DOUBLE)")


PARSED = POSTINGS + f""",
tx AS (SELECT posting_id, body, {_LINES} AS lines FROM (SELECT posting_id, body FROM pt UNION ALL SELECT * FROM docs)),
px AS (SELECT posting_id, body, {_near('E10 - UNLEADED')} AS unleaded, {_near('E10 - PREMIUM')} AS premium, {_near('CLEAR DIESEL')} AS diesel FROM tx),
pr AS (SELECT *, CASE WHEN unleaded IS NULL OR premium IS NULL OR diesel IS NULL THEN 'missing_label'
  WHEN NOT (unleaded BETWEEN 1 AND 10 AND premium BETWEEN 1 AND 10 AND diesel BETWEEN 1 AND 10) THEN 'out_of_bounds' END AS reason FROM px),
""" + r"""
pd AS (SELECT *, regexp_extract(body, '(?i)good\s+from\s+([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})', ['m', 'd', 'y']) AS g FROM pr),
ps AS (SELECT * EXCLUDE (g), TRY_CAST(lpad(CASE WHEN g.y::VARCHAR <> '' AND length(g.y) = 2 THEN '20' || g.y ELSE g.y END, 4, '0') || '-' || lpad(g.m, 2, '0') || '-' || lpad(g.d, 2, '0') AS DATE) AS stated FROM pd)"""


@query("posting_prices", with_ctes(PARSED, "SELECT posting_id, unleaded, premium, diesel, reason FROM ps"))
def posting_prices(spark, sf_dir):
    """Every text is read whole; documents are the negatives."""
    return po.posting_prices(texts_of(spark, sf_dir)).select("posting_id", "unleaded", "premium", "diesel", "reason")


@query("posting_effective_date", with_ctes(PARSED, """
e AS (SELECT pt.posting_id, header_ts, CAST(header_ts AS DATE) AS hd, stated FROM pt JOIN ps USING (posting_id)),
c AS (SELECT posting_id, stated AS session, 'body' AS rule FROM e WHERE stated IS NOT NULL
  UNION ALL SELECT posting_id, hd, 'header' FROM e WHERE stated IS NULL UNION ALL SELECT posting_id, hd - 1, 'late_morning' FROM e WHERE stated IS NULL AND hour(header_ts) < 9)""", """
SELECT posting_id, session, rule FROM c WHERE session IN (SELECT session FROM wk)"""))
def posting_effective_date(spark, sf_dir):
    sessions = weekdays(daily_panel(spark, sf_dir)).select("session").distinct()
    return po.effective_dates(postings_of(spark, sf_dir)).join(F.broadcast(sessions), "session", "left_semi").select(
        "posting_id", "session", "rule")


@query("posting_import_new", with_ctes(PARSED, """
SELECT posting_id, stated AS session, CASE WHEN reason IS NOT NULL THEN reason WHEN stated IS NULL THEN 'no_date' WHEN stated IN (SELECT session FROM wk WHERE session < DATE '1998-07-01') THEN 'already_present' ELSE 'imported' END AS status FROM ps"""))
def posting_import_new(spark, sf_dir):
    existing = weekdays(daily_panel(spark, sf_dir)).where("session < DATE '1998-07-01'")
    return po.import_reason(texts_of(spark, sf_dir), existing).select("posting_id", "session", "status")


@query("html_text", r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') AS s FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(s, '(?is)<script\b.*?</script[^>]*>', ' ', 'g'), '(?is)<style\b.*?</style[^>]*>', ' ', 'g') AS s FROM a),
c AS (SELECT page_id, regexp_replace(s, '(?s)<[^>]*>', ' ', 'g') AS s FROM b),
d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(s, '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS s FROM c),
e AS (SELECT page_id, regexp_replace(regexp_replace(s, '[ \t\r\n\f]+', ' ', 'g'), '^ | $', '', 'g') AS s FROM d)
SELECT page_id, md5(s) AS text_md5, length(s) AS n_chars FROM e""")
def html_text(spark, sf_dir):
    text = po.html_text(F.col("html"))
    return read(spark, sf_dir, "pages", "page_id", "html").select(
        "page_id", F.md5(text.cast("binary")).alias("text_md5"), F.length(text).cast("long").alias("n_chars"))


@query("mask_contacts", r"""
WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations),
m AS (SELECT id, text, regexp_replace(regexp_replace(text, '([A-Za-z0-9._%+-]{2})[A-Za-z0-9._%+-]+([A-Za-z0-9._%+-])@([A-Za-z0-9.-]+)', '\1***\2@\3', 'g'),
  '(^|[^A-Za-z0-9._%+*-])[A-Za-z0-9._%+-]{1,3}@([A-Za-z0-9.-]+)', '\1***@\2', 'g') AS masked FROM t)
SELECT id, md5(masked) AS masked_md5, masked <> text AS changed FROM m""")
def mask_contacts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    conv = read(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    both = docs.unionByName(conv).withColumn("masked", po.mask_contacts(F.col("text")))
    return both.select("id", F.md5(F.col("masked").cast("binary")).alias("masked_md5"),
                       (F.col("masked") != F.col("text")).alias("changed"))


@query("mask_recipients", r"""
WITH r AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN lower(replace(s_name, '#', '.')) || '@mail.example' WHEN 1 THEN '+1-555-' || lpad((s_suppkey * 7919 % 10000)::VARCHAR, 4, '0')
  WHEN 2 THEN substr(md5(s_name), 1, 24) ELSE s_suppkey::VARCHAR END AS v FROM supplier)
SELECT s_suppkey, CASE WHEN v LIKE '%@%' THEN CASE WHEN strpos(v, '@') <= 4 THEN '***' ELSE substr(v, 1, 2) || '***' || substr(v, strpos(v, '@') - 1, 1) END || '@' || split_part(v, '@', 2)
  WHEN length(v) <= 4 THEN '***' ELSE substr(v, 1, 2) || '***' || right(v, 2) END AS masked FROM r""")
def mask_recipients(spark, sf_dir):
    """Addresses, telephone numbers, keys and short names, one kind per supplier."""
    k = F.col("s_suppkey")
    number = F.concat(F.lit("+1-555-"), F.lpad((k * 7919 % 10000).cast("string"), 4, "0"))
    value = (F.when(k % 4 == 0, F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("."))), F.lit("@mail.example")))
             .when(k % 4 == 1, number).when(k % 4 == 2, F.substring(F.md5(F.col("s_name").cast("binary")), 1, 24))
             .otherwise(k.cast("string")))
    return read(spark, sf_dir, "supplier", "s_suppkey", "s_name").select("s_suppkey", po.mask_recipient(value).alias("masked"))


@query("mask_recipient_lists", r"""
WITH r AS (SELECT s_nationkey, s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN lower(replace(s_name, '#', '.')) || '@mail.example' WHEN 1 THEN s_suppkey::VARCHAR ELSE '' END AS v FROM supplier),
m AS (SELECT s_nationkey, s_suppkey, CASE WHEN v LIKE '%@%' THEN CASE WHEN strpos(v, '@') <= 4 THEN '***' ELSE substr(v, 1, 2) || '***' || substr(v, strpos(v, '@') - 1, 1) END || '@' || split_part(v, '@', 2)
  WHEN length(v) <= 4 THEN '***' ELSE substr(v, 1, 2) || '***' || right(v, 2) END AS masked FROM r WHERE v <> '')
SELECT n_nationkey, coalesce(string_agg(masked, ';' ORDER BY s_suppkey), CASE WHEN (SELECT count(*) FROM r WHERE r.s_nationkey = n_nationkey) < 2 THEN 'None' ELSE '' END) AS masked
FROM nation LEFT JOIN m ON s_nationkey = n_nationkey GROUP BY 1""")
def mask_recipient_lists(spark, sf_dir):
    """One list of recipients per nation, with blanks between the commas."""
    k = F.col("s_suppkey")
    value = (F.when(k % 3 == 0, F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("."))), F.lit("@mail.example")))
             .when(k % 3 == 1, k.cast("string")).otherwise(""))
    lists = read(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", value.alias("v")))), lambda r: r["v"]), " , ").alias("v"))
    nations = read(spark, sf_dir, "nation", "n_nationkey").join(lists, "n_nationkey", "left")
    return nations.select("n_nationkey", F.array_join(po.mask_recipients(F.col("v")), ";").alias("masked"))
