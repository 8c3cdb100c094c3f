"""Records that are one file each, and execution records beside the log they quote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sluice.operators import executions as ex
from sluice.operators.ledger import byte_of
from sluice.plans.base import log_of
from sluice.plans.ctes import LOG, PANEL, byte
from sluice.plans.quality_queries import EXEC, executions
from sluice.plans.registry import query, with_ctes
from sluice.session import shared_folder
from sluice.sources import file_records as fr
from sluice.sources.panel import daily_panel, weekdays

_K, _P = byte(2, "session"), byte(3, "session")

# Bytes of the session: below 8 misnamed, 16 cut short, 24 empty, 32 edited after the seal, 40 with a field more.
FILED = PANEL + f""",
rf AS (SELECT session, {_K} AS b, {_P} < 16 AS changed, count(*) AS n_series FROM wk GROUP BY 1),
rs AS (SELECT CASE WHEN b < 8 THEN 'x' ELSE '' END || session AS stem, session, n_series, changed, CASE WHEN b >= 8 AND b < 24 THEN 'unreadable' WHEN b >= 24 AND b < 40 THEN 'hash_mismatch' WHEN session < DATE '1994-01-01' THEN 'out_of_bounds' WHEN b < 8 THEN 'misnamed' ELSE 'ok' END AS status FROM rf)"""


def bodies(spark, sf_dir):
    """(stem, body) of one record per session, some damaged as they were filed."""
    days = weekdays(daily_panel(spark, sf_dir)).groupBy("session").agg(F.count("*").alias("n_series"))
    b = byte_of(2, "session")
    days = days.withColumn("day", F.col("session").cast("string")).withColumn("b", b).withColumn("changed", byte_of(3, "session") < 16)
    rows = fr.sealed(days, F.concat(F.when(F.col("b") < 8, "x").otherwise(""), F.col("day"), F.lit("|"), F.col("b").cast("string"),
                                    F.lit("|"), F.col("changed").cast("string")), ["day", "n_series"])
    part = F.split("stem", r"\|")
    body, b = F.col("body"), part[1].cast("int")
    damaged = (F.when((b >= 8) & (b < 16), F.substring(body, 1, 20)).when((b >= 16) & (b < 24), "")
               .when((b >= 24) & (b < 32), F.replace(body, F.lit('"n_series":'), F.lit('"n_series":1')))
               .when((b >= 32) & (b < 40), F.concat(F.lit('{"note":"late",'), F.substr(body, F.lit(2)))).otherwise(body))
    return rows.select(part[0].alias("stem"), damaged.alias("body"), part[2].cast("boolean").alias("changed"))


@query("record_files", with_ctes(FILED, """
SELECT stem || '.json' AS file_name, CASE WHEN status <> 'unreadable' THEN session::VARCHAR END AS day, status FROM rs"""))
def record_files(spark, sf_dir):
    """Every file of a folder of sealed records with the first thing wrong with it."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    fr.write_once(bodies(spark, sf_dir).drop("changed"), path)
    back = fr.checked_files(spark, path, "day string, n_series long", "day", F.col("day") >= "1994-01-01")
    return back.select("file_name", F.when(F.col("status") != "unreadable", F.col("day")).alias("day"), "status")


@query("record_files_again", with_ctes(FILED, """
SELECT CASE WHEN changed THEN 'conflict' ELSE 'present' END AS status, count(*) AS files FROM rs GROUP BY 1"""))
def record_files_again(spark, sf_dir):
    """A second delivery of the same records, some with another text: no file changes."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    first = bodies(spark, sf_dir)
    fr.write_once(first.drop("changed"), path)
    again = first.select("stem", F.when(F.col("changed"), F.concat("body", F.lit(" "))).otherwise(F.col("body")).alias("body"))
    return fr.write_once(again, path).groupBy("status").agg(F.count("*").alias("files"))


_TWICE = byte(15, "series_id", "session")


@query("execution_recommendations", with_ctes(LOG, EXEC, f"""
lr AS (SELECT series_id, session, direction FROM log WHERE prediction_source = 'live' UNION ALL SELECT series_id, session, direction FROM log WHERE prediction_source = 'live' AND {_TWICE} < 8),
lv AS (SELECT series_id, session AS signal_date, count(*) AS live_rows, min(direction) AS direction FROM lr GROUP BY 1, 2),
er AS (SELECT exr.series_id, exr.gallons, CASE WHEN live_rows = 1 THEN direction END AS recommendation, CASE WHEN live_rows IS NULL THEN 'no_live_row' WHEN live_rows > 1 THEN 'several_live_rows' END AS refusal
  FROM exr LEFT JOIN lv USING (series_id, signal_date))""", """
SELECT series_id, recommendation, refusal, count(*) AS records, sum(gallons)::BIGINT AS gallons FROM er GROUP BY 1, 2, 3"""))
def execution_recommendations(spark, sf_dir):
    """Execution records with the recommendation of their day's live row; some rows are logged twice."""
    log = log_of(spark, sf_dir).select("series_id", "session", "direction", "prediction_source")
    twice = log.unionByName(log.where(byte_of(15, "series_id", "session") < 8))
    rows = ex.with_live_recommendation(executions(spark, sf_dir), twice)
    return rows.groupBy("series_id", "recommendation", "refusal").agg(F.count("*").alias("records"), F.sum("gallons").alias("gallons"))
