"""Inputs shared by the registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sluice.functions.calendar import business_calendar
from sluice.operators import commits, ledger
from sluice.operators.align import one_session_deltas, training_pairs
from sluice.session import durable, shared_folder
from sluice.sources.panel import daily_panel, weekdays


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = weekdays(daily_panel(spark, sf_dir))
    return one_session_deltas(panel, business_calendar(spark))


def train_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_pairs(pairs_of(spark, sf_dir))


def cut_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training pairs, written once because several branches read them."""
    return durable(train_of(spark, sf_dir))


def artifacts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.artifacts(train_of(spark, sf_dir))


_LEDGERS: dict[tuple, tuple[str, StructType]] = {}


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision log, as the ledger table that reports read.

    It is filed once per application and state of the input files through the
    append that production uses; every report then reads the columns it needs from
    the table instead of fitting all models again.  Files that are written anew,
    under the same name too, make it file the log anew.
    """
    files = spark.read.parquet(f"{sf_dir}/lineitem.parquet").inputFiles()
    key = spark.sparkContext.applicationId, commits.stamps(spark, files)
    if key not in _LEDGERS:
        train = cut_train(spark, sf_dir)
        log = ledger.decision_log(train, ledger.artifacts(train))
        path = f"{shared_folder(spark)}/decision-log-{uuid.uuid4().hex}"
        ledger.append_table(log, path, ["series_id", "session"])
        _LEDGERS[key] = path, log.schema
    path, schema = _LEDGERS[key]
    return commits.latest(spark, path).rows(spark, schema).select(*schema.names)
