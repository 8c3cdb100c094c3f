"""Sealed records, one JSON file each, named by a field of the record.

A record carries the hash of its other fields in name order.  Files are written by the tasks that hold the records, each
under its own name and once; a file that is there is compared, never replaced.  Reading tells what is wrong with a file by
its name and stops at none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from sluice.operators import commits
from sluice.session import durable

#: File names that can be written: no folders, nothing that readers take for hidden.
NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def canonical(fields: list[str], *more: Column) -> Column:
    """JSON of ``fields`` in name order; a null field counts as absent."""
    return F.to_json(F.struct(*[F.col(f) for f in sorted(fields)], *more))


def sealed(records: DataFrame, stem: Column, fields: list[str]) -> DataFrame:
    """(stem, body): the JSON of each record with its ``record_hash``."""
    seal = F.sha2(canonical(fields), 256).alias("record_hash")
    return records.select(stem.cast("string").alias("stem"), canonical(fields, seal).alias("body"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, stem, body) of every JSON file in a folder.

    A scan passes over empty files, so the names come from the listing that the scan is planned on.
    """
    scan = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    names = spark.createDataFrame([(p.rsplit("/", 1)[-1],) for p in scan.inputFiles()], "file_name string")
    # By name: listing and scan write the scheme of a local folder in two ways.
    found = scan.select(F.substring_index("_metadata.file_path", "/", -1).alias("file_name"), F.col("value").alias("body"))
    return names.join(found, "file_name", "left").select(
        "file_name", F.regexp_replace("file_name", r"\.json$", "").alias("stem"), F.coalesce("body", F.lit("")).alias("body"))


def write_once(records: DataFrame, folder: str) -> DataFrame:
    """File each (stem, body) as ``<stem>.json``; returns (stem, status) when all are on disk.

    ``written``; ``present`` if the same text is filed already; ``conflict`` if another one is, or if the delivery holds
    two texts of one name, of which none is filed; ``bad_name`` if no file can have that name.  What is filed is listed
    before anything is written, so a task that runs again writes the same text and tells the same.
    """
    spark = records.sparkSession
    fs, at = commits._files(spark, folder)
    fs.mkdirs(at(folder))
    one = records.groupBy("stem").agg(F.min("body").alias("body"), F.max("body").alias("other"))
    old = texts(spark, folder).select("stem", F.col("body").alias("old"))
    status = (F.when(~F.coalesce(F.col("stem").rlike(NAME), F.lit(False)), "bad_name")
              .when(~F.col("body").eqNullSafe(F.col("other")) | F.col("body").isNull(), "conflict")
              .when(F.col("old").isNull(), "written").when(F.col("old") == F.col("body"), "present").otherwise("conflict"))
    told = one.join(old, "stem", "left").select("stem", "body", status.alias("status"))
    # Local folders are named by one slash behind the scheme, which the file library does not take.
    base = "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        disk, root = FileSystem.from_uri(base)
        for batch in batches:
            new = batch[batch["status"] == "written"]
            for stem, body in zip(new["stem"], new["body"]):
                part = f"{root}/.{stem}.{uuid.uuid4().hex}"
                with disk.open_output_stream(part) as out:
                    out.write(body.encode())
                disk.move(part, f"{root}/{stem}.json")  # whole or not there
            yield batch[["stem", "status"]]

    return durable(told.mapInPandas(put, "stem string, status string"))


def checked_files(spark: SparkSession, folder: str, schema: str, stem: str, inside: Column | None = None) -> DataFrame:
    """Every file with its fields and the first thing wrong with it.

    ``unreadable``: empty, broken or no object; ``hash_mismatch``: a field was changed, added or taken away since the
    record was sealed; ``out_of_bounds``: ``inside``, a condition on the fields, does not hold; ``misnamed``: the field
    ``stem`` is not the file's name; else ``ok``.
    """
    fields = StructType.fromDDL(schema).names
    parsed = F.from_json("body", f"{schema}, record_hash string, _bad string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = texts(spark, folder).withColumn("keys", F.json_object_keys("body")).withColumn("r", parsed)
    rows = rows.select("file_name", F.col("stem").alias("_stem"), "keys", "r.*")
    unknown = F.size(F.array_except("keys", F.array(*[F.lit(f) for f in (*fields, "record_hash")]))) > 0
    holds = lambda c: F.coalesce(c, F.lit(False))
    status = (F.when(F.col("keys").isNull() | F.col("_bad").isNotNull(), "unreadable")
              .when(unknown | ~holds(F.col("record_hash") == F.sha2(canonical(fields), 256)), "hash_mismatch")
              .when(F.lit(False) if inside is None else ~holds(inside), "out_of_bounds")
              .when(~holds(F.col(stem).cast("string") == F.col("_stem")), "misnamed").otherwise("ok"))
    return rows.withColumn("status", status).drop("keys", "_bad", "_stem")
