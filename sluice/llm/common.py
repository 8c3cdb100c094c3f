"""What the operators of this folder share: inputs, written tables, bounded slices, range lookups."""

from __future__ import annotations

import ctypes
import json
import uuid
from collections.abc import Iterator
from importlib import import_module
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice.session import shared_folder

#: Text bytes handled at once inside a task; bounds a worker's memory whatever the batch holds.
SLICE_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh place under the folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parked(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage is cut, lost executors cost nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def in_worker(module: str) -> ModuleType:
    """The module as the worker process itself holds it.

    Functions reach a task as copies with globals of their own; what is kept in the module proper outlives the task.
    """
    return import_module(module)


def widened(df: DataFrame, more: str) -> StructType:
    """The schema of ``df`` with the columns of ``more``, written as in SQL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one longer text alone."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size.astype(np.int64) + 1)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def pieces(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The slices with their texts: only the slice in hand becomes Python strings, however large the batch is."""
    for part in slices(batch, name, limit):
        yield part, column(part, name)


def give_back() -> None:
    """Hands memory that a worker has freed to the system, for jobs whose workers go on to other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def range_of(key: Column, splitters: list[tuple[int, ...]]) -> Column:
    """How many of the sorted ``splitters`` are at or below the struct of longs ``key``, by binary search in the row."""
    if not splitters:
        return F.lit(0)
    names = [f"k{i}" for i in range(len(splitters[0]))]
    text = json.dumps([dict(zip(names, s)) for s in splitters])
    cuts = F.from_json(F.lit(text), f"array<struct<{','.join(f'{n}:long' for n in names)}>>")  # folded to a constant
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(len(splitters).bit_length()))))

    def step(pos: Column, width: Column) -> Column:
        ahead = pos + width
        return F.when((ahead <= len(splitters)) & (F.get(cuts, ahead - 1) <= key), ahead).otherwise(pos)

    return F.aggregate(steps, F.lit(0), step)
