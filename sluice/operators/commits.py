"""Insert-only tables whose appends are committed one after another.

An append writes its rows as files of its own and then names them in a commit, a small file whose name is the next
version.  Rows count only through commits, so an append that ends before its commit leaves nothing.  A commit file is
made with all of its content in one step that fails if the version exists: of two appends that read the same version one
wins, and the other decides anew over what the winner has filed.  Readers see the versions that are there when they look.
The folder must lie on this machine's or a distributed file system, whose renames do not replace files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import MapType, StructType

from sluice.session import durable

#: Digits of a version in a commit's name.
DIGITS = 12
#: Rows that one task writes of one month, about.
FILE_ROWS = 1_000_000


@dataclass(frozen=True)
class Commit:
    """One append: its version, the folder of its rows, the months it touched, and who made it as which batch."""

    version: int
    folder: str
    months: tuple[str, ...]
    writer: str | None = None
    batch: int | None = None


@dataclass(frozen=True)
class Snapshot:
    """A table as some version left it."""

    path: str
    commits: tuple[Commit, ...] = field(default=())

    @property
    def version(self) -> int:
        return self.commits[-1].version if self.commits else 0

    def holds(self, writer: str | None, batch: int | None) -> bool:
        return writer is not None and any((c.writer, c.batch) == (writer, batch) for c in self.commits)

    def rows(self, spark: SparkSession, schema: StructType, months: set[str] | None = None) -> DataFrame:
        """Rows of this version with ``month``; only the appends that touched one of ``months`` are opened, if given."""
        typed = StructType([*(f for f in schema.fields if f.name != "month"), *StructType.fromDDL("month string, append string").fields])
        folders = [c.folder for c in self.commits if c.months and (months is None or months & set(c.months))]
        if not folders:
            return spark.createDataFrame([], typed).drop("append")
        found = spark.read.schema(typed).option("basePath", f"{self.path}/rows").parquet(*(f"{self.path}/rows/append={f}" for f in folders))
        found = found if months is None else found.where(F.col("month").isin(*months))  # prunes partitions
        return found.select(*(n for n in typed.names if n != "append"))


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and a maker of paths on it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stamps(spark: SparkSession, paths: list[str]) -> tuple[tuple[str, int, int], ...]:
    """Name, time and length of files: what changes when data does."""
    found = []
    for p in sorted(paths):
        fs, at = _files(spark, p)
        status = fs.getFileStatus(at(p))
        found.append((p, status.getModificationTime(), status.getLen()))
    return tuple(found)


def latest(spark: SparkSession, path: str) -> Snapshot:
    """The newest version of the table at ``path``; version 0 before the first commit."""
    fs, at = _files(spark, path)
    folder = at(f"{path}/commits")
    if not fs.exists(folder):
        return Snapshot(path)
    jvm = spark.sparkContext._jvm
    found = []
    for status in fs.listStatus(folder):  # one small file an append
        name = status.getPath().getName()
        if name.isdigit():
            stream = fs.open(status.getPath())
            try:
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            said = json.loads(text)
            found.append(Commit(int(name), said["folder"], tuple(said["months"]), said["writer"], said["batch"]))
    return Snapshot(path, tuple(sorted(found, key=lambda c: c.version)))


def commit(spark: SparkSession, path: str, made: Commit) -> bool:
    """Make ``made`` the version it names; False if another append has that version already."""
    fs, at = _files(spark, path)
    folder, name = f"{path}/commits", str(made.version).zfill(DIGITS)
    fs.mkdirs(at(folder))
    draft = f"{folder}/.{uuid.uuid4().hex}"
    out = fs.create(at(draft), False)
    try:
        out.write(bytearray(json.dumps({"folder": made.folder, "months": list(made.months), "writer": made.writer, "batch": made.batch}).encode()))
    finally:
        out.close()
    try:
        return _published(spark, fs, at(draft), at(f"{folder}/{name}"))
    finally:
        fs.delete(at(draft), False)


def _published(spark: SparkSession, fs, draft, final) -> bool:
    """The draft under its final name, in one step that fails if the name is taken."""
    jvm = spark.sparkContext._jvm
    try:
        if fs.getUri().getScheme() == "file":  # a rename would replace what is there; a second link to the draft cannot
            local = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (final, draft)]
            jvm.java.nio.file.Files.createLink(*local)
            return True
        return bool(fs.rename(draft, final))  # refused by a distributed file system where the name is taken
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise


#: From the rows that are filed: the rows to append (with ``month``) and what to tell.
Decision = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def append(spark: SparkSession, path: str, schema: StructType, decide: Decision, months: set[str] | None = None,
           writer: str | None = None, batch: int | None = None) -> DataFrame | None:
    """Append what ``decide`` chooses, as one commit, and return what it tells; None if the writer's batch is filed already.

    ``months`` are those that the decision depends on, all of them if None: only their rows are shown to it, and commits
    that touch none of them do not make it decide anew.  Every month is written by as many tasks as its size asks for.
    """
    seen = latest(spark, path)
    while True:
        if seen.holds(writer, batch):
            return None
        fresh, told = decide(seen.rows(spark, schema, months))
        folder, touched = _written(fresh, path)
        while True:
            if commit(spark, path, Commit(seen.version + 1, folder, touched, writer, batch)):
                return told
            before, seen = seen.version, latest(spark, path)
            since = {m for c in seen.commits if c.version > before for m in c.months}
            if seen.holds(writer, batch) or since and (months is None or since & months):
                break  # what was written stays unnamed; the decision is taken again over the newer version


def _written(fresh: DataFrame, path: str) -> tuple[str, tuple[str, ...]]:
    """Rows as files of their own: their folder and the months that have some."""
    spark, folder = fresh.sparkSession, uuid.uuid4().hex
    rows = durable(fresh)
    sizes = {r["month"]: r["n"] for r in rows.groupBy("month").agg(F.count("*").alias("n")).collect()}  # a row a month
    touched = tuple(sorted(sizes))
    if touched:
        # A month goes to as many tasks as its size asks for.
        tasks = F.create_map(*(F.lit(x) for m, n in sizes.items() for x in (m, -(-n // FILE_ROWS))))
        hashed = [f.name for f in fresh.schema.fields if not isinstance(f.dataType, MapType)]
        salt = F.pmod(F.xxhash64(*hashed), F.element_at(tasks, F.col("month")))
        rows.repartition(sum(-(-n // FILE_ROWS) for n in sizes.values()), "month", salt).write.partitionBy("month").parquet(f"{path}/rows/append={folder}")
    return folder, touched


def unnamed(spark: SparkSession, path: str) -> list[str]:
    """Folders of rows that no commit names: appends under way, or ones that ended before their commit."""
    fs, at = _files(spark, path)
    if not fs.exists(at(f"{path}/rows")):
        return []
    named = {f"append={c.folder}" for c in latest(spark, path).commits}
    found = (s.getPath().getName() for s in fs.listStatus(at(f"{path}/rows")))
    return sorted(n.removeprefix("append=") for n in found if n not in named)
