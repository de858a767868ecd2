"""Versions of the stored tables: written apart, committed together.

An ingest writes its rows to folders of a version of its own, ``version=<v>/day=<d>`` of
each table, and never touches folders that readers use. Then one commit record says which
versions hold which days of each table. A record is a file that appears by renaming, under
the next number; readers follow the newest one. So readers see all tables of an ingest or
none, an ingest that is lost leaves them on the old state, and of two that commit at once
one is refused.

The day of a row is the day folder in its file's path. A record has an entry for each day
and version, so its size follows the calendar, not the data.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sessionlake.schemas import schema_of

NO_DAY = "other"
_COMMITS = "_commits"
Live = dict[str, dict[str, list[str]]]


class CommitRefused(RuntimeError):
    """Another commit came first; what was written is not part of the tables."""


@dataclass(frozen=True)
class Record:
    """What a commit made valid: versions by table and day, in the order they were added."""

    number: int = 0
    live: Live = field(default_factory=dict)

    def folders(self, table: str, days: Iterable[str] | None = None) -> list[str]:
        held = self.live.get(table, {})
        wanted = held if days is None else [day for day in days if day in held]
        return [f"{version}/{day}" for day in wanted for version in held[day]]


def day_of(path: Column | None = None) -> Column:
    """The day of a file, from the folders it lies in."""
    path = F.col("file_path") if path is None else path
    found = [F.regexp_extract(path, r"/(\d{4})/(\d{1,2})/(\d{1,2})/[^/]*\z", n) for n in (1, 2, 3)]
    day = F.concat_ws("-", found[0], *(F.lpad(part, 2, "0") for part in found[1:]))
    return F.when(found[0] != "", day).otherwise(NO_DAY).alias("day")


def _context(spark: SparkSession, base: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    conf = spark._jsc.hadoopConfiguration()
    return path.getFileSystem(conf), spark._jvm.org.apache.hadoop.fs.Path


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    system, path = _context(spark, folder)
    if not system.exists(path(folder)):
        return []
    return [status.getPath().getName() for status in system.listStatus(path(folder))]


def newest(spark: SparkSession, base: str) -> Record:
    """The record that readers follow."""
    names = [n for n in folder_names(spark, f"{base}/{_COMMITS}") if n.endswith(".json") and n[0].isdigit()]
    if not names:
        return Record()
    system, path = _context(spark, base)
    stream = system.open(path(f"{base}/{_COMMITS}/{max(names)}"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Record(int(max(names).split(".")[0]), json.loads(text))


def commit(spark: SparkSession, base: str, before: Record, live: Live) -> Record:
    """Make ``live`` what readers see, if nothing was committed since ``before``."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    system, path = _context(spark, base)
    folder = f"{base}/{_COMMITS}"
    waiting, done = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/{before.number + 1:012d}.json"
    stream = system.create(path(waiting), False)
    try:
        stream.write(bytearray(json.dumps(live, sort_keys=True).encode()))
    finally:
        stream.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(base).toUri(), spark._jsc.hadoopConfiguration())
    options = gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        files.rename(system.makeQualified(path(waiting)), system.makeQualified(path(done)), options)
    except Py4JJavaError as problem:
        system.delete(path(waiting), False)
        if "FileAlreadyExists" not in str(problem):
            raise
        raise CommitRefused(f"Commit {before.number + 1} of {base} was taken by another ingest") from problem
    return Record(before.number + 1, live)


def new_version(before: Record) -> str:
    """A folder name that no other ingest uses, a lost one of the same number included."""
    return f"{before.number + 1:012d}-{uuid.uuid4().hex[:12]}"


def write_rows(frame: DataFrame, base: str, table: str, version: str) -> list[str]:
    """Write rows as a version that is not valid yet; gives its days.

    Rebalancing gathers small days in one task and splits a large one by its size.
    """
    folder = f"{base}/{table}/version={version}"
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema_of(table).fields]
    rows = frame.select(*columns).withColumn("day", day_of())
    rows.hint("rebalance", "day").write.partitionBy("day").parquet(folder)
    days = (name.removeprefix("day=") for name in folder_names(frame.sparkSession, folder) if name.startswith("day="))
    return sorted(days)


def with_version(
    live: Live, table: str, version: str, days: Iterable[str], replaced: Iterable[str] = ()
) -> Live:
    """``live`` with a version added; it stands for all earlier ones on ``replaced`` days."""
    gone = set(replaced)
    held = {day: list(versions) for day, versions in live.get(table, {}).items() if day not in gone}
    for day in days:
        held.setdefault(day, []).append(version)
    return {**live, table: held}


def read_rows(
    spark: SparkSession, base: str, table: str, days: Iterable[str] | None = None, record: Record | None = None
) -> DataFrame:
    """A stored table as a record has it, or only some of its days."""
    schema = schema_of(table)
    folders = (record or newest(spark, base)).folders(table, days)
    if not folders:
        return spark.createDataFrame([], schema)
    try:
        layout = f"{schema.toDDL()}, version string, day string"
        stored = spark.read.schema(layout).parquet(f"{base}/{table}")
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)
    # Only names of folders: Spark leaves out all others before it reads a file.
    valid = F.concat_ws("/", "version", "day").isin(folders)
    return stored.where(valid).select(*[f.name for f in schema.fields])


def compact(spark: SparkSession, base: str, most: int = 16) -> Record:
    """Write days that lie in more than ``most`` versions anew, as one."""
    before = newest(spark, base)
    live, version = before.live, new_version(before)
    for table, held in before.live.items():
        days = [day for day, versions in held.items() if len(versions) > most]
        if days:
            written = write_rows(read_rows(spark, base, table, days, before), base, table, version)
            live = with_version(live, table, version, written, days)
    return commit(spark, base, before, live) if live is not before.live else before


def vacuum(spark: SparkSession, base: str) -> int:
    """Remove what the newest record does not need; gives the number of folders.

    Versions of a later number stay: their ingest may still be running. Readers that
    began before the newest commit lose their files, so run this when there are none.
    """
    record, removed = newest(spark, base), 0
    system, path = _context(spark, base)
    for table in folder_names(spark, base):
        needed = set(record.folders(table))
        for name in folder_names(spark, f"{base}/{table}") if table != _COMMITS else ():
            version = name.removeprefix("version=")
            if version == name or int(version.split("-")[0]) > record.number:
                continue
            for day in folder_names(spark, f"{base}/{table}/{name}"):
                if day.startswith("day=") and f"{version}/{day.removeprefix('day=')}" not in needed:
                    system.delete(path(f"{base}/{table}/{name}/{day}"), True)
                    removed += 1
    return removed
