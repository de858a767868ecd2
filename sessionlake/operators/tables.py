"""Stored tables: writing, replacing files, copying and checking."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sessionlake.operators import lake
from sessionlake.operators.chunks import with_running_totals
from sessionlake.schemas import EXTRA_TABLES, TABLES, schema_of
from sessionlake.session import stage

ALL_TABLES = (*TABLES, *EXTRA_TABLES)


class CopyRefused(RuntimeError):
    """The target of a copy holds rows or the copy does not match."""


def conform(frame: DataFrame, table: str) -> DataFrame:
    """Columns of the table in order and type."""
    return frame.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema_of(table).fields]
    )


def write_tables(spark: SparkSession, frames: dict[str, DataFrame], base: str, mode: str = "append") -> None:
    """Write tables in the one layout all stored tables have, in one commit."""
    before = lake.newest(spark, base)
    live, version = before.live, lake.new_version(before)
    for name, frame in frames.items():
        days = lake.write_rows(frame, base, name, version)
        gone = live.get(name, {}) if mode == "overwrite" else ()
        live = lake.with_version(live, name, version, days, gone)
    lake.commit(spark, base, before, live)


def write_table(frame: DataFrame, base: str, table: str, mode: str = "append") -> None:
    """Add rows to a stored table, or overwrite it."""
    write_tables(frame.sparkSession, {table: frame}, base, mode)


def read_table(
    spark: SparkSession,
    base: str,
    table: str,
    days: Iterable[str] | None = None,
    record: lake.Record | None = None,
) -> DataFrame:
    """A stored table, or only some of its days; never written means empty."""
    return lake.read_rows(spark, base, table, days, record)


def replace_files(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """Old rows of all other files plus the new rows.

    All tables hang on ``file_path``, events included, so a second ingest leaves no
    duplicates; manual redactions are kept. Only the old side of the anti join may
    be large, and its key is spread by AQE when one file dominates.
    """
    salts = int(old.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = files.select(
        "file_path", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    )
    spread = F.pmod(F.xxhash64(*old.columns), F.lit(salts)).cast("int")
    kept = (
        old.withColumn("_salt", spread)
        .join(salted, ["file_path", "_salt"], "left_anti")
        .drop("_salt")
    )
    return kept.unionByName(new)


def touch_files(old: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """The files table after an ingest: known paths refreshed, new ones added."""
    fresh = files.select("file_path", now.cast("timestamp").alias("ingested_at"))
    return old.join(fresh.select("file_path"), "file_path", "left_anti").unionByName(fresh)


def file_ids(files: DataFrame) -> DataFrame:
    """Integer ids where they are wanted: dense, in path order.

    Ranks come from range partitions: each counts its rows, and the counts before
    a partition are added to the position inside it. The ranges are written into
    the frame first, so that both steps see the same ones.
    """
    placed = stage(
        files.select("file_path")
        .distinct()
        .repartitionByRange("file_path")
        .withColumn("chunk", F.spark_partition_id().cast("bigint"))
        .withColumn("one", F.lit(1)),
        "file_ids",
    )
    return with_running_totals(placed, ["one"], "file_path", {"file_id": F.lit(1)}).select(
        "file_path", "file_id"
    )


def assign_ids(stored: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, file_id) of ``files``: a stored file keeps its id, new ones get ids
    above the largest of ``stored``, in path order (O42a).

    Only the largest id passes through the driver; new ids are ranks of range partitions.
    """
    largest = stored.agg(F.max("file_id")).first()[0] or 0
    known = stored.join(files.select("file_path"), "file_path", "left_semi").select("file_path", "file_id")
    new = file_ids(files.join(stored, "file_path", "left_anti"))
    above = new.select("file_path", (F.col("file_id") + largest).cast("bigint").alias("file_id"))
    return known.unionByName(above)


def table_counts(tables: dict[str, DataFrame], label: str = "rows") -> DataFrame:
    """One row per table with its row count."""
    counts = [
        frame.agg(F.count("*").alias(label)).select(F.lit(name).alias("table_name"), label)
        for name, frame in tables.items()
    ]
    union = counts[0]
    for frame in counts[1:]:
        union = union.unionByName(frame)
    return union


def max_ids(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Next sequence position per table: the largest id, at least 1 (O42d)."""
    rows = [
        frame.agg(
            F.greatest(F.coalesce(F.max(column), F.lit(0)), F.lit(1)).cast("bigint").alias("max_id")
        ).select(F.lit(name).alias("table_name"), "max_id")
        for name, (frame, column) in tables.items()
    ]
    union = rows[0]
    for frame in rows[1:]:
        union = union.unionByName(frame)
    return union


def dry_run(
    spark: SparkSession, source: str, target: str, tables: Iterable[str] = ALL_TABLES
) -> DataFrame:
    """Source and target counts per table; a missing table counts zero."""
    names = list(tables)
    left = table_counts({t: read_table(spark, source, t) for t in names}, "source_rows")
    right = table_counts({t: read_table(spark, target, t) for t in names}, "target_rows")
    return left.join(right, "table_name")


def copy_tables(
    spark: SparkSession, source: str, target: str, tables: Iterable[str] = ALL_TABLES
) -> DataFrame:
    """Copy all tables to an empty target and compare the counts afterwards."""
    names = list(tables)
    before = dry_run(spark, source, target, names)
    taken = before.where("target_rows > 0").collect()
    if taken:
        details = ", ".join(f"{row.table_name}={row.target_rows}" for row in taken)
        raise CopyRefused(
            f"Target is not empty. Clear data before migrating. ({details})"
        )
    write_tables(spark, {name: read_table(spark, source, name) for name in names}, target)
    after = dry_run(spark, source, target, names)
    wrong = after.where("source_rows <> target_rows").collect()
    if wrong:
        raise CopyRefused(f"Copied rows differ: {wrong}")
    return after


def write_jdbc(frame: DataFrame, url: str, table: str, batch_size: int = 1000) -> None:
    """Append a table to a database, for a copy out of the lake."""
    (
        conform(frame, table)
        .write.format("jdbc")
        .options(url=url, dbtable=table, batchsize=batch_size)
        .mode("append")
        .save()
    )
