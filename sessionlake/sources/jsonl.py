"""JSONL lines with their place in the file."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionlake.sources import discovery
from sessionlake.sources.paths import escape_path


def _positions(scan: DataFrame) -> DataFrame:
    """A block is one split of a file; ids grow with the lines of a block."""
    return scan.select(
        discovery.readable_path(F.col("_metadata.file_path")).alias("file_path"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
    )


def read_lines(
    spark: SparkSession, root: str, limit: int | None = None
) -> DataFrame:
    """Lines of all session files below ``root`` or of the first ``limit`` files.

    Columns: file_path, chunk (start of the split), pos (order inside the split),
    line. A limit prunes the scan to the days that hold those files.
    """
    if limit is None:
        try:
            scan = spark.read.text(discovery.session_glob(root))
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            raise discovery.NoSessionsFound(
                f"No session files found under {root}"
            ) from problem
        lines = _positions(scan)
        return lines.where(discovery.at_session_depth(F.col("file_path"), root))
    if limit < 0:
        raise ValueError("limit must not be negative")
    wanted = discovery.first_files(discovery.session_files(spark, root), limit)
    day = F.regexp_replace("pattern", r"/[^/]*\z", "")
    days = [row.day for row in wanted.select(day.alias("day")).distinct().collect()]
    if not days:
        raise discovery.NoSessionsFound(f"No session files found under {root}")
    return of_files(_positions(spark.read.text([f"{day}/*" for day in days])), wanted)


def of_files(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines of the listed files; a huge file is spread over as many keys as a shuffle has."""
    salts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = files.select(
        "file_path", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    )
    return (
        lines.withColumn("_salt", (F.col("pos") % salts).cast("int"))
        .join(salted, ["file_path", "_salt"], "left_semi")
        .drop("_salt")
    )


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one explicitly named session file."""
    return _positions(spark.read.text(escape_path(path)))
