"""Session files below ``root/<year>/<month>/<day>/``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sessionlake.sources.paths import escape_path, escaped


class NoSessionsFound(RuntimeError):
    """No session file lies below the root."""


def _decoded(uri: Column) -> Column:
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def readable_path(uri: Column) -> Column:
    """Decoded path; local files lose their scheme."""
    return F.regexp_replace(_decoded(uri), r"\Afile:/+", "/")


def _parts(path: Column) -> Column:
    bare = F.regexp_replace(path, r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    return F.filter(F.split(bare, "/"), lambda part: part != "")


def at_session_depth(path: Column, root: str) -> Column:
    return F.size(_parts(path)) == F.size(_parts(F.lit(root))) + 4


def session_glob(root: str) -> str:
    return escape_path(root.rstrip("/")) + "/*/*/*/*"


def discovery_order(path: Column | None = None) -> Column:
    """Sort key: year, month, day and file name, compared one by one."""
    parts = _parts(F.col("file_path") if path is None else path)
    return F.slice(parts, F.greatest(F.size(parts) - 3, F.lit(1)), F.lit(4))


def session_files(
    spark: SparkSession, root: str, with_empty: bool = True
) -> DataFrame:
    """One row per file (file_path, pattern, length). Contents are not read.

    Spark's scans pass over files of length zero. They have a session all the same,
    so they are added from the listing, which the driver holds for any scan.
    """
    try:
        listing = spark.read.format("binaryFile").load(session_glob(root))
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        raise NoSessionsFound(f"No session files found under {root}") from problem
    filled = listing.select(_canonical(F.col("_metadata.file_path")).alias("uri"), "length")
    if with_empty:
        listed = spark.createDataFrame(
            [(uri,) for uri in listing.inputFiles()], "listed string"
        ).select(_canonical(F.col("listed")).alias("uri"))
        empty = listed.join(filled, "uri", "left_anti")
        filled = filled.unionByName(
            empty.select("uri", F.lit(0).cast("bigint").alias("length"))
        )
    pattern = escaped(_decoded(F.col("uri")))
    return filled.select(
        readable_path(F.col("uri")).alias("file_path"), pattern.alias("pattern"), "length"
    ).where(at_session_depth(F.col("file_path"), root))


def _canonical(uri: Column) -> Column:
    """One spelling of local paths: 'file:/a' and 'file:///a' are the same."""
    return F.regexp_replace(uri, r"\Afile:/+", "file:/")


def first_files(files: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` files in discovery order (a top-k, no full sort)."""
    return files.orderBy(discovery_order()).limit(limit)


def debug_limit(limit: int | None) -> int:
    """Debug runs read two files at most."""
    return 2 if limit is None or limit > 2 else limit
