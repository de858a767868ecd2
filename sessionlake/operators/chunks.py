"""Ordered work over sessions of any size.

A session (or a prompt, or a call id) may hold a third of all rows, so no window
runs over a whole one. Rows carry a ``chunk``: a run of neighbouring rows of
bounded size that grows with the order key. Running values are built in two
steps: inside the chunk, and over one summary row per chunk. The summaries are
thousands of times fewer than the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK_ROWS = 16_384


def chunk_of(position: Column) -> Column:
    """Chunk of a unique integer position: at most CHUNK_ROWS rows of any key."""
    return F.floor(position / F.lit(CHUNK_ROWS)).cast("bigint")


def before_chunk(keys: list[str]):
    """Window over chunk summaries: all chunks before the current one."""
    return (
        Window.partitionBy(*keys)
        .orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def inside_chunk(keys: list[str], order: str, end: int = 0):
    """Window over the rows of one chunk up to the current row."""
    return (
        Window.partitionBy(*keys, "chunk")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, end)
    )


def with_running_totals(
    rows: DataFrame, keys: list[str], order: str, totals: dict[str, Column]
) -> DataFrame:
    """Add, for each name, the running sum of its flag in order within ``keys``."""
    flags = {name: flag.cast("bigint") for name, flag in totals.items()}
    summary = rows.groupBy(*keys, "chunk").agg(
        *[F.sum(flag).alias(f"_{name}") for name, flag in flags.items()]
    )
    carry = summary.select(
        *keys,
        "chunk",
        *[
            F.coalesce(F.sum(f"_{name}").over(before_chunk(keys)), F.lit(0)).alias(
                f"_{name}"
            )
            for name in flags
        ],
    )
    inside = inside_chunk(keys, order)
    return rows.join(carry, [*keys, "chunk"]).select(
        *[c for c in rows.columns if c not in flags],
        *[
            (F.col(f"_{name}") + F.coalesce(F.sum(flag).over(inside), F.lit(0))).alias(
                name
            )
            for name, flag in flags.items()
        ],
    )


def with_previous(
    rows: DataFrame, keys: list[str], order: str, values: dict[str, str]
) -> DataFrame:
    """Add, for each ``new: column``, the value of the row before within ``keys``.

    Inside a chunk a plain lag finds it. Only the first and the last row of each
    chunk meet in a second window, where the last row of the chunk before is
    the neighbour wanted; all other rows sit in partitions of their own chunk.
    """
    names = list(rows.columns)
    inside = Window.partitionBy(*keys, "chunk").orderBy(order)
    across = Window.partitionBy(*keys, "_edge").orderBy(order)
    first, last = F.lag(F.lit(1)).over(inside), F.lead(F.lit(1)).over(inside)
    local = rows.select(
        *names,
        first.isNull().alias("_first"),
        F.when(first.isNull() | last.isNull(), F.lit(-1))
        .otherwise(F.col("chunk"))
        .alias("_edge"),
        *[F.lag(source).over(inside).alias(f"_in_{new}") for new, source in values.items()],
    )
    return local.select(
        *names,
        *[
            F.when(F.col("_first"), F.lag(source).over(across))
            .otherwise(F.col(f"_in_{new}"))
            .alias(new)
            for new, source in values.items()
        ],
    )


def with_last(
    rows: DataFrame, keys: list[str], order: str, values: dict[str, str]
) -> DataFrame:
    """Add, for each ``new: column``, its last value that is not null up to the row."""
    filled = {source: F.when(F.col(source).isNotNull(), F.col(order)) for source in values.values()}
    summary = rows.groupBy(*keys, "chunk").agg(
        *[F.max_by(source, filled[source]).alias(f"_last_{new}") for new, source in values.items()]
    )
    carry = summary.select(
        *keys,
        "chunk",
        *[
            F.last(f"_last_{new}", ignorenulls=True).over(before_chunk(keys)).alias(f"_carry_{new}")
            for new in values
        ],
    )
    inside = inside_chunk(keys, order)
    return rows.join(carry, [*keys, "chunk"]).select(
        *rows.columns,
        *[
            F.coalesce(F.last(source, ignorenulls=True).over(inside), f"_carry_{new}").alias(new)
            for new, source in values.items()
        ],
    )


def without_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of all files but the listed ones.

    The list is first spread to (file, chunk) pairs, so that a huge file never
    meets its list entry in a single task.
    """
    pairs = rows.select("file_path", "chunk").distinct()
    dropped = pairs.join(files.select("file_path").distinct(), "file_path")
    return rows.join(dropped, ["file_path", "chunk"], "left_anti")


def in_parts(
    rows: DataFrame, keys: list[str], order: str, size: Column, part_size: int
) -> DataFrame:
    """Add ``part``: a number that grows by one each ``part_size`` of summed size."""
    sized = with_running_totals(rows, keys, order, {"_sum": size})
    start = F.col("_sum") - size.cast("bigint")
    return sized.withColumn(
        "part", F.floor(start / F.lit(part_size)).cast("bigint")
    ).drop("_sum")
