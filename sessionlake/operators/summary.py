"""Counts per session, totals and error previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionlake.operators import chunks
from sessionlake.operators.events import valid_events

COUNTS = [
    "prompts",
    "token_messages",
    "turn_context_messages",
    "agent_reasoning_messages",
    "function_plan_messages",
    "function_calls",
]


def event_counts(grouped: DataFrame) -> DataFrame:
    """Counts per file that need no call matching; partial sums before the shuffle."""
    subtype = F.col("payload_type")
    is_msg = F.col("event_type") == "event_msg"
    name = F.get_json_object("raw_json", "$.payload.name")
    member = (F.col("prompt_index") > 0) & ~F.col("is_anchor")
    reasoning = subtype.isin("agent_reasoning", "turn_aborted", "agent_message")
    plan = (
        (F.col("event_type") == "response_item")
        & (subtype == "function_call")
        & (name == "update_plan")
    )
    return (
        valid_events(grouped)
        .groupBy("file_path")
        .agg(
            F.count_if("is_anchor").alias("prompts"),
            F.count_if(member & is_msg & (subtype == "token_count")).alias(
                "token_messages"
            ),
            F.count_if(member & (F.col("event_type") == "turn_context")).alias(
                "turn_context_messages"
            ),
            F.count_if(member & is_msg & reasoning).alias("agent_reasoning_messages"),
            F.count_if(member & plan).alias("function_plan_messages"),
        )
    )


def summaries(
    grouped: DataFrame, calls: DataFrame, files: DataFrame, errors: DataFrame
) -> DataFrame:
    """One row per file with six counts and the number of errors.

    ``calls`` is any frame with one row per stored call, stubs included.
    """
    n_calls = calls.groupBy("file_path").agg(F.count("*").alias("function_calls"))
    n_errors = errors.groupBy("file_path").agg(F.count("*").alias("errors"))
    joined = (
        files.select("file_path")
        .join(event_counts(grouped), "file_path", "left")
        .join(n_calls, "file_path", "left")
        .join(n_errors, "file_path", "left")
    )
    return joined.select(
        "file_path",
        *[F.coalesce(name, F.lit(0)).cast("bigint").alias(name) for name in COUNTS],
        F.coalesce("errors", F.lit(0)).cast("bigint").alias("errors"),
    )


_RECORD = ["line_number", "severity", "code", "message", "recommended_action", "context"]
# Errors of a file that one cell holds; more are read in parts.
CELL_ERRORS = 100_000


def _records() -> Column:
    return F.array_sort(F.collect_list(F.struct(*_RECORD))).alias("error_list")


def with_error_lists(
    summary: DataFrame, errors: DataFrame, cell_errors: int | None = None
) -> DataFrame:
    """Add ``error_list``, the error records of each file in order.

    With ``cell_errors`` it is null for files that have more errors than that, and no task
    collects them; ``error_parts`` gives them all.
    """
    if cell_errors is not None:
        errors = chunks.without_files(errors, summary.where(F.col("errors") > cell_errors))
    lists = errors.groupBy("file_path").agg(_records())
    none = F.array().cast(lists.schema["error_list"].dataType)
    held = F.lit(True) if cell_errors is None else F.col("errors") <= cell_errors
    return summary.join(lists, "file_path", "left").withColumn(
        "error_list", F.when(held, F.coalesce("error_list", none))
    )


def error_parts(errors: DataFrame, part_errors: int = 1000) -> DataFrame:
    """All error records of each file, in parts of ``part_errors``.

    Parts count from 0; one after the other they are the whole list in order. A file
    without errors has none. Rows need ``chunk``, as the stored errors have it.
    """
    placed = chunks.in_parts(errors, ["file_path"], "line_number", F.lit(1), part_errors)
    return placed.groupBy("file_path", "part").agg(_records())


def totals(summary: DataFrame) -> DataFrame:
    """Sums over all files with the number of files."""
    return summary.agg(
        F.count("*").alias("files_processed"),
        *[
            F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name)
            for name in [*COUNTS, "errors"]
        ],
    )


def event_rollup(grouped: DataFrame) -> DataFrame:
    """Events by day and file, by day, and of all days, in one aggregation.

    The day is that of the event's timestamp, null where it has none that begins with a
    date. ``level`` tells the rows apart: file, day or all.
    """
    day = F.when(F.col("timestamp").rlike(r"\A\d{4}-\d\d-\d\d"), F.substr("timestamp", F.lit(1), F.lit(10)))
    rows = valid_events(grouped).select(
        day.alias("day"), "file_path", "is_anchor", "event_type", "payload_type"
    )
    item = F.col("event_type") == "response_item"
    return rows.rollup("day", "file_path").agg(
        F.when(F.grouping_id() == 0, "file").when(F.grouping_id() == 1, "day").otherwise("all").alias("level"),
        F.count("*").alias("events"),
        F.count_if("is_anchor").alias("prompts"),
        F.count_if(item & (F.col("payload_type") == "function_call")).alias("calls"),
        F.count_if(item & (F.col("payload_type") == "function_call_output")).alias("outputs"),
        F.count_if(F.col("event_type") == "turn_context").alias("contexts"),
    )


def error_preview(errors: DataFrame, shown: int = 3) -> DataFrame:
    """Printed error lines per file: the count, the first few, and how many more.

    The first few are found per chunk before they are compared across chunks.
    """
    in_chunk = Window.partitionBy("file_path", "chunk").orderBy("line_number")
    in_file = Window.partitionBy("file_path").orderBy("line_number")
    text = F.concat(
        F.lit("  - "), F.col("severity"), F.lit("/"), F.col("code"), F.lit(": "), F.col("message")
    )
    heads = (
        errors.withColumn("_n", F.row_number().over(in_chunk))
        .where(F.col("_n") <= shown)
        .withColumn("_n", F.row_number().over(in_file))
        .where(F.col("_n") <= shown)
        .select("file_path", F.col("_n").cast("bigint").alias("line_no"), text.alias("text"))
    )
    counts = errors.groupBy("file_path").agg(F.count("*").alias("_count"))
    first = counts.select(
        "file_path",
        F.lit(0).cast("bigint").alias("line_no"),
        F.concat(F.lit("errors: "), F.col("_count").cast("string")).alias("text"),
    )
    more = counts.where(F.col("_count") > shown).select(
        "file_path",
        F.lit(shown + 1).cast("bigint").alias("line_no"),
        F.concat(
            F.lit("  - ... "), (F.col("_count") - shown).cast("string"), F.lit(" more")
        ).alias("text"),
    )
    return first.unionByName(heads).unionByName(more)


