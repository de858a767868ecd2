"""As-of joins along a session: what was in force when something happened."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionlake.functions import jsonv
from sessionlake.operators import chunks
from sessionlake.operators.events import payload_json, valid_events


def calls_in_context(grouped: DataFrame) -> DataFrame:
    """Tool calls with the turn context in force: the last one before them in their file.

    Calls and contexts are one stream in file order, so the join is a running last value.
    It is built over chunks: no window covers a whole session, and no key is shuffled
    twice. A context before the first prompt counts; without one the columns are null.
    """
    payload, is_context = F.col("_p"), F.col("event_type") == "turn_context"
    steps = (
        valid_events(grouped)
        .where(
            "event_type = 'turn_context' OR"
            " (event_type = 'response_item' AND payload_type = 'function_call')"
        )
        .withColumn("_p", jsonv.parse(payload_json()))
        .select(
            "file_path",
            "prompt_index",
            "chunk",
            "seq",
            is_context.alias("is_context"),
            jsonv.column_text(payload, "$.name").alias("name"),
            jsonv.column_text(payload, "$.call_id").alias("call_id"),
            F.when(
                is_context,
                F.struct(
                    F.col("seq").alias("context_seq"),
                    jsonv.column_text(payload, "$.cwd").alias("cwd"),
                    jsonv.column_text(payload, "$.approval_policy").alias("approval_policy"),
                    jsonv.column_text(payload, "$.sandbox_policy.mode").alias("sandbox_mode"),
                ),
            ).alias("context"),
        )
    )
    known = chunks.with_last(steps, ["file_path"], "seq", {"in_force": "context"})
    return known.where(
        "NOT is_context AND prompt_index > 0 AND name IS DISTINCT FROM 'update_plan'"
    ).select("file_path", "prompt_index", "seq", "name", "call_id", "in_force.*")
