"""Tables of the events below a prompt: filters and projections only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlake.functions import jsonv
from sessionlake.functions.prompt import parse_prompt
from sessionlake.operators.events import members, payload_json, valid_events

_KEY = ["file_path", "prompt_index", "seq"]


def _payloads(grouped: DataFrame, event_type: str, *payload_types: str) -> DataFrame:
    rows = members(grouped).where(F.col("event_type") == event_type)
    if payload_types:
        rows = rows.where(F.col("payload_type").isin(*payload_types))
    return rows.withColumn("_p", jsonv.parse(payload_json()))


TEMPLATE = ["active_file", "open_tabs", "my_request"]


def messages(grouped: DataFrame) -> DataFrame:
    """User messages."""
    rows = valid_events(grouped).where("is_anchor")
    message = jsonv.string(jsonv.parse(F.col("raw_json")), "$.payload.message")
    return rows.select(
        *_KEY, "timestamp", F.coalesce(message, F.lit("")).alias("message"), "raw_json"
    )


def with_template(told: DataFrame) -> DataFrame:
    """The parts of the prompt template from ``message``."""
    parts = told.withColumn("_parts", parse_prompt(F.col("message")))
    return parts.withColumns({name: F.col(f"_parts.{name}") for name in TEMPLATE}).drop("_parts")


def prompts(grouped: DataFrame) -> DataFrame:
    """User messages with the parts of the prompt template."""
    return with_template(messages(grouped)).select(
        *_KEY, "timestamp", "message", *TEMPLATE, "raw_json"
    )


def _with_default(path: str, default: str) -> Column:
    """The default stands in for a missing key only, not for a null."""
    payload = F.col("_p")
    return F.when(~jsonv.present(payload, path), default).otherwise(
        jsonv.column_text(payload, path)
    )


def base_events(grouped: DataFrame) -> DataFrame:
    """Every event_msg below a prompt."""
    rows = _payloads(grouped, "event_msg").withColumn("data", payload_json())
    return rows.select(
        *_KEY,
        "timestamp",
        _with_default("$.type", "unknown").alias("event_type"),
        _with_default("$.category", "other").alias("category"),
        _with_default("$.priority", "medium").alias("priority"),
        jsonv.column_text(F.col("_p"), "$.session_id").alias("session_id"),
        "data",
        "raw_json",
    )


def _limits(name: str) -> list[Column]:
    payload, path = F.col("_p"), f"$.rate_limits.{name}"
    resets = F.when(
        jsonv.truthy(payload, f"{path}.resets_at"),
        jsonv.column_text(payload, f"{path}.resets_at"),
    ).otherwise(jsonv.column_text(payload, f"{path}.resets_in_seconds"))
    return [
        jsonv.double(payload, f"{path}.used_percent").alias(f"{name}_used_percent"),
        jsonv.bigint(payload, f"{path}.window_minutes").alias(f"{name}_window_minutes"),
        resets.alias(f"{name}_resets"),
    ]


def token_messages(grouped: DataFrame) -> DataFrame:
    """Rate limit windows of token counts."""
    return _payloads(grouped, "event_msg", "token_count").select(
        *_KEY, "timestamp", *_limits("primary"), *_limits("secondary"), "raw_json"
    )


def turn_context_messages(grouped: DataFrame) -> DataFrame:
    """Working folder and policies of a turn."""
    payload, sandbox = F.col("_p"), "$.sandbox_policy"
    roots = jsonv.as_array(payload, f"{sandbox}.writable_roots")
    joined = F.array_join(
        F.transform(roots, lambda root: jsonv.display_text(root, "$")), ", "
    )
    return _payloads(grouped, "turn_context").select(
        *_KEY,
        "timestamp",
        jsonv.column_text(payload, "$.cwd").alias("cwd"),
        jsonv.column_text(payload, "$.approval_policy").alias("approval_policy"),
        jsonv.column_text(payload, f"{sandbox}.mode").alias("sandbox_mode"),
        jsonv.column_text(payload, f"{sandbox}.network_access").alias("network_access"),
        F.coalesce(joined, jsonv.column_text(payload, f"{sandbox}.writable_roots")).alias(
            "writable_roots"
        ),
        "raw_json",
    )


def reasoning_text(payload: Column) -> Column:
    """Visible text, else that of the first summary entry, else the content."""
    return F.coalesce(
        jsonv.filled_string(payload, "$.text"),
        jsonv.filled_string(payload, "$.summary[0].text"),
        jsonv.filled_string(payload, "$.content"),
    )


def agent_reasoning_messages(grouped: DataFrame) -> DataFrame:
    """Reasoning, agent messages and aborted turns."""
    kind = F.col("payload_type")
    return _payloads(
        grouped, "event_msg", "agent_reasoning", "turn_aborted", "agent_message"
    ).select(
        *_KEY,
        "timestamp",
        F.when(kind == "agent_reasoning", "event_msg").otherwise(kind).alias("source"),
        reasoning_text(F.col("_p")).alias("text"),
        "raw_json",
    )


def _function_calls(grouped: DataFrame) -> DataFrame:
    payload = F.col("_p")
    return _payloads(grouped, "response_item", "function_call").select(
        *_KEY,
        "chunk",
        "timestamp",
        jsonv.column_text(payload, "$.name").alias("name"),
        jsonv.column_text(payload, "$.call_id").alias("call_id"),
        jsonv.string(payload, "$.call_id").alias("match_id"),
        jsonv.column_text(payload, "$.arguments").alias("arguments"),
        "raw_json",
    )


def function_plan_messages(grouped: DataFrame) -> DataFrame:
    """Calls of update_plan."""
    return (
        _function_calls(grouped)
        .where("name = 'update_plan'")
        .select(*_KEY, "timestamp", "name", "arguments", "raw_json")
    )


def tool_calls(grouped: DataFrame) -> DataFrame:
    """All other calls, before they meet their outputs."""
    return _function_calls(grouped).where("name IS DISTINCT FROM 'update_plan'")


def tool_outputs(grouped: DataFrame) -> DataFrame:
    payload = F.col("_p")
    return _payloads(grouped, "response_item", "function_call_output").select(
        *_KEY,
        "chunk",
        "timestamp",
        jsonv.string(payload, "$.call_id").alias("match_id"),
        jsonv.column_text(payload, "$.output").alias("output"),
        "raw_json",
    )
