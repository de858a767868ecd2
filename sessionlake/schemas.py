"""Layout of the stored tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

_KEY = "file_path string, prompt_index bigint, seq bigint"
_REDACTIONS = (
    "id bigint, file_path string, prompt_index bigint, scope string, "
    "field_path string, replacement_text string, reason string, actor string, "
    "created_at timestamp, updated_at timestamp"
)
_LIMITS = ", ".join(
    f"{w}_used_percent double, {w}_window_minutes bigint, {w}_resets string"
    for w in ("primary", "secondary")
)

# Table and column names; raw_json comes last so that scans of the
# other columns stay narrow. The order is the one tables are copied in.
TABLES = {
    "files": "file_path string, file_id bigint, ingested_at timestamp",
    "sessions": (
        "file_path string, session_id string, session_timestamp string, cwd string, "
        "approval_policy string, sandbox_mode string, network_access string, "
        "prelude_parts bigint, raw_json string"
    ),
    "prompts": (
        f"{_KEY}, timestamp string, message string, active_file string, "
        "open_tabs string, my_request string, raw_json string"
    ),
    "redactions": _REDACTIONS,
    "token_messages": f"{_KEY}, timestamp string, {_LIMITS}, raw_json string",
    "turn_context_messages": (
        f"{_KEY}, timestamp string, cwd string, approval_policy string, "
        "sandbox_mode string, network_access string, writable_roots string, raw_json string"
    ),
    "agent_reasoning_messages": (
        f"{_KEY}, timestamp string, source string, text string, raw_json string"
    ),
    "function_plan_messages": (
        f"{_KEY}, timestamp string, name string, arguments string, raw_json string"
    ),
    "function_calls": (
        f"{_KEY}, call_timestamp string, output_timestamp string, name string, "
        "call_id string, arguments string, output string, raw_call_json string, "
        "raw_output_json string"
    ),
    "events": (
        f"{_KEY}, timestamp string, event_type string, category string, "
        "priority string, session_id string, data string, raw_json string"
    ),
}
# Tables this engine adds: parts of long preludes and rejected events.
EXTRA_TABLES = {
    "prelude_parts": "file_path string, part bigint, events_json string",
    "ingest_errors": (
        "file_path string, line_number bigint, severity string, code string, "
        "message string, recommended_action string, context string, chunk bigint"
    ),
}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL({**TABLES, **EXTRA_TABLES}[table])


def column_names(table: str) -> list[str]:
    columns = {**TABLES, **EXTRA_TABLES}[table].split(", ")
    return [column.split()[0] for column in columns]
