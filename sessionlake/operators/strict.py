"""The strict event model: log metadata, messages and actions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sessionlake.functions import jsonv
from sessionlake.functions.jsonv import json_record

AGENT = "codex"
# Numbers of the event categories and priorities.
CATEGORY = {
    "USER_INPUT": 1,
    "AGENT_RESPONSE": 2,
    "SYSTEM": 3,
    "TOOL_CALL": 4,
    "TOOL_RESULT": 5,
    "REASONING": 6,
    "ERROR": 7,
    "OTHER": 8,
}
PRIORITY = {"HIGH": 1, "MEDIUM": 2, "LOW": 3}

_DATE = r"(\d{4})-?(\d{2})-?(\d{2})"
_CLOCK = r"(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
_ZONE = r"(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?"
# Calendar dates in extended or basic form, any one separator, optional offset.
_ISO = (
    r"\A(?=\d{4}-\d{2}-\d{2}(?:\D|\z)|\d{8}(?:\D|\z))"
    rf"{_DATE}(?:[\s\S]{_CLOCK}{_ZONE})?\z"
)


class _Iso:
    """Pieces of an ISO timestamp, from a struct of the pattern's groups."""

    def __init__(self, groups: Column) -> None:
        def group(n: int) -> Column:
            return groups[f"g{n}"]

        def or_zero(piece: Column) -> Column:
            return F.when(piece == "", "00").otherwise(piece)

        self.date = F.concat_ws("-", group(1), group(2), group(3))
        self.clock = F.concat_ws(
            ":", or_zero(group(4)), or_zero(group(5)), or_zero(group(6))
        )
        self.micros = F.rpad(F.substr(group(7), F.lit(1), F.lit(6)), 6, "0")
        zone = F.regexp_replace(group(8), ":", "")
        self.sign = F.substr(zone, F.lit(1), F.lit(1))
        self.offset = F.when(zone == "Z", "+0000").when(
            zone != "", F.rpad(zone, 5, "0")
        )
        stamp = F.concat(self.date, F.lit(" "), self.clock, F.lit("."), self.micros)
        # The cast says whether month, day and clock exist in the calendar.
        self.local = F.when(group(1) != "", stamp.try_cast("timestamp_ntz"))


def _with_pieces(text: Column, make: Callable[[_Iso], Column]) -> Column:
    """``make`` of the pieces; the text is looked up once and each group taken once.

    A one-element array binds a value to a name inside an expression. Its lambda is not
    part of the generated code of its stage, which would outgrow its limit otherwise.
    """
    groups = F.transform(
        F.array(text),
        lambda t: F.struct(*(F.regexp_extract(t, _ISO, n).alias(f"g{n}") for n in range(1, 9))),
    )
    return F.transform(groups, lambda found: make(_Iso(found)))[0]


def _offset_seconds(iso: _Iso) -> Column:
    hours = F.substr(iso.offset, F.lit(2), F.lit(2)).try_cast("int")
    minutes = F.substr(iso.offset, F.lit(4), F.lit(2)).try_cast("int")
    total = hours * 3600 + minutes * 60
    return F.coalesce(F.when(iso.sign == "-", -total).otherwise(total), F.lit(0))


def is_iso_timestamp(text: Column) -> Column:
    def valid(iso: _Iso) -> Column:
        return F.coalesce(iso.local.isNotNull(), F.lit(False)) & (
            F.abs(_offset_seconds(iso)) < 86_400
        )

    return _with_pieces(text, valid)


def iso_timestamp(text: Column) -> Column:
    """Instant in UTC (TIMESTAMP_NTZ); a text without offset is taken as it is."""
    return _with_pieces(
        text, lambda iso: iso.local - F.make_dt_interval(secs=_offset_seconds(iso))
    )


def iso_text(text: Column) -> Column:
    """The timestamp written back in its normal ISO form, with its own offset."""

    def written(iso: _Iso) -> Column:
        fraction = F.when(iso.micros == "000000", "").otherwise(
            F.concat(F.lit("."), iso.micros)
        )
        hours, minutes = (F.substr(iso.offset, F.lit(a), F.lit(n)) for a, n in ((1, 3), (4, 2)))
        offset = F.when(iso.offset.isNull(), "").otherwise(
            F.concat(hours, F.lit(":"), minutes)
        )
        return F.when(
            iso.local.isNotNull(),
            F.concat(iso.date, F.lit("T"), iso.clock, fraction, offset),
        )

    return _with_pieces(text, written)


def _stamp_ok(event: Column) -> Column:
    return is_iso_timestamp(jsonv.string(event, "$.timestamp"))


def is_strict_event(event: Column) -> Column:
    """True for events of the strict model."""
    p = "$.payload"
    kind = jsonv.string(event, "$.type")
    subtype = jsonv.string(event, f"{p}.type")
    message_ok = jsonv.is_string(event, f"{p}.message")
    tool_ok = jsonv.is_object(event, f"{p}.tool") & jsonv.is_string(event, f"{p}.tool.name")
    body_ok = (
        F.when(kind == "session_meta", True)
        .when(kind != "event_msg", False)
        .when(subtype.isin("user_message", "ai_response"), message_ok)
        .when(subtype.isin("tool_call", "tool_result"), tool_ok)
    )
    return (
        _stamp_ok(event)
        & jsonv.is_object(event, p)
        & F.coalesce(body_ok, F.lit(False))
    )


def _opened(grouped: DataFrame) -> DataFrame:
    return grouped.withColumn("_event", jsonv.parse(F.col("raw_json")))


def metadata_error(event: Column) -> Column:
    """What is wrong with the first line, in order of the checks."""
    p = "$.payload"
    kind_ok = F.coalesce(jsonv.string(event, "$.type") == "session_meta", F.lit(False))
    return (
        F.when(F.col("blank"), "Empty log file")
        .when(
            F.col("json_error").isNotNull(),
            F.concat(F.lit("Invalid JSON: "), F.col("json_error")),
        )
        .when(~jsonv.is_object(event), "Event must be a JSON object")
        .when(~kind_ok, "First event must be session_meta")
        .when(
            jsonv.not_an_object(event, p), "Session meta payload must be a JSON object"
        )
        .when(~jsonv.is_string(event, "$.timestamp"), "Invalid timestamp format")
        .when(
            ~_stamp_ok(event),
            F.concat(
                F.lit("Invalid timestamp format: Invalid isoformat string: '"),
                jsonv.string(event, "$.timestamp"),
                F.lit("'"),
            ),
        )
        .when(~jsonv.is_string(event, f"{p}.id"), "Missing or invalid session ID")
    )


def log_metadata(grouped: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row per file from its first physical line, or the error found there."""
    event = F.col("_event")
    stamp = jsonv.string(event, "$.timestamp")
    first = _opened(grouped.where("seq = 1")).withColumn("error", metadata_error(event))
    good = F.col("error").isNull()
    rows = first.select(
        "file_path",
        F.when(good, AGENT).alias("agent_type"),
        F.when(good, jsonv.string(event, "$.payload.id")).alias("session_id"),
        F.when(good, iso_timestamp(stamp)).alias("timestamp"),
        F.when(good, jsonv.column_text(event, "$.payload.cwd")).alias("workspace_path"),
        F.when(good, jsonv.column_text(event, "$.payload.version")).alias("version"),
        "error",
    )
    if files is None:
        return rows
    return files.select("file_path", F.lit(True).alias("_listed")).join(
        rows, "file_path", "left"
    ).select(
        *[c for c in rows.columns if c != "error"],
        F.when(F.col("agent_type").isNull() & F.col("error").isNull(), "Empty log file")
        .otherwise(F.col("error"))
        .alias("error"),
    )


def _checked(grouped: DataFrame) -> DataFrame:
    event = F.col("_event")
    bad = F.when(
        F.col("json_error").isNotNull(), F.concat(F.lit("Invalid JSON: "), F.col("json_error"))
    ).when(~is_strict_event(event), "Event failed validation")
    rows = _opened(grouped.where("NOT blank"))
    return rows.withColumn("_bad", bad)


def first_failures(grouped: DataFrame) -> DataFrame:
    """First bad event of each file (O48): file_path, line_number, error."""
    return (
        _checked(grouped)
        .where("_bad IS NOT NULL")
        .groupBy("file_path")
        .agg(F.min(F.struct(F.col("seq").alias("line_number"), F.col("_bad").alias("error"))).alias("f"))
        .select("file_path", "f.line_number", "f.error")
    )


def strict_events(grouped: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Good events before the first bad one, of files with good metadata.

    Per-file facts are spread to (file, chunk) pairs before they meet the events.
    """
    failures = first_failures(grouped) if failures is None else failures
    meta = log_metadata(grouped).where("error IS NULL").select("file_path", "session_id")
    facts = (
        grouped.select("file_path", "chunk")
        .distinct()
        .join(meta, "file_path")
        .join(failures.select("file_path", "line_number"), "file_path", "left")
    )
    rows = _checked(grouped).where("_bad IS NULL")
    return rows.join(facts, ["file_path", "chunk"]).where(
        "line_number IS NULL OR seq < line_number"
    )


_EVENT_COLUMNS = [
    "file_path",
    "seq",
    "agent_type",
    "timestamp",
    "timestamp_text",
    "event_type",
    "event_category",
    "priority",
    "session_id",
    "content",
    "is_user",
    "action_type",
    "tool_name",
    "parameters",
    "result",
    "raw_data",
]


def _projected(events: DataFrame, priority: str, **values: Column) -> DataFrame:
    stamp = jsonv.string(F.col("_event"), "$.timestamp")
    base = {
        "agent_type": F.lit(AGENT),
        "timestamp": iso_timestamp(stamp),
        "timestamp_text": iso_text(stamp),
        "priority": F.lit(PRIORITY[priority]),
        "raw_data": F.col("raw_json"),
        **values,
    }
    empty = {"content": "string", "is_user": "boolean", "action_type": "string",
             "tool_name": "string", "parameters": "string", "result": "string"}
    columns = []
    for name in _EVENT_COLUMNS:
        if name in base:
            columns.append(base[name].alias(name))
        elif name in empty:
            columns.append(F.lit(None).cast(empty[name]).alias(name))
        else:
            columns.append(F.col(name))
    return events.select(*columns)


def messages(events: DataFrame) -> DataFrame:
    """User messages and agent responses."""
    is_user = F.col("payload_type") == "user_message"
    rows = events.where(
        (F.col("event_type") == "event_msg")
        & F.col("payload_type").isin("user_message", "ai_response")
    )
    return _projected(
        rows,
        "HIGH",
        event_type=F.col("payload_type"),
        event_category=F.when(is_user, CATEGORY["USER_INPUT"]).otherwise(
            CATEGORY["AGENT_RESPONSE"]
        ),
        content=jsonv.string(F.col("_event"), "$.payload.message"),
        is_user=is_user,
    )


def actions(events: DataFrame) -> DataFrame:
    """Tool calls and results."""
    event, kind = F.col("_event"), F.col("payload_type")
    rows = events.where(
        (F.col("event_type") == "event_msg") & kind.isin("tool_call", "tool_result")
    )
    return _projected(
        rows,
        "MEDIUM",
        event_type=F.concat(F.lit("action."), kind),
        event_category=action_category(kind),
        action_type=kind,
        tool_name=jsonv.string(event, "$.payload.tool.name"),
        parameters=F.get_json_object("raw_json", "$.payload.tool.parameters"),
        result=jsonv.column_text(event, "$.payload.result"),
    )


def action_category(kind: Column) -> Column:
    return (
        F.when(kind == "tool_call", CATEGORY["TOOL_CALL"])
        .when(kind == "tool_result", CATEGORY["TOOL_RESULT"])
        .otherwise(CATEGORY["SYSTEM"])
    )


def agent_events(events: DataFrame) -> DataFrame:
    """Messages and actions in one frame."""
    return messages(events).unionByName(actions(events))


_MESSAGE = "agent_type string, timestamp string, event_type string, content string, " \
    "is_user boolean, session_id string, raw_data string"
_ACTION = "agent_type string, timestamp string, event_type string, event_category int, " \
    "priority int, session_id string, raw_data string, action_type string, " \
    "tool_name string, parameters string, result string"


def to_records(rows: DataFrame, action: bool) -> DataFrame:
    """Messages or actions as JSON records with nested parameters and raw event."""
    names = [piece.split()[0] for piece in (_ACTION if action else _MESSAGE).split(", ")]
    nested = [n for n in names if n in ("parameters", "raw_data")]
    flat = [
        (F.col("timestamp_text") if n == "timestamp" else F.col(n)).alias(n)
        for n in names
        if n not in nested
    ]
    record = json_record(F.struct(*flat), {n: F.col(n) for n in nested})
    return rows.select("file_path", "seq", record.alias("record"))


def from_records(records: DataFrame, action: bool) -> DataFrame:
    """Back from JSON records; type, category and priority follow from the content."""
    row = F.from_json("record", _ACTION if action else _MESSAGE)
    opened = records.select("file_path", "seq", row.alias("_r")).select(
        "file_path",
        "seq",
        "_r.*",
    )
    stamped = opened.withColumn("timestamp_text", iso_text(F.col("timestamp"))).withColumn(
        "timestamp", iso_timestamp(F.col("timestamp"))
    )
    if action:
        derived = {
            "agent_type": F.lit(AGENT),
            "event_type": F.concat(F.lit("action."), F.col("action_type")),
            "event_category": action_category(F.col("action_type")),
            "priority": F.lit(PRIORITY["MEDIUM"]),
        }
    else:
        derived = {
            "agent_type": F.lit(AGENT),
            "event_type": F.when(F.col("is_user"), "user_message").otherwise("ai_response"),
            "event_category": F.when(F.col("is_user"), CATEGORY["USER_INPUT"]).otherwise(
                CATEGORY["AGENT_RESPONSE"]
            ),
            "priority": F.lit(PRIORITY["HIGH"]),
        }
    return stamped.withColumns(derived)
