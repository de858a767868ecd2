"""From lines to validated, numbered and grouped events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlake.functions import jsonv
from sessionlake.functions.strict_json import strict_json
from sessionlake.functions.text import is_blank
from sessionlake.operators.chunks import with_running_totals

# Messages of rejected events.
NOT_AN_OBJECT = "Event must be a JSON object."
BAD_TYPE = "Event 'type' must be a non-empty string."
BAD_TIMESTAMP = "Event 'timestamp' must be a string or null."
BAD_PAYLOAD = "Event 'payload' must be a JSON object."

NOT_UTF8 = "not valid UTF-8"
TOO_LARGE = "JSON value too large to read"


def _containers(event: Column, *paths: str) -> Column:
    found = F.lit(False)
    for path in paths:
        found = found | jsonv.is_container(event, path)
    return found


def _resets_is_container(event: Column, limits: str) -> Column:
    first, second = f"{limits}.resets_at", f"{limits}.resets_in_seconds"
    return F.when(
        jsonv.truthy(event, first), jsonv.is_container(event, first)
    ).otherwise(jsonv.is_container(event, second))


def storage_fault(event: Column, event_type: Column, payload_type: Column) -> Column:
    """Why an event could not be stored under a prompt; null when it could.

    One such event below a prompt makes its whole file fail.
    """
    p = "$.payload"
    limits = f"{p}.rate_limits"
    call_name = jsonv.string(event, f"{p}.name")

    def subtype(name: str) -> Column:
        return F.coalesce(payload_type == name, F.lit(False))

    required_null = F.lit(False)
    for key in ("type", "category", "priority"):
        path = f"{p}.{key}"
        required_null = required_null | (
            jsonv.present(event, path) & jsonv.is_null(event, path)
        )
    token_fault = (
        jsonv.not_an_object(event, limits)
        | jsonv.not_an_object(event, f"{limits}.primary")
        | jsonv.not_an_object(event, f"{limits}.secondary")
        | _containers(
            event,
            *[
                f"{limits}.{window}.{field}"
                for window in ("primary", "secondary")
                for field in ("used_percent", "window_minutes")
            ],
        )
        | _resets_is_container(event, f"{limits}.primary")
        | _resets_is_container(event, f"{limits}.secondary")
    )
    message = f"{p}.message"
    of_event_msg = (
        F.when(
            subtype("user_message"),
            F.when(
                jsonv.truthy(event, message) & ~jsonv.is_string(event, message),
                "prompt message is not text",
            ),
        )
        .when(jsonv.is_null(event, "$.timestamp"), "event without timestamp")
        .when(required_null, "null in a required event field")
        .when(
            _containers(event, f"{p}.type", f"{p}.category", f"{p}.priority", f"{p}.session_id"),
            "nested value in an event field",
        )
        .when(subtype("token_count") & token_fault, "malformed rate limits")
    )
    sandbox = f"{p}.sandbox_policy"
    of_turn_context = F.when(
        jsonv.not_an_object(event, sandbox), "sandbox policy is not an object"
    ).when(
        _containers(
            event,
            f"{p}.cwd",
            f"{p}.approval_policy",
            f"{sandbox}.mode",
            f"{sandbox}.network_access",
        )
        | jsonv.is_object(event, f"{sandbox}.writable_roots"),
        "nested value in a turn context field",
    )
    of_response = F.when(
        subtype("function_call")
        & (
            _containers(event, f"{p}.arguments", f"{p}.name")
            | (
                F.coalesce(call_name != "update_plan", F.lit(True))
                & _containers(event, f"{p}.call_id")
            )
        ),
        "nested value in a function call field",
    ).when(
        subtype("function_call_output") & _containers(event, f"{p}.output"),
        "nested value in a function call output",
    )
    return (
        F.when(event_type == "event_msg", of_event_msg)
        .when(event_type == "turn_context", of_turn_context)
        .when(event_type == "response_item", of_response)
    )


def parse_lines(lines: DataFrame, clean: bool = True) -> DataFrame:
    """Check, scrub and classify each line.

    ``clean=False`` keeps the events as they are, for the report and the strict
    model, and looks for no faults. Adds: blank, json_error, raw_json, payload_at, payload_len, event_type,
    payload_type, timestamp, event_error, fault, is_anchor.
    """
    readable = F.is_valid_utf8("line")
    blank = is_blank(F.col("line"))
    checked = lines.select(
        "file_path",
        "chunk",
        "pos",
        blank.alias("blank"),
        readable.alias("_utf8"),
        strict_json(F.when(readable & ~blank, F.col("line")), clean).alias("_json"),
    )
    opened = checked.select(
        "file_path",
        "chunk",
        "pos",
        "blank",
        F.when(~F.col("_utf8"), NOT_UTF8).otherwise(F.col("_json.json_error")).alias(
            "json_error"
        ),
        F.col("_json.raw_json").alias("raw_json"),
        F.col("_json.payload_at").alias("payload_at"),
        F.col("_json.payload_len").alias("payload_len"),
    )
    return classify(opened, with_faults=clean)


def trusted_lines(lines: DataFrame, with_faults: bool = False) -> DataFrame:
    """Same columns for lines known to be clean JSON, such as stored ``raw_json``.

    Runs on the JVM alone: nothing has to be checked or scrubbed again.
    """
    return classify(
        lines.select(
            "file_path",
            "chunk",
            "pos",
            F.lit(False).alias("blank"),
            F.lit(None).cast("string").alias("json_error"),
            F.col("line").alias("raw_json"),
            F.lit(None).cast("int").alias("payload_at"),
            F.lit(None).cast("int").alias("payload_len"),
        ),
        with_faults,
    )


def classify(opened: DataFrame, with_faults: bool = False) -> DataFrame:
    """Header fields and first validation error of each event.

    Step by step, so that each value is looked up once. ``fault`` is worked out
    only where files may fail as a whole.
    """
    event, head = F.col("_event"), F.col("_head")
    kept = [F.col(c) for c in opened.columns]
    valued = opened.withColumn("_event", jsonv.parse(F.col("raw_json"))).withColumn(
        "_head",
        F.try_variant_get(
            event, "$", "struct<type:variant,timestamp:variant,payload:variant>"
        ),
    )
    kind, stamp, payload = (head[n] for n in ("type", "timestamp", "payload"))
    looked_up = valued.select(
        *kept,
        event,
        head.isNotNull().alias("_is_object"),
        jsonv.string(kind, "$").alias("event_type"),
        jsonv.string(stamp, "$").alias("timestamp"),
        (stamp.isNull() | F.is_variant_null(stamp)).alias("_no_stamp"),
        (payload.isNull() | F.is_variant_null(payload)).alias("_no_payload"),
        F.try_variant_get(payload, "$", "struct<type:variant>").alias("_payload"),
    )
    # Sound JSON that no variant can hold (over 128 MiB) fails its file by name.
    unread = F.col("raw_json").isNotNull() & event.isNull()
    error = (
        F.when(F.col("raw_json").isNull() | event.isNull(), None)
        .when(~F.col("_is_object"), NOT_AN_OBJECT)
        .when(F.col("event_type").isNull() | is_blank(F.col("event_type")), BAD_TYPE)
        .when(F.col("timestamp").isNull() & ~F.col("_no_stamp"), BAD_TIMESTAMP)
        .when(F.col("_payload").isNull() & ~F.col("_no_payload"), BAD_PAYLOAD)
    )
    judged = looked_up.select(
        *[F.coalesce("json_error", F.when(unread, TOO_LARGE)).alias("json_error")
          if name == "json_error" else F.col(name) for name in opened.columns],
        event,
        "event_type",
        jsonv.string(F.col("_payload.type"), "$").alias("payload_type"),
        "timestamp",
        error.alias("event_error"),
    )
    good = F.col("event_error").isNull() & event.isNotNull()
    anchor = (
        good
        & (F.col("event_type") == "event_msg")
        & (F.col("payload_type") == "user_message")
    )
    fault = F.lit(None).cast("string")
    if with_faults:
        fault = F.when(
            good, storage_fault(event, F.col("event_type"), F.col("payload_type"))
        )
    return judged.select(
        *kept,
        "event_type",
        "payload_type",
        "timestamp",
        "event_error",
        fault.alias("fault"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
    )


def number_and_group(parsed: DataFrame) -> DataFrame:
    """Add seq (physical line), event_index (non-blank) and prompt_index.

    An event belongs to the last user message before it; prompt_index 0 is the
    prelude. All three are running totals and share one shuffle.
    """
    return with_running_totals(
        parsed,
        ["file_path"],
        "pos",
        {
            "seq": F.lit(1),
            "event_index": (~F.col("blank")).cast("int"),
            "prompt_index": F.col("is_anchor").cast("int"),
        },
    )


def valid_events(grouped: DataFrame) -> DataFrame:
    return grouped.where(
        "NOT blank AND json_error IS NULL AND event_error IS NULL"
    )


def prelude(grouped: DataFrame) -> DataFrame:
    """Valid events before the first user message."""
    return valid_events(grouped).where("prompt_index = 0")


def members(grouped: DataFrame) -> DataFrame:
    """Valid events below a prompt, without the anchors."""
    return valid_events(grouped).where("prompt_index > 0 AND NOT is_anchor")


def payload_json() -> Column:
    """Text of the payload, cut out of the stored event."""
    return F.when(
        F.col("payload_at").isNotNull(),
        F.substr("raw_json", F.col("payload_at"), F.col("payload_len")),
    ).otherwise(F.get_json_object("raw_json", "$.payload"))


def ingest_errors(grouped: DataFrame) -> DataFrame:
    """Dead-letter rows of rejected events."""
    is_object = F.col("event_error") != NOT_AN_OBJECT
    return grouped.where("event_error IS NOT NULL").select(
        "file_path",
        F.col("event_index").alias("line_number"),
        F.lit("WARNING").alias("severity"),
        F.lit("invalid_event").alias("code"),
        F.col("event_error").alias("message"),
        F.lit("CONTINUE").alias("recommended_action"),
        F.when(
            is_object, F.concat(F.lit('{"event": '), F.col("raw_json"), F.lit("}"))
        ).alias("context"),
        "chunk",
    )


def serialize_errors(errors: DataFrame) -> DataFrame:
    """Errors as JSON text with nulls written out and the context nested."""
    fields = ["severity", "code", "message", "recommended_action", "file_path", "line_number"]
    return errors.select(
        "file_path",
        "line_number",
        jsonv.json_record(F.struct(*fields), {"context": F.col("context")}).alias(
            "error_json"
        ),
    )


def file_errors(grouped: DataFrame) -> DataFrame:
    """Files that fail as a whole, with the first reason.

    Columns file_path, line_number (physical), reason. A malformed line wins over
    a storage fault, since files are parsed before anything is stored.
    """
    broken = F.col("json_error").isNotNull()
    stuck = F.col("fault").isNotNull() & (F.col("prompt_index") > 0)
    reason = F.when(
        broken,
        F.concat(
            F.lit("Failed to parse JSON on line "),
            F.col("seq").cast("string"),
            F.lit(" of "),
            F.col("file_path"),
            F.lit(": "),
            F.col("json_error"),
        ),
    ).otherwise(F.col("fault"))
    return (
        grouped.where(broken | stuck)
        .groupBy("file_path")
        .agg(
            F.min(
                F.struct(
                    F.when(broken, 0).otherwise(1).alias("rank"),
                    F.col("seq").alias("line_number"),
                    reason.alias("reason"),
                )
            ).alias("first")
        )
        .select("file_path", "first.line_number", "first.reason")
    )
