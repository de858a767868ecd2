"""Readable report of sessions, grouped by prompt.

Works on events as they are in the file (``parse_lines(clean=False)``). A report is
a frame of entries (file_path, prompt_index, seq, part, text); sorted by these keys
the texts are the lines of the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sessionlake.functions import jsonv
from sessionlake.functions.text import indent, shorten, strip
from sessionlake.operators import chunks

_TAB = "    "
_TEXT_LIMIT = 500


def _labelled(label: str, text: Column) -> Column:
    return indent(F.concat(F.lit(label), shorten(text, _TEXT_LIMIT)), _TAB)


def _limit_line(payload: Column, name: str) -> Column:
    """Usage line of one rate limit window (O43d)."""
    path = f"$.rate_limits.{name}"
    first, second = f"{path}.resets_at", f"{path}.resets_in_seconds"
    use_first = jsonv.truthy(payload, first)
    resets = F.when(use_first, jsonv.display_text(payload, first)).when(
        ~jsonv.is_null(payload, second), jsonv.display_text(payload, second)
    )
    line = F.concat(
        F.lit(f"{name}: "),
        jsonv.display_text(payload, f"{path}.used_percent"),
        F.lit("% used of "),
        jsonv.display_text(payload, f"{path}.window_minutes"),
        F.lit(" min window"),
        F.coalesce(F.concat(F.lit(", resets "), resets), F.lit("")),
    )
    return F.when(jsonv.is_object(payload, path), indent(line, _TAB))


def _event_msg_lines(payload: Column, subtype: Column) -> Column:
    """Lines of event_msg payloads (O43c). A message's label is its line prefix."""
    text = jsonv.filled_string(payload, "$.text")
    message = jsonv.filled_string(payload, "$.message")
    reason = jsonv.string(payload, "$.reason")
    return (
        F.when(subtype == "agent_reasoning", F.array(_labelled("reasoning: ", text)))
        .when(
            subtype == "token_count",
            F.array(_limit_line(payload, "primary"), _limit_line(payload, "secondary")),
        )
        .when(
            subtype == "agent_message",
            F.array(indent(shorten(message, _TEXT_LIMIT), f"{_TAB}message: ")),
        )
        .when(
            subtype == "turn_aborted",
            F.array(indent(F.concat(F.lit("reason: "), reason), _TAB)),
        )
    )


def _response_lines(payload: Column, subtype: Column) -> Column:
    """Lines of response_item payloads (O43e)."""
    texts = F.filter(
        F.transform(
            jsonv.as_array(payload, "$.content"), lambda item: jsonv.string(item, "$.text")
        ),
        lambda text: text.isNotNull(),
    )
    joined = F.when(F.size(texts) > 0, F.array_join(texts, " "))
    name = F.when(jsonv.truthy(payload, "$.name"), jsonv.display_text(payload, "$.name"))
    return (
        F.when(
            subtype == "reasoning",
            F.array(_labelled("summary: ", jsonv.string(payload, "$.summary[0].text"))),
        )
        .when(
            subtype == "message",
            F.array(indent(shorten(joined, _TEXT_LIMIT), f"{_TAB}message: ")),
        )
        .when(
            subtype == "function_call",
            F.array(
                indent(F.concat(F.lit("function: "), name), _TAB),
                _labelled("args: ", jsonv.filled_string(payload, "$.arguments")),
            ),
        )
        .when(
            subtype == "function_call_output",
            F.array(_labelled("output: ", jsonv.string(payload, "$.output"))),
        )
    )


def describe_event(event: Column, payload: Column) -> Column:
    """Header and payload lines of an event (O43b), see ``with_events``."""
    kind = jsonv.string(event, "$.type")
    subtype = jsonv.string(event, "$.payload.type")
    shown = F.when(
        jsonv.truthy(event, "$.payload.type"), jsonv.display_text(event, "$.payload.type")
    )
    header = F.concat(
        jsonv.display_text(event, "$.type", missing="<unknown>"),
        F.coalesce(F.concat(F.lit(" ("), shown, F.lit(")")), F.lit("")),
        F.lit(" @ "),
        jsonv.display_text(event, "$.timestamp", missing="?"),
    )
    cwd = indent(F.concat(F.lit("cwd: "), jsonv.string(payload, "$.cwd")), _TAB)
    lines = (
        F.when(kind == "event_msg", _event_msg_lines(payload, subtype))
        .when(kind == "response_item", _response_lines(payload, subtype))
        .when((kind == "turn_context") | (subtype == "turn_context"), F.array(cwd))
    )
    return F.concat_ws("\n", header, lines)  # missing lines are left out


def raw_events(grouped: DataFrame) -> DataFrame:
    """All events in file order; nothing is validated for the report."""
    return grouped.where("NOT blank AND json_error IS NULL")


def with_events(rows: DataFrame) -> DataFrame:
    """Rows with ``_event`` and its ``_payload``, parsed once for all that reads them."""
    parsed = rows.withColumn("_event", jsonv.parse(F.col("raw_json")))
    return parsed.withColumn("_payload", jsonv.at(F.col("_event"), "$.payload"))


def report_entries(grouped: DataFrame, files: DataFrame) -> DataFrame:
    """Entries of the reports of all files (O43g)."""
    event = F.col("_event")
    rows = with_events(raw_events(grouped))
    key = ["file_path", "prompt_index"]

    def fixed(frame: DataFrame, seq: int, part: int, text: str) -> DataFrame:
        return frame.select(
            "file_path",
            F.col("prompt_index"),
            F.lit(seq).cast("bigint").alias("seq"),
            F.lit(part).alias("part"),
            F.lit(text).alias("text"),
        )

    start = files.select(
        "file_path",
        F.lit(0).cast("bigint").alias("prompt_index"),
        F.lit(0).cast("bigint").alias("seq"),
        F.lit(0).alias("part"),
        F.concat(F.lit("Session file: "), F.col("file_path")).alias("text"),
    )
    below = ~F.col("is_anchor")
    groups = raw_events(grouped).groupBy(*key).agg(
        F.max("is_anchor").alias("has_anchor"),
        F.count_if(below).alias("n_events"),
        F.min(F.when(F.col("is_anchor"), F.col("seq"))).alias("anchor_seq"),
    )
    preludes = groups.where("prompt_index = 0")
    no_prompts = (
        files.select("file_path")
        .join(
            groups.where("prompt_index > 0").select("file_path").distinct(),
            "file_path",
            "left_anti",
        )
        .withColumn("prompt_index", F.lit(0).cast("bigint"))
    )
    described = describe_event(event, F.col("_payload"))
    events = rows.where(below).select(
        *key,
        "seq",
        F.lit(2).alias("part"),
        F.when(F.col("prompt_index") > 0, indent(described, _TAB))
        .otherwise(indent(described, "  "))
        .alias("text"),
    )
    message = strip(F.coalesce(jsonv.string(event, "$.payload.message"), F.lit("")))
    body = shorten(message, _TEXT_LIMIT)
    prompt_rows = rows.where("is_anchor").select(
        *key,
        "seq",
        F.explode(
            F.array(
                F.struct(
                    F.lit(0).alias("part"),
                    F.concat(
                        F.lit("\n== Prompt "),
                        F.col("prompt_index").cast("string"),
                        F.lit(" @ "),
                        jsonv.display_text(event, "$.timestamp", missing="?"),
                        F.lit(" =="),
                    ).alias("text"),
                ),
                F.struct(
                    F.lit(1).alias("part"),
                    indent(F.when(body == "", "<empty prompt>").otherwise(body), "  ").alias(
                        "text"
                    ),
                ),
            )
        ).alias("entry"),
    ).select(*key, "seq", "entry.part", "entry.text")
    notices = groups.where("prompt_index > 0").select(
        *key,
        F.col("anchor_seq").alias("seq"),
        F.lit(2).alias("part"),
        F.when(F.col("n_events") == 0, "  (No subsequent events recorded.)")
        .otherwise("  -- Following events --")
        .alias("text"),
    )
    last = 2**62
    entries = [
        start,
        fixed(preludes, 0, 1, ""),
        fixed(preludes, 0, 2, "-- Session Prelude --"),
        fixed(no_prompts, last, 0, "\nNo user messages found in session."),
        prompt_rows,
        notices,
        events,
    ]
    all_entries = entries[0]
    for frame in entries[1:]:
        all_entries = all_entries.unionByName(frame)
    return all_entries


def report_texts(entries: DataFrame) -> DataFrame:
    """Report text in parts (file_path, part, text), each of a bounded run of events.

    Joined in order with a line feed they are the report. A session below
    CHUNK_ROWS lines has one part, and a second one if it ends with the notice
    about missing prompts.
    """
    at = F.struct("prompt_index", "seq", "part")
    return (
        entries.groupBy("file_path", chunks.chunk_of(F.col("seq")).alias("_chunk"))
        .agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "text"))).alias("_lines"))
        .select(
            "file_path",
            F.col("_chunk").alias("part"),
            F.array_join(F.col("_lines.text"), "\n").alias("text"),
        )
    )


def _in_order(entries: DataFrame) -> DataFrame:
    """Range partitioning on the full sort key cuts a huge report over many tasks."""
    key = ["file_path", "prompt_index", "seq", "part"]
    return entries.select(*key, "text").repartitionByRange(*key).sortWithinPartitions(*key)


def write_report(entries: DataFrame, path: str) -> None:
    """Write all reports as text, one after the other; each starts with its file's name.

    The number of text files hangs on the amount of text, not on the number of sessions.
    """
    _in_order(entries).select("text").write.mode("overwrite").text(path)


def store_report(entries: DataFrame, path: str) -> None:
    """Write all reports as sorted Parquet, of which ``read_report`` reads few files."""
    _in_order(entries).write.mode("overwrite").parquet(path)


def read_report(spark: SparkSession, path: str, file_path: str) -> DataFrame:
    """The lines (text) of one stored report in order; none for a file without report.

    Files are sorted by ``file_path``, so the filter reaches the bounds that Parquet keeps
    and passes over files of other reports.
    """
    of_file = spark.read.parquet(path).where(F.col("file_path") == file_path)
    return of_file.orderBy("prompt_index", "seq", "part").select("text")
