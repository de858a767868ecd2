"""Queries that run the operators over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sessionlake.functions import jsonv, rules, text as texts
from sessionlake.functions.prompt import parse_prompt
from sessionlake.functions.strict_json import strict_json
from sessionlake.operators import (
    asof,
    calls,
    chunks,
    events,
    extract,
    redactions,
    report,
    rule_pass,
    sessions,
    strict,
    summary,
    tables,
)
from sessionlake.plans import ingest
from sessionlake.session import stage, staging_folder, staging_root
from sessionlake.sources import adapters, discovery, jsonl
from sessionlake.streaming import growing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return adapters.table(spark, sf_dir, name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.spread(_table(spark, sf_dir, "documents"), "doc_id")


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a grouped log."""
    lines = adapters.conversation_log(_table(spark, sf_dir, "conversations"))
    return events.number_and_group(events.trusted_lines(lines))


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a grouped log."""
    lines = adapters.activity_log(_table(spark, sf_dir, "events"))
    return events.number_and_group(events.trusted_lines(lines))


def _once(grouped: DataFrame) -> DataFrame:
    """Numbered log written once, for queries that read it from several sides."""
    return stage(grouped, "grouped")


def _files(grouped_source: DataFrame, path: Column) -> DataFrame:
    return grouped_source.select(path.alias("file_path")).distinct()


def _talk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(_table(spark, sf_dir, "conversations"), adapters.conv_path())


def _activity_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(_table(spark, sf_dir, "events"), adapters.user_path())


# --- sources -----------------------------------------------------------------


def _dated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations laid out as root/year/month/day/file."""
    c = F.col("conv_id")
    path = F.concat_ws(
        "/",
        F.lit("/logs"),
        (2021 + c % 4).cast("string"),
        (1 + c % 12).cast("string"),
        (1 + c % 28).cast("string"),
        F.concat(F.lit("conv-"), c.cast("string"), F.lit(".jsonl")),
    )
    return _files(_table(spark, sf_dir, "conversations").withColumn("conv_id", c), path)


@query
def first_session_file(spark, sf_dir):
    return discovery.first_files(_dated_files(spark, sf_dir), 1)


@query
def limited_session_files(spark, sf_dir):
    """Lines of the files a debug run reads."""
    files = _talk_files(spark, sf_dir)
    # Names without folders sort by name alone.
    wanted = discovery.first_files(files, discovery.debug_limit(None))
    lines = adapters.conversation_log(_table(spark, sf_dir, "conversations"))
    return jsonl.of_files(lines, wanted).groupBy("file_path").agg(
        F.count("*").alias("n_lines")
    )


def _document_lines(spark, sf_dir) -> DataFrame:
    """Document lines as JSONL; one in thirteen has text after its JSON."""
    rows = _documents(spark, sf_dir).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "body")
    )
    body = F.to_json(
        F.struct(F.lit("event_msg").alias("type"), F.struct("body").alias("payload"))
    )
    junk = F.when((F.col("doc_id") + F.col("n")) % 13 == 5, " junk").otherwise("")
    line = F.when(F.trim("body") == "", F.lit("  ")).otherwise(F.concat(body, junk))
    path = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return adapters.as_lines(rows, path, F.col("n"), line)


@query
def jsonl_load(spark, sf_dir):
    """Physical and non-blank lines per file, and its first malformed line."""
    parsed = stage(events.parse_lines(_document_lines(spark, sf_dir)), "parsed")
    numbered = events.number_and_group(parsed)
    return numbered.groupBy("file_path").agg(
        F.max("seq").alias("n_lines"),
        F.max("event_index").alias("n_events"),
        F.min(F.when(F.col("json_error").isNotNull(), F.col("seq"))).alias("first_bad_line"),
    )


# --- validation and errors ---------------------------------------------------


def _flawed_log(spark, sf_dir) -> DataFrame:
    """Events with every kind of flaw, by event_id modulo 7."""
    n = F.col("event_id")
    number, stamp = n.cast("string"), adapters.event_time()
    head = F.concat(F.lit('{"type": "event_msg", "timestamp": "'), stamp, F.lit('"'))
    line = (
        F.when(n % 7 == 0, F.concat(F.lit('"text '), number, F.lit('"')))
        .when(n % 7 == 1, F.concat(F.lit('{"type": " ", "n": '), number, F.lit("}")))
        .when(n % 7 == 2, F.concat(F.lit('{"type": "x", "timestamp": '), number, F.lit("}")))
        .when(n % 7 == 3, F.concat(head, F.lit(', "payload": "p'), number, F.lit('"}')))
        .when(n % 7 == 4, F.concat(head, F.lit(', "payload": null, "metadata": 3}')))
        .when(n % 7 == 5, F.concat(head, F.lit("}")))
        .otherwise(F.concat(head, F.lit(', "payload": {"n": '), number, F.lit("}}")))
    )
    lines = adapters.as_lines(
        _table(spark, sf_dir, "events"), adapters.user_path(), n, line
    )
    parsed = stage(events.parse_lines(lines), "parsed")
    return events.number_and_group(parsed)


@query
def event_validation(spark, sf_dir):
    return _flawed_log(spark, sf_dir).select("file_path", "event_index", "event_error")


@query
def event_normalization(spark, sf_dir):
    return events.valid_events(_flawed_log(spark, sf_dir)).select(
        "file_path", "event_index", "raw_json"
    )


@query
def dead_letter_errors(spark, sf_dir):
    return events.ingest_errors(_flawed_log(spark, sf_dir)).drop("chunk")


@query
def serialized_errors(spark, sf_dir):
    return events.serialize_errors(events.ingest_errors(_flawed_log(spark, sf_dir)))


@query
def error_preview(spark, sf_dir):
    return summary.error_preview(events.ingest_errors(_flawed_log(spark, sf_dir)))


@query
def atomic_files(spark, sf_dir):
    """Events kept per file after files with an event that cannot be stored."""
    k, n = F.col("k"), F.col("event_id")
    payload = (
        F.when((F.col("event_type") == "signup"), '{"type": "user_message", "message": "m"}')
        .when(
            (F.col("event_type") == "view") & (n % 97 == 3),
            '{"type": "token_count", "rate_limits": []}',
        )
        .otherwise(F.concat(F.lit('{"type": "agent_message", "n": '), k.cast("string"), F.lit("}")))
    )
    line = F.concat(
        F.lit('{"type": "event_msg", "timestamp": "'),
        adapters.event_time(),
        F.lit('", "payload": '),
        payload,
        F.lit("}"),
    )
    rows = _table(spark, sf_dir, "events").withColumn("k", adapters.prop())
    lines = adapters.as_lines(rows, adapters.user_path(), n, line)
    grouped = _once(events.number_and_group(events.trusted_lines(lines, with_faults=True)))
    kept = chunks.without_files(grouped, events.file_errors(grouped))
    return events.valid_events(kept).groupBy("file_path").agg(F.count("*").alias("n_events"))


# --- sanitization ------------------------------------------------------------


def _secret_texts(spark, sf_dir) -> DataFrame:
    """Documents, most of them turned into one form of secret."""
    d, text = F.col("doc_id"), F.col("text")
    made = (
        F.when(d % 6 == 0, F.concat(F.lit("  Sk-"), text))
        .when(d % 6 == 1, F.concat(text, F.lit("\n-----BEGIN KEY")))
        .when(d % 6 == 2, F.concat(F.md5("text"), F.md5("lang")))
        .when(d % 6 == 3, F.substr(F.concat(F.md5("text"), F.md5("lang")), F.lit(2)))
        .when(d % 6 == 4, F.concat(F.lit("BEARER "), text))
        .otherwise(text)
    )
    return _documents(spark, sf_dir).select("doc_id", made.alias("text"))


@query
def secret_strings(spark, sf_dir):
    return _secret_texts(spark, sf_dir).select(
        "doc_id", texts.looks_like_secret(F.col("text")).alias("is_secret")
    )


@query
def scrubbed_strings(spark, sf_dir):
    return _secret_texts(spark, sf_dir).select(
        "doc_id", texts.scrub_text(F.col("text")).alias("scrubbed")
    )


@query
def sensitive_keys(spark, sf_dir):
    """Values below sensitive keys, at any depth."""
    quoted = F.to_json(F.struct(F.col("text").alias("note")))
    line = F.concat(
        F.lit('{"api_key_backup": "keep", "Password": '),
        F.col("doc_id").cast("string"),
        F.lit(', "deep": {"SECRET": {"a": [1, null, "x", {"b": false}]}}, "doc": '),
        quoted,
        F.lit("}"),
    )
    rows = _documents(spark, sf_dir).select("doc_id", strict_json(line).alias("_j"))
    return rows.select("doc_id", F.col("_j.raw_json").alias("raw_json"))


@query
def deep_sanitize(spark, sf_dir):
    """Secrets inside lists and objects of events."""
    rows = _secret_texts(spark, sf_dir)
    line = F.to_json(
        F.struct(
            F.lit("response_item").alias("type"),
            F.struct(
                F.lit("message").alias("type"), adapters.content(F.col("text")).alias("content")
            ).alias("payload"),
        )
    )
    cleaned = rows.select("doc_id", strict_json(line).alias("_j"))
    return cleaned.select("doc_id", F.col("_j.raw_json").alias("raw_json"))


# --- grouping ----------------------------------------------------------------


@query
def prompt_groups(spark, sf_dir):
    return _talk(spark, sf_dir).select("file_path", "seq", "prompt_index", "is_anchor")


@query
def prompt_groups_activity(spark, sf_dir):
    return _activity(spark, sf_dir).select(
        "file_path", F.col("pos").alias("event_id"), "prompt_index"
    )


@query
def session_prelude(spark, sf_dir):
    return events.prelude(_activity(spark, sf_dir)).select(
        "file_path", "seq", "event_type", "payload_type", "timestamp"
    )


@query
def prompts(spark, sf_dir):
    return extract.prompts(_talk(spark, sf_dir)).select(
        "file_path", "prompt_index", "seq", "timestamp", "message"
    )


def _environment_log(spark, sf_dir) -> DataFrame:
    """Conversations whose first turns describe the session."""
    c, t = F.col("conv_id"), F.col("turn")
    stamp = adapters.turn_time(t)
    c_text = c.cast("string")
    meta = F.struct(
        F.when(c % 5 != 0, F.concat(F.lit("s"), c_text)).alias("id"),
        F.when(c % 2 == 0, F.concat(F.lit("p"), c_text))
        .when(c % 3 == 0, "")
        .alias("timestamp"),
        F.when(c % 3 == 0, "").otherwise(F.concat(F.lit("/home/"), c_text)).alias("cwd"),
    )
    described = F.concat(
        F.lit("<environment_context>\n<cwd> "),
        F.when(c % 4 == 0, "").otherwise(F.concat(F.lit("/w/"), t.cast("string"))),
        F.lit(" </cwd>\n<approval_policy>never</approval_policy>\n"),
        F.when(t == 1, "<sandbox_mode>full</sandbox_mode>").otherwise("<sandbox_mode>open"),
        F.lit("\n<network_access>on</network_access> "),
        F.col("text"),
    )
    message = F.struct(
        F.lit("message").alias("type"),
        adapters.content(F.when((c + t) % 3 == 0, F.col("text")).otherwise(described)).alias(
            "content"
        ),
    )
    prompt = F.struct(F.lit("user_message").alias("type"), F.col("text").alias("message"))
    line = (
        F.when(t == 0, adapters.event_json("session_meta", stamp, meta))
        .when(t < 3, adapters.event_json("response_item", stamp, message))
        .otherwise(adapters.event_json("event_msg", stamp, prompt))
    )
    lines = adapters.as_lines(
        _table(spark, sf_dir, "conversations"), adapters.conv_path(), t, line
    )
    return events.number_and_group(events.trusted_lines(lines))


@query
def session_rows(spark, sf_dir):
    grouped = _once(_environment_log(spark, sf_dir))
    rows = sessions.sessions(grouped, _talk_files(spark, sf_dir))
    return rows.drop("raw_json", "prelude_parts")


@query
def session_documents(spark, sf_dir):
    """Stored prelude of each session."""
    grouped = _once(_talk(spark, sf_dir))
    rows = sessions.sessions(grouped, _talk_files(spark, sf_dir))
    return rows.select("file_path", "raw_json", "prelude_parts")


@query
def environment_contexts(spark, sf_dir):
    rows = events.prelude(_environment_log(spark, sf_dir)).where("payload_type = 'message'")
    env = sessions.environment(jsonv.parse(F.col("raw_json")))
    return rows.select("file_path", "seq", env.alias("env")).select("file_path", "seq", "env.*")


@query
def tag_values(spark, sf_dir):
    d, text = F.col("doc_id"), F.col("text")
    tagged = (
        F.when(d % 4 == 0, F.concat(text, F.lit("<cwd> a<cwd>b "), text, F.lit(" </cwd></cwd>")))
        .when(d % 4 == 1, F.concat(F.lit("</cwd>"), text, F.lit("<cwd>open")))
        .when(d % 4 == 2, F.concat(F.lit("<cwd>"), text, F.lit("</cwd><cwd>2</cwd>")))
        .otherwise(text)
    )
    return _documents(spark, sf_dir).select(
        "doc_id", texts.tag_value(tagged, "cwd").alias("cwd")
    )


# --- extraction --------------------------------------------------------------


@query
def base_events(spark, sf_dir):
    return extract.base_events(_activity(spark, sf_dir)).drop("raw_json", "data")


@query
def base_event_documents(spark, sf_dir):
    """Stored payload and event texts."""
    grouped = events.members(_talk(spark, sf_dir))
    return extract.base_events(grouped).select("file_path", "seq", "data", "raw_json")


@query
def token_messages(spark, sf_dir):
    return extract.token_messages(_activity(spark, sf_dir)).drop("raw_json")


@query
def turn_context_messages(spark, sf_dir):
    return extract.turn_context_messages(_activity(spark, sf_dir)).drop("raw_json")


@query
def agent_reasoning_messages(spark, sf_dir):
    return extract.agent_reasoning_messages(_activity(spark, sf_dir)).drop("raw_json")


@query
def function_plan_messages(spark, sf_dir):
    return extract.function_plan_messages(_activity(spark, sf_dir)).drop("raw_json")


@query
def tool_calls(spark, sf_dir):
    return extract.tool_calls(_activity(spark, sf_dir)).select(
        "file_path", "prompt_index", "seq", "timestamp", "name", "call_id", "arguments"
    )


# --- call matching -----------------------------------------------------------


@query
def call_id_matches(spark, sf_dir):
    steps = calls.call_steps(_activity(spark, sf_dir))
    return calls.with_id_match(steps).drop("chunk")


@query
def call_waiting_line(spark, sf_dir):
    steps = calls.call_steps(_activity(spark, sf_dir))
    line = calls.waiting_line(calls.with_id_match(steps))
    return line.where("enter_no IS NOT NULL OR take_no IS NOT NULL").select(
        "file_path", "prompt_index", "seq", "is_call", "is_stub", "enter_no", "take_no"
    )


@query
def function_calls(spark, sf_dir):
    return calls.function_calls(_once(_activity(spark, sf_dir))).drop(
        "raw_call_json", "raw_output_json"
    )


@query
def growing_calls(spark, sf_dir):
    """Calls matched while the logs grow: three batches, with late and repeated lines."""
    grouped = _activity(spark, sf_dir)
    last = F.lit(_table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0)
    part = F.floor(F.col("pos") * 3 / (last + 1))
    late = F.least(part + (F.col("pos") % 10 == 0).cast("int"), F.lit(2))
    parts = F.when(F.col("pos") % 25 == 1, F.array(late, F.lit(2))).otherwise(F.array(late))
    sent = stage(
        grouped.select(
            "file_path",
            (F.col("seq") - 1).alias("pos"),
            F.col("raw_json").alias("line"),
            F.explode(parts).alias("part"),
        ),
        "sent",
    )
    folder = staging_folder(spark)
    for number in range(3):
        sent.where(F.col("part") == number).drop("part").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(sent.drop("part").schema).parquet(f"{folder}/in")
        growing.follow_lines(stream, f"{folder}/out", f"{folder}/marks", once=True).awaitTermination()
    return growing.matched_calls(spark, f"{folder}/out")


@query
def calls_in_context(spark, sf_dir):
    """Each tool call with the turn context in force."""
    return asof.calls_in_context(_activity(spark, sf_dir))


@query
def event_rollup(spark, sf_dir):
    return summary.event_rollup(_activity(spark, sf_dir))


# --- prompt template and rules -----------------------------------------------


@query
def prompt_template(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    message = F.concat(
        F.lit("## Active file: "),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")),
        F.lit("\r\n## Open tabs: ignored\n- tab "),
        d,
        F.lit("\n-\n plain.py \n\n- after\n## My request for Codex: ignored\n"),
        F.col("text"),
    )
    rows = _documents(spark, sf_dir).select(
        "doc_id", parse_prompt(message).alias("_p")
    )
    return rows.select("doc_id", "_p.*")


def _marked_documents(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id").cast("string")
    marked = F.concat(
        F.col("text"),
        F.lit(" Mail A"), d, F.lit("@Example.org or bearer  tok"), d, F.lit("-abcdef "),
        F.lit("[redact\npw"), F.when(F.col("doc_id") % 2 == 0, "=1").otherwise(""),
        F.lit("] see C:\\dir\\"), d, F.lit(" and [long note of "), d, F.lit("] in /var/log/"),
        d,
    )
    return _documents(spark, sf_dir).select("doc_id", marked.alias("text"))


@query
def rule_redaction(spark, sf_dir):
    done = rules.with_rules(_marked_documents(spark, sf_dir), "text", rules.DEFAULT_RULES)

    def count(rule_id):
        found = F.try_element_at("rule_counts", F.lit(rule_id))
        return F.coalesce(found, F.lit(0)).alias(f"n_{rule_id}")

    return done.select("doc_id", "redacted", *[count(r.id) for r in rules.DEFAULT_RULES])


_LITERALS = [
    {"id": "braces", "type": "literal", "pattern": "(the.", "replacement": "$1\\"},
    {"id": "word", "type": "literal", "pattern": "THE"},
    {"id": "off", "type": "regex", "pattern": "a", "enabled": False},
    {"id": "exact", "type": "regex", "pattern": "Que\\b", "ignore_case": False},
]


@query
def literal_rules(spark, sf_dir):
    marked = _documents(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("(the. "), F.col("text")).alias("text")
    )
    done = rules.with_rules(marked, "text", rules.make_rules(spark, _LITERALS))
    return done.select("doc_id", "redacted", F.explode("rule_counts").alias("rule_id", "n"))


@query
def rule_totals(spark, sf_dir):
    """Matches per rule over prompts and agent text, by the scope of the rule."""
    d, role = F.col("conv_id").cast("string"), F.col("role")
    mixed = F.concat(F.col("text"), F.lit(" u"), d, F.lit("@mail.org [long note of "), d, F.lit("]"))
    talk = _table(spark, sf_dir, "conversations").withColumn("text", mixed)
    stamp = adapters.turn_time(F.col("turn"))
    line = F.when(
        role == "user",
        adapters.event_json(
            "event_msg", stamp,
            F.struct(F.lit("user_message").alias("type"), F.col("text").alias("message")),
        ),
    ).otherwise(
        adapters.event_json(
            "event_msg", stamp,
            F.struct(F.lit("agent_reasoning").alias("type"), F.col("text").alias("text")),
        )
    )
    lines = adapters.as_lines(talk, adapters.conv_path(), F.col("turn"), line)
    grouped = _once(events.number_and_group(events.trusted_lines(lines)))
    field_rules = [
        {"id": "vowels", "type": "regex", "pattern": "[aeiou]{3}", "scope": "field"},
    ]
    active = rules.DEFAULT_RULES + rules.make_rules(spark, field_rules)
    fields = {"vowels": ["agent_reasoning_messages.text"]}
    return rule_pass.rule_totals(
        [
            rule_pass.redact_table(extract.prompts(grouped), "prompts", active, fields),
            rule_pass.redact_table(
                extract.agent_reasoning_messages(grouped),
                "agent_reasoning_messages",
                active,
                fields,
            ),
        ]
    )


_INGEST_RULES = [
    {"id": "keys", "type": "regex", "pattern": "key[0-9]+", "replacement": "<KEY>",
     "scope": "global"},
    {"id": "marker", "type": "regex", "pattern": "\\[redact [a-z0-9]+\\]",
     "replacement": "<MARK>", "scope": "prompt"},
    {"id": "file", "type": "regex", "pattern": "a[0-9]+\\.py", "replacement": "<FILE>",
     "scope": "field"},
]
_INGEST_TEXTS = {
    "prompts": ["message", "active_file", "my_request", "raw_json"],
    "events": ["data", "raw_json"],
    "agent_reasoning_messages": ["text", "raw_json"],
    "prelude_parts": ["events_json"],
}


@query
def ingest_redaction(spark, sf_dir):
    """Conversations through the whole ingest: rules by scope, then manual redactions.

    One row for each stored text, raw JSON among them.
    """
    c, role = F.col("conv_id").cast("string"), F.col("role")
    said = F.concat(F.lit("key"), c, F.lit(" "), F.replace("text", F.lit("\n"), F.lit(" ")))
    message = F.concat(
        F.lit("## Active file: a"), c, F.lit(".py\n## My request for Codex:\n"), said,
        F.lit(" [redact pw"), c, F.lit("x] end"),
    )
    answer = F.concat(said, F.lit(" end"))
    stamp = adapters.turn_time(F.col("turn"))

    def told(kind, name, text):
        return adapters.event_json(
            "event_msg", stamp, F.struct(F.lit(kind).alias("type"), text.alias(name))
        )

    line = F.when(role == "user", told("user_message", "message", message)).otherwise(
        told("agent_reasoning", "text", answer)
    )
    talk = _table(spark, sf_dir, "conversations")
    lines = adapters.as_lines(talk, adapters.conv_path(), F.col("turn"), line)
    fifth = F.col("conv_id") % 5
    manual = talk.where(fifth < 2).select(adapters.conv_path().alias("file_path"), fifth.alias("_n"))
    manual = manual.distinct().select(
        F.xxhash64("file_path").alias("id"),
        "file_path",
        F.lit(1).cast("bigint").alias("prompt_index"),
        F.when(F.col("_n") == 0, "prompt").otherwise("field").alias("scope"),
        F.when(F.col("_n") == 1, "my_request").alias("field_path"),
        F.when(F.col("_n") == 0, "<MANUAL>").otherwise("<MINE>").alias("replacement_text"),
        F.lit("2025-01-01 00:00:00").cast("timestamp").alias("created_at"),
    )
    built = ingest.build(
        lines,
        _talk_files(spark, sf_dir),
        rules=rules.make_rules(spark, _INGEST_RULES),
        fields={"file": ["prompts.active_file"]},
        manual=manual,
    ).tables
    found = None
    for name, columns in _INGEST_TEXTS.items():
        place = F.col("part" if name == "prelude_parts" else "seq").cast("bigint").alias("place")
        texts_of = [
            F.struct(F.lit(f"{name}.{column}").alias("stored"), F.col(column).alias("text"))
            for column in columns
        ]
        rows = built[name].select("file_path", place, F.inline(F.array(*texts_of)))
        found = rows if found is None else found.unionByName(rows)
    return found


@query
def rule_records(spark, sf_dir):
    """One rule record per document, every flaw among them, with its error."""
    d = F.col("doc_id")
    text = d.cast("string")
    kinds = F.element_at(F.array(*map(F.lit, ("Regex", "literal", "MARKER", "glob"))), (d % 4 + 1).cast("int"))
    scope = F.when(d % 3 == 0, "global").when(d % 3 == 2, "field").when(d % 2 == 0, "page")
    records = _documents(spark, sf_dir).select(
        d.cast("int").alias("position"),
        F.when(d % 13 != 0, F.concat(F.lit("r"), (d % 400).cast("string"))).alias("id"),
        F.when(d % 17 != 0, kinds).alias("type"),
        F.when(d % 19 != 0, F.when(d % 5 == 0, " \t").otherwise(text)).alias("pattern"),
        scope.alias("scope"),
        F.when(d % 2 == 0, text).alias("replacement"),
        F.when(d % 6 == 0, "false").when(d % 6 == 1, "0").when(d % 6 == 2, "true").alias("enabled"),
        F.when(d % 2 == 0, " ").otherwise(F.concat(F.lit(" why "), F.col("source"))).alias("reason"),
        F.col("lang").alias("actor"),
        F.when(d % 5 == 1, "").alias("ignore_case"),
        F.when(d % 5 == 2, "yes").alias("dotall"),
    )
    return rules.check_rules(records)


# --- manual redactions -------------------------------------------------------


def _redaction_requests(spark, sf_dir) -> DataFrame:
    """One request per document, every flaw among them."""
    d = F.col("doc_id")
    text = d.cast("string")
    return _documents(spark, sf_dir).select(
        d.alias("id"),
        F.when(d % 11 != 0, F.concat(F.lit("conv-"), (d % 100).cast("string"))).alias("file_path"),
        F.when(d % 11 != 0, 1 + d % 3).alias("prompt_index"),
        F.when(d % 17 == 0, "page")
        .when(d % 3 == 0, "prompt")
        .when(d % 3 == 1, "field")
        .otherwise("global")
        .alias("scope"),
        F.when(d % 3 != 1, None)
        .when(d % 5 == 0, None)
        .when(d % 5 == 1, " ")
        .otherwise(" message ")
        .alias("field_path"),
        F.when(d % 19 == 0, " ").otherwise(F.concat(F.lit(" <"), text, F.lit("> "))).alias(
            "replacement_text"
        ),
        F.when(d % 2 == 0, " ").otherwise(F.concat(F.lit(" why "), F.col("source"))).alias("reason"),
        F.col("lang").alias("actor"),
        (
            F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(days=d % 37)
        ).alias("created_at"),
    )


def _redaction_table(spark, sf_dir) -> DataFrame:
    requests = _redaction_requests(spark, sf_dir)
    checked = redactions.check_new(requests).where("error IS NULL")
    columns = [
        "id", "file_path", "prompt_index", "scope", "field_path", "replacement_text",
        "reason", "actor", "created_at",
    ]
    return checked.select(*columns, F.lit(None).cast("timestamp_ntz").alias("updated_at"))


@query
def redaction_create(spark, sf_dir):
    return redactions.check_new(_redaction_requests(spark, sf_dir)).drop("created_at")


@query
def redaction_get(spark, sf_dir):
    return redactions.get(_redaction_table(spark, sf_dir), 2).drop("created_at", "updated_at")


@query
def redaction_list(spark, sf_dir):
    rows = redactions.listing(_redaction_table(spark, sf_dir), scope="global")
    return rows.select("id", "file_path", "prompt_index", "replacement_text")


@query
def redaction_update(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    patches = labels.select(
        F.col("doc_id").alias("id"),
        F.lit(None).cast("string").alias("file_path"),
        F.lit(None).cast("bigint").alias("prompt_index"),
        F.when(F.col("toxic") == 1, "field")
        .when(F.col("doc_id") % 23 == 0, "page")
        .alias("scope"),
        F.lit(None).cast("string").alias("field_path"),
        F.when(F.col("quality") == 1, " better ").alias("replacement_text"),
        F.when(F.col("doc_id") % 7 == 0, " ").alias("reason"),
        F.lit(None).cast("string").alias("actor"),
    )
    now = F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")
    done = redactions.update(_redaction_table(spark, sf_dir), patches, now)
    return done.select(
        "id", "scope", "field_path", "replacement_text", "reason", "actor",
        F.col("updated_at").isNotNull().alias("updated"),
    )


@query
def redaction_delete(spark, sf_dir):
    ids = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return redactions.delete(_redaction_table(spark, sf_dir), ids).select("id", "scope")


@query
def manual_redactions(spark, sf_dir):
    """Prompts with their newest manual redaction in each text column."""
    found = extract.prompts(_talk(spark, sf_dir))
    done = redactions.apply_manual(
        found, _redaction_table(spark, sf_dir), ["message", "my_request"]
    )
    return done.select("file_path", "prompt_index", "message", "my_request")


# --- summaries and tables ----------------------------------------------------


@query
def session_summaries(spark, sf_dir):
    grouped = _once(_activity(spark, sf_dir))
    return summary.summaries(
        grouped,
        calls.match_calls(grouped),
        _activity_files(spark, sf_dir),
        events.ingest_errors(grouped),
    )


@query
def summary_totals(spark, sf_dir):
    return summary.totals(session_summaries(spark, sf_dir))


@query
def summary_error_lists(spark, sf_dir):
    """Number and lines of the errors a summary carries."""
    grouped = _once(_flawed_log(spark, sf_dir))
    errors = events.ingest_errors(grouped)
    counted = summary.summaries(
        grouped, calls.match_calls(grouped), _activity_files(spark, sf_dir), errors
    )
    listed = summary.with_error_lists(counted, errors)
    return listed.select(
        "file_path",
        "errors",
        F.array_join(F.col("error_list.line_number").cast("array<string>"), ",").alias("lines"),
    )


@query
def summary_error_parts(spark, sf_dir):
    """The errors of each file in parts of ten."""
    parts = summary.error_parts(events.ingest_errors(_once(_flawed_log(spark, sf_dir))), 10)
    numbers = F.col("error_list.line_number").cast("array<string>")
    return parts.select("file_path", "part", F.array_join(numbers, ",").alias("lines"))


@query
def table_counts(spark, sf_dir):
    return tables.table_counts({t: _table(spark, sf_dir, t) for t in DRIVER_TABLES})


@query
def max_ids(spark, sf_dir):
    keys = {
        "orders": "o_orderkey",
        "customer": "c_custkey",
        "events": "event_id",
        "documents": "doc_id",
        "pages": "page_id",
    }
    return tables.max_ids({t: (_table(spark, sf_dir, t), key) for t, key in keys.items()})


@query
def replaced_files(spark, sf_dir):
    """Orders stored per customer, where the files of some customers come anew."""
    stored = _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("file_path"),
        "o_orderkey",
        F.col("o_orderpriority").alias("message"),
        (F.col("o_custkey") % 3 == 0).alias("again"),
    )
    old = stored.drop("again")
    new = stored.where("again").drop("again").withColumn("message", F.lit("new"))
    return tables.replace_files(old, new, new.select("file_path").distinct())


@query
def refreshed_files(spark, sf_dir):
    """Files table after a second ingest of some files and a first one of others."""
    customers = _table(spark, sf_dir, "customer").select(
        F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("file_path"), "c_custkey"
    )
    first = F.lit("2025-01-01 00:00:00").cast("timestamp")
    old = customers.where("c_custkey % 2 = 0").select("file_path", first.alias("ingested_at"))
    now = F.lit("2025-02-01 00:00:00").cast("timestamp")
    done = tables.touch_files(old, customers.where("c_custkey % 3 = 0"), now)
    return done.select("file_path", (F.month("ingested_at") == 2).alias("refreshed"))


@query
def file_ids(spark, sf_dir):
    return tables.file_ids(_activity_files(spark, sf_dir))


@query
def table_copy(spark, sf_dir):
    """Log tables written, copied to an empty target and counted on both sides."""
    base = f"{staging_root(spark)}/sessionlake/copy-{uuid.uuid4().hex}"
    grouped = stage(_activity(spark, sf_dir), "grouped")
    files = _activity_files(spark, sf_dir)
    built = {
        "files": tables.file_ids(files).withColumn("ingested_at", F.lit(None)),
        "sessions": sessions.sessions(grouped, files),
        "prompts": extract.prompts(grouped),
        "token_messages": extract.token_messages(grouped),
        "turn_context_messages": extract.turn_context_messages(grouped),
        "agent_reasoning_messages": extract.agent_reasoning_messages(grouped),
        "function_plan_messages": extract.function_plan_messages(grouped),
        "function_calls": calls.function_calls(grouped),
        "events": extract.base_events(grouped),
        "redactions": _redaction_table(spark, sf_dir),
    }
    tables.write_tables(spark, built, f"{base}/source")
    return tables.copy_tables(spark, f"{base}/source", f"{base}/target", built)


# --- report ------------------------------------------------------------------


@query
def shortened_texts(spark, sf_dir):
    text = F.concat(F.lit(" \r\n"), F.col("text"), F.lit("\r"))
    return _documents(spark, sf_dir).select(
        "doc_id",
        texts.shorten(text).alias("short_120"),
        texts.shorten(text, 500).alias("short_500"),
        texts.shorten(text, 2).alias("short_2"),
    )


@query
def event_descriptions(spark, sf_dir):
    rows = report.with_events(report.raw_events(_activity(spark, sf_dir)))
    described = report.describe_event(F.col("_event"), F.col("_payload"))
    return rows.select("file_path", "seq", described.alias("description"))


@query
def session_report(spark, sf_dir):
    grouped = _once(_talk(spark, sf_dir))
    entries = report.report_entries(grouped, _talk_files(spark, sf_dir))
    return entries.select("file_path", "prompt_index", "seq", "part", "text")


@query
def session_report_texts(spark, sf_dir):
    """Whole report of each session."""
    grouped = _once(_talk(spark, sf_dir))
    entries = report.report_entries(grouped, _talk_files(spark, sf_dir))
    return report.report_texts(entries)


# --- strict model ------------------------------------------------------------


def _strict_log(spark, sf_dir) -> DataFrame:
    """Conversations in the strict model, some with a bad line."""
    c, t, text = F.col("conv_id"), F.col("turn"), F.col("text")
    stamp = F.when(c % 2 == 0, adapters.turn_time(t)).otherwise(
        F.replace(adapters.turn_time(t), F.lit("Z"), F.lit(".5+01:30"))
    )
    name = F.concat(F.lit("tool"), (c % 3).cast("string"))
    meta = F.struct(
        F.when(c % 13 != 12, F.concat(F.lit("s"), c.cast("string"))).alias("id"),
        F.concat(F.lit("/w/"), c.cast("string")).alias("cwd"),
    )
    kind = (
        F.when((c % 10 == 7) & (t == 3), "unknown")
        .when(t % 4 == 1, F.when(F.col("role") == "user", "user_message").otherwise("ai_response"))
        .when(t % 4 == 2, "tool_call")
        .when(t % 4 == 3, "tool_result")
        .otherwise("user_message")
    )
    payload = F.struct(
        kind.alias("type"),
        text.alias("message"),
        F.struct(
            name.alias("name"),
            F.when(t % 4 == 2, F.struct(t.alias("turn"))).alias("parameters"),
        ).alias("tool"),
        F.when(t % 4 == 3, F.concat(F.lit("ok "), t.cast("string"))).alias("result"),
    )
    meta_time = F.when(c % 13 == 11, "yesterday").otherwise(stamp)
    line = (
        F.when((t == 0) & (c % 13 == 10), "")
        .when(t == 0, adapters.event_json("session_meta", meta_time, meta))
        .when((c % 10 == 3) & (t == 2), '{"type": ')
        .otherwise(adapters.event_json("event_msg", stamp, payload))
    )
    lines = adapters.as_lines(_table(spark, sf_dir, "conversations"), adapters.conv_path(), t, line)
    parsed = stage(events.parse_lines(lines, clean=False), "parsed")
    return _once(events.number_and_group(parsed))


@query
def log_metadata(spark, sf_dir):
    rows = strict.log_metadata(_strict_log(spark, sf_dir))
    return rows.withColumn("timestamp", F.col("timestamp").cast("string"))


@query
def strict_validation(spark, sf_dir):
    grouped = _strict_log(spark, sf_dir).where("NOT blank AND json_error IS NULL")
    event = jsonv.parse(F.col("raw_json"))
    return grouped.select("file_path", "seq", strict.is_strict_event(event).alias("is_valid"))


@query
def strict_failures(spark, sf_dir):
    found = strict.first_failures(_strict_log(spark, sf_dir))
    return found.select(
        "file_path", "line_number", F.substring_index("error", ":", 1).alias("error")
    )


@query
def strict_messages(spark, sf_dir):
    rows = strict.messages(strict.strict_events(_strict_log(spark, sf_dir)))
    return rows.select(
        "file_path", "seq", "agent_type", F.col("timestamp").cast("string").alias("timestamp"),
        "timestamp_text", "event_type", "event_category", "priority", "session_id",
        "content", "is_user",
    )


@query
def strict_actions(spark, sf_dir):
    rows = strict.actions(strict.strict_events(_strict_log(spark, sf_dir)))
    return rows.select(
        "file_path", "seq", "agent_type", "timestamp_text", "event_type", "event_category",
        "priority", "session_id", "action_type", "tool_name", "parameters", "result",
    )


@query
def event_records(spark, sf_dir):
    """Messages and actions written as records and read back."""
    found = stage(
        strict.agent_events(strict.strict_events(_strict_log(spark, sf_dir))), "agent_events"
    )
    spoken = found.where("action_type IS NULL")
    acted = found.where("action_type IS NOT NULL")
    columns = ["file_path", "seq", "timestamp_text", "event_type", "event_category", "session_id"]
    back = strict.from_records(strict.to_records(spoken, False), False).select(
        *columns, F.col("content").alias("body")
    )
    return back.unionByName(
        strict.from_records(strict.to_records(acted, True), True).select(
            *columns, F.col("tool_name").alias("body")
        )
    )
