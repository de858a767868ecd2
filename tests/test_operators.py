"""Operators on small logs with known results."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import event, item, msg
from sessionlake.functions import jsonv, rules
from sessionlake.operators import (
    chunks,
    events,
    extract,
    redactions,
    report,
    rule_pass,
    sessions,
    strict,
    summary,
)

PROMPT = msg("user_message", message="go")


def log(spark, logs, chunk_rows=chunks.CHUNK_ROWS, clean=True):
    """Grouped log of ``{file: [events or lines]}``."""
    rows = [
        (name, n // chunk_rows, n, line if isinstance(line, str) else json.dumps(line))
        for name, lines in logs.items()
        for n, line in enumerate(lines)
    ]
    schema = "file_path string, chunk bigint, pos bigint, line string"
    parsed = events.parse_lines(spark.createDataFrame(rows, schema), clean)
    return events.number_and_group(parsed)


def files(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "file_path string")


def got(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


# --- grouping and sessions -----------------------------------------------------


def test_prompt_groups_do_not_depend_on_chunks(spark):
    rng = random.Random(5)
    logs = {
        f"f{i}": [PROMPT if rng.random() < 0.3 else msg("x") for _ in range(rng.randint(1, 60))]
        for i in range(20)
    }
    expected = {}
    for name, lines in logs.items():
        group = 0
        for n, line in enumerate(lines, 1):
            group += line is PROMPT
            expected[name, n] = group
    for size in (4, 1000):
        found = got(log(spark, logs, size), "file_path", "seq", "prompt_index")
        assert {(f, s): p for f, s, p in found} == expected


def test_running_totals_of_one_hot_key(spark):
    rows = spark.range(5000).select(
        F.lit("hot").alias("file_path"), (F.col("id") % 4999).alias("v"), F.col("id").alias("seq"),
        F.floor(F.col("id") / 64).alias("chunk"),
    )
    total = chunks.with_running_totals(rows, ["file_path"], "seq", {"t": F.col("v")})
    before = chunks.with_previous(total, ["file_path"], "seq", {"p": "t"})
    wrong = before.where("t <> p + v OR (p IS NULL AND seq <> 0)")
    assert wrong.count() == 0 and before.where("p IS NULL").count() == 1


def env(text):
    return item("message", content=[{"text": "plain"}, {"text": text}, 3])


def test_session_fold(spark):
    logs = {
        "a": [
            event("session_meta", {"id": "one", "timestamp": "t1", "cwd": "/one"}),
            env("<environment_context><cwd>/env</cwd><sandbox_mode>x</sandbox_mode>"),
            event("session_meta", {"cwd": ""}, "t9"),
            env("<environment_context><cwd></cwd><approval_policy> p </approval_policy>"),
            PROMPT,
            event("session_meta", {"id": "late"}),
        ],
        "b": [PROMPT],
        "c": [event("session_meta", {"id": 7, "timestamp": True, "cwd": False})],
    }
    rows = sessions.sessions(log(spark, logs), files(spark, "a", "b", "c", "empty"))
    found = {r.file_path: tuple(r)[1:7] for r in rows.collect()}
    assert found == {
        "a": (None, "t9", "/env", "p", None, None),
        "b": (None,) * 6,
        "c": ("7", "1", None, None, None, None),
        "empty": (None,) * 6,
    }


def test_long_preludes_stay_whole_in_parts(spark):
    grouped = log(spark, {"a": [msg("x", n=n) for n in range(200)], "b": [msg("y")]}, 16)
    parts = sessions.prelude_parts(grouped, part_bytes=1000)
    texts = [r.events_json for r in parts.where("file_path = 'a'").orderBy("part").collect()]
    assert len(texts) > 5 and max(map(len, texts)) < 1200
    document = json.loads("[" + ", ".join(texts) + "]")
    assert [e["payload"]["n"] for e in document] == list(range(200))
    rows = sessions.sessions(grouped, files(spark, "a", "b"), parts).orderBy("file_path")
    a, b = rows.collect()
    assert a.prelude_parts == len(texts) and json.loads(a.raw_json)["events"] == document
    assert json.loads(b.raw_json)["events"][0]["payload"] == {"type": "y"}


# --- faults ----------------------------------------------------------------------


def tokens(**limits):
    return msg("token_count", rate_limits=limits)


FAULTY = [
    msg("user_message", message=5),
    msg("user_message", message=["x"]),
    msg("x", ts=None),
    event("event_msg", {"type": None}),
    msg("x", category=None),
    msg("x", session_id={"a": 1}),
    msg("token_count", rate_limits=None),
    msg("token_count", rate_limits=[]),
    tokens(primary=None),
    tokens(secondary="x"),
    tokens(primary={"used_percent": [1]}),
    tokens(primary={"resets_at": {"a": 1}}),
    event("turn_context", {"sandbox_policy": None}),
    event("turn_context", {"cwd": []}),
    event("turn_context", {"sandbox_policy": {"writable_roots": {}}}),
    item("function_call", name="update_plan", arguments={}),
    item("function_call", name="x", call_id=[1]),
    item("function_call_output", output={"a": 1}),
]
FINE = [
    msg("user_message", message=0),
    msg("user_message", message=None),
    event("event_msg", {}),
    msg("token_count"),
    tokens(primary={"resets_at": {}, "resets_in_seconds": 3}),
    event("turn_context", {"sandbox_policy": {"writable_roots": [1, None, True, "x", 2.0]}}),
    item("function_call", name="update_plan", call_id=[1], arguments=None),
    item("function_call_output", output=None),
    item("message", content={"a": 1}),
    event("other", None, None),
]


def test_storage_faults(spark):
    logs = {f"bad{n}": [PROMPT, line] for n, line in enumerate(FAULTY)}
    logs |= {f"fine{n}": [PROMPT, line] for n, line in enumerate(FINE)}
    logs["prelude"] = [line for line in FAULTY if line["payload"].get("type") != "user_message"]
    found = {r.file_path for r in events.file_errors(log(spark, logs)).collect()}
    assert found == {name for name in logs if name.startswith("bad")}


def test_without_files(spark):
    grouped = log(spark, {"a": [PROMPT] * 10, "b": [PROMPT] * 3}, 4)
    kept = chunks.without_files(grouped, files(spark, "a"))
    assert {r.file_path for r in kept.collect()} == {"b"}


# --- extraction -------------------------------------------------------------------


def test_extraction_details(spark):
    lines = [
        PROMPT,
        tokens(primary={"used_percent": "12.5", "window_minutes": 60.0, "resets_at": 0,
                        "resets_in_seconds": 1.5},
               secondary={"used_percent": True, "resets_at": "", "resets_in_seconds": "soon"}),
        event("turn_context", {"cwd": 5, "sandbox_policy": {
            "network_access": True, "writable_roots": ["/a", 1, None, False, 2.0]}}),
        msg("agent_reasoning", text=" ", summary=[{"text": " s "}, {"text": "t"}]),
        msg("turn_aborted", text=1, summary=["x"], content="c", reason="r"),
        msg("agent_message", message="m"),
        msg("x", category="c", priority=3, session_id=False),
    ]
    grouped = log(spark, {"f": lines})
    token = extract.token_messages(grouped).first()
    assert tuple(token)[4:10] == (12.5, 60, "1.5", 1.0, None, "soon")
    turn = extract.turn_context_messages(grouped).first()
    assert (turn.cwd, turn.network_access, turn.writable_roots) == (
        "5", "1", "/a, 1, None, False, 2.0",
    )
    reasons = extract.agent_reasoning_messages(grouped).orderBy("seq")
    assert got(reasons, "source", "text") == [
        ("event_msg", " s "), ("turn_aborted", "c"), ("agent_message", None),
    ]
    last = extract.base_events(grouped).orderBy("seq").collect()[-1]
    assert (last.category, last.priority, last.session_id) == ("c", "3", "0")
    assert extract.prompts(log(spark, {"f": [msg("user_message", message=None)]})).first().message == ""


# --- redaction table ---------------------------------------------------------------


def table_of(spark, rows):
    full = [
        (i, f, p, scope, path, text, None, None, datetime(2025, 1, day), None)
        for i, f, p, scope, path, text, day in rows
    ]
    from sessionlake.schemas import schema_of

    return spark.createDataFrame(full, schema_of("redactions"))


def test_redaction_table(spark):
    table = table_of(spark, [(1, "f", 1, "prompt", None, "<a>", 1)])
    schema = (
        "id bigint, file_path string, prompt_index bigint, scope string, field_path string,"
        " replacement_text string, reason string, actor string, created_at timestamp"
    )
    day = datetime(2025, 1, 2)
    requests = spark.createDataFrame(
        [
            (2, "f", 1, "field", " message ", " x ", " ", " me ", day),
            (3, "f", 1, "page", None, "x", None, None, day),
            (4, "f", 1, "field", None, "x", None, None, day),
            (5, "f", 1, "prompt", " ", "x", None, None, day),
            (6, "f", 1, "global", None, "  ", None, None, day),
        ],
        schema,
    )
    table, rejected = redactions.create(table, requests)
    assert got(table.where("id = 2"), "field_path", "replacement_text", "reason", "actor") == [
        ("message", "x", None, "me")
    ]
    assert {r.id: r.error for r in rejected.collect()} == {
        3: "Invalid scope 'page'.",
        4: redactions.PATH_NEEDED,
        5: redactions.BLANK_PATH,
        6: redactions.NO_REPLACEMENT,
    }
    assert [r.id for r in redactions.listing(table, ("f", 1)).collect()] == [2, 1]
    assert [r.id for r in redactions.listing(table, scope="prompt").collect()] == [1]
    with pytest.raises(redactions.RedactionError):
        redactions.listing(table, scope="page")
    patches = spark.createDataFrame(
        [
            (1, None, None, "field", None, None, None, None),
            (2, None, None, None, None, " y ", None, " "),
            (9, None, None, "global", None, None, None, None),
        ],
        "id bigint, file_path string, prompt_index bigint, scope string, field_path string,"
        " replacement_text string, reason string, actor string",
    )
    done = redactions.update(table, patches, F.current_timestamp()).orderBy("id")
    assert got(done, "id", "scope", "replacement_text", "actor", F.isnotnull("updated_at")) == [
        (1, "field", "<a>", None, True), (2, "field", "y", None, True),
    ]
    none = redactions.update(table, patches.where("id = 9"), F.current_timestamp())
    assert none.where("updated_at IS NOT NULL").count() == 0
    left = redactions.delete(table, spark.createDataFrame([(1,)], "id bigint"))
    assert [r.id for r in left.collect()] == [2]
    assert redactions.get(table, 2).count() == 1 and redactions.get(table, 3).count() == 0


def test_manual_redactions_override_rules(spark):
    grouped = log(spark, {"f": [msg("user_message", message=f"me@x.org {n}") for n in range(4)]})
    redacted = rule_pass.redact_table(
        extract.prompts(grouped), "prompts", rules.DEFAULT_RULES
    ).with_map()
    table = table_of(
        spark,
        [
            (1, "f", 1, "prompt", None, "old", 1),
            (2, "f", 1, "prompt", None, "new", 2),
            (3, "f", 2, "field", "my_request", "only request", 3),
            (4, None, None, "global", None, "all", 1),
            (5, "f", 3, "global", None, "third", 1),
            (6, None, None, "prompt", None, "no target", 9),
        ],
    )
    done = redactions.apply_manual(redacted, table, ["message", "my_request"])
    assert got(done.orderBy("seq"), "message", "my_request") == [
        ("new", "all"), ("all", "only request"), ("third", "third"), ("all", "all"),
    ]
    assert redacted.first().rule_counts == {"email": 1}
    none = redactions.apply_manual(redacted, table.where("false"), ["message"])
    assert none.orderBy("seq").first().message == "<REDACTED> 0"


# --- summary -------------------------------------------------------------------------


def test_error_lists_and_preview(spark):
    grouped = log(spark, {"f": ["1", "2", "3", "4", json.dumps(PROMPT)], "g": [PROMPT], "h": ["1"]}, 2)
    errors = events.ingest_errors(grouped)
    preview = summary.error_preview(errors).where("file_path = 'f'").orderBy("line_no")
    line = f"  - WARNING/invalid_event: {events.NOT_AN_OBJECT}"
    assert [r.text for r in preview.collect()] == ["errors: 4", line, line, line, "  - ... 1 more"]
    calls = spark.createDataFrame([], "file_path string")
    counted = summary.summaries(grouped, calls, files(spark, "f", "g", "h"), errors)
    listed = summary.with_error_lists(counted, errors).orderBy("file_path")
    found = {r.file_path: (r.prompts, r.errors, r.error_list) for r in listed.collect()}
    assert found["f"][:2] == (1, 4) and found["g"] == (1, 0, [])
    assert [e.line_number for e in found["f"][2]] == [1, 2, 3, 4]
    assert found["h"][1] == 1 and found["h"][2][0].line_number == 1
    total = summary.totals(counted).first()
    assert (total.files_processed, total.prompts, total.errors) == (3, 2, 5)


# --- report --------------------------------------------------------------------------


def test_report_text(spark):
    lines = [
        event("session_meta", {"id": "x"}, "t0"),
        item("message", "t1", content=[{"text": "a"}, {"text": "b\n\nc"}, {"no": 1}]),
        {"payload": {"type": "turn_context", "cwd": "/w"}},
        msg("user_message", "t2", message=" hello\nworld "),
        msg("agent_message", "t3", message="one\ntwo"),
        tokens(primary={"used_percent": 1.0, "window_minutes": 300, "resets_at": 5},
               secondary={"used_percent": None}),
        item("function_call", None, name="run", arguments="{}"),
        item("function_call_output", "t5", output=""),
        item("reasoning", "t6", summary=[{"text": "why"}]),
        msg("turn_aborted", "t7", reason="stop"),
        msg("user_message", "t8", message=""),
    ]
    grouped = log(spark, {"f": lines, "g": [event("x", {}, "t")]}, clean=False)
    entries = report.report_entries(grouped, files(spark, "f", "g"))
    ordered = entries.orderBy("file_path", "prompt_index", "seq", "part").collect()
    text = "\n".join(r.text for r in ordered if r.file_path == "f")
    assert text == """Session file: f

-- Session Prelude --
  session_meta @ t0
  response_item (message) @ t1
      message: a b

      message: c
  <unknown> (turn_context) @ ?
      cwd: /w

== Prompt 1 @ t2 ==
  hello
  world
  -- Following events --
    event_msg (agent_message) @ t3
        message: one
        message: two
    event_msg (token_count) @ 2025-01-01T00:00:00Z
        primary: 1.0% used of 300 min window, resets 5
        secondary: None% used of None min window
    response_item (function_call) @ None
        function: run
        args: {}
    response_item (function_call_output) @ t5
        output: 
    response_item (reasoning) @ t6
        summary: why
    event_msg (turn_aborted) @ t7
        reason: stop

== Prompt 2 @ t8 ==
  <empty prompt>
  (No subsequent events recorded.)"""
    other = "\n".join(r.text for r in ordered if r.file_path == "g")
    assert other == (
        "Session file: g\n\n-- Session Prelude --\n  x @ t\n\nNo user messages found in session."
    )
    assert report.report_texts(entries).where("file_path = 'f'").first().text == text


def test_report_files(spark, tmp_path):
    grouped = log(spark, {"f": [PROMPT]}, clean=False)
    entries = report.report_entries(grouped, files(spark, "f"))
    report.write_report(entries, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() > 3


def test_stored_reports(spark, tmp_path):
    grouped = log(spark, {name: [PROMPT, PROMPT] for name in "fgh"}, clean=False)
    entries = report.report_entries(grouped, files(spark, *"fgh", "empty"))
    path = str(tmp_path / "stored")
    report.store_report(entries, path)
    whole = {row.file_path: row.text for row in report.report_texts(entries).where("part = 0").collect()}
    for name in "fgh":
        lines = [row.text for row in report.read_report(spark, path, name).collect()]
        assert "\n".join(lines) == whole[name]
    assert report.read_report(spark, path, "empty").count() == 2
    assert report.read_report(spark, path, "missing").count() == 0
    plan = report.read_report(spark, path, "f")._jdf.queryExecution().toString()
    assert "EqualTo(file_path,f)" in plan


# --- strict model ----------------------------------------------------------------------


META = event("session_meta", {"id": "sid", "cwd": "C:/repo", "version": "1"}, "2025-11-23T10:00:00+00:00")


def test_log_metadata(spark):
    bad = {
        "empty": ["", META],
        "json": ['{"not": "json"'],
        "kind": [event("other", {}, "2025-11-23T10:00:00")],
        "payload": [event("session_meta", "x", "2025-11-23T10:00:00")],
        "number": [event("session_meta", {}, 123)],
        "date": [event("session_meta", {}, "not-a-date")],
        "id": [event("session_meta", {}, "2025-11-23T10:00:00")],
        "list": ["[]"],
    }
    grouped = log(spark, {**bad, "good": [META]}, clean=False)
    rows = {r.file_path: r for r in strict.log_metadata(grouped).collect()}
    words = {
        "empty": "Empty log file", "json": "Invalid JSON", "kind": "session_meta",
        "payload": "payload", "number": "timestamp", "date": "timestamp", "id": "session ID",
        "list": "JSON object",
    }
    for name, word in words.items():
        assert word in rows[name].error, name
    good = rows["good"]
    assert tuple(good)[1:] == (
        "codex", "sid", datetime(2025, 11, 23, 10), "C:/repo", "1", None,
    )


def test_strict_events(spark):
    def at(second, payload):
        return event("event_msg", payload, f"2025-11-23T10:00:0{second}+00:00")

    good = [
        META,
        at(1, {"type": "user_message", "message": "Hi"}),
        at(2, {"type": "ai_response", "message": "Hello"}),
        "",
        at(3, {"type": "tool_call", "tool": {"name": "shell", "parameters": {"cmd": "ls"}}}),
        at(4, {"type": "tool_result", "tool": {"name": "shell"}, "result": "ok"}),
    ]
    logs = {
        "good": good,
        "late": [*good, at(5, {"type": "unknown"}), at(6, {"type": "user_message", "message": "x"})],
        "broken": [META, '{"invalid": '],
        "headless": good[1:],
    }
    grouped = log(spark, logs, chunk_rows=3, clean=False)
    assert {tuple(r) for r in strict.first_failures(grouped).select("file_path", "line_number").collect()} == {
        ("late", 7), ("broken", 2),
    }
    rows = strict.agent_events(strict.strict_events(grouped))
    found = got(rows.orderBy("file_path", "seq"), "file_path", "seq", "event_type", "event_category",
                "priority", "content", "is_user", "tool_name", "parameters", "result")
    one = [
        (2, "user_message", 1, 1, "Hi", True, None, None, None),
        (3, "ai_response", 2, 1, "Hello", False, None, None, None),
        (5, "action.tool_call", 4, 2, None, None, "shell", '{"cmd":"ls"}', None),
        (6, "action.tool_result", 5, 2, None, None, "shell", None, "ok"),
    ]
    assert found == [("good", *r) for r in one] + [("late", *r) for r in one]
    record = strict.to_records(strict.actions(strict.strict_events(grouped)), True)
    first = json.loads(record.where("file_path = 'good' AND seq = 5").first().record)
    assert first["parameters"] == {"cmd": "ls"} and first["raw_data"]["payload"]["type"] == "tool_call"
    assert first["timestamp"] == "2025-11-23T10:00:03+00:00"
    back = strict.from_records(record, True).where("file_path = 'good' AND seq = 5").first()
    assert (back.tool_name, json.loads(back.parameters), back.event_category) == (
        "shell", {"cmd": "ls"}, 4,
    )


def test_strict_validation_branches(spark):
    stamp = "2025-11-23"
    cases = [
        ({"type": "event_msg", "timestamp": stamp, "payload": {"type": "user_message", "message": "k"}}, True),
        ({"timestamp": stamp}, False),
        ({"type": "event_msg", "timestamp": 123, "payload": {}}, False),
        ({"type": "event_msg", "timestamp": stamp, "payload": {"type": "user_message"}}, False),
        ({"type": "event_msg", "timestamp": stamp, "payload": {"type": "tool_call", "tool": {"name": "x"}}}, True),
        ({"type": "event_msg", "timestamp": stamp, "payload": {"type": "tool_call", "tool": "bad"}}, False),
        ({"type": "turn_context", "timestamp": stamp, "payload": {}}, False),
        ({"type": "session_meta", "timestamp": stamp, "payload": {}}, True),
        ({"type": "session_meta", "timestamp": stamp}, False),
        ({"type": "event_msg"}, False),
    ]
    frame = spark.createDataFrame([(n, json.dumps(c)) for n, (c, _) in enumerate(cases)], "n int, v string")
    rows = frame.select("n", strict.is_strict_event(jsonv.parse(F.col("v"))).alias("ok")).orderBy("n")
    assert [r.ok for r in rows.collect()] == [ok for _, ok in cases]


def test_iso_timestamps(spark):
    values = [
        "2025-11-23", "20251123", "2025-11-23T10:00", "2025-11-23 10:00:00.123", "2025-11-23T10",
        "2025-11-23T10:00:00Z", "2025-11-23T10:00:00.1234567-05:30", "20251123T100000+0100",
        "2025-02-30", "2025-11-23T25:00", "12:00", "2025", "", "2025-11-23T", "2025-1-1",
        "2025-11-23T10:00:60", "2025-11-23T10:00:00+24:00", "x2025-11-23",
    ]
    frame = spark.createDataFrame(list(enumerate(values)), "n int, v string")
    v = F.col("v")
    rows = frame.select("n", strict.is_iso_timestamp(v), strict.iso_text(v), strict.iso_timestamp(v))
    for value, row in zip(values, rows.orderBy("n").collect()):
        try:
            known = datetime.fromisoformat(value)
        except ValueError:
            assert row[1] is False, value
            continue
        assert row[1] is True and row[2] == known.isoformat(), value
        utc = known - known.utcoffset() if known.tzinfo else known
        assert row[3] == utc.replace(tzinfo=None), value
