"""End to end: files to tables and summaries."""

import json

import pytest

from helpers import event, item, msg
from sessionlake.operators import events, lake, tables
from sessionlake.plans import ingest
from sessionlake.sources import discovery, jsonl

META_TS = "2025-11-23T21:43:14.941Z"


def update_session():
    return [
        event(
            "session_meta",
            {"id": "s-1", "timestamp": "2025-11-23T21:43:09.920Z", "cwd": "C:\\work"},
            META_TS,
        ),
        event(
            "turn_context",
            {"cwd": "C:\\work", "approval_policy": "never", "sandbox_policy": {"type": "full"}},
        ),
        msg("user_message", message="Please compare the files.", images=[]),
        msg("agent_reasoning", text="Looking at both."),
        msg(
            "token_count",
            info={"total_token_usage": {"input_tokens": 1200}},
            rate_limits={
                "primary": {"used_percent": 1.0, "window_minutes": 300, "resets_at": 1763952191},
                "secondary": {"used_percent": 0.0, "window_minutes": 10080, "resets_at": 1764538991},
            },
        ),
        item("function_call", name="shell_command", arguments="{}", call_id="c1"),
        item("function_call_output", call_id="c1", output="diff count 1"),
        msg("agent_message", message="Both match."),
    ]


def small_session():
    return [
        event("session_meta", {"id": "s-2", "cwd": "/test/work"}, "2025-10-31T10:00:00Z"),
        msg("user_message", message="## My request for Codex:\nHelp me write a test"),
        msg("token_count", rate_limits={"primary": {"used_percent": 50, "window_minutes": 60}}),
        msg("agent_reasoning", text="A test structure"),
    ]


def rows(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


def test_two_sessions(spark, log_root, tmp_path):
    root = log_root(
        {"2025/11/23/b.jsonl": update_session(), "2025/10/31/a.jsonl": small_session()}
    )
    base = str(tmp_path / "tables")
    summary = ingest.ingest_directory(spark, root, base)
    got = {r.file_path.rsplit("/", 1)[1]: r for r in summary.collect()}
    assert got["b.jsonl"][1:] == (1, 1, 0, 2, 0, 1, 0, [], {})
    assert got["a.jsonl"][1:] == (1, 1, 0, 1, 0, 0, 0, [], {})

    def table(name):
        return tables.read_table(spark, base, name).orderBy("file_path", *(
            ["seq"] if name not in ("sessions", "files") else []))

    found = {r.session_id: r for r in table("sessions").collect()}
    assert found["s-1"].session_timestamp == "2025-11-23T21:43:09.920Z"
    assert found["s-1"].cwd == "C:\\work"
    prelude = json.loads(found["s-1"].raw_json)["events"]
    assert [e["type"] for e in prelude] == ["session_meta", "turn_context"]
    assert found["s-2"].session_timestamp == "2025-10-31T10:00:00Z"
    assert rows(table("prompts"), "prompt_index", "my_request") == [
        (1, "Help me write a test"),
        (1, None),
    ]
    assert rows(table("token_messages"), "primary_used_percent", "primary_window_minutes",
                "primary_resets", "secondary_resets") == [
        (50.0, 60, None, None),
        (1.0, 300, "1763952191", "1764538991"),
    ]
    assert rows(table("agent_reasoning_messages"), "source", "text") == [
        ("event_msg", "A test structure"),
        ("event_msg", "Looking at both."),
        ("agent_message", None),
    ]
    assert rows(table("function_calls"), "name", "call_id", "output") == [
        ("shell_command", "c1", "diff count 1")
    ]
    stored = rows(table("events"), "event_type", "category", "priority", "raw_json", "data")
    assert [r[0] for r in stored] == [
        "token_count", "agent_reasoning", "agent_reasoning", "token_count", "agent_message",
    ]
    assert {r[1:3] for r in stored} == {("other", "medium")}
    # Stored text is the event as Python's json module writes it.
    assert stored[-1][3] == json.dumps(msg("agent_message", message="Both match."))
    assert json.loads(stored[-1][4]) == {"type": "agent_message", "message": "Both match."}

    # A second ingest replaces the rows of its files and duplicates none.
    log_root({"2025/11/23/b.jsonl": update_session()[:4], "2025/12/1/c.jsonl": small_session()})
    ingest.ingest_directory(spark, root, base)
    assert table("events").count() == 5
    assert table("files").count() == 3
    assert table("function_calls").count() == 0
    assert rows(table("token_messages"), "primary_window_minutes") == [(60,), (60,)]

    # One new file is appended.
    log_root({"2025/12/2/d.jsonl": update_session()})
    ingest.ingest_file(spark, f"{root}/2025/12/2/d.jsonl", base)
    assert table("events").count() == 8 and table("files").count() == 4


def test_discovery_depth_order_and_limit(spark, log_root):
    root = log_root(
        {
            "2025/10/2/z.jsonl": small_session(),
            "2025/10/10/b.jsonl": small_session(),
            "2025/10/10/a b+c.txt": small_session(),
            "2025/10/top.jsonl": small_session(),
            "2025/10/10/deep/x.jsonl": small_session(),
        }
    )
    files = discovery.session_files(spark, root)
    names = [
        r.file_path[len(root) + 1 :]
        for r in files.orderBy(discovery.discovery_order()).collect()
    ]
    assert names == ["2025/10/10/a b+c.txt", "2025/10/10/b.jsonl", "2025/10/2/z.jsonl"]
    first = discovery.first_files(files, 1).first().file_path
    assert first.endswith("a b+c.txt")
    assert {r[0] for r in jsonl.read_lines(spark, root, 2).select("file_path").distinct().collect()} == {
        f"{root}/{n}" for n in names[:2]
    }
    assert jsonl.read_lines(spark, root).select("file_path").distinct().count() == 3
    assert discovery.debug_limit(None) == 2 and discovery.debug_limit(1) == 1


def test_no_sessions(spark, tmp_path):
    with pytest.raises(discovery.NoSessionsFound):
        discovery.session_files(spark, str(tmp_path))
    with pytest.raises(discovery.NoSessionsFound):
        jsonl.read_lines(spark, str(tmp_path))


def test_bad_lines_fail_the_file(spark, log_root, tmp_path):
    root = log_root(
        {
            "2025/1/1/bad.jsonl": "\n" + json.dumps(small_session()[0]) + "\n{\"a\": 1} junk\n",
            "2025/1/1/good.jsonl": small_session(),
            "2025/1/1/late.jsonl": [*small_session(), event("event_msg", {"type": "x"}, None)],
        }
    )
    (tmp_path / "logs/2024/1/1").mkdir(parents=True)
    first = tmp_path / "logs/2024/1/1/first.jsonl"
    first.write_text(json.dumps(small_session()[1]) + "\n")
    base = str(tmp_path / "t1")
    with pytest.raises(ingest.IngestFailed, match="Failed to parse JSON on line 3 of .*bad.jsonl"):
        ingest.ingest_directory(spark, root, base)
    # Files before the bad one stay stored.
    assert rows(tables.read_table(spark, base, "prompts"), "file_path") == [(str(first),)]
    first.unlink()
    base = str(tmp_path / "t2")
    summary = ingest.ingest_directory(spark, root, base, on_bad_file="quarantine")
    assert [r.file_path.rsplit("/", 1)[1] for r in summary.collect()] == ["good.jsonl"]
    assert tables.read_table(spark, base, "events").count() == 2


def test_invalid_events_are_reported_and_skipped(spark, log_root, tmp_path):
    bad = [
        "",
        json.dumps("not-a-dict"),
        {"type": " ", "timestamp": "t"},
        {"type": "event_msg", "timestamp": 1},
        {"type": "event_msg", "payload": "no", "api_key": "abc"},
        {"type": "session_meta", "payload": None, "metadata": 3},
    ]
    root = log_root({"2025/1/1/a.jsonl": bad})
    base = str(tmp_path / "t")
    summary = ingest.ingest_directory(spark, root, base)
    assert summary.first().errors == 4
    errors = tables.read_table(spark, base, "ingest_errors").orderBy("line_number")
    got = [(r.line_number, r.message, r.context) for r in errors.collect()]
    assert got == [
        (1, events.NOT_AN_OBJECT, None),
        (2, events.BAD_TYPE, '{"event": {"type": " ", "timestamp": "t"}}'),
        (3, events.BAD_TIMESTAMP, '{"event": {"type": "event_msg", "timestamp": 1}}'),
        (4, events.BAD_PAYLOAD,
         '{"event": {"type": "event_msg", "payload": "no", "api_key": "[redacted]"}}'),
    ]
    session = tables.read_table(spark, base, "sessions").first()
    assert json.loads(session.raw_json) == {
        "events": [{"type": "session_meta", "payload": {}, "metadata": {}}]
    }


def test_rules_at_ingest(spark, log_root, tmp_path):
    from sessionlake.functions.rules import DEFAULT_RULES

    root = log_root(
        {
            "2025/1/1/a.jsonl": [
                msg("user_message", message="mail me@x.org [redact pw=123]"),
                msg("agent_reasoning", text="see /etc/passwd or me@x.org [long bracket text]"),
                item("function_call", name="shell", arguments="cat /etc/hosts"),
            ]
        }
    )
    base = str(tmp_path / "t")
    ingest.ingest_directory(spark, root, base, rules=DEFAULT_RULES)
    assert tables.read_table(spark, base, "prompts").first().message == (
        "mail <REDACTED> <REDACTED>"
    )
    assert tables.read_table(spark, base, "agent_reasoning_messages").first().text == (
        "see <REDACTED> or <REDACTED> [long bracket text]"
    )
    assert tables.read_table(spark, base, "function_calls").first().arguments == "cat <REDACTED>"


def test_redaction_leaves_no_copy_of_the_text(spark, log_root, tmp_path):
    """Template parts, stored events, preludes; field rules; counts; manual redactions."""
    from sessionlake.functions.rules import DEFAULT_RULES, RuleError, make_rules

    request = "# Context\n## My request for Codex:\nsay [redact hunter22pw] to me@x.org"
    root = log_root(
        {
            "2025/1/1/a.jsonl": [
                event("session_meta", {"id": "s", "note": "me@x.org"}),
                "7",
                msg("user_message", message=request),
                msg("agent_reasoning", text="topsecret plan of me@x.org"),
                item("function_call", name="shell", call_id="c", arguments='{"to": "me@x.org"}'),
                item("function_call_output", call_id="c", output="sent to me@x.org"),
                msg("user_message", message="second me@x.org"),
            ]
        }
    )
    base = str(tmp_path / "t")
    extra = make_rules(spark, [{"id": "top", "type": "literal", "pattern": "topsecret", "scope": "field"}])
    rules = [*DEFAULT_RULES, *extra]
    with pytest.raises(RuleError, match="top"):
        ingest.ingest_directory(spark, root, base, rules=rules)
    manual = spark.createDataFrame(
        [(1, f"{root}/2025/1/1/a.jsonl", 2, "prompt", None, "<hidden>", None, None, None, None)],
        tables.schema_of("redactions"),
    )
    tables.write_table(manual, base, "redactions")
    fields = {"top": ["agent_reasoning_messages.text"]}
    (row,) = ingest.ingest_directory(spark, root, base, rules=rules, fields=fields).collect()
    assert row.rule_counts["top"] == 1 and row.rule_counts["email"] >= 4
    assert row.rule_counts["bracketed_troubleshooting"] == 1 and [e.line_number for e in row.error_list] == [2]
    text = ""
    for name in tables.ALL_TABLES:
        for stored in tables.read_table(spark, base, name).collect():
            text += json.dumps(stored.asDict(), default=str)
    assert "me@x.org" not in text
    prompts = tables.read_table(spark, base, "prompts").orderBy("prompt_index").collect()
    assert prompts[0].my_request == "say <REDACTED> to <REDACTED>"
    assert prompts[1].message == "<hidden>"
    assert json.loads(prompts[0].raw_json)["payload"]["type"] == "user_message"
    call = tables.read_table(spark, base, "function_calls").first()
    assert json.loads(call.raw_call_json)["payload"]["name"] == "shell"


def test_large_values_are_kept(spark, log_root, tmp_path):
    """A prompt of 24 million characters, a prelude over 8 MiB, more than 1000 errors."""
    long = "x " * 12_000_000
    prelude = [event("session_meta", {"id": "s", "note": "y " * 1_500_000}) for _ in range(4)]
    root = log_root(
        {"2025/1/1/a.jsonl": [*prelude, *["5"] * 1200, msg("user_message", message=long), msg("x")]}
    )
    base = str(tmp_path / "t")
    (row,) = ingest.ingest_directory(spark, root, base).collect()
    assert (row.prompts, row.errors, len(row.error_list)) == (1, 1200, 1200)
    assert tables.read_table(spark, base, "prompts").first().message == long
    session = tables.read_table(spark, base, "sessions").first()
    assert session.prelude_parts > 1 and len(json.loads(session.raw_json)["events"]) == 4
    assert tables.read_table(spark, base, "events").count() == 1


def test_a_copied_lake_can_be_ingested_into(spark, log_root, tmp_path):
    root = log_root({"2025/1/1/a.jsonl": update_session(), "2025/1/1/b.jsonl": ["1", *small_session()]})
    base, copied = str(tmp_path / "t"), str(tmp_path / "u")
    ingest.ingest_directory(spark, root, base)
    counts = tables.copy_tables(spark, base, copied).collect()
    assert {r.table_name for r in counts} == set(tables.ALL_TABLES)

    def content(at):
        return {
            name: sorted(map(repr, tables.read_table(spark, at, name).drop("ingested_at").collect()))
            for name in tables.ALL_TABLES
        }

    assert content(base) == content(copied)
    log_root({"2025/1/1/c.jsonl": small_session(), "2025/1/1/b.jsonl": small_session()})
    for name in ("c", "b"):
        for at in (base, copied):
            ingest.ingest_file(spark, f"{root}/2025/1/1/{name}.jsonl", at)
    assert content(base) == content(copied)
    assert len(content(copied)["files"]) == 3 and len(content(copied)["prompts"]) == 3
    with pytest.raises(tables.CopyRefused):
        tables.copy_tables(spark, base, copied)


def test_reingest_writes_only_days_of_known_files(spark, log_root, tmp_path):
    root = log_root({f"2025/1/{n}/a.jsonl": small_session() for n in range(1, 6)})
    base = str(tmp_path / "t")
    ingest.ingest_directory(spark, root, base)
    before = lake.newest(spark, base)
    assert sorted(before.live["events"]) == [f"2025-01-0{n}" for n in range(1, 6)]
    log_root({"2025/1/7/new.jsonl": small_session(), "2025/1/3/b.jsonl": small_session()})
    paths = [f"{root}/2025/1/3/a.jsonl", f"{root}/2025/1/3/b.jsonl", f"{root}/2025/1/7/new.jsonl"]
    lines = jsonl.read_file(spark, paths[0])
    for path in paths[1:]:
        lines = lines.unionByName(jsonl.read_file(spark, path))
    ingest.run(spark, lines, lines.select("file_path").distinct(), base, "fail")
    after = lake.newest(spark, base)
    assert after.number == before.number + 1
    for table, held in after.live.items():
        changed = {day for day in held if held[day] != before.live[table].get(day)}
        assert changed <= {"2025-01-03", "2025-01-07"}
        assert all(len(versions) == 1 for versions in held.values())
    assert tables.read_table(spark, base, "events").count() == 14
    old = tables.read_table(spark, base, "events", record=before)
    assert old.count() == 10  # readers of the old record still have its files
    assert lake.vacuum(spark, base) > 0 and lake.vacuum(spark, base) == 0
    assert tables.read_table(spark, base, "events").count() == 14


def test_lost_ingest_leaves_readers_on_the_old_state(spark, log_root, tmp_path, monkeypatch):
    root = log_root({"2025/1/1/a.jsonl": update_session()})
    base = str(tmp_path / "t")
    ingest.ingest_directory(spark, root, base)

    def content():
        return {n: sorted(map(repr, tables.read_table(spark, base, n).collect())) for n in tables.ALL_TABLES}

    old, write = content(), lake.write_rows
    log_root({"2025/1/1/a.jsonl": small_session(), "2025/1/2/b.jsonl": small_session()})

    def lost(frame, base, table, version):
        if table == "token_messages":
            raise RuntimeError("lost")
        return write(frame, base, table, version)

    monkeypatch.setattr(lake, "write_rows", lost)
    with pytest.raises(RuntimeError, match="lost"):
        ingest.ingest_directory(spark, root, base)
    assert content() == old
    monkeypatch.setattr(lake, "write_rows", write)
    ingest.ingest_directory(spark, root, base)
    assert tables.read_table(spark, base, "files").count() == 2
    assert {r.session_id for r in tables.read_table(spark, base, "sessions").collect()} == {"s-2"}
    assert tables.read_table(spark, base, "function_calls").count() == 0


def test_one_of_two_commits_is_refused(spark, tmp_path):
    base = str(tmp_path / "t")
    before = lake.newest(spark, base)
    lake.commit(spark, base, before, {})
    with pytest.raises(lake.CommitRefused):
        lake.commit(spark, base, before, {"files": {}})
    assert lake.newest(spark, base) == lake.Record(1, {})


def test_files_keep_their_ids(spark, log_root, tmp_path):
    root = log_root({"2025/1/2/m.jsonl": small_session(), "2025/1/2/z.jsonl": small_session()})
    base = str(tmp_path / "t")

    def ids():
        stored = tables.read_table(spark, base, "files").collect()
        return {r.file_path.rsplit("/", 1)[1]: r.file_id for r in stored}

    ingest.ingest_directory(spark, root, base)
    assert ids() == {"m.jsonl": 1, "z.jsonl": 2}
    log_root({"2025/1/1/a.jsonl": small_session(), "2025/1/2/n.jsonl": small_session()})
    ingest.ingest_directory(spark, root, base)
    assert ids() == {"m.jsonl": 1, "z.jsonl": 2, "a.jsonl": 3, "n.jsonl": 4}
    ingest.ingest_file(spark, f"{root}/2025/1/2/z.jsonl", base)
    assert ids() == {"m.jsonl": 1, "z.jsonl": 2, "a.jsonl": 3, "n.jsonl": 4}


def test_many_versions_of_a_day_become_one(spark, tmp_path):
    base = str(tmp_path / "t")
    for n in range(3):
        rows = [(f"/logs/2025/1/{day}/f{n}", n, None) for day in (1, 2)[: n + 1]]
        tables.write_table(spark.createDataFrame(rows, tables.schema_of("files")), base, "files")
    assert len(lake.newest(spark, base).live["files"]["2025-01-01"]) == 3
    done = lake.compact(spark, base, most=2)
    assert [len(v) for _, v in sorted(done.live["files"].items())] == [1, 2]
    assert tables.read_table(spark, base, "files").count() == 5
    assert lake.compact(spark, base, most=2) == done


def test_empty_named_file_and_special_names(spark, log_root, tmp_path):
    root = log_root({"2025/1/1/a[1]{x}?.jsonl": "", "2025/1/1/b*[2].jsonl": small_session()})
    base = str(tmp_path / "t")
    assert ingest.ingest_file(spark, f"{root}/2025/1/1/a[1]{{x}}?.jsonl", base).count() == 1
    assert ingest.ingest_file(spark, f"{root}/2025/1/1/b*[2].jsonl", base).first().prompts == 1
    assert tables.read_table(spark, base, "sessions").count() == 2


def test_empty_file_keeps_its_session(spark, log_root, tmp_path):
    root = log_root({"2025/1/1/empty.jsonl": "", "2025/1/1/one.jsonl": small_session()})
    base = str(tmp_path / "t")
    summary = ingest.ingest_directory(spark, root, base)
    assert summary.count() == 2
    empty = tables.read_table(spark, base, "sessions").where("session_id IS NULL").first()
    assert empty.raw_json == '{"events": []}'


def test_lines_keep_their_order_over_many_splits(spark, log_root):
    n = 20_000
    root = log_root(
        {
            "2025/1/1/long.jsonl": [msg("user_message" if i % 50 == 7 else "x", n=i) for i in range(n)],
            "2025/1/1/two.jsonl": [msg("x", n=i) for i in range(3000)],
        }
    )
    spark.conf.set("spark.sql.files.maxPartitionBytes", 64 * 1024)
    try:
        parsed = events.parse_lines(jsonl.read_lines(spark, root))
        from sessionlake.session import stage

        grouped = events.number_and_group(stage(parsed, "parsed"))
        wrong = grouped.selectExpr(
            "CAST(get_json_object(raw_json, '$.payload.n') AS bigint) AS n", "seq",
            "event_index", "prompt_index", "file_path",
        ).where(
            "seq <> n + 1 OR event_index <> seq OR (file_path LIKE '%long%' AND"
            " prompt_index <> (n + 43) div 50)"
        )
        assert wrong.count() == 0
        assert grouped.select("chunk").distinct().count() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
