"""Contexts in force, and totals by day and file."""

from helpers import event, item, msg
from sessionlake.operators import asof, chunks, events, summary
from sessionlake.sources import jsonl


def log():
    context = lambda cwd: event("turn_context", {"cwd": cwd, "sandbox_policy": {"mode": "m" + cwd}})
    call = lambda name: item("function_call", name=name, call_id=name)
    return [
        call("before"), context("/a"), msg("user_message", message="p"), call("first"),
        context("/b"), call("update_plan"), context("/c"), call("second"),
        event("turn_context", {"cwd": None}), call("third"), msg("user_message", message="q"), call("fourth"),
    ]


def grouped(spark, log_root):
    root = log_root({"2025/1/1/a.jsonl": log(), "2025/1/2/b.jsonl": [msg("user_message", message="p"), item("function_call", name="alone")]})
    return events.number_and_group(events.parse_lines(jsonl.read_lines(spark, root)))


def test_context_in_force(spark, log_root):
    found = asof.calls_in_context(grouped(spark, log_root)).collect()
    got = {r.name: (r.context_seq, r.cwd, r.sandbox_mode) for r in found}
    assert got == {
        "first": (2, "/a", "m/a"), "second": (7, "/c", "m/c"), "third": (9, None, None),
        "fourth": (9, None, None), "alone": (None, None, None),
    }


def test_last_value_crosses_chunks_of_a_hot_key(spark):
    rows = [(key, n // 5, n, n if n % 17 == 3 else None) for key, size in (("hot", 500), ("x", 3)) for n in range(size)]
    frame = spark.createDataFrame(rows, "k string, chunk long, n long, v long")
    found = chunks.with_last(frame, ["k"], "n", {"last": "v"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "chunk" in plan
    for r in found.collect():
        want = [m for key, _, m, v in rows if key == r.k and v is not None and m <= r.n]
        assert r["last"] == (max(want) if want else None)


def test_rollup_levels(spark, log_root):
    found = summary.event_rollup(grouped(spark, log_root)).collect()
    by_level = {level: [r for r in found if r.level == level] for level in ("all", "day", "file")}
    assert [(r.events, r.prompts, r.calls, r.contexts) for r in by_level["all"]] == [(14, 3, 7, 4)]
    assert len(by_level["day"]) == 1 and sorted(r.events for r in by_level["file"]) == [2, 12]
