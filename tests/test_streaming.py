"""New files are ingested batch by batch."""

from helpers import event, item, msg
from sessionlake.operators import tables
from sessionlake.streaming.ingest import follow_directory


def session(n):
    return [
        event("session_meta", {"id": f"s{n}"}),
        msg("user_message", message=f"prompt {n}"),
        item("function_call", name="shell", call_id="c"),
        item("function_call_output", call_id="c", output=str(n)),
    ]


def test_follow_directory(spark, log_root, tmp_path):
    base, marks = str(tmp_path / "tables"), str(tmp_path / "marks")
    root = log_root({"2025/1/1/a.jsonl": session(1)})
    follow_directory(spark, root, base, marks, once=True).awaitTermination()
    log_root({"2025/1/2/b.jsonl": session(2), "2025/1/2/bad.jsonl": "{"})
    follow_directory(spark, root, base, marks, once=True).awaitTermination()
    calls = tables.read_table(spark, base, "function_calls")
    assert sorted(r.output for r in calls.collect()) == ["1", "2"]
    assert tables.read_table(spark, base, "sessions").count() == 2
