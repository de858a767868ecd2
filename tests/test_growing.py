"""Growing logs: any split into batches gives the result of the whole file."""

import json
import random

import pytest

from helpers import event, item, msg
from sessionlake.operators import calls, chunks, events
from sessionlake.streaming import growing

LINES = "file_path string, pos bigint, line string"
SEQ = ["file_path", "pos", "seq", "event_index", "prompt_index", "event_error"]


def random_log(rng, n):
    log = [json.dumps(event("session_meta", {"id": "s"}))]
    for place in range(n):
        roll = rng.random()
        cid = rng.choice([None, "", "a", "b"])
        if roll < 0.06:
            log.append(json.dumps(msg("user_message", message=f"m{place}")))
        elif roll < 0.1:
            log.append(rng.choice(["", "  ", "7", json.dumps({"type": " "})]))
        elif roll < 0.5:
            log.append(json.dumps(item("function_call", name="sh", call_id=cid)))
        else:
            log.append(json.dumps(item("function_call_output", call_id=cid, output=str(place))))
    return log


def rows_of(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def whole(spark, logs):
    rows = [(f, n, line) for f, log in logs.items() for n, line in enumerate(log)]
    lines = spark.createDataFrame(rows, LINES).withColumn("chunk", chunks.chunk_of(growing.F.col("pos")))
    return events.number_and_group(events.parse_lines(lines))


def test_any_split_gives_the_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_ROWS", 5)  # many chunks in a file
    rng, base = random.Random(5), str(tmp_path / "out")
    logs = {f"f{n}": random_log(rng, rng.randint(0, 60)) for n in range(12)}
    parts = [[] for _ in range(3)]
    for path, log in logs.items():
        for pos, line in enumerate(log):
            # Mostly in order, some late, some sent again.
            part = min(2, pos * 3 // len(log) + (rng.random() < 0.2))
            parts[part].append((path, pos, line))
            if rng.random() < 0.1:
                parts[rng.randint(part, 2)].append((path, pos, line))
    for number, part in enumerate(parts):
        rng.shuffle(part)
        batch = spark.createDataFrame(part, LINES)
        growing.add_batch(batch, base, number)
        if number == 1:  # a batch that is repeated changes nothing
            growing.add_batch(batch, base, number)
            assert growing.late_lines(spark, base).count() > 0
    expected = whole(spark, logs)
    assert growing.late_lines(spark, base).isEmpty()
    assert rows_of(growing.grouped_lines(spark, base).select(SEQ)) == rows_of(expected.select(SEQ))
    assert rows_of(growing.matched_calls(spark, base)) == rows_of(calls.match_calls(expected))


def test_batch_lost_before_its_mark(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "out")
    log = random_log(random.Random(3), 40)
    halves = [[("f", n, line) for n, line in enumerate(log)][a:b] for a, b in ((0, 20), (20, 41))]
    growing.add_batch(spark.createDataFrame(halves[0], LINES), base, 0)
    seen = rows_of(growing.matched_calls(spark, base))
    with monkeypatch.context() as patched:
        patched.setattr(growing, "_mark", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            growing.add_batch(spark.createDataFrame(halves[1], LINES), base, 1)
    assert rows_of(growing.matched_calls(spark, base)) == seen
    growing.add_batch(spark.createDataFrame(halves[1], LINES), base, 1)
    expected = whole(spark, {"f": log})
    assert rows_of(growing.matched_calls(spark, base)) == rows_of(calls.match_calls(expected))


def test_stream_of_appended_lines(spark, tmp_path):
    base, marks, folder = (str(tmp_path / name) for name in ("out", "marks", "in"))
    log = [
        msg("user_message", message="go"),
        item("function_call", name="sh", call_id="c"),
        item("function_call_output", call_id="c", output="1"),
    ]
    rows = [("f", n, json.dumps(line)) for n, line in enumerate(log)]
    for sent in (rows[:1], rows[2:], rows[1:2]):  # the output comes before its call
        spark.createDataFrame(sent, LINES).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(LINES).parquet(folder)
        growing.follow_lines(stream, base, marks, once=True).awaitTermination()
    assert rows_of(growing.matched_calls(spark, base)) == [("f", 1, 2, 2, 3)]
    assert growing.grouped_lines(spark, base).count() == 3


def test_no_batch_yet(spark, tmp_path):
    with pytest.raises(ValueError, match="No batch"):
        growing.matched_calls(spark, str(tmp_path))
