"""Call matching against a sequential simulation."""

import random

import pytest

from helpers import item, msg
from sessionlake.operators import calls, chunks, events


def simulate(steps):
    """Rows (opened_at, call, output) by the rules of the match, one step at a time."""
    rows, by_id, waiting = [], {}, []
    for n, (is_call, cid) in enumerate(steps):
        if is_call:
            rows.append([n, n, None])
            if cid:
                by_id[cid] = len(rows) - 1
            else:
                waiting.append(len(rows) - 1)
            continue
        if cid and cid in by_id:
            place = by_id.pop(cid)
        elif waiting:
            place = waiting.pop(0)
        else:
            rows.append([n, None, None])
            place = len(rows) - 1
            waiting.append(place)
        rows[place][2] = n
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("chunk_rows", [3, 16_384])
def test_random_groups(spark, chunk_rows):
    rng = random.Random(7)
    groups, data = {}, []
    for g in range(300):
        ids = [None, "", "a", "b"][: rng.randint(1, 4)]
        bias = rng.choice([0.2, 0.5, 0.8])
        steps = [(rng.random() < bias, rng.choice(ids)) for _ in range(rng.randint(1, 40))]
        groups[g] = steps
        data += [
            (f"f{g}", 1, n // chunk_rows, n, is_call, cid or None)
            for n, (is_call, cid) in enumerate(steps)
        ]
    steps = spark.createDataFrame(
        data,
        "file_path string, prompt_index bigint, chunk bigint, seq bigint,"
        " is_call boolean, match_id string",
    )
    line = calls.waiting_line(calls.with_id_match(steps))
    got = {}
    for row in calls.pair_rows(line).collect():
        got.setdefault(row.file_path, []).append((row.row_seq, row.call_seq, row.output_seq))
    for g, expected in groups.items():
        assert sorted(got[f"f{g}"]) == simulate(expected), (g, expected)


def grouped_log(spark, payloads):
    lines = spark.createDataFrame(
        [("f", n // chunks.CHUNK_ROWS, n, __import__("json").dumps(e)) for n, e in enumerate(payloads)],
        "file_path string, chunk bigint, pos bigint, line string",
    )
    return events.number_and_group(events.parse_lines(lines))


def test_calls_and_outputs_of_one_prompt(spark):
    log = [
        msg("user_message", message="x"),
        item("reasoning"),
        item("function_call", ts="t5", name="shell", call_id="abc", arguments="{}"),
        item("function_call_output", ts="t6", call_id="abc", output="done"),
        item("function_call_output", ts="t7", output="queued"),
        item("function_call_output", ts="t9", output="updated"),
        item("function_call", name="update_plan", arguments="{}"),
        msg("user_message", message="y"),
        item("function_call_output", call_id="abc", output="late"),
    ]
    rows = calls.function_calls(grouped_log(spark, log)).orderBy("seq").collect()
    got = [(r.prompt_index, r.name, r.call_timestamp, r.output_timestamp, r.output, r.raw_call_json == "{}")
           for r in rows]
    assert got == [
        (1, "shell", "t5", "t6", "done", False),
        (1, None, None, "t9", "updated", True),
        (2, None, None, "2025-01-01T00:00:00Z", "late", True),
    ]
