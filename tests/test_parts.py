"""Documents and error lists that no single cell has to hold."""

import json

from pyspark.sql import functions as F

from sessionlake.operators import chunks, events, sessions, summary


def test_a_million_errors_in_one_file(spark):
    number = F.col("id") + 1
    errors = spark.range(1_000_000).select(
        F.lit("f").alias("file_path"), number.alias("line_number"),
        *[F.lit("x").alias(c) for c in ("severity", "code", "message", "recommended_action", "context")],
        chunks.chunk_of(F.col("id")).alias("chunk"),
    )
    parts = summary.error_parts(errors).select(
        "part", F.size("error_list").alias("n"), F.col("error_list.line_number").alias("lines")
    )
    wrong = (F.col("n") != 1000) | (F.col("lines") != F.sequence(F.col("part") * 1000 + 1, F.col("part") * 1000 + 1000))
    assert parts.count() == 1000 and parts.where(wrong).isEmpty()
    counted = spark.createDataFrame([("f", 1_000_000), ("g", 0)], "file_path string, errors bigint")
    listed = summary.with_error_lists(counted, errors, summary.CELL_ERRORS)
    assert {r.file_path: r.error_list for r in listed.collect()} == {"f": None, "g": []}


def test_error_lists_within_and_beyond_a_cell(spark):
    rows = [(f, n, "w", "c", "m", "a", None, n // 2) for f, k in (("f", 5), ("g", 2)) for n in range(k)]
    errors = spark.createDataFrame(
        rows,
        "file_path string, line_number bigint, severity string, code string, message string,"
        " recommended_action string, context string, chunk bigint",
    )
    counted = errors.groupBy("file_path").agg(F.count("*").alias("errors"))
    found = {r.file_path: r.error_list for r in summary.with_error_lists(counted, errors, 2).collect()}
    assert found["f"] is None and [e.line_number for e in found["g"]] == [0, 1]
    parts = summary.error_parts(errors, 2).orderBy("file_path", "part").collect()
    assert [(r.file_path, r.part, [e.line_number for e in r.error_list]) for r in parts] == [
        ("f", 0, [0, 1]), ("f", 1, [2, 3]), ("f", 2, [4]), ("g", 0, [0, 1]),
    ]


def test_documents_in_pieces(spark):
    events_of = {"f": 9, "g": 1}
    lines = [
        (f, n // 3, n, json.dumps({"type": "t", "timestamp": None, "payload": {"n": n}}))
        for f, k in events_of.items() for n in range(k)
    ]
    grouped = events.number_and_group(events.trusted_lines(spark.createDataFrame(
        lines, "file_path string, chunk bigint, pos bigint, line string")))
    files = spark.createDataFrame([("f",), ("g",), ("h",)], "file_path string")
    parts = sessions.prelude_parts(grouped, part_bytes=100)
    whole = {r.file_path: r.raw_json for r in sessions.sessions(grouped, files, parts).collect()}
    bounded = {r.file_path: r.raw_json for r in sessions.sessions(grouped, files, parts, 1).collect()}
    assert len(json.loads(whole["f"])["events"]) == 9
    assert bounded == {"f": None, "g": whole["g"], "h": whole["h"]}
    texts = {}
    for row in sessions.document_pieces(parts).orderBy("file_path", "part").collect():
        texts[row.file_path] = texts.get(row.file_path, "") + row.text
    assert texts == {"f": whole["f"], "g": whole["g"]}
