"""Shape of the physical plans."""

import re

import pytest

from sessionlake.operators import calls, events, extract
from sessionlake.plans import queries
from sessionlake.session import stage

SF_DIR = "/root/testdata/sf0.001"


def physical(frame):
    jvm = frame.sparkSession._jvm
    explain = jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString
    return explain(frame._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def grouped(spark):
    return stage(queries._activity(spark, SF_DIR), "grouped")


def test_extraction_is_filter_and_projection(grouped):
    plan = physical(extract.token_messages(grouped))
    assert "Exchange" not in plan
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan).group(1)
    assert "EqualTo(event_type,event_msg)" in pushed and "token_count" in pushed
    read = re.search(r"ReadSchema: (struct<.*>)", plan).group(1)
    assert "fault" not in read and "pos:" not in read


def test_call_matching_reads_the_log_once(grouped):
    plan = physical(calls.match_calls(grouped))
    assert len(re.findall(r"^\(\d+\) Scan parquet", plan, re.M)) == 1
    assert "Join" not in plan


def test_no_window_over_a_whole_session(spark, grouped):
    """Windows run inside chunks, over chunk summaries, or over edge rows."""
    for frame in (
        calls.match_calls(grouped),
        events.number_and_group(events.trusted_lines(
            grouped.selectExpr("file_path", "chunk", "pos", "raw_json AS line"))),
    ):
        specs = re.findall(r"windowspecdefinition\((.*?) ASC NULLS FIRST", physical(frame))
        assert specs
        for spec in specs:
            *keys, order = re.findall(r"([A-Za-z_]+)#", spec)
            assert {"chunk", "_edge"} & set(keys) or order == "chunk", spec
