"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all) set the
input and the cores. Each query runs once to warm up and then BENCH_RUNS times
(default 1) into a sink that keeps nothing; the best run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sessionlake.plans.queries import QUERIES  # noqa: E402
from sessionlake.session import local_session  # noqa: E402

HEADLINE = [
    "session_summaries",
    "function_calls",
    "prompt_groups_activity",
    "token_messages",
    "jsonl_load",
    "deep_sanitize",
    "secret_strings",
    "prompt_template",
    "rule_redaction",
    "rule_totals",
    "manual_redactions",
    "session_rows",
    "session_report",
    "event_descriptions",
    "strict_messages",
    "table_counts",
]


def timed(spark, name: str, sf_dir: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, 8 if cpus == "*" else max(int(cpus), 1))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        timed(spark, name, sf_dir)
        seconds[name] = round(min(timed(spark, name, sf_dir) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "config": {"cores": cpus, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
