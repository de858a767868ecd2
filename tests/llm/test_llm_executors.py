"""Executors need no installed package: the driver starts in a folder of its own."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
RUN = """
import sys
sys.path.insert(0, {root!r})
from sessionlake.session import local_session
spark = local_session("2", 2)
spark.sparkContext.setLogLevel("ERROR")
from sessionlake.llm.queries import QUERIES
for name, query in QUERIES.items():
    rows = query(spark, "/root/testdata/sf0.001").count()
    assert rows > 0, name
    print("ran", name, rows)
spark.stop()
"""


def test_queries_run_where_workers_cannot_import_the_package(tmp_path):
    from sessionlake.llm.queries import QUERIES

    command = [sys.executable, "-c", RUN.format(root=str(ROOT))]
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(command, cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran ") == len(QUERIES)
