"""Compare queries with their SQL on DuckDB: python tests/check_oracles.py [sf] [names...]"""

import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from sessionlake.plans.queries import DRIVER_TABLES  # noqa: E402


def database(sf_dir):
    connection = duckdb.connect()
    for name in DRIVER_TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        if isinstance(value, Decimal):
            value = float(value)
        return repr(value)

    return [columns[i] for i in order], sorted(
        tuple(plain(row[i]) for i in order) for row in rows
    )


def compare(spark, connection, sf_dir, name):
    """None if equal, else a short text; also gives the row count."""
    frame = contract.queries()[name](spark, sf_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        if node in plan:
            return f"plan with {node}", 0
    rows = [tuple(row) for row in frame.collect()]
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return None, len(rows)
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    ours, theirs = canonical(frame.columns, rows), canonical(columns, cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} <> {theirs[0]}", len(rows)
    if ours[1] == theirs[1]:
        return None, len(rows)
    extra, absent = set(ours[1]) - set(theirs[1]), set(theirs[1]) - set(ours[1])
    sample = f"rows {len(ours[1])}/{len(theirs[1])}\n   spark {sorted(extra)[:2]}\n   sql   {sorted(absent)[:2]}"
    return f"{len(extra)} rows differ, {sample}", len(rows)


def main():
    from sessionlake.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(contract.queries())
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("8", 8)
    spark.sparkContext.setLogLevel("OFF")
    connection, bad = database(sf_dir), 0
    for name in names:
        begin = time.time()
        try:
            problem, n = compare(spark, connection, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:700]}", 0
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok':4s} {name:28s} {n:7d} rows {time.time() - begin:6.2f}s",
              (problem or "")[:1500], flush=True)
    print(f"{bad} of {len(names)} differ")


if __name__ == "__main__":
    main()
