"""Session logs that grow: lines are handled as they are appended.

A stream gives lines as (file_path, pos, line); ``pos`` counts the lines of a file from 0.
What a batch needs of all earlier ones is kept beside the results: per file the number of
lines done with its running totals, the calls of the newest prompt that an output may still
close, and lines that came before their predecessors. A batch joins them to its own rows and
runs the operators that run on whole files, so a session of any size is worked on by chunk
and no task holds one.

Each batch writes folders of its own and is made valid by one mark. A batch that is lost or
repeated starts again from the state of the one before, so every line counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionlake.operators import calls, chunks, events, lake
from sessionlake.session import remove_folder, stage, staging_folder

STATE = "file_path string, seq bigint, event_index bigint, prompt_index bigint"
STEPS = (
    "file_path string, prompt_index bigint, chunk bigint, seq bigint, is_call boolean,"
    " match_id string, kept boolean, stub boolean"
)
_TOTALS = ["seq", "event_index", "prompt_index"]
_PROMPT = ["file_path", "prompt_index"]
_DONE = "_done"


def follow_lines(
    lines: DataFrame, base: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Handle lines as they come and keep the results at ``base``.

    Lines may come late, in any order and more than once; a line counts when all lines
    before it are there, until then ``late_lines`` gives it. A line that comes again has
    to be the same. ``once`` handles what is there and stops.
    """
    spark = lines.sparkSession
    writer = lines.writeStream.foreachBatch(
        lambda batch, number: add_batch(batch, base, number, spark)
    ).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def add_batch(
    batch: DataFrame, base: str, number: int, spark: SparkSession | None = None
) -> None:
    """Add the lines of one batch; a batch that was added before changes nothing.

    A stream's own session runs without adaptive execution, and so without splitting of
    skewed joins; only the check of the lines runs in it, all else in ``spark``.
    """
    spark = spark or batch.sparkSession
    before = newest(spark, base)
    if before is not None and number <= before:
        return
    folder = staging_folder(spark)
    try:
        placed = batch.select(
            "file_path", chunks.chunk_of(F.col("pos")).alias("chunk"), "pos", "line"
        )
        parsed = events.parse_lines(placed)
        parsed.write.parquet(f"{folder}/parsed")
        fresh = spark.read.schema(parsed.schema).parquet(f"{folder}/parsed")
        state = _earlier(spark, base, "state", before, STATE)
        numbered = stage(
            number_lines(_earlier(spark, base, "late", before, fresh.schema).unionByName(fresh), state),
            "numbered",
            folder,
        )
        done = numbered.where("in_order").drop("in_order")
        grown = state.unionByName(done.select("file_path", *_TOTALS))
        totals = stage(
            grown.groupBy("file_path").agg(*[F.max(name).alias(name) for name in _TOTALS]),
            "totals",
            folder,
        )
        fresh_steps = calls.call_steps(done).withColumns({"kept": F.lit(False), "stub": F.lit(False)})
        old_steps = _earlier(spark, base, "steps", before, STEPS)
        steps = stage(old_steps.unionByName(fresh_steps), "steps", folder)
        rows = stage(match_steps(steps), "rows", folder)
        written = {
            "lines": done,
            "late": numbered.where("NOT in_order").drop("in_order", *_TOTALS),
            "state": totals,
            "calls": rows.where("NOT kept OR output_seq IS NOT NULL").select(
                *_PROMPT, "row_seq", "call_seq", "output_seq"
            ),
            "steps": open_steps(rows, steps, totals),
        }
        for name, frame in written.items():
            frame.write.mode("overwrite").parquet(_folder(base, name, number))
        _mark(spark, base, number)
        if before is not None:
            for name in ("late", "state", "steps"):
                remove_folder(spark, _folder(base, name, before))
    finally:
        remove_folder(spark, folder)


def number_lines(rows: DataFrame, state: DataFrame) -> DataFrame:
    """New lines with seq, event_index, prompt_index and whether all before them are there.

    The state of a file stands in front of its lines as a row that holds the totals so
    far. Lines done before and repeated ones are left out.
    """
    ordered = Window.partitionBy("file_path", "chunk").orderBy("pos")
    front = F.lit(-1).cast("bigint")
    marks = state.join(rows.select("file_path").distinct(), "file_path", "left_semi").select(
        "file_path",
        front.alias("chunk"),
        front.alias("pos"),
        *[F.col(name).alias(f"_had_{name}") for name in _TOTALS],
    )
    single = (
        rows.withColumn("_before", F.lag("pos").over(ordered))
        .where("_before IS DISTINCT FROM pos")
        .drop("_before")
    )
    pool = single.unionByName(marks, allowMissingColumns=True)
    known = chunks.with_last(pool, ["file_path"], "pos", {"_from": "_had_seq"})
    wanted = known.where("pos < 0 OR pos >= coalesce(_from, 0)").drop("_from")
    steps = {
        "seq": F.lit(1),
        "event_index": (~F.col("blank")).cast("int"),
        "prompt_index": F.col("is_anchor").cast("int"),
    }
    numbered = chunks.with_running_totals(
        wanted, ["file_path"], "pos",
        {name: F.coalesce(f"_had_{name}", step) for name, step in steps.items()},
    )
    return (
        numbered.where("pos >= 0")
        .withColumn("in_order", F.col("seq") == F.col("pos") + 1)
        .drop(*[f"_had_{name}" for name in _TOTALS])
    )


def match_steps(steps: DataFrame) -> DataFrame:
    """Rows of calls as ``calls.match_calls`` has them, from open steps and new ones.

    A stub that waits on is kept as a call without id; its row has no call.
    """
    line = calls.waiting_line(calls.with_id_match(steps))
    opens = F.col("is_call") | F.col("is_stub")
    of_opener = {
        "kept": F.col("kept"),
        "stub": F.col("stub") | F.col("is_stub"),
        "chunk": F.col("chunk"),
        "match_id": F.when(F.col("is_call"), F.col("match_id")),
    }
    rows = calls.pair_rows(
        line, {name: F.max(F.when(opens, value)) for name, value in of_opener.items()}
    )
    return rows.withColumn("call_seq", F.when(~F.col("stub"), F.col("call_seq")))


def open_steps(rows: DataFrame, steps: DataFrame, totals: DataFrame) -> DataFrame:
    """Steps a later output may still close: those open in each file's newest prompt.

    Of calls with one id only the last can be closed, and only if no output followed.
    """
    waiting = rows.where("output_seq IS NULL OR output_seq = row_seq").select(
        *_PROMPT, "chunk", F.col("row_seq").alias("seq"), F.lit(True).alias("is_call"),
        "match_id", F.lit(True).alias("kept"), "stub",
    )
    last = steps.where("match_id IS NOT NULL").groupBy(*_PROMPT, "match_id").agg(
        F.max("seq").alias("seq")
    )
    named = waiting.where("match_id IS NOT NULL").join(
        last, [*_PROMPT, "match_id", "seq"], "left_semi"
    )
    still = waiting.where("match_id IS NULL").unionByName(named)
    places = still.select(*_PROMPT, "chunk").distinct().join(totals, _PROMPT, "left_semi")
    return still.join(places, [*_PROMPT, "chunk"], "left_semi")


# --- results ---------------------------------------------------------------------------


def grouped_lines(spark: SparkSession, base: str) -> DataFrame:
    """All lines done, numbered and grouped; every operator on grouped logs runs on them."""
    return _all_batches(spark, base, "lines")


def matched_calls(spark: SparkSession, base: str) -> DataFrame:
    """Rows of calls as ``calls.match_calls`` gives them for the same lines."""
    rows = _all_batches(spark, base, "calls").groupBy(*_PROMPT, "row_seq")
    return rows.agg(F.max("call_seq").alias("call_seq"), F.max("output_seq").alias("output_seq"))


def late_lines(spark: SparkSession, base: str) -> DataFrame:
    """Lines that wait for lines before them."""
    return spark.read.parquet(_folder(base, "late", _known(spark, base)))


def newest(spark: SparkSession, base: str) -> int | None:
    """Number of the last valid batch."""
    return max((int(name) for name in lake.folder_names(spark, f"{base}/{_DONE}")), default=None)


def _known(spark: SparkSession, base: str) -> int:
    number = newest(spark, base)
    if number is None:
        raise ValueError(f"No batch was added at {base}")
    return number


def _folder(base: str, name: str, number: int) -> str:
    return f"{base}/{name}/batch={number}"


def _earlier(spark: SparkSession, base: str, name: str, before: int | None, schema) -> DataFrame:
    if before is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_folder(base, name, before))


def _all_batches(spark: SparkSession, base: str, name: str) -> DataFrame:
    known = _known(spark, base)
    return spark.read.parquet(f"{base}/{name}").where(F.col("batch") <= known).drop("batch")


def _mark(spark: SparkSession, base: str, number: int) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{_DONE}/{number}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True).close()
