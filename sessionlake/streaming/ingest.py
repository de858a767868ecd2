"""The ingest run continuously over new session files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionlake.functions.rules import Rule
from sessionlake.plans import ingest
from sessionlake.sources import discovery


def follow_directory(
    spark: SparkSession,
    root: str,
    base: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    rules: Iterable[Rule] = (),
    fields: dict[str, list[str]] | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Ingest session files as they appear below ``root``.

    A file comes as a whole in one batch, and its rows replace those of an earlier
    run, so a batch that is repeated after a failure changes nothing. Bad files are
    left out (see ``ingest.build``). ``once`` handles what is there and stops. A file
    is read when it is first seen; one that grows later needs ``ingest_file``.
    """
    rules = list(rules)
    lines = (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(discovery.session_glob(root))
        .select(
            discovery.readable_path(F.col("_metadata.file_path")).alias("file_path"),
            F.col("_metadata.file_block_start").alias("chunk"),
            F.col("value").alias("line"),
        )
        .where(discovery.at_session_depth(F.col("file_path"), root))
    )

    def one_batch(batch: DataFrame, _: int) -> None:
        placed = batch.withColumn("pos", F.monotonically_increasing_id())
        files = batch.select("file_path").distinct()
        ingest.run(batch.sparkSession, placed, files, base, "quarantine", rules, fields)

    writer = lines.writeStream.foreachBatch(one_batch).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
