"""Tables of other shapes read as session logs.

Each adapter turns rows into JSONL lines with a file, a position and a chunk; from
there on they run through the same operators as log files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sessionlake.operators.chunks import chunk_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_lines(rows: DataFrame, file_path: Column, position: Column, line: Column) -> DataFrame:
    """Lines frame; positions are unique integers inside a file.

    The one shuffle all ordered work needs comes first, on the source columns: they
    are smaller than the lines made from them. Rows without a file or position are
    no lines; saying so here lets both readers of the shuffle share it.
    """
    placed = rows.withColumns(
        {"file_path": file_path, "chunk": chunk_of(position)}
    ).where("file_path IS NOT NULL AND chunk IS NOT NULL").repartition(
        "file_path", "chunk"
    )
    return placed.select(
        "file_path", "chunk", position.cast("bigint").alias("pos"), line.alias("line")
    )


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows over all cores where a scan has fewer partitions than the cluster."""
    if rows.rdd.getNumPartitions() < rows.sparkSession.sparkContext.defaultParallelism:
        return rows.repartition(key)
    return rows


def event_json(event_type: str, timestamp: Column, payload: Column) -> Column:
    return F.to_json(
        F.struct(
            timestamp.alias("timestamp"),
            F.lit(event_type).alias("type"),
            payload.alias("payload"),
        )
    )


def turn_time(turn: Column) -> Column:
    """A turn has no clock; one second per turn stands in."""
    start = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    return F.date_format(
        start + F.make_dt_interval(secs=turn), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    )


def event_time() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def conv_path() -> Column:
    return F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))


def user_path() -> Column:
    return F.concat(F.lit("user-"), F.col("user_id").cast("string"))


def content(text: Column) -> Column:
    return F.array(F.struct(F.lit("input_text").alias("type"), text.alias("text")))


def conversation_log(conversations: DataFrame) -> DataFrame:
    """One session per conversation: prompts, answers and system messages."""
    stamp, text = turn_time(F.col("turn")), F.col("text")
    line = (
        F.when(
            F.col("role") == "user",
            event_json(
                "event_msg",
                stamp,
                F.struct(F.lit("user_message").alias("type"), text.alias("message")),
            ),
        )
        .when(
            F.col("role") == "assistant",
            event_json(
                "event_msg",
                stamp,
                F.struct(F.lit("agent_message").alias("type"), text.alias("message")),
            ),
        )
        .otherwise(
            event_json(
                "response_item",
                stamp,
                F.struct(
                    F.lit("message").alias("type"),
                    F.lit("system").alias("role"),
                    content(text).alias("content"),
                ),
            )
        )
    )
    return as_lines(conversations, conv_path(), F.col("turn"), line)


def prop() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def activity_log(events: DataFrame) -> DataFrame:
    """One session per user: every kind of event, calls with and without ids."""
    rows = events.withColumn("k", prop())
    k, stamp = F.col("k"), event_time()
    call_id = F.when(k % 2 == 0, F.concat(F.lit("c"), (k % 4).cast("string")))
    number = F.col("event_id").cast("string")
    k_text = k.cast("string")
    prompt = F.struct(
        F.lit("user_message").alias("type"),
        F.concat(F.lit("prompt "), number).alias("message"),
    )
    call = F.struct(
        F.lit("function_call").alias("type"),
        F.when(k % 5 == 0, "update_plan")
        .otherwise(F.concat(F.lit("tool"), (k % 3).cast("string")))
        .alias("name"),
        F.col("props").alias("arguments"),
        call_id.alias("call_id"),
    )
    output = F.struct(
        F.lit("function_call_output").alias("type"),
        call_id.alias("call_id"),
        F.concat(F.lit("out "), number).alias("output"),
    )
    turn = F.struct(
        F.concat(F.lit("/w/"), k_text).alias("cwd"),
        F.lit("never").alias("approval_policy"),
        F.struct(
            F.when(k % 20 == 9, "read-only").alias("mode"),
            (k % 20 == 9).alias("network_access"),
            F.array(F.lit("/tmp"), F.concat(F.lit("/r"), k_text)).alias("writable_roots"),
        ).alias("sandbox_policy"),
    )
    tokens = F.struct(
        F.lit("token_count").alias("type"),
        F.struct(
            F.struct(
                F.col("value").alias("used_percent"),
                k.alias("window_minutes"),
                F.when(k % 3 == 0, 0).otherwise(k * 1000).alias("resets_at"),
                k.alias("resets_in_seconds"),
            ).alias("primary"),
            F.when(
                k % 2 == 1,
                F.struct(k.alias("used_percent"), k_text.alias("resets_at")),
            ).alias("secondary"),
        ).alias("rate_limits"),
    )
    note = F.concat(F.lit("note "), k_text)
    reasons = F.struct(
        F.when(k % 4 <= 1, "agent_reasoning")
        .when(k % 4 == 2, "turn_aborted")
        .otherwise("agent_message")
        .alias("type"),
        F.when(k % 4 == 0, note).when(k % 4 == 2, "  ").alias("text"),
        F.when(k % 4 == 1, F.array(F.struct(note.alias("text")))).alias("summary"),
        F.when(k % 4 == 2, F.concat(F.lit("content "), k_text)).alias("content"),
        F.when(k % 4 == 2, F.lit("interrupted")).alias("reason"),
        F.when(k % 4 == 3, note).alias("message"),
        F.when(k % 8 == 0, "tool").alias("category"),
        F.when(k % 8 == 1, "high").alias("priority"),
    )
    kind = F.col("event_type")
    line = (
        F.when(kind == "signup", event_json("event_msg", stamp, prompt))
        .when(kind == "click", event_json("response_item", stamp, call))
        .when(kind == "purchase", event_json("response_item", stamp, output))
        .when((kind == "view") & (k % 10 == 9), event_json("turn_context", stamp, turn))
        .when(kind == "view", event_json("event_msg", stamp, tokens))
        .otherwise(event_json("event_msg", stamp, reasons))
    )
    return as_lines(rows, user_path(), F.col("event_id"), line)
