"""Function calls matched with their outputs inside a prompt.

Rules of the match: an output with the id of the last open call of that id closes
it. Any other output takes the oldest waiting call without an id; when none waits,
it opens a stub row that waits itself.

The waiting line needs no sequential fold. Let ``s`` be calls minus outputs so far
and ``low`` the largest drop of ``s`` below zero. A stub adds one waiting row where
an output would have removed one, so it lifts the line by two, and it is needed
exactly when ``low`` passes an odd number. After any row there have been
``(low + 1) div 2`` stubs. Running sums and a running maximum say everything else:
the n-th taking output closes the n-th waiting row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionlake.functions import jsonv
from sessionlake.operators import chunks
from sessionlake.operators.events import members, payload_json
from sessionlake.operators.extract import tool_calls, tool_outputs

_PROMPT = ["file_path", "prompt_index"]


def call_steps(grouped: DataFrame) -> DataFrame:
    """Calls and outputs in order, without their contents (one scan)."""
    rows = members(grouped).where(
        "event_type = 'response_item' AND"
        " payload_type IN ('function_call', 'function_call_output')"
    )
    payload = F.col("_payload")
    is_call = F.col("payload_type") == "function_call"
    return (
        rows.withColumn("_payload", jsonv.parse(payload_json()))
        .select(
            *_PROMPT,
            "chunk",
            "seq",
            is_call.alias("is_call"),
            F.nullif(jsonv.string(payload, "$.call_id"), F.lit("")).alias("match_id"),
            (is_call & (jsonv.string(payload, "$.name") == "update_plan")).alias("_plan"),
        )
        .where("_plan IS DISTINCT FROM true")
        .drop("_plan")
    )


def with_id_match(steps: DataFrame) -> DataFrame:
    """Add call_seq, the call an output closes by id.

    That is the row just before it with the same id, if that row is a call.
    """
    seen = chunks.with_previous(
        steps, [*_PROMPT, "match_id"], "seq", {"_before_call": "is_call", "_before_seq": "seq"}
    )
    closes = "NOT is_call AND match_id IS NOT NULL AND _before_call"
    return seen.withColumn(
        "call_seq", F.expr(f"CASE WHEN {closes} THEN _before_seq END")
    ).drop("_before_call", "_before_seq")


def waiting_line(identified: DataFrame) -> DataFrame:
    """Number the rows of the waiting line.

    Works on the rows the id match left over; the others count as no step. Adds
    is_stub; enter_no, the place at which a call or stub joined the line; take_no,
    the place an output takes.
    """
    names = identified.columns
    waits = F.col("is_call") & F.col("match_id").isNull()
    takes = ~F.col("is_call") & F.col("call_seq").isNull()
    step = F.when(waits, 1).when(takes, -1).otherwise(0)
    chunk_keys = [*_PROMPT, "chunk"]
    inside = chunks.inside_chunk(_PROMPT, "seq")
    earlier = chunks.inside_chunk(_PROMPT, "seq", end=-1)
    whole = Window.partitionBy(*chunk_keys)
    ordered = Window.partitionBy(*chunk_keys).orderBy("seq")
    local = identified.select(
        *names,
        waits.alias("_waits"),
        takes.alias("_takes"),
        F.sum(step).over(inside).alias("_s"),
        F.sum(waits.cast("bigint")).over(inside).alias("_calls"),
        F.lead(F.lit(1)).over(ordered).isNull().alias("_last"),
    ).select(
        "*",
        F.max(-F.col("_s")).over(inside).alias("_drop"),
        F.max(-F.col("_s")).over(earlier).alias("_drop_before"),
        # Last rows of chunks meet in one window; all others stay with their chunk.
        F.when(F.col("_last"), F.lit(-1)).otherwise(F.col("chunk")).alias("_edge"),
    )
    across = (
        Window.partitionBy(*_PROMPT, "_edge")
        .orderBy("seq")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    started = local.select(
        "*",
        F.coalesce(F.sum("_s").over(across), F.lit(0)).alias("_s0"),
        F.coalesce(F.sum("_calls").over(across), F.lit(0)).alias("_calls0"),
    ).select(
        "*",
        F.coalesce(F.max(F.col("_drop") - F.col("_s0")).over(across), F.lit(0)).alias(
            "_low0"
        ),
    )

    def of_chunk(name: str) -> Column:
        return F.max(F.when(F.col("_last"), F.col(name))).over(whole)

    carried = started.withColumns(
        {name: of_chunk(name) for name in ("_s0", "_calls0", "_low0")}
    )
    low = F.greatest(F.lit(0), F.col("_low0"), F.col("_drop") - F.col("_s0"))
    low_before = F.greatest(
        F.lit(0), F.col("_low0"), F.col("_drop_before") - F.col("_s0")
    )
    counted = carried.select(
        *names,
        "_waits",
        "_takes",
        F.floor((low + 1) / 2).alias("_stubs"),
        F.floor((low_before + 1) / 2).alias("_stubs_before"),
        (F.col("_calls0") + F.col("_calls")).alias("_n_calls"),
        (F.col("_s0") + F.col("_s")).alias("_balance"),
    )
    stub = F.col("_stubs") > F.col("_stubs_before")
    n_outputs = F.col("_n_calls") - F.col("_balance")
    return counted.select(
        *names,
        stub.alias("is_stub"),
        F.when(F.col("_waits") | stub, F.col("_n_calls") + F.col("_stubs")).alias("enter_no"),
        F.when(F.col("_takes") & ~stub, n_outputs - F.col("_stubs")).alias("take_no"),
    )


def match_calls(grouped: DataFrame) -> DataFrame:
    """One row per stored call: call_seq (null for a stub), output_seq, row_seq.

    ``row_seq`` is where the row was opened, by its call or by the stub's output.
    """
    return pair_rows(waiting_line(with_id_match(call_steps(grouped))))


def pair_rows(line: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """A call and its output share one key, so a plain aggregate pairs them.

    ``more`` are further aggregates over the steps of a row.
    """
    more = more or {}
    queued = F.coalesce("enter_no", "take_no")
    opens = F.col("is_call") | F.col("is_stub")
    pairs = (
        line.withColumn("_queued", queued.isNotNull())
        .withColumn(
            "_pair",
            F.coalesce(queued, "call_seq", "seq"),
        )
        .groupBy(*_PROMPT, "_queued", "_pair")
        .agg(
            F.max(F.when(opens, F.col("seq"))).alias("row_seq"),
            F.max(F.when(F.col("is_call"), F.col("seq"))).alias("call_seq"),
            F.max(F.when(~F.col("is_call"), F.col("seq"))).alias("output_seq"),
            *[value.alias(name) for name, value in more.items()],
        )
    )
    return pairs.select(*_PROMPT, "row_seq", "call_seq", "output_seq", *more)


def function_calls(grouped: DataFrame) -> DataFrame:
    """Stored calls with the contents of call and output."""
    # A missing side gets a key of its own that no row has, not one hot null.
    matches = match_calls(grouped).select(
        *_PROMPT,
        "row_seq",
        F.coalesce("call_seq", -F.col("row_seq")).alias("call_seq"),
        F.coalesce("output_seq", -F.col("row_seq")).alias("output_seq"),
    )
    calls = tool_calls(grouped).select(
        "file_path",
        F.col("seq").alias("call_seq"),
        F.col("timestamp").alias("call_timestamp"),
        "name",
        "call_id",
        "arguments",
        F.col("raw_json").alias("raw_call_json"),
    )
    outputs = tool_outputs(grouped).select(
        "file_path",
        F.col("seq").alias("output_seq"),
        F.col("timestamp").alias("output_timestamp"),
        "output",
        F.col("raw_json").alias("raw_output_json"),
    )
    return (
        matches.join(calls, ["file_path", "call_seq"], "left")
        .join(outputs, ["file_path", "output_seq"], "left")
        .select(
            *_PROMPT,
            F.col("row_seq").alias("seq"),
            "call_timestamp",
            "output_timestamp",
            "name",
            "call_id",
            "arguments",
            "output",
            F.when(F.col("call_seq") < 0, "{}")
            .otherwise(F.col("raw_call_json"))
            .alias("raw_call_json"),
            "raw_output_json",
        )
    )


