"""One row per session file, folded from its prelude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlake.functions import jsonv
from sessionlake.functions.text import tag_value
from sessionlake.operators import chunks
from sessionlake.operators.events import prelude

ENVIRONMENT = "<environment_context>"
# Size of the parts in which a document is put together.
PART_BYTES = 8 * 1024 * 1024
# Parts of a document that one cell of the stored sessions holds (128 MiB of text).
CELL_PARTS = 16


def environment_texts(event: Column) -> Column:
    """Texts of the message items that describe the environment."""
    texts = F.transform(
        jsonv.as_array(event, "$.payload.content"), lambda item: jsonv.string(item, "$.text")
    )
    return F.filter(texts, lambda text: F.coalesce(text.contains(ENVIRONMENT), F.lit(False)))


def environment(event: Column) -> Column:
    """Struct of the settings in a message; null when it describes none.

    The last description sets the policies, nulls included; a folder is only
    replaced by one that is not empty.
    """
    texts = environment_texts(event)
    last = F.try_element_at(texts, F.lit(-1))
    folders = F.filter(
        F.transform(texts, lambda text: tag_value(text, "cwd")), lambda cwd: cwd != ""
    )
    return F.when(
        F.size(texts) > 0,
        F.struct(
            F.try_element_at(folders, F.lit(-1)).alias("cwd"),
            tag_value(last, "approval_policy").alias("approval_policy"),
            tag_value(last, "sandbox_mode").alias("sandbox_mode"),
            tag_value(last, "network_access").alias("network_access"),
        ),
    )


def session_details(grouped: DataFrame) -> DataFrame:
    """Session fields of each file with a prelude.

    ``max_by`` keeps the last setting in event order and combines on the map side,
    so a file of any size costs one small buffer per task.
    """
    event = F.col("_event")
    rows = (
        prelude(grouped)
        .where("event_type = 'session_meta' OR "
               "(event_type = 'response_item' AND payload_type = 'message')")
        .withColumn("_event", jsonv.parse(F.col("raw_json")))
    )
    is_meta = F.col("event_type") == "session_meta"
    p = "$.payload"
    stamp = F.when(
        jsonv.truthy(event, f"{p}.timestamp"), jsonv.column_text(event, f"{p}.timestamp")
    ).otherwise(F.col("timestamp"))
    nested = (
        jsonv.is_container(event, f"{p}.id")
        | (jsonv.truthy(event, f"{p}.timestamp") & jsonv.is_container(event, f"{p}.timestamp"))
    )
    facts = rows.select(
        "file_path",
        "seq",
        F.when(
            is_meta,
            F.struct(
                jsonv.column_text(event, f"{p}.id").alias("session_id"),
                stamp.alias("session_timestamp"),
                nested.alias("nested"),
            ),
        ).alias("meta"),
        F.when(~is_meta, environment(event)).alias("env"),
        F.when(
            is_meta & jsonv.truthy(event, f"{p}.cwd"),
            F.struct(
                jsonv.column_text(event, f"{p}.cwd").alias("cwd"),
                jsonv.is_container(event, f"{p}.cwd").alias("nested"),
            ),
        ).alias("meta_cwd"),
    )
    env_cwd = F.when(
        F.col("env.cwd").isNotNull(),
        F.struct(F.col("env.cwd").alias("cwd"), F.lit(False).alias("nested")),
    )
    folder = F.coalesce("meta_cwd", env_cwd)

    def last(value: Column, seen: Column) -> Column:
        return F.max_by(value, F.when(seen.isNotNull(), F.col("seq")))

    folded = facts.groupBy("file_path").agg(
        last(F.col("meta"), F.col("meta")).alias("meta"),
        last(F.col("env"), F.col("env")).alias("env"),
        last(folder, folder).alias("folder"),
    )
    return folded.select(
        "file_path",
        "meta.session_id",
        "meta.session_timestamp",
        "folder.cwd",
        "env.approval_policy",
        "env.sandbox_mode",
        "env.network_access",
        (
            F.coalesce("meta.nested", F.lit(False))
            | F.coalesce("folder.nested", F.lit(False))
        ).alias("nested"),
    )


def prelude_parts(grouped: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The prelude document in parts; joined in order they give the whole text.

    Each part is built from a bounded run of events, whatever the file holds.
    """
    rows = prelude(grouped).select("file_path", "chunk", "seq", "raw_json")
    size = F.length("raw_json") + 2
    placed = chunks.in_parts(rows, ["file_path"], "seq", size, part_bytes)
    parts = placed.groupBy("file_path", "part").agg(
        F.array_sort(F.collect_list(F.struct("seq", "raw_json"))).alias("_events")
    )
    return parts.select(
        "file_path",
        "part",
        F.array_join(F.col("_events.raw_json"), ", ").alias("events_json"),
    )


def document_pieces(parts: DataFrame) -> DataFrame:
    """Session documents in pieces (file_path, part, text), whatever their size.

    The texts of a file, in the order of ``part``, join to its whole document; no task
    holds more than a piece. Files without a prelude have no piece.
    """
    counted = parts.groupBy("file_path").agg(F.min("part").alias("_first"), F.max("part").alias("_last"))
    begin = F.when(F.col("part") == F.col("_first"), '{"events": [').otherwise(", ")
    end = F.when(F.col("part") == F.col("_last"), "]}").otherwise("")
    return parts.join(counted, "file_path").select(
        "file_path", "part", F.concat(begin, F.col("events_json"), end).alias("text")
    )


def sessions(
    grouped: DataFrame,
    files: DataFrame,
    parts: DataFrame | None = None,
    cell_parts: int | None = None,
) -> DataFrame:
    """One row per file, also where the prelude is empty.

    ``raw_json`` is put together from the parts of the prelude, however many. With
    ``cell_parts`` it is null for documents of more parts, and no task collects them;
    ``document_pieces`` gives them whole.
    """
    parts = prelude_parts(grouped) if parts is None else parts
    within = F.lit(True) if cell_parts is None else F.col("part") < cell_parts
    documents = parts.groupBy("file_path").agg(
        F.count("*").alias("n_parts"),
        F.array_sort(
            F.collect_list(F.when(within, F.struct("part", "events_json")))
        ).alias("_parts"),
    )
    n_parts = F.coalesce("n_parts", F.lit(0))
    whole = F.lit(True) if cell_parts is None else n_parts <= cell_parts
    document = F.concat(
        F.lit('{"events": ['),
        F.coalesce(F.array_join(F.col("_parts.events_json"), ", "), F.lit("")),
        F.lit("]}"),
    )
    return (
        files.select("file_path")
        .join(session_details(grouped), "file_path", "left")
        .join(documents, "file_path", "left")
        .select(
            "file_path",
            "session_id",
            "session_timestamp",
            "cwd",
            "approval_policy",
            "sandbox_mode",
            "network_access",
            F.when(whole, document).alias("raw_json"),
            n_parts.alias("prelude_parts"),
        )
    )
