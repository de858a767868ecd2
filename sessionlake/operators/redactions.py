"""The manual redaction table: create, read, update, delete, and its application.

A redaction names its prompt by (file_path, prompt_index), a key that outlives a
new ingest of the file. Changes take batches of rows and give back a new table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlake.functions.rules import SCOPES
from sessionlake.functions.text import strip
from sessionlake.schemas import column_names

PROMPT_KEY = ["file_path", "prompt_index"]
_COLUMNS = column_names("redactions")

# Messages of rejected rows.
BAD_SCOPE = "Invalid scope"
BLANK_PATH = "field_path cannot be blank when provided."
PATH_NEEDED = "field_path is required when scope='field'."
NO_REPLACEMENT = "replacement_text must be a non-empty string."


class RedactionError(ValueError):
    """A request that is refused before any row is read."""


def _check_scope(scope: str) -> None:
    if scope not in SCOPES:
        raise RedactionError(f"Invalid scope '{scope}'. Allowed scopes: {SCOPES}")


def _trimmed(name: str) -> Column:
    return F.nullif(strip(F.col(name)), F.lit(""))


def _path_error(scope: Column) -> Column:
    path = F.col("field_path")
    return F.when(path.isNotNull() & (strip(path) == ""), BLANK_PATH).when(
        (scope == "field") & path.isNull(), PATH_NEEDED
    )


def _scope_error() -> Column:
    scope = F.col("scope")
    return F.when(
        ~F.coalesce(scope.isin(*SCOPES), F.lit(False)),
        F.concat(F.lit(f"{BAD_SCOPE} '"), F.coalesce(scope, F.lit("None")), F.lit("'.")),
    )


def _replacement_error() -> Column:
    return F.when(
        F.coalesce(strip(F.col("replacement_text")), F.lit("")) == "", NO_REPLACEMENT
    )


def check_new(requests: DataFrame) -> DataFrame:
    """Requests with trimmed fields and the error of a bad one."""
    error = F.coalesce(
        _scope_error(), _path_error(F.col("scope")), _replacement_error()
    )
    return requests.withColumn("error", error).select(
        *[c for c in requests.columns if c not in ("field_path", "replacement_text", "reason", "actor")],
        _trimmed("field_path").alias("field_path"),
        strip(F.col("replacement_text")).alias("replacement_text"),
        _trimmed("reason").alias("reason"),
        _trimmed("actor").alias("actor"),
        "error",
    )


def create(table: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table with the good requests added, rejected requests with their error).

    Requests carry their own id and created_at, so that a retry adds the same rows.
    """
    checked = check_new(requests)
    good = checked.where("error IS NULL").withColumn(
        "updated_at", F.lit(None).cast("timestamp")
    )
    return (
        table.unionByName(good.select(*_COLUMNS)),
        checked.where("error IS NOT NULL"),
    )


def get(table: DataFrame, redaction_id: int) -> DataFrame:
    """The row with this id, or none."""
    return table.where(F.col("id") == redaction_id)


def listing(
    table: DataFrame,
    prompt: tuple[str, int] | None = None,
    scope: str | None = None,
) -> DataFrame:
    """Rows of a prompt and scope (None: all), newest first."""
    if scope is not None:
        _check_scope(scope)
        table = table.where(F.col("scope") == scope)
    if prompt is not None:
        table = table.where(
            (F.col("file_path") == prompt[0]) & (F.col("prompt_index") == prompt[1])
        )
    return table.orderBy(F.desc("created_at"), F.desc("id"))


_PATCHED = [*PROMPT_KEY, "scope", "field_path", "replacement_text", "reason", "actor"]


def check_patches(patches: DataFrame) -> DataFrame:
    """Patches with the error of a bad one.

    A patch that sets only the scope to 'field' passes: the path is looked at when
    it is given.
    """
    scope = F.coalesce("scope", F.lit("prompt"))
    error = F.coalesce(
        F.when(F.col("scope").isNotNull(), _scope_error()),
        F.when(F.col("field_path").isNotNull(), _path_error(scope)),
        F.when(F.col("replacement_text").isNotNull(), _replacement_error()),
    )
    return patches.withColumn("error", error)


def update(table: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """Set the fields a patch gives (not null) and updated_at.

    At most one patch per id. Reason and actor may be blanked with ''. A patch
    that gives nothing, or is wrong, changes nothing.
    """
    given = F.lit(False)
    for name in _PATCHED:
        given = given | F.col(name).isNotNull()
    good = check_patches(patches).where(F.col("error").isNull() & given).select(
        "id", *[F.col(name).alias(f"_new_{name}") for name in _PATCHED], F.lit(True).alias("_hit")
    )

    def patched(name: str) -> Column:
        new = F.col(f"_new_{name}")
        if name in ("field_path", "reason", "actor", "replacement_text"):
            return F.when(new.isNotNull(), F.nullif(strip(new), F.lit(""))).otherwise(
                F.col(name)
            )
        return F.coalesce(new, F.col(name))

    values = {name: patched(name) for name in _PATCHED}
    values["updated_at"] = F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))
    return table.join(good, "id", "left").select(
        *[values.get(name, F.col(name)).alias(name) for name in _COLUMNS]
    )


def delete(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Table without the listed ids."""
    return table.join(ids.select("id"), "id", "left_anti")


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Newest replacement per key, combined on the map side."""
    return rows.groupBy(*keys).agg(
        F.max_by(
            F.struct("created_at", "id", "replacement_text"), F.struct("created_at", "id")
        ).alias("_win")
    )


def apply_manual(
    prompts: DataFrame, table: DataFrame, columns: list[str]
) -> DataFrame:
    """Replace text columns of prompts by their newest redaction.

    Prompt scope replaces the message, field scope the named column, global scope
    every text column. Field and global rows without a prompt hold for all prompts.
    Run after the rules, so that the manual text is what stays.
    """
    targets = F.expr(
        "CASE scope WHEN 'prompt' THEN array('message')"
        " WHEN 'field' THEN array(field_path)"
        f" ELSE array({', '.join(repr(c) for c in columns)}) END"
    )
    aimed = (
        table.withColumn("_column", F.explode(targets))
        .where(F.col("_column").isin(*columns))
    )
    own = _newest(aimed.where("prompt_index IS NOT NULL"), [*PROMPT_KEY, "_column"])
    own = own.groupBy(*PROMPT_KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("_column", "_win"))).alias("_own")
    )
    # One row per text column at most: a value of fixed size.
    common = _newest(
        aimed.where("prompt_index IS NULL AND scope <> 'prompt'"), ["_column"]
    ).agg(F.map_from_entries(F.collect_list(F.struct("_column", "_win"))).alias("_common"))
    joined = prompts.join(own, PROMPT_KEY, "left").withColumn("_common", common.scalar())

    def redacted(name: str) -> Column:
        mine = F.try_element_at("_own", F.lit(name))
        shared = F.try_element_at("_common", F.lit(name))
        newest = F.greatest(mine, shared)
        return F.coalesce(newest["replacement_text"], F.col(name)).alias(name)

    return joined.select(
        *[redacted(c) if c in columns else F.col(c) for c in prompts.columns]
    )
