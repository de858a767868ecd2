"""Line dedup across sites, in DataFrame operations only.

A line is boilerplate when it stands on at least ``min_sites`` distinct sites (values of
``source``; null is no site). Lines are compared by hash, without spaces at their ends;
blank lines are never boilerplate. Each line hash gets a HyperLogLog sketch of its
sites, merged by aggregation. The sketch decides where its estimate is clear of the
threshold by ``margin``; lines near it get an exact distinct count. Of a boilerplate
line the first occurrence (smallest doc_id, then hash of the row, then line number)
stays and all others go, so every line remains in the corpus once.

Line texts are never shuffled, only their hashes; whole texts once, with the numbers of
the lines that go. Aggregates combine before the shuffle; a line that a third of all
rows share makes a large join partition, which Spark splits.

Defined cases: a null text stays null and has no lines; an empty text has one blank
line; equal rows are treated alike; null ids sort last; a text whose lines all go
becomes empty; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlake.session import stage

MIN_SITES = 8
MARGIN = 0.15
SKETCH_BITS = 10  # error of about 3 percent; a few dozen sites are counted exactly


def _lines() -> Column:
    return F.split("text", "\n", -1)


def _row_hash() -> Column:
    """Tells rows with the same id apart."""
    return F.xxhash64("text", "source")


def occurrences(documents: DataFrame) -> DataFrame:
    """(doc_id, row_hash, n, line hash, source) of every line that is not blank."""
    lines = documents.select(
        "doc_id", _row_hash().alias("row_hash"), "source", F.posexplode(_lines()).alias("n", "line")
    )
    return lines.where(F.trim("line") != "").withColumn("line", F.xxhash64(F.trim("line")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """(line, first) of lines on enough sites; ``first`` is the occurrence that stays."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash", "n")
    merged = lines.groupBy("line").agg(
        F.count("*").alias("times"),
        F.hll_sketch_agg("source", SKETCH_BITS).alias("sites"),
        F.min(place).alias("first"),
    )
    low, high = min_sites * (1 - margin), min_sites * (1 + margin)
    # Fewer occurrences than sites asked for need no estimate.
    rated = merged.where(F.col("times") >= min_sites).select(
        "line", "first", F.hll_sketch_estimate("sites").alias("estimate")
    )
    rated = stage(rated.where(F.col("estimate") >= low), "rated_lines")
    near = rated.where(F.col("estimate") <= high)
    exact = (
        lines.join(near.select("line"), "line", "left_semi")
        .groupBy("line")
        .agg(F.countDistinct("source").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    sure = rated.where(F.col("estimate") > high).select("line", "first")
    return sure.union(near.join(exact, "line").select("line", "first"))


def dedup_lines(
    documents: DataFrame,
    min_sites: int = MIN_SITES,
    margin: float = MARGIN,
    n_lines: str = "n_lines",
    n_removed: str = "n_removed",
) -> DataFrame:
    """``documents`` with boilerplate lines taken from ``text``, and two counts."""
    lines = stage(occurrences(documents), "lines")
    found = boilerplate(lines, min_sites, margin)
    stays = (
        F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
        & (F.col("row_hash") == F.col("first.row_hash"))
        & (F.col("n") == F.col("first.n"))
    )
    gone = (
        lines.join(found, "line")
        .where(~stays)
        .groupBy("doc_id", "row_hash")
        .agg(F.array_sort(F.collect_set("n")).alias("__gone"))
        .withColumnsRenamed({"doc_id": "__doc_id", "row_hash": "__row_hash"})
    )
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (_row_hash() == F.col("__row_hash"))
    joined = documents.join(gone, same, "left").drop("__doc_id", "__row_hash")
    size = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines()))
    return joined.withColumns(
        {
            n_lines: size.cast("bigint"),
            n_removed: F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint"),
            "text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(
                F.array_join(_between("__gone"), "\n")
            ),
        }
    ).drop("__gone")


def _between(gone: str) -> Column:
    """The lines of ``text`` that stand before, between and behind the numbers gone."""
    start = F.concat(F.array(F.lit(-1)), F.col(gone))
    end = F.concat(F.col(gone), F.array(F.size(_lines())))
    return F.flatten(F.zip_with(start, end, lambda a, b: F.slice(_lines(), a + 2, b - a - 1)))


def drop_boilerplate(
    documents: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN
) -> DataFrame:
    """Columns as they came, boilerplate lines gone, and documents that were nothing else."""
    cut = dedup_lines(documents, min_sites, margin, "__n_lines", "__n_removed")
    changed = F.col("__n_removed") > 0
    kept = cut.where(~changed | (F.trim("text") != "") | F.col("text").isNull())
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        length = F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", length)
    return kept.select(*documents.columns)


#: The same by exact counts; ids are unique there.
SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM documents
), spread AS (
  SELECT trim(line) AS line, count(DISTINCT source) AS sites FROM lines GROUP BY 1
), marked AS (
  SELECT doc_id, n, lines.line, trim(lines.line) <> '' AND sites >= {MIN_SITES}
         AND row_number() OVER (PARTITION BY trim(lines.line) ORDER BY doc_id, n) > 1 AS gone
  FROM lines JOIN spread ON trim(lines.line) = spread.line
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept.text
FROM documents d LEFT JOIN kept USING (doc_id)
"""
