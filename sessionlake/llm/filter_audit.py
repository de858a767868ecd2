"""How five document filters interact in every order of applying them.

Spark finds which filters a document fails, its mask, and counts documents by part and
mask: at most 32 rows for each part. The rest is a min-plus product: the mask matrix (0
where a mask fails a filter, else infinity) with the matrix of the filters' steps in all
120 orders gives the step that removes a mask's documents, and counts scatter by it.

Copies (filter E) are told by digest of the text. Equal texts fail the same other filters,
so all rows are first counted as copies and the rows of each text's smallest id are then
moved to the mask without E. No text's rows are gathered in one task.

Defined cases: a null text is empty; a null language is the part of the empty string; rows
with equal ids are a document each, and neither is the other's copy; a document without an
id is not a copy of any and has no copies; of several labels of an id the largest count,
a null label is none; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import string
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sessionlake.session import stage

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
_SPACE = " \t-\r"


def failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text alone."""
    words = F.array_remove(F.split(text, f"[{_SPACE}]+"), "")
    upper = F.length(text) - F.length(F.translate(text, string.ascii_uppercase, ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * upper > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def narrow(documents: DataFrame) -> DataFrame:
    """(doc_id, part, mask, copy_of, n): documents alike in all of these, counted."""
    text = F.coalesce("text", F.lit(""))
    mask = sum(F.when(fails, 1 << FILTERS.index(name)).otherwise(0) for name, fails in failures(text).items())
    rows = documents.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        mask.alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("copy_of"),
    )
    return rows.groupBy("doc_id", "part", "mask", "copy_of").agg(F.count("*").alias("n"))


def mask_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents that fail exactly the filters of ``mask``."""
    rows = stage(narrow(documents), "masks")
    label = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic_label")
    )
    with_id = rows.where("doc_id IS NOT NULL")
    # One row for each text; the smallest id is unique in it, so no join key is hot.
    first = with_id.groupBy("copy_of").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    found = with_id.join(first, ["copy_of", "doc_id"], "left").join(label, "doc_id", "left")
    found = found.select(
        "part",
        (F.col("mask") + F.when(F.col("first"), 0).otherwise(COPY)).alias("mask"),
        "n",
        F.when(F.col("quality") == 1, F.col("n")).otherwise(0).alias("good"),
        F.when(F.col("toxic_label") == 1, F.col("n")).otherwise(0).alias("toxic"),
    )
    none = F.lit(0).cast("bigint")
    without = rows.where("doc_id IS NULL").select("part", "mask", "n", none.alias("good"), none.alias("toxic"))
    return found.union(without).groupBy("part", "mask").agg(
        *(F.sum(name).alias(name) for name in ("n", "good", "toxic"))
    )


ORDERS = ["".join(order) for order in permutations(FILTERS)]
#: Step of each filter in each order: the orders' inverse permutations.
POSITIONS = np.array([[order.index(name) + 1 for name in FILTERS] for order in ORDERS])
NEVER = len(FILTERS) + 1


def removal_steps(masks: np.ndarray) -> np.ndarray:
    """Min-plus product of masks and positions: the step that removes each mask's documents
    in each order, or NEVER."""
    fails = masks[:, None] >> np.arange(len(FILTERS)) & 1
    cost = np.where(fails == 1, 0, NEVER)
    return np.minimum((cost[:, None, :] + POSITIONS[None, :, :]).min(axis=2), NEVER)


def audit_part(part: str, counts: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part, from its at most 32 rows of counts."""
    masks = counts["mask"].to_numpy(np.int64)
    weights = counts[["n", "good", "toxic"]].to_numpy(np.int64)
    steps, orders = removal_steps(masks), np.arange(len(ORDERS))
    removed = np.zeros((len(ORDERS), NEVER + 1, 3), dtype=np.int64)
    for each, weight in zip(steps, weights):
        np.add.at(removed, (orders, each), weight)
    kept = weights[:, 0].sum() - np.cumsum(removed[:, :, 0], axis=1)
    redundant = np.zeros((len(ORDERS), NEVER + 1), dtype=np.int64)
    alone = np.zeros(len(FILTERS), dtype=np.int64)
    shapley = np.zeros(len(FILTERS), dtype=np.int64)
    for mask, each, (n, *_) in zip(masks, steps, weights):
        for index in range(len(FILTERS)):
            if mask >> index & 1:
                at = POSITIONS[:, index]
                redundant[orders, at] += np.where(each < at, n, 0)
                shapley[index] += n * int((each == at).sum())
                alone[index] += n if mask == 1 << index else 0
    rows = [
        (
            part, order, step, kept[o, step], removed[o, step, 0], redundant[o, step],
            alone[(index := FILTERS.index(order[step - 1]))], removed[o, step, 1],
            removed[o, step, 2], shapley[index],
        )
        for o, order in enumerate(ORDERS)
        for step in range(1, NEVER)
    ]
    return pd.DataFrame(rows, columns=_NAMES)


_NAMES = [
    "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
    "good_lost", "toxic_lost", "shapley",
]
_SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{n} bigint" for n in _NAMES[3:])


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does at each step of each order, by part."""

    def run(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:
        return audit_part(key[0], counts)

    return mask_counts(documents, labels).groupBy("part").applyInPandas(run, _SCHEMA)


SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS words
  FROM documents
), label AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), firsts AS (
  SELECT text, min(doc_id) AS first FROM texts GROUP BY text
), judged AS (
  SELECT t.part,
    [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
     100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 3 * length(t.text),
     regexp_matches(t.text, '[#$%&*|]'), coalesce(t.doc_id > f.first, false)] AS fails,
    coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM texts t JOIN firsts f ON f.text = t.text LEFT JOIN label l ON l.doc_id = t.doc_id
), counted AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM judged GROUP BY part, fails
), orders AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || letter FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS l(letter)
  WHERE NOT contains(filter_order, letter)
), ranks AS (
  SELECT part, fails, n, good, toxic, filter_order,
    coalesce(list_min(list_filter(list_transform(['A', 'B', 'C', 'D', 'E'],
      lambda letter, i: CASE WHEN fails[i] THEN instr(filter_order, letter) END), lambda s: s IS NOT NULL)), 6) AS gone
  FROM counted, orders WHERE length(filter_order) = 5
), steps AS (
  SELECT r.part, r.filter_order, s.step::INT AS step, substr(r.filter_order, s.step, 1) AS letter,
    sum(n) FILTER (gone > s.step) AS kept, sum(n) FILTER (gone = s.step) AS removed,
    sum(n) FILTER (gone < s.step AND fails[ascii(substr(filter_order, s.step, 1)) - 64]) AS redundant,
    sum(n) FILTER (fails[ascii(substr(filter_order, s.step, 1)) - 64]
      AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    sum(good) FILTER (gone = s.step) AS good_lost, sum(toxic) FILTER (gone = s.step) AS toxic_lost
  FROM ranks r, range(1, 6) AS s(step) GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM steps
"""
