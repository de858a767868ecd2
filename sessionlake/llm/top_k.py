"""Exact top-k search by inner product in buckets of vectors of like length.

Components become floor(256 * x). Vectors are laid out by falling length, so that each
task holds a range of lengths, and inside a task they form buckets whose lengths lie close
together. A query carries the score that its k-th best must reach so far. Divided by
the lengths of the query and of the bucket's longest vector, it becomes the cosine that
a member needs at least. Above 1 the bucket is skipped. Where it is high, coordinate
pruning keeps members whose direction lies in the feasible range of the query's largest
coordinates; where it is low, length pruning keeps members that are long enough. What is
left is verified by exact integer products: in float64 where lengths allow no larger ones
than it holds exactly, else in whole numbers, from candidates that may err by rounding.

Queries meet all vectors in blocks of ``block`` queries; a block is what is broadcast.
Starting scores come from the longest vectors, a bounded number, and only speed things
up. A task hands on at most k rows a query.

Defined cases: vectors that are null, or hold null or non-finite components, and rows
without an id take no part; vectors of unlike size compare as if filled up with zeros;
rows with the query's id are never its answers; a repeated query is answered each time; a
repeated candidate counts each time; a product beyond the range of a long raises; other
columns are not used.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionlake.llm.shared import share
from sessionlake.session import stage

SCALE = 256
BUCKET = 1024
NARROW = 0.9  # shortest to longest in a bucket
COORDINATE_COSINE = 0.5
FOCUS = 3
SLACK = 1e-9
EXACT = 2.0**52  # float64 products of shorter vectors are exact integers


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, length) of the vectors that take part."""
    usable = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    )
    # A double is whole from 2 ** 53 on; floor itself would stop at the largest long.
    floored = F.transform(
        "embedding",
        lambda x: F.when(F.abs(x.cast("double")) < 2.0**45, F.floor(x.cast("double") * SCALE).cast("double"))
        .otherwise(x.cast("double") * SCALE),
    )
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable)
    return kept.select("vec_id", floored.alias("v")).withColumn("length", F.sqrt(square))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as float64, filled up with zeros to ``width``."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), max(width, int(sizes.max(initial=0)))))
    rows = np.repeat(np.arange(len(column)), sizes)
    places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, places] = column.flatten().to_numpy(zero_copy_only=False)
    return out


@dataclass
class Queries:
    """A block of queries and the score that a member of each answer must reach."""

    ids: np.ndarray
    vectors: np.ndarray
    needed: np.ndarray

    def __post_init__(self):
        self.lengths = np.sqrt((self.vectors**2).sum(axis=1))
        unit = self.vectors / np.maximum(self.lengths, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
        self.unit = np.take_along_axis(unit, self.focus, axis=1)


class Best:
    """The k best answers so far of each query of a block."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k = queries, k
        self.needed = queries.needed.copy()
        self.rows = [np.zeros(0, dtype=np.int64)] * 3

    def add(self, query: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> None:
        fresh = (query, vec_id, score.astype(np.int64))
        query, vec_id, score = (np.concatenate(pair) for pair in zip(self.rows, fresh))
        order = np.lexsort((vec_id, -score, query))
        query, vec_id, score = query[order], vec_id[order], score[order]
        first = np.searchsorted(query, query, side="left")
        kept = np.arange(len(query)) - first < self.k
        self.rows = [query[kept], vec_id[kept], score[kept]]
        last = np.arange(len(query)) - first == self.k - 1
        at = query[last]
        self.needed[at] = np.maximum(self.needed[at], score[last])


def _buckets(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of falling lengths that lie close together."""
    low = 0
    while low < len(lengths):
        near = np.searchsorted(-lengths, -lengths[low] * NARROW, side="right")
        high = min(max(int(near), low + 1), low + BUCKET)
        yield low, high
        low = high


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer products row by row, of any size that a long holds; a larger one raises."""
    sums = [sum(map(operator.mul, a, b)) for a, b in zip(*(map(_whole, side) for side in (left, right)))]
    return np.array(sums, dtype=np.int64)


def _whole(row: np.ndarray) -> list[int]:
    return [int(x) for x in row.tolist()]


def search_bucket(best: Best, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray) -> None:
    """Verify what pruning leaves of one bucket (members by falling length)."""
    queries = best.queries
    reach = np.maximum(queries.lengths * lengths[0], 1e-300)
    # How far a float64 product may be from the true one; nothing where all are exact.
    unsure = np.where(reach < EXACT, 0.0, reach * (vectors.shape[1] + 4) * 2.0**-52)
    cosine = best.needed / reach
    alive = cosine <= 1 + SLACK + unsure / reach
    by_coordinate = np.flatnonzero(alive & (cosine >= COORDINATE_COSINE))
    by_length = np.flatnonzero(alive & (cosine < COORDINATE_COSINE))
    found = []
    if len(by_coordinate):
        unit = (vectors / np.maximum(lengths, 1e-300)[:, None]).T.copy()
        for q in by_coordinate.tolist():
            # Vectors within the needed angle of the query, seen on one coordinate.
            t, along = min(cosine[q], 1.0), queries.unit[q]
            spread = np.sqrt((1 - t * t) * np.maximum(1 - along**2, 0)) + SLACK
            low = np.where(along < -t, -1.0, t * along - spread) - SLACK
            high = np.where(along > t, 1.0, t * along + spread) + SLACK
            kept = np.ones(len(ids), dtype=bool)
            for f, a, b in zip(queries.focus[q], low, high):
                kept &= (unit[f] >= a) & (unit[f] <= b)
            members = np.flatnonzero(kept)
            scores = vectors[members] @ queries.vectors[q]
            good = scores >= best.needed[q] - unsure[q]
            found.append((np.full(good.sum(), q), members[good], scores[good]))
    if len(by_length):
        shortest = best.needed[by_length] / np.maximum(queries.lengths[by_length], 1e-300)
        size = int(np.searchsorted(-lengths, -shortest.min() * (1 - SLACK), side="right"))
        size = len(ids) if shortest.min() <= 0 else size
        scores = queries.vectors[by_length] @ vectors[:size].T
        q, members = np.nonzero(scores >= (best.needed - unsure)[by_length, None])
        found.append((by_length[q], members, scores[q, members]))
    if found:
        query, members, scores = (np.concatenate(parts) for parts in zip(*found))
        other = queries.ids[query] != ids[members]
        query, members, scores = query[other], members[other], scores[other]
        if (unsure[query] > 0).any():
            scores = exact_products(queries.vectors[query], vectors[members])
        best.add(query, ids[members], scores)


def _search(queries: Queries, k: int, batches: Iterator[pa.RecordBatch]):
    best = Best(queries, k)
    for batch in batches:
        vectors = matrix(batch.column("v"), queries.vectors.shape[1])
        ids = batch.column("vec_id").to_numpy()
        lengths = batch.column("length").to_numpy()
        wide = vectors[:, : queries.vectors.shape[1]]  # what is longer meets zeros
        order = np.argsort(-lengths, kind="stable")
        ids, wide, lengths = ids[order], wide[order], lengths[order]
        for low, high in _buckets(lengths):
            search_bucket(best, ids[low:high], wide[low:high], lengths[low:high])
    query, vec_id, score = best.rows
    yield pa.RecordBatch.from_arrays(
        [pa.array(query), pa.array(queries.ids[query]), pa.array(vec_id), pa.array(score)],
        ["ordinal", "query_id", "vec_id", "score"],
    )


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's best vectors other than itself."""
    spark = vectors.sparkSession
    whole = stage(whole_vectors(vectors), "vectors")
    parts = max(1, spark.sparkContext.defaultParallelism)
    # By length, and by id where many are equally long: a range for each task.
    laid_out = stage(
        whole.repartitionByRange(parts, F.desc("length"), F.asc("vec_id")).sortWithinPartitions(
            F.desc("length")
        ),
        "by_length",
    )
    width = whole.agg(F.max(F.size("v"))).first()[0] or 0
    longest = laid_out.orderBy(F.desc("length"), "vec_id").limit(2 * BUCKET).toArrow()
    asking = whole.where(is_query)
    blocks = -(-asking.count() // block) or 1
    key = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    found = None
    for number in range(blocks):
        held = asking.where(key == number).select("vec_id", "v").toArrow().combine_chunks()
        ids = held.column("vec_id").to_numpy()
        rows = [matrix(c, width) for c in held.column("v").chunks] or [np.zeros((0, width))]
        queries = Queries(ids, np.concatenate(rows), np.full(len(ids), -np.inf))
        start = Best(queries, k)
        for batch in longest.to_batches():
            members, lengths = matrix(batch.column("v"), width), batch.column("length").to_numpy()
            for low, high in _buckets(lengths):
                vec_id = batch.column("vec_id").to_numpy()[low:high]
                search_bucket(start, vec_id, members[low:high], lengths[low:high])
        queries.needed = start.needed
        shared = share(spark, queries)

        def run(batches, shared=shared):
            return _search(shared(), k, batches)

        schema = "ordinal bigint, query_id bigint, vec_id bigint, score bigint"
        answers = stage(laid_out.mapInArrow(run, schema), "answers").withColumn("block", F.lit(number))
        found = answers if found is None else found.union(answers)
    place = F.row_number().over(
        Window.partitionBy("block", "ordinal").orderBy(F.desc("score"), F.asc("vec_id"))
    )
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
"""
