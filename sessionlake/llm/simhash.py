"""SimHash near-duplicates by the generalised pigeonhole principle.

A text, A-Z lower-cased, is split at ASCII white space; its shingles are the runs of
three words (all of a shorter text), repeats included. Bit b of the fingerprint is set
if more than half of the shingles' XXH64 (seed 42) set it. A text without words has
fingerprint 0. Fingerprints that differ in at most ``distance`` bits are linked.

Finding links over the distinct fingerprints:

1. Correlated bits are put into the same of m parts (correlations over all rows).
2. If two fingerprints differ in at most t bits, then for any thresholds t_i that sum to
   t - m + 1, some part differs in at most t_i bits; -1 skips a part. For several m,
   dynamic programming picks the thresholds with the least estimated work: candidate
   pairs, from how often each part's values repeat over all rows, plus probes.
3. Each fingerprint is indexed under its own part values and probes those within t_i;
   pairs that meet are verified.
4. Values shared by more than ``bucket_rows`` fingerprints are not paired: inside
   such a bucket the bits not yet used are split again by the same principle, as often
   as needed. Buckets shrink with every split, for distinct fingerprints that agree in
   nearly all bits are few. Nothing is capped.

Links become components without leaving Spark.

Defined cases: repeated rows share a fingerprint; null and empty texts are linked with
each other; rows without an id get the smallest id of their component, null if it has
none; all other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from sessionlake.llm.components import connected_components
from sessionlake.session import stage

BITS = 64
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(whole[a:b], SEED) for a, b in zip(starts, stops)])
    bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
    majority = bits.sum(axis=0, dtype=np.int64) * 2 > len(stops)
    return int.from_bytes(np.packbits(majority).tobytes(), "big", signed=True)


def with_fingerprint(documents: DataFrame, shingle: int = 3, name: str = "fingerprint") -> DataFrame:
    """``documents`` with the fingerprint as a (signed) long."""
    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(text, shingle) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(prints, pa.int64())], [*batch.schema.names, name]
            )

    return documents.mapInArrow(run, schema)


# --- planning ----------------------------------------------------------------


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def correlations(prints: DataFrame) -> np.ndarray:
    """Absolute correlation of every two bits over all rows."""

    def run(batches):
        sums, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            bits = (values[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(float)
            sums += bits.T @ bits
            rows += len(values)
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows]), pa.array([sums.ravel().tolist()])], ["n", "sums"]
        )

    parts = prints.select("fp").mapInArrow(run, "n bigint, sums array<double>")
    sums = parts.select("n", F.posexplode("sums").alias("at", "x")).groupBy("at").agg(
        F.sum("x").alias("x"), F.sum("n").alias("n")
    )
    both, n = np.zeros(BITS * BITS), 0
    for row in sums.collect():  # one row for each pair of bits
        both[row["at"]], n = row["x"], row["n"]
    both = both.reshape(BITS, BITS) / max(1, n)
    mean = np.diag(both)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return np.abs((both - np.outer(mean, mean)) / np.outer(spread, spread))


def group_bits(likeness: np.ndarray, bits: list[int], parts: int) -> list[list[int]]:
    """``bits`` in ``parts`` groups of even size, each grown by the bits most like it."""
    left, groups = list(bits), []
    for number in range(parts):
        size = -(-len(left) // (parts - number))
        group: list[int] = []
        while len(group) < size:
            inside = likeness[np.ix_(left, group or left)]
            pull = inside.mean(axis=1) if group else inside.sum(axis=1)
            group.append(left.pop(int(np.argmax(pull))))
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    return sum(1 << bit for bit in bits)


def probes(width: int, threshold: int) -> int:
    return sum(len(list(combinations(range(width), k))) for k in range(threshold + 1))


def allocate(work: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one a part, that sum to ``total`` with the least work."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for costs in work:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for threshold, more in costs.items():
                option = (cost + more, [*chosen, threshold])
                if option < after.get(spent + threshold, (float("inf"), [])):
                    after[spent + threshold] = option
        best = after
    return best[total]


def plan(prints: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """Parts (their bits) and thresholds with the least estimated work."""
    likeness = correlations(prints)
    choices = {m: group_bits(likeness, list(range(BITS)), m) for m in range(1, distance + 3)}
    flat = [(m, i, bits) for m, parts in choices.items() for i, bits in enumerate(parts)]
    keys = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(m).alias("m"),
                    F.lit(i).alias("i"),
                    F.col("fp").bitwiseAND(F.lit(signed(mask_of(bits)))).alias("key"),
                )
                for m, i, bits in flat
            )
        )
    )
    sizes = prints.select(keys.alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    pairs = sizes.groupBy("k.m", "k.i").agg(
        F.sum(F.col("n") * (F.col("n") - 1.0) / 2).alias("pairs"), F.sum("n").alias("rows")
    )
    seen = {(r["m"], r["i"]): (r["pairs"], r["rows"]) for r in pairs.collect()}
    options = []
    for m, parts in choices.items():
        work = []
        for i, bits in enumerate(parts):
            same, rows = seen.get((m, i), (0.0, 0))
            # A probe at another value meets about as many rows as one at the own value.
            costs = {
                t: probes(len(bits), t) * (float(same) + rows)
                for t in range(min(distance, len(bits)) + 1)
            }
            work.append({-1: 0.0, **costs})
        cost, thresholds = allocate(work, distance - m + 1)
        options.append((cost, m, thresholds))
    _, m, thresholds = min(options)
    return [(bits, t) for bits, t in zip(choices[m], thresholds) if t >= 0]


# --- probing and verifying ---------------------------------------------------

FEW_BITS = 6  # distinct fingerprints that agree in all other bits are at most 64


def _entries(prints: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """Rows (fp, bucket, probe, rest): where each fingerprint is indexed and looks.

    ``rest`` has the bits that say nothing about the bucket.
    """
    places = []
    for bits, threshold in parts:
        mask, rest = mask_of(bits), mask_of([b for b in range(BITS) if b not in bits])
        flips = [
            mask_of(list(chosen))
            for k in range(threshold + 1)
            for chosen in combinations(bits, k)
        ]
        for probe, flip in [(False, 0), *((True, flip) for flip in flips)]:
            values = (signed(mask), signed(rest), signed(flip))
            names = ("mask", "rest", "flip")
            fields = [F.lit(v).cast("bigint").alias(n) for v, n in zip(values, names)]
            places.append(F.struct(F.lit(probe).alias("probe"), *fields))
    rows = prints.select("fp", F.explode(F.array(*places)).alias("at"))
    value = F.col("fp").bitwiseXOR(F.col("at.flip")).bitwiseAND(F.col("at.mask"))
    bucket = F.xxhash64("at.mask", value)
    return rows.select("fp", bucket.alias("bucket"), "at.probe", "at.rest")


def _meet(entries: DataFrame, distance: int) -> DataFrame:
    index = entries.where("NOT probe").select("bucket", F.col("fp").alias("a"))
    asks = entries.where("probe").select("bucket", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return index.join(asks, "bucket").where((F.col("a") < F.col("b")) & near).select("a", "b")


def links(
    prints: DataFrame,
    distance: int,
    bucket_rows: int = 512,
    parts: list[tuple[list[int], int]] | None = None,
) -> DataFrame:
    """All pairs (a < b) of distinct fingerprints ``fp`` that differ in few enough bits."""
    parts = parts or plan(prints, distance)
    entries = stage(_entries(prints, parts), "probes")
    found = None
    while True:
        sizes = entries.groupBy("bucket").agg(F.count("*").alias("n"))
        large = sizes.where(F.col("n") > 2 * bucket_rows).select("bucket", F.lit(True).alias("hot"))
        large = stage(large, "large_buckets")
        if not large.limit(1).count():
            pairs = _meet(entries, distance)
            return (pairs if found is None else found.union(pairs)).distinct()
        split = F.col("hot") & (F.bit_count("rest") > FEW_BITS)
        sized = entries.join(large, "bucket", "left").withColumn("split", F.coalesce(split, F.lit(False)))
        sized = stage(sized, "sized")
        pairs = _meet(sized.where("NOT split"), distance)
        found = pairs if found is None else found.union(pairs)
        rests = [r["rest"] for r in sized.where("split").select("rest").distinct().collect()]
        if not rests:
            return found.distinct()
        entries = stage(_split(sized.where("split"), rests, distance), "probes")


def _split(entries: DataFrame, rests: list[int], distance: int) -> DataFrame:
    """The rows of large buckets in buckets that more bits decide.

    Two that match differ in at most ``distance`` of the bits in ``rest``, so of
    distance + 1 groups of these one is equal. ``rests`` are the few values of ``rest``.
    """
    groups = []
    for rest in rests:
        bits = [b for b in range(BITS) if rest >> b & 1]
        for k in range(distance + 1):
            mask = mask_of(bits[k :: distance + 1])
            groups.append((rest, signed(mask), signed(rest & (1 << BITS) - 1 & ~mask)))
    spark = entries.sparkSession
    table = spark.createDataFrame(groups, "rest bigint, mask bigint, after bigint")
    bucket = F.xxhash64("bucket", "mask", F.col("fp").bitwiseAND(F.col("mask")))
    return entries.join(table, "rest").select(
        "fp", bucket.alias("bucket"), "probe", F.col("after").alias("rest")
    )


def _roots(prints: DataFrame, distance: int, bucket_rows: int) -> DataFrame:
    """For every fingerprint: the root of its component, and the first of its rows."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    distinct = stage(prints.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    roots = connected_components(links(distinct.select("fp"), distance, bucket_rows))
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return stage(joined.select("fp", F.coalesce("root", "fp").alias("root"), "first"), "roots")


def near_duplicates(
    documents: DataFrame, shingle: int = 3, distance: int = 2, bucket_rows: int = 512
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    rows = with_fingerprint(documents.select("doc_id", "text"), shingle, "fp")
    prints = stage(
        rows.select("doc_id", "fp", F.monotonically_increasing_id().alias("row")), "prints"
    )
    roots = _roots(prints, distance, bucket_rows)
    first = roots.groupBy("root").agg(F.min("first").alias("first"))
    components = roots.select("fp", "root").join(first, "root").select(
        "fp", F.col("first.doc_id").alias("component_id")
    )
    # A fingerprint of very many copies makes a large join partition, which Spark splits.
    return prints.join(components, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    documents: DataFrame, shingle: int = 3, distance: int = 2, bucket_rows: int = 512
) -> DataFrame:
    """One row of each component, the one with the smallest id; columns as they came."""
    held = with_fingerprint(documents, shingle, "__fp")
    held = stage(held.withColumn("__row", F.monotonically_increasing_id()), "held")
    prints = held.select("doc_id", F.col("__fp").alias("fp"), F.col("__row").alias("row"))
    roots = _roots(prints, distance, bucket_rows)
    kept = roots.groupBy("root").agg(F.min("first").alias("first")).select("first.row")
    gone = prints.select("row").join(kept, "row", "left_anti").withColumnRenamed("row", "__row")
    return held.join(gone, "__row", "left_anti").drop("__row", "__fp")
