"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes ratios.

A feature is that a lower-case character n-gram (3 to 6 characters, hashed to 2**20
buckets) stands in a document at least once, twice or four times. Its value is the
log-count ratio of naive Bayes: how much likelier toxic documents are to have it. A
logistic regression on these scaled features gives the weights; features that tell little
about the label are left out.

Learning uses a bounded sample of labelled documents: about ``max_documents``, half of
them toxic where there are enough, chosen by a hash of the id; the intercept is moved
back to the real share of toxic documents. Counts are summed by Spark; the regression
runs on the driver over the sample's best features. How many of them (``sizes``) and which
of ``penalties`` is chosen by a fold of the sample that is put aside: models made from the
other rows alone are tried on it, and the likeliest wins. More features than the choice
only fit the sample's chance. The final model learns from the whole sample.

Defined cases: a null or empty text has no features and scores the intercept; without
labels of both kinds every document scores the share of toxic labels (0 without labels);
several labels of one document count as the highest; rows are judged one by one; other
columns pass through, but for one with the score's name, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sessionlake.llm.shared import share
from sessionlake.llm.words import slices, utf8
from sessionlake.session import stage

ORDERS = (3, 4, 5, 6)
BUCKET_BITS = 20
LEVELS = (1, 2, 4)  # occurrences that make a feature of their own
FEATURES = len(LEVELS) << BUCKET_BITS
FOLDS = 5  # one is put aside
PENALTIES = (0.3, 1.0, 3.0, 10.0)
SIZES = (250, 1000, 4000)  # features of a model
_STEP, _SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def gram_buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: buckets of all n-grams, the places where they begin, and row ends."""
    lowered = [text.lower() for text in texts]
    lengths = np.array([len(text) for text in lowered], dtype=np.int64)
    ends = np.cumsum(lengths)
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    left = np.repeat(ends, lengths) - np.arange(len(points))
    hashes = points * _STEP
    for order in range(2, max(ORDERS) + 1):
        if len(points) < order:
            return
        hashes = (hashes[:-1] ^ (hashes[:-1] >> np.uint32(15))) * _STEP + points[order - 1 :]
        if order in ORDERS:
            buckets = (hashes * _SPREAD) >> np.uint32(32 - BUCKET_BITS)
            yield buckets, left[: len(buckets)] >= order, ends


def present(texts: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of what a row holds of wanted buckets, each once."""
    found = [np.zeros(0, dtype=np.int64)]
    for buckets, whole, ends in gram_buckets(texts):
        places = np.flatnonzero(wanted[buckets] & whole)
        rows = np.searchsorted(ends, places, side="right")
        found.append(rows << BUCKET_BITS | buckets[places].astype(np.int64))
    pairs, times = np.unique(np.concatenate(found), return_counts=True)
    rows, buckets = pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1)
    kept = [times >= least for least in LEVELS]
    features = [buckets[k] | level << BUCKET_BITS for level, k in enumerate(kept)]
    return np.concatenate([rows[k] for k in kept]), np.concatenate(features)


def of_buckets(features: np.ndarray) -> np.ndarray:
    """The buckets that a mask over features needs."""
    return features.reshape(len(LEVELS), -1).any(axis=0)


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    offsets = utf8(column)[1]
    for low, high in slices(offsets, 1 << 20):
        yield low, [text or "" for text in column.slice(low, high - low).to_pylist()]


_COUNTS = ("clean", "toxic", "clean_aside", "toxic_aside")


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label, aside or not, that have a feature, summed over a batch."""
    every = np.ones(1 << BUCKET_BITS, dtype=bool)
    for batch in batches:
        kind = np.array(batch.column("toxic").to_pylist()) + 2 * np.array(batch.column("aside").to_pylist())
        counts = np.zeros((len(_COUNTS), FEATURES), dtype=np.int32)
        for low, texts in _parts(batch.column("text")):
            rows, features = present(texts, every)
            for each in np.unique(kind[low : low + len(texts)]).tolist():
                counts[each] += np.bincount(features[kind[low + rows] == each], minlength=FEATURES).astype(np.int32)
        seen = np.flatnonzero(counts.any(axis=0))
        columns = [pa.array(counts[each, seen].astype(np.int64)) for each in range(len(_COUNTS))]
        yield pa.RecordBatch.from_arrays([pa.array(seen), *columns], ["feature", *_COUNTS])


@dataclass
class Model:
    intercept: float
    weights: np.ndarray

    def __post_init__(self):
        self.wanted = of_buckets(self.weights != 0)

    def score(self, texts: list[str]) -> np.ndarray:
        rows, features = present(texts, self.wanted)
        sums = np.bincount(rows, weights=self.weights[features], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(sums + self.intercept, -500, 500)))


def _feature_rows(wanted: np.ndarray, batches: Iterator[pa.RecordBatch]):
    buckets = of_buckets(wanted)
    for batch in batches:
        for low, texts in _parts(batch.column("text")):
            rows, features = present(texts, buckets)
            kept = np.flatnonzero(wanted[features])
            kept = kept[np.argsort(rows[kept], kind="stable")]
            rows, features = rows[kept], features[kept].astype(np.int32)
            offsets = np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(features))
            part = batch.slice(low, len(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column("toxic"), part.column("aside"), lists], ["toxic", "aside", "features"]
            )


def _regression(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, penalty: float
) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by conjugate gradients inside Newton steps."""
    n, d = len(labels), int(columns.max(initial=-1)) + 1

    def times(w):
        return np.bincount(rows, weights=values * w[columns], minlength=n) + w[d]

    def transposed(r):
        sums = np.bincount(columns, weights=values * r[rows], minlength=d)
        return np.append(sums, r.sum())

    ridge = np.append(np.full(d, penalty), 1e-6)
    w = np.zeros(d + 1)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        gradient = transposed(p - labels) + ridge * w
        curve = np.maximum(p * (1 - p), 1e-5)
        step, residual = np.zeros(d + 1), -gradient
        direction, size = residual.copy(), residual @ residual
        first = size
        for _ in range(25):
            if size <= 1e-8 * first or size == 0:
                break
            product = transposed(curve * times(direction)) + ridge * direction
            alpha = size / (direction @ product)
            step += alpha * direction
            residual -= alpha * product
            size, before = residual @ residual, size
            direction = residual + size / before * direction
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w[:d], float(w[d])


def _entropy(counts: np.ndarray) -> np.ndarray:
    return counts * np.log(np.maximum(counts, 1e-12))


def ratios_and_best(table: np.ndarray, documents: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratios from counts of clean and toxic documents, and the best features,
    the best one first: by the likelihood ratio of feature and label being bound."""
    share = (table + 1) / (table + 1).sum(axis=1, keepdims=True)
    ratios = np.log(share[1] / share[0])
    both, every = table.sum(axis=0), documents.sum()
    worth = _entropy(table).sum(axis=0) + _entropy(documents[:, None] - table).sum(axis=0)
    worth -= _entropy(both) + _entropy(every - both)
    worth += _entropy(every) - _entropy(documents).sum()
    worth[both < 2] = 0
    best = np.argsort(-worth, kind="stable")[:most]
    return ratios, best[worth[best] > 1e-6]


@dataclass
class Sample:
    """Features of the sampled documents: one entry for each row and feature."""

    truth: np.ndarray
    rows: np.ndarray
    features: np.ndarray

    def of(self, chosen: np.ndarray) -> Sample:
        """Only some of the documents."""
        kept = chosen[self.rows]
        numbers = np.cumsum(chosen) - 1
        return Sample(self.truth[chosen], numbers[self.rows[kept]], self.features[kept])

    def learn(self, ratios: np.ndarray, best: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
        """Weights by feature, and the intercept."""
        best = np.sort(best)
        kept = np.isin(self.features, best, assume_unique=False)
        columns = np.searchsorted(best, self.features[kept])
        learned, intercept = _regression(
            self.rows[kept], columns, ratios[self.features[kept]], self.truth, penalty
        )
        weights = np.zeros(FEATURES, dtype=np.float32)
        weights[best[: len(learned)]] = ratios[best[: len(learned)]] * learned
        return weights, intercept

    def loss(self, weights: np.ndarray, intercept: float) -> float:
        sums = np.bincount(self.rows, weights=weights[self.features], minlength=len(self.truth)) + intercept
        return float(np.logaddexp(0, np.where(self.truth > 0, -sums, sums)).mean())


def fit(
    documents: DataFrame,
    labels: DataFrame,
    max_documents: int = 12_000,
    sizes: tuple[int, ...] = SIZES,
    penalties: tuple[float, ...] = PENALTIES,
) -> Model:
    """Model from the documents that ``labels`` (doc_id, toxic) covers."""
    no_weights = np.zeros(FEATURES, dtype=np.float32)
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")
    )
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = counts.get(0, 0), counts.get(1, 0)
    if not clean or not toxic:
        share = toxic / max(1, clean + toxic)
        return Model(float(np.log(share or 1e-9) - np.log(1 - share or 1e-9)), no_weights)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    limit = F.when(F.col("toxic") == 1, max_documents / 2 / toxic).otherwise(
        max_documents / 2 / clean
    )
    aside = (F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(FOLDS)) == 0).cast("int").alias("aside")
    chosen = stage(marks.where(part < limit).select("doc_id", "toxic", aside), "sampled_ids")
    # About max_documents ids by their hashes; were it far more, texts would be shuffled.
    if chosen.count() <= 2 * max_documents:
        chosen = F.broadcast(chosen)
    sample = documents.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic", "aside")
    schema = "feature bigint, " + ", ".join(f"{name} bigint" for name in _COUNTS)
    sums = sample.mapInArrow(_document_counts, schema).groupBy("feature")
    sums = sums.agg(*(F.sum(name).alias(name) for name in _COUNTS)).where(f"{' + '.join(_COUNTS)} >= 2")
    table = np.zeros((len(_COUNTS), FEATURES))
    for batch in sums.toArrow().to_batches():
        at = batch.column("feature").to_numpy()
        for row, name in enumerate(_COUNTS):
            table[row, at] = batch.column(name).to_numpy()
    held = {
        (row["toxic"], row["aside"]): row["n"]
        for row in sample.groupBy("toxic", "aside").agg(F.count("*").alias("n")).collect()
    }
    sizes_of = np.array([[held.get((label, fold), 0.0) for label in (0, 1)] for fold in (0, 1)])
    ratios, best = ratios_and_best(table[:2] + table[2:], sizes_of.sum(axis=0), max(sizes))
    inner_ratios, inner_best = ratios_and_best(table[:2], sizes_of[0], max(sizes))
    wanted = np.zeros(FEATURES, dtype=bool)
    wanted[best] = wanted[inner_best] = True
    held = sample.mapInArrow(
        lambda batches: _feature_rows(wanted, batches), "toxic int, aside int, features array<int>"
    ).toArrow()
    truth, set_aside = (held.column(name).to_numpy() > 0 for name in ("toxic", "aside"))
    if truth.all() or not truth.any():
        share = toxic / (clean + toxic)
        return Model(float(np.log(share / (1 - share))), no_weights)
    lists = held.column("features").combine_chunks()
    held_by = np.diff(lists.offsets.to_numpy())
    every = Sample(truth.astype(float), np.repeat(np.arange(len(truth)), held_by), lists.flatten().to_numpy())
    choice, inner = (sizes[0], penalties[0]), every.of(~set_aside)
    if set_aside.any() and inner.truth.any() and not inner.truth.all():
        asked = every.of(set_aside)
        choice = min(
            product(sizes, penalties),
            key=lambda c: asked.loss(*inner.learn(inner_ratios, inner_best[: c[0]], c[1])),
        )
    weights, intercept = every.learn(ratios, best[: choice[0]], choice[1])
    # The sample is balanced; the corpus is not.
    sampled = np.log(truth.sum() / (len(truth) - truth.sum()))
    return Model(intercept + np.log(toxic / clean) - sampled, weights)


def score(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``documents`` with the probability that a document is toxic."""
    documents, shared = documents.drop(name), share(documents.sparkSession, model)
    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        model = shared()
        for batch in batches:
            parts = [model.score(texts) for _, texts in _parts(batch.column("text"))]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name]
            )

    return documents.mapInArrow(run, schema)
