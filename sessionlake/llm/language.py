"""Language identification: words first, character n-grams for words never seen.

The model holds, per language, the log frequency of its words and of the character
n-grams of its words (with their edges marked). A known word scores by its frequency in
each language. An unseen word scores by its longest known n-grams: five characters, then
four, down to one. A document scores the mean of its words, and the answer is the best
language; its score is that language's share of the likelihood per word.

The model is fitted on a bounded sample of labelled documents: about ``max_documents``
in all, an even share for each language, chosen by a hash of the id. It keeps at most
``max_entries`` words and n-grams, the most frequent of each language.

Defined cases: a text that is null or has no letters is ``und`` with score 0; with no
model at all every document is ``und``; a word unknown in all its parts scores nothing;
ties go to the language first in the alphabet; each row is judged by itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sessionlake.llm.shared import share
from sessionlake.llm.words import byte_class, find_words, slices, utf8

UNKNOWN = "und"
ORDERS = (5, 4, 3, 2, 1)
PENALTY = 2.0  # nats below the rarest entry of any language, for what one never showed


def grams(word: str, order: int) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def _distinct(column: pa.Array):
    """Distinct lower-case words of slices of a column, and where they stand."""
    data, offsets = utf8(column)
    table = byte_class(digits=False)
    for low, high in slices(offsets, 1 << 22):
        starts, ends, rows, hashes = [], [], [], []
        # Words are found in smaller steps, whose temporary arrays are large.
        for a, b in slices(offsets[low : high + 1], 1 << 20):
            begin = offsets[low + a]
            part = data[begin : offsets[low + b]]
            found = find_words(part, offsets[low + a : low + b + 1] - begin, table)
            starts.append(found.starts + begin)
            ends.append(found.ends + begin)
            rows.append(found.rows + a)
            hashes.append(found.hashes)
        _, first, place = np.unique(
            np.concatenate(hashes), return_index=True, return_inverse=True
        )
        spans = zip(np.concatenate(starts)[first].tolist(), np.concatenate(ends)[first].tolist())
        names = [data[a:b].tobytes().decode("utf-8").lower() for a, b in spans]
        yield low, high, names, place, np.concatenate(rows)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (order 0) and n-grams by language, summed over each batch."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        sums: Counter = Counter()
        for low, _, names, place, rows in _distinct(batch.column("text")):
            of_row, numbers = np.unique(langs[low + rows].astype(str), return_inverse=True)
            pairs, times = np.unique(place * len(of_row) + numbers, return_counts=True)
            for pair, n in zip(pairs.tolist(), times.tolist()):
                word, lang = names[pair // len(of_row)], of_row[pair % len(of_row)]
                sums[lang, 0, word] += n
                for order in ORDERS:
                    for gram in grams(word, order):
                        sums[lang, order, gram] += n
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([str(k[0]) for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.int32()),
                pa.array([k[2] for k in keys], pa.string()),
                pa.array([sums[k] for k in keys], pa.int64()),
            ],
            names=["lang", "n", "entry", "times"],
        )


class Model:
    def __init__(self, rows: list[tuple[str, int, str, int]]):
        self.langs = sorted({row[0] for row in rows})
        number = {lang: i for i, lang in enumerate(self.langs)}
        totals = np.ones((len(ORDERS) + 1, max(1, len(self.langs))))
        for lang, order, _, times in rows:
            totals[order, number[lang]] += times
        self.entries: list[dict[str, int]] = [{} for _ in totals]
        orders: list[int] = []
        for _, order, entry, _ in rows:
            if entry not in self.entries[order]:
                self.entries[order][entry] = len(orders)
                orders.append(order)
        # One floor for all, or a language seen little would pass for any unknown word.
        floors = np.repeat(-np.log(totals.max(axis=1, keepdims=True)) - PENALTY, totals.shape[1], 1)
        self.scores = floors[np.array(orders, dtype=np.int64)].astype(np.float32)
        for lang, order, entry, times in rows:
            score = np.log(times / totals[order, number[lang]])
            self.scores[self.entries[order][entry], number[lang]] = score

    def parts(self, word: str) -> list[int]:
        """Entries that speak for a word: itself, or its longest known n-grams."""
        known = self.entries[0].get(word)
        if known is not None:
            return [known]
        for order in ORDERS:
            entries = self.entries[order]
            found = [entries[g] for g in grams(word, order) if g in entries]
            if found:
                return found
        return []

    def words(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words by language, and which words have any."""
        found = [self.parts(n) if any(map(str.isalpha, n)) else [] for n in names]
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        known, scores = sizes > 0, np.zeros((len(names), len(self.langs)))
        if known.any():
            flat = np.array([e for f in found for e in f], dtype=np.int64)
            heads = (np.cumsum(sizes) - sizes)[known]
            sums = np.add.reduceat(self.scores[flat].astype(float), heads, axis=0)
            scores[known] = sums / sizes[known, None]
        return scores, known

    def judge(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        answers, shares = [UNKNOWN] * len(column), np.zeros(len(column))
        if not self.langs:
            return answers, shares
        for low, high, names, place, rows in _distinct(column):
            scores, counted = self.words(names)
            n = np.bincount(rows, weights=counted[place], minlength=high - low)
            mean = np.stack(
                [
                    np.bincount(rows, weights=scores[place, k], minlength=high - low)
                    for k in range(len(self.langs))
                ],
                axis=1,
            ) / np.maximum(n, 1)[:, None]
            best = mean.argmax(axis=1)
            share = 1 / np.exp(mean - mean.max(axis=1, keepdims=True)).sum(axis=1)
            for row in np.flatnonzero(n):
                answers[low + row], shares[low + row] = self.langs[best[row]], share[row]
            # Letters, but in no word that the model knows anything about.
            for row in np.flatnonzero(n == 0):
                text = column[low + int(row)].as_py()
                if text and any(map(str.isalpha, text)):
                    answers[low + row], shares[low + row] = self.langs[0], 1 / len(self.langs)
        return answers, shares


def fit(labelled: DataFrame, max_documents: int = 8_000, max_entries: int = 300_000) -> Model:
    """Model from documents with a text and a lang; see above for the two bounds."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([])
    share = max_documents / len(sizes)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    limits = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, share / n)))
    sample = rows.where(part < limits[F.col("lang")])
    counts = sample.mapInArrow(_counts, "lang string, n int, entry string, times bigint")
    per_group = max(1, max_entries // (len(sizes) * (len(ORDERS) + 1)))
    sums = counts.groupBy("lang", "n", "entry").agg(F.sum("times").alias("times"))
    place = F.row_number().over(
        Window.partitionBy("lang", "n").orderBy(F.desc("times"), F.asc("entry"))
    )
    kept = sums.withColumn("place", place).where(F.col("place") <= per_group).drop("place")
    return Model([tuple(row) for row in kept.collect()])


def predict(documents: DataFrame, model: Model, lang: str, score: str) -> DataFrame:
    """``documents`` with the predicted language and its score as two more columns, which
    replace columns of their names."""
    shared = share(documents.sparkSession, model)
    # A result named ``text`` replaces the text, which then travels under another name.
    source = "__text" if "text" in (lang, score) else "text"
    texts = documents.withColumn(source, F.col("text")).drop(lang, score)
    kept = [field for field in texts.schema.fields if field.name != "__text"]
    names = [field.name for field in kept]
    schema = T.StructType(
        [
            *kept,
            T.StructField(lang, T.StringType()),
            T.StructField(score, T.DoubleType()),
        ]
    )

    def run(batches):
        model = shared()
        for batch in batches:
            answers, shares = model.judge(batch.column(source))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in names), pa.array(answers, pa.string()), pa.array(shares, pa.float64())],
                [*names, lang, score],
            )

    return texts.mapInArrow(run, schema)


def is_held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a document is kept from learning; one without an id is not held out."""
    number = F.crc32(doc_id.cast("string").cast("binary")) % modulus
    return F.coalesce(number == remainder, F.lit(False))
