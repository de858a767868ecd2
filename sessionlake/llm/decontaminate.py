"""Benchmark decontamination with an FM-index per training shard.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z. A window
is 13 consecutive words of a benchmark item, or a whole shorter item. A task collects its
documents into shards of bounded size. The text of a shard is its words as numbers of
the benchmark's vocabulary: a word that no item uses ends a run, since no window
crosses it, and a run shorter than the shortest window holds none and is left out. Each
distinct run is indexed once, however often a hot passage repeats it. Windows are found
by backward search over wavelet-tree ranks, occurrences by sampled suffix positions, and
overlapping ones merge into removal spans.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item
has no window; repeated rows and ids are judged row by row; an empty benchmark hits
nothing; other columns pass through untouched. A null ``item_id`` reads ``null``.
Tasks are independent and deterministic, so a lost executor's shards are just redone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sessionlake.llm.fm_index import FMIndex
from sessionlake.llm.shared import share
from sessionlake.llm.words import byte_class, find_words, slices, utf8

WINDOW = 13
SHARD_WORDS = 1 << 21
BLOCK_BYTES = 8 << 20

SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())]
    )
)
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", SPANS),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)
_SPANS_ARROW = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))
_FOUND_ARROW = pa.struct(
    [("n_words", pa.int64()), ("spans", _SPANS_ARROW), ("item_ids", pa.list_(pa.string()))]
)


class Windows:
    """The windows of a block of benchmark items, as numbers of its own vocabulary."""

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        data, offsets = utf8(pa.array([text for _, text in items], pa.string()))
        words = find_words(data, offsets, byte_class())
        self.vocabulary, numbers = np.unique(words.hashes, return_inverse=True)
        names = np.array(["null" if k is None else str(k) for k, _ in items], dtype=object)
        by_length: dict[int, dict[bytes, set[str]]] = {}
        bounds = np.searchsorted(words.rows, np.arange(len(items) + 1))
        for name, low, high in zip(names, bounds[:-1], bounds[1:]):
            length = min(width, high - low)
            for at in range(low, high - length + 1) if length else ():
                window = (numbers[at : at + length] + 2).tobytes()
                by_length.setdefault(int(length), {}).setdefault(window, set()).add(name)
        self.shortest = min(by_length, default=0)
        self.by_length = {
            length: (
                np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, length),
                [sorted(names) for names in found.values()],
            )
            for length, found in by_length.items()
        }

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers from 2; 0 for a word that no window holds."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 0)


class Shard:
    """Documents of a task, kept until their words make an index of full size."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.batches: list[pa.RecordBatch] = []
        self.n_words: list[np.ndarray] = []
        self.runs: dict[bytes, list[tuple[int, int]]] = {}
        self.rows = self.size = 0

    def add(self, batch: pa.RecordBatch, n_words: np.ndarray) -> None:
        self.batches.append(batch)
        self.n_words.append(n_words)
        self.rows += len(n_words)

    def note_runs(self, row: int, numbers: np.ndarray, rows: np.ndarray, places: np.ndarray):
        """Keep the runs of benchmark words that could hold a window."""
        known = np.flatnonzero(numbers)
        if not len(known) or not self.windows.shortest:
            return
        new = np.ones(len(known), dtype=bool)
        new[1:] = (np.diff(known) != 1) | (np.diff(rows[known]) != 0)
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(known)))
        for head, size in zip(*(x[sizes >= self.windows.shortest] for x in (heads, sizes))):
            at = known[head]
            content = numbers[at : at + size].tobytes()
            self.runs.setdefault(content, []).append((row + int(rows[at]), int(places[at])))
            self.size += int(size)

    def judge(self) -> Iterator[tuple[pa.RecordBatch, pa.StructArray]]:
        """The shard's documents, each with its number of words, spans and items."""
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        if self.runs:
            for content, at, length, names in self._occurrences():
                for row, place in self.runs[content]:
                    spans.setdefault(row, []).append((place + at, place + at + length))
                    items.setdefault(row, set()).update(names)
        row = 0
        for batch, counts in zip(self.batches, self.n_words):
            found = [
                {
                    "n_words": int(count),
                    "spans": [
                        {"first_word": a, "end_word": b} for a, b in merged(spans.get(row + i, []))
                    ],
                    "item_ids": sorted(items.get(row + i, ())),
                }
                for i, count in enumerate(counts)
            ]
            yield batch, pa.array(found, _FOUND_ARROW)
            row += len(counts)

    def _occurrences(self) -> Iterator[tuple[bytes, int, int, list[str]]]:
        contents = list(self.runs)
        runs = [np.frombuffer(content, dtype=np.int64) for content in contents]
        text = np.concatenate([part for run in runs for part in (run, [1])])
        begins = np.cumsum([0] + [len(run) + 1 for run in runs])
        index = FMIndex(text, len(self.windows.vocabulary) + 2)
        for length, (phrases, names) in self.windows.by_length.items():
            phrase, positions = index.occurrences(phrases)
            run = np.searchsorted(begins, positions, side="right") - 1
            for p, r, at in zip(phrase.tolist(), run.tolist(), (positions - begins[run]).tolist()):
                yield contents[r], at, length, names[p]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    joined: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if joined and first <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((first, end))
    return joined


def _shards(windows: Windows, shard_words: int, batches: Iterator[pa.RecordBatch]):
    shard, table = Shard(windows), byte_class()
    waiting = 0
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for low, high in slices(offsets):
            part = offsets[low : high + 1] - offsets[low]
            words = find_words(data[offsets[low] : offsets[high]], part, table)
            counts = np.bincount(words.rows, minlength=high - low)
            firsts = np.cumsum(counts) - counts
            places = np.arange(len(words.rows)) - firsts[words.rows]
            if len(windows.vocabulary):
                shard.note_runs(shard.rows, windows.numbers(words.hashes), words.rows, places)
            shard.add(batch.slice(low, high - low), counts)
            waiting += int(part[-1])
            if shard.size >= shard_words or waiting >= 8 * shard_words:
                yield from shard.judge()
                shard, waiting = Shard(windows), 0
    yield from shard.judge()


def _with_column(name: str, search: Callable, batches: Iterator[pa.RecordBatch]):
    for batch, found in search(batches):
        yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, str | None]]]:
    """Items in blocks of about ``block_bytes``, so that none outgrows a task."""
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for block in range(blocks):
        yield [tuple(row) for row in items.where(key == block).toLocalIterator()]


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_bytes: int = BLOCK_BYTES,
    name: str = "contamination",
) -> DataFrame:
    """``documents`` with a struct ``name``: n_words, merged spans of words, item_ids. It
    replaces a column of that name.

    The benchmark meets all documents in blocks: one pass for each ``block_bytes`` of it.
    """
    spark, found = documents.sparkSession, documents.drop(name)
    kept, columns = found.columns, []
    for number, items in enumerate(_blocks(benchmark, block_bytes)):
        windows = share(spark, Windows(items, window))
        column = f"__found_{number}"
        schema = T.StructType([*found.schema.fields, T.StructField(column, FOUND)])

        def run(batches, windows=windows, column=column):
            search = partial(_shards, windows(), shard_words)
            return _with_column(column, search, batches)

        found = found.mapInArrow(run, schema)
        columns.append(F.col(column))
    if len(columns) == 1:
        return found.withColumnRenamed("__found_0", name)
    joined = F.struct(
        columns[0]["n_words"].alias("n_words"),
        merge_spans(F.flatten(F.array(*(c["spans"] for c in columns)))).alias("spans"),
        F.array_sort(
            F.array_distinct(F.flatten(F.array(*(c["item_ids"] for c in columns))))
        ).alias("item_ids"),
    )
    return found.select(*kept, joined.alias(name))


@F.udf(SPANS, useArrow=True)
def merge_spans(spans):
    return merged([tuple(span) for span in spans])


def n_hit(name: str = "contamination"):
    spans = F.col(f"{name}.spans")
    return F.aggregate(
        spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end_word"] - s["first_word"]
    )


def is_contaminated(name: str = "contamination"):
    """At least one word in twenty lies inside occurrences of windows."""
    return (n_hit(name) > 0) & (20 * n_hit(name) >= F.col(f"{name}.n_words"))


def digests(found: DataFrame, name: str = "contamination") -> DataFrame:
    ids = F.col(f"{name}.item_ids")
    return found.select(
        "doc_id",
        F.col(f"{name}.n_words").alias("n_words"),
        n_hit(name).alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"),
        is_contaminated(name).alias("contaminated"),
        F.col(f"{name}.spans").alias("spans"),
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated, as they came."""
    found = find_contamination(documents, benchmark, name="__contamination")
    return found.where(~is_contaminated("__contamination")).drop("__contamination")
