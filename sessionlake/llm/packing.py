"""Best-fit packing of documents into sequences after Martello-Toth reduction.

A document is its token ids and an end id; one longer than the capacity is cut into
pieces of the capacity, the first of which may be shorter. Sequences are bins for
pieces. What matters of a piece is its length, so the instance is the number of pieces of
each length: at most ``capacity`` numbers, however many documents there are.

Reduction: for the longest length left, a set of at most three pieces that dominates all
other ways to fill its bin is fixed for good. It is the piece alone if nothing fits with it;
with the longest partner that fits, if that fills the bin, or if no two others fit beside
it, or if no two that do are longer together than that partner; with two partners if
these are the longest that fit in turn and no other two beat them piece by piece. All
bins alike are fixed at once while they last. This repeats over all lengths until none can
be fixed. The rest goes best-fit in falling order of length, again all equal bins at once.

Spark counts lengths and numbers the pieces of each length: by task and place in the
task, with the tasks' counts summed up before. A piece's number says which bin it gets.

Defined cases: a null text is empty and is one piece of one end id; equal rows are packed
each; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sessionlake.llm.shared import share
from sessionlake.llm.tokens import END, MOST_CHARS, Encoder, vocabulary_path
from sessionlake.llm.words import slices, utf8
from sessionlake.session import stage

CAPACITY = 2048


def cuts(size: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces."""
    first = (size - 1) % capacity + 1
    starts = [0, *range(first, size, capacity)]
    return list(zip(starts, np.diff([*starts, size]).tolist()))


def pieces(documents: DataFrame, path: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, place): place is the number of
    pieces of the same length that the same task made before."""
    schema = (
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
        "task bigint, place bigint"
    )

    state = documents.sparkSession.sparkContext.broadcast({})  # filled by each worker

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder(path, state.value), np.zeros(capacity + 1, dtype=np.int64)
        end = END.to_bytes(4, "little")
        for batch in batches:
            for low, high in slices(utf8(batch.column("text"))[1], MOST_CHARS):
                part = batch.slice(low, high - low)
                columns = part.column("doc_id").to_pylist(), part.column("task").to_pylist()
                ids = encoder.encode(part.column("text").to_pylist())
                rows = []
                for doc_id, task, found in zip(*columns, ids):
                    found += end
                    for n, (start, length) in enumerate(cuts(len(found) // 4, capacity)):
                        crc = zlib.crc32(found[4 * start : 4 * (start + length)])
                        rows.append((doc_id, n, start, length, crc, task, seen[length]))
                        seen[length] += 1
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "place")
                kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = documents.select("doc_id", "text", F.spark_partition_id().cast("bigint").alias("task"))
    return rows.mapInArrow(run, schema)


# --- the instance by length --------------------------------------------------


class Bins:
    """Groups of equal bins: how many, what each holds (length, times), and what is free."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.groups: list[tuple[int, list[tuple[int, int]]]] = []
        self.open: dict[int, list[int]] = {}

    def add(self, count: int, content: list[tuple[int, int]]) -> None:
        free = self.capacity - sum(length * times for length, times in content)
        self.groups.append((count, content))
        if free:
            self.open.setdefault(free, []).append(len(self.groups) - 1)


def _at_most(counts: np.ndarray, most: int) -> int:
    """The longest length of at most ``most`` that has pieces; 0 if none."""
    found = np.flatnonzero(counts[: max(most, 0) + 1])
    return int(found[-1]) if len(found) else 0


def dominating(counts: np.ndarray, length: int, capacity: int) -> list[int] | None:
    """Partners for a piece of ``length`` (taken from ``counts``) that dominate all others."""
    space = capacity - length
    best = _at_most(counts, space)
    if not best:
        return []
    if best == space:
        return [best]
    present = np.flatnonzero(counts)
    smallest = np.repeat(present[:3], np.minimum(counts[present[:3]], 3))[:3].tolist()
    if len(smallest) < 2 or sum(smallest[:2]) > space:
        return [best]
    if len(smallest) == 3 and sum(smallest) <= space:
        return None  # three others could fit: no small set need dominate
    pairs = [(a, _at_most(_without(counts, a), min(a, space - a))) for a in present[present <= space]]
    pairs = [(int(a), b) for a, b in pairs if b]
    if all(a + b <= best for a, b in pairs):
        return [best]
    partner = _at_most(_without(counts, best), space - best)
    # Two partners dominate a pair if each stands for a piece, or the longest for both.
    if partner and all(b <= partner or a + b <= best for a, b in pairs):
        return [best, partner]
    return None


def _without(counts: np.ndarray, length: int) -> np.ndarray:
    if counts[length] > 1:
        return counts
    counts = counts.copy()
    counts[length] = 0
    return counts


def reduce(counts: np.ndarray, capacity: int, bins: Bins) -> int:
    """Fix dominating sets and take their pieces from ``counts``; how many bins that made."""
    fixed, changed = 0, True
    while changed:
        changed = False
        for length in np.flatnonzero(counts)[::-1].tolist():
            while counts[length]:
                counts[length] -= 1
                partners = dominating(counts, length, capacity)
                counts[length] += 1
                if partners is None:
                    break
                content: dict[int, int] = {}
                for each in (length, *partners):
                    content[each] = content.get(each, 0) + 1
                times = min(int(counts[k]) // n for k, n in content.items())
                for k, n in content.items():
                    counts[k] -= times * n
                bins.groups.append((times, list(content.items())))
                fixed, changed = fixed + times, True
    return fixed


def best_fit(counts: np.ndarray, capacity: int, bins: Bins) -> None:
    """All pieces left, longest first, each into the fullest bin that takes it."""
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        for free in sorted(f for f in bins.open if f >= length):
            each = free // length
            for group in bins.open.pop(free):
                count, content = bins.groups[group]
                full, rest = divmod(min(left, each * count), each)
                left -= full * each + rest
                # Of the bins alike some get all they can, one the rest, others nothing.
                parts = [(full, each), (1 if rest else 0, rest)]
                parts.append((count - full - (1 if rest else 0), 0))
                bins.groups[group] = (0, [])
                for number, times in parts:
                    if number:
                        bins.add(number, [*content, (length, times)] if times else content)
            if not left:
                break
        each = capacity // length
        full, rest = divmod(left, each)
        for number, times in ((full, each), (1 if rest else 0, rest)):
            if number:
                bins.add(number, [(length, times)])
        counts[length] = 0


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's second bound: no packing has fewer bins."""
    sizes, n = np.arange(capacity + 1), counts.astype(np.int64)
    weight, number = np.cumsum(n * sizes), np.cumsum(n)
    best = int(-(-weight[-1] // capacity))
    half = capacity // 2
    for k in range(half + 1):
        large = int(number[-1] - number[capacity - k])
        middle = int(number[capacity - k] - number[half])
        of_middle = int(weight[capacity - k] - weight[half])
        small = int(weight[half] - (weight[k - 1] if k else 0))
        over = small - (middle * capacity - of_middle)
        best = max(best, large + middle + max(0, -(-over // capacity)))
    return best


def pack(counts: np.ndarray, capacity: int) -> Bins:
    """Bins for so many pieces of each length."""
    counts, bins = counts.copy(), Bins(capacity)
    reduce(counts, capacity, bins)
    best_fit(counts, capacity, bins)
    bins.groups = [group for group in bins.groups if group[0]]
    return bins


class Places:
    """Where the n-th piece of a length goes: bin and offset in it."""

    def __init__(self, bins: Bins):
        table: dict[int, list[tuple[int, int, int, int]]] = {}
        first = 0
        for count, content in bins.groups:
            offset = 0
            for length, times in content:
                table.setdefault(length, []).append((count * times, times, first, offset))
                offset += length * times
            first += count
        self.sequences = first
        self.slots = {
            length: (
                np.array([0, *accumulate(slot[0] for slot in slots)], dtype=np.int64),
                np.array([slot[1:] for slot in slots], dtype=np.int64),
            )
            for length, slots in table.items()
        }

    def find(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequences, offsets = np.empty_like(lengths), np.empty_like(lengths)
        order = np.argsort(lengths, kind="stable")
        kinds, heads = np.unique(lengths[order], return_index=True)
        for length, rows in zip(kinds.tolist(), np.split(order, heads[1:])):
            begins, slots = self.slots[length]
            slot = np.searchsorted(begins, numbers[rows], side="right") - 1
            times, first, offset = slots[slot].T
            at = numbers[rows] - begins[slot]
            sequences[rows] = first + at // times
            offsets[rows] = offset + at % times * length
        return sequences, offsets


# --- over documents ----------------------------------------------------------


def pack_documents(
    documents: DataFrame, capacity: int = CAPACITY, path: str | None = None
) -> DataFrame:
    """The pieces of all documents with their sequence and their offset in it."""
    path = path or vocabulary_path()
    made = stage(pieces(documents, path, capacity), "pieces")
    per_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    per_task = stage(per_task, "lengths")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]  # one row for each length
    places = share(documents.sparkSession, Places(pack(counts, capacity)))
    earlier = F.sum("n").over(
        Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = per_task.select("task", "length", F.coalesce(earlier, F.lit(0)).alias("before"))
    numbered = made.join(before, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("before") + F.col("place")).alias("number"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places()
        for batch in batches:
            found = table.find(
                *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            )
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in names), *map(pa.array, found)],
                [*names, "sequence_id", "offset"],
            )

    schema = (
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
        "sequence_id bigint, offset bigint"
    )
    return numbered.mapInArrow(run, schema)
