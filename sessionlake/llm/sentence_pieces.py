"""SentencePiece ids of texts by a table of distinct chunks, and texts of ids.

Where no piece of a model has a whitespace marker after another character, a text's chunks
(markers and the characters up to the next marker) have the ids that they have alone. A
slice of texts is cut into chunks, the distinct ones that the task's table does not hold
are segmented by the library once each, and ids are joined back by the chunks' positions.
The table is emptied when it is full; that changes no result. Models whose pieces cross
markers, or that normalise texts, get whole texts.

Defined cases: a null text is empty and has the end id only; equal rows are encoded each;
an empty table gives no rows; ids alone come with ``doc_id``, other columns are not used.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from sentencepiece import SentencePieceProcessor

from sessionlake.llm.words import slices, utf8

MODEL = "piece_bpe_32k.model"
MARKER = "▁"
_CHUNK = re.compile(f"{MARKER}+[^{MARKER}]*")
#: Texts that a model must leave as they are for chunks to be encoded alone.
_PROBES = ("", " ", "  a  b ", "ﬁ é 　x y", "A\tb\r\n c", "中文 \U0001f600 z")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks_stand_alone(model: SentencePieceProcessor) -> bool:
    """Whether a text's ids are those of its chunks."""
    known = model.piece_to_id(MARKER)
    if model.is_unknown(known) or any(
        MARKER in piece.lstrip(MARKER) for piece in map(model.id_to_piece, range(model.get_piece_size()))
    ):
        return False
    kept = (model.normalize(probe) == (MARKER + probe).replace(" ", MARKER) for probe in _PROBES if probe)
    return model.encode("") == [] and all(kept)


class ChunkTable:
    """Ids of chunks, segmented once while the table holds them."""

    def __init__(self, model: SentencePieceProcessor, held_chunks: int):
        self.model, self.held_chunks = model, held_chunks
        self.alone = chunks_stand_alone(model)
        self.held: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("i", ids).tobytes() for ids in self.model.encode(texts, num_threads=1)]

    def _segment(self, chunks: list[str]) -> None:
        # The library puts the first marker before a text itself, but not before no text.
        self.held.update(zip(chunks, self._library([chunk[1:] for chunk in chunks])))
        if MARKER in self.held:
            self.held[MARKER] = array("i", [self.model.piece_to_id(MARKER)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """32-bit ids of each text, without an end id."""
        if not self.alone:
            return self._library(texts)
        if len(self.held) > self.held_chunks:
            self.held.clear()
        cut = [_CHUNK.findall(MARKER + text.replace(" ", MARKER)) if text else [] for text in texts]
        self._segment(list(set(chain.from_iterable(cut)).difference(self.held)))
        look_up = self.held.__getitem__
        return [b"".join(map(look_up, chunks)) for chunks in cut]


def encode(documents: DataFrame, path: str | None = None, held_chunks: int = 700_000) -> DataFrame:
    """(doc_id, ids) of every document; ids end with the end id.

    ``held_chunks`` bounds a task's table before a slice of texts is added to it."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SentencePieceProcessor(model_file=path)
        table, end = ChunkTable(model, held_chunks), array("i", [model.eos_id()]).tobytes()
        for batch in batches:
            for low, high in slices(utf8(batch.column("text"))[1]):
                part = batch.slice(low, high - low)
                found = table.encode([text or "" for text in part.column("text").to_pylist()])
                flat = np.frombuffer(b"".join(ids + end for ids in found), dtype=np.int32)
                offsets = np.cumsum([0, *(len(ids) // 4 + 1 for ids in found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), ids], ["doc_id", "ids"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text) of ids, by the library's own decoding."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SentencePieceProcessor(model_file=path)
        for batch in batches:
            offsets = batch.column("ids").offsets.to_numpy().astype(np.int64)
            values = batch.column("ids").values.to_numpy()
            for low, high in slices(4 * offsets):
                part, flat = batch.slice(low, high - low), values[offsets[low] : offsets[high]].tolist()
                places = (offsets[low : high + 1] - offsets[low]).tolist()
                texts = model.decode([flat[a:b] for a, b in zip(places, places[1:])], num_threads=1)
                columns = [part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """The number of ids, and digests of ids and texts."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
