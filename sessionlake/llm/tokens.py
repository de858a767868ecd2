"""Token ids of texts by the tokenizers library's vocabularies, whole texts at a time.

A byte-level BPE vocabulary splits a text by its pattern and merges inside the parts only,
so a part has the same ids wherever it stands. Texts are split here, many at a time by numpy,
and each distinct part of them is encoded once.

Where such a vocabulary's merges are numbered in their order, it is also a table of ranks,
which tiktoken encodes several times faster and to the same ids; the table is made from the
vocabulary's own file. What tiktoken or the split could do otherwise goes to the tokenizers
library: texts with characters that are not in the scripts below, since pattern libraries
know different Unicode versions, parts with long runs of white space, which overflow
tiktoken's pattern, and all texts of other vocabularies. Strings of special tokens are
ordinary text. Broadcast as a plain dict, what is loaded serves all tasks of a worker.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from tokenizers import Tokenizer

END = 0
VOCABULARY = "byte_bpe_50k.json"

# Latin, Greek and Cyrillic, punctuation, currency, kana, Han, Hangul.
SCRIPTS = "\\x00-\\u052f\\u2000-\\u206f\\u20a0-\\u20bf\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3"
LONGEST_SPACE = 200
MOST_CHARS = 1 << 23  # of texts that are split together
_LETTER, _NUMBER, _SPACE, _MARK = range(1, 5)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: visible bytes for
    themselves, the others in order for the characters from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


def ranks(vocabulary: dict) -> dict[bytes, int] | None:
    """Ids by bytes, where the vocabulary (its file's content) is such a table."""
    model, splitter = vocabulary["model"], vocabulary.get("pre_tokenizer") or {}
    plain = (
        model["type"] == "BPE"
        and not any(model.get(name) for name in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        and not vocabulary.get("normalizer")
        and splitter.get("type") == "ByteLevel"
        and splitter.get("use_regex", True)
        and not splitter.get("add_prefix_space", True)
    )
    if not plain:
        return None
    ids, byte_of = model["vocab"], _byte_of()
    special = {token["content"] for token in vocabulary["added_tokens"]}
    parts = (merge.split(" ") if isinstance(merge, str) else merge for merge in model["merges"])
    made = [ids["".join(merge)] for merge in parts]
    if any(a >= b for a, b in zip(made, made[1:])):
        return None
    return {bytes(map(byte_of.__getitem__, t)): n for t, n in ids.items() if t not in special}


def _classes() -> np.ndarray:
    """The class of each character of the scripts in the byte-level pattern."""
    table = np.zeros(0x10000, dtype=np.uint8)
    inside = regex.compile(f"[{SCRIPTS}]")
    kinds = [(_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\p{White_Space}"), (_MARK, ".|\n")]
    for char in filter(inside.match, map(chr, range(0x10000))):
        table[ord(char)] = next(kind for kind, of in kinds if regex.match(of, char))
    return table


def part_starts(codes: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the parts of texts laid end to end begin, by public_tokenizers.PATTERN.

    A part is a run of letters, of numbers, of white space or of other characters. Of white
    space before another run, the last character stands by itself, or if it is a blank with
    that run. A quote that begins a part takes the letters of a contraction with it."""
    kind = classes.take(codes)
    edge = np.zeros(len(codes) + 4, dtype=bool)
    edge[ends] = edge[0] = True
    edge[len(codes) :] = True
    begins = edge.copy()
    changes = kind[1:] != kind[:-1]
    begins[1 : len(codes)] |= changes
    last = np.flatnonzero((kind[:-1] == _SPACE) & changes & ~edge[1 : len(codes)])
    begins[last] = True
    begins[last[codes[last] == ord(" ")] + 1] = False
    quote = np.flatnonzero((codes == ord("'")) & begins[: len(codes)])
    quote = quote[~edge[quote + 1]]
    first = codes[quote + 1]
    short = quote[np.isin(first, np.array([ord(c) for c in "stmd"]))]
    rest = quote[~edge[quote + 2]]
    first, second = codes[rest + 1], codes[rest + 2]
    pairs = [(first == ord(a)) & (second == ord(b)) for a, b in ("re", "ve", "ll")]
    long = rest[pairs[0] | pairs[1] | pairs[2]]
    begins[short + 1] = begins[long + 1] = False
    begins[short + 2] = begins[long + 3] = True
    return np.flatnonzero(begins[: len(codes)])


class Parts:
    """Encodes texts of the scripts by their distinct parts."""

    def __init__(self, tokenizer: Tokenizer, fast: tiktoken.Encoding, table: dict[bytes, int]):
        self.tokenizer, self.fast = tokenizer, fast
        self.classes = _classes()
        self.sizes = np.zeros(max(table.values()) + 1, dtype=np.int64)
        self.sizes[list(table.values())] = [len(part) for part in table]
        # After a blank these bytes may begin more white space.
        self.joins = np.ones(256, dtype=bool)
        self.joins[[*range(9, 14), 32, 0xC2, 0xE2]] = False

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are not empty."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum([len(text) for text in texts])
        starts = part_starts(codes, ends, self.classes)
        offsets = starts
        if not joined.isascii():
            widths = 1 + (codes >= 0x80).view(np.uint8) + (codes >= 0x800)
            offsets = np.cumsum(np.add.reduceat(widths, starts, dtype=np.int64))
            offsets = np.append(0, offsets[:-1])
        data = joined.encode()
        buffers = [None, pa.py_buffer(np.append(offsets, len(data))), pa.py_buffer(data)]
        parts = pa.Array.from_buffers(pa.large_string(), len(starts), buffers)
        parts = parts.dictionary_encode()
        which = parts.indices.to_numpy()
        ids, lengths = self._distinct(parts.dictionary)
        firsts = np.cumsum(lengths) - lengths
        sizes = lengths[which]
        stops = np.cumsum(sizes)
        places = np.repeat(firsts[which] - stops + sizes, sizes)
        places += np.arange(len(places))
        found = ids[places]
        ends = stops[np.searchsorted(starts, ends) - 1].tolist()
        return [found[low:high].tobytes() for low, high in zip([0, *ends], ends)]

    def _distinct(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each part in order, and their numbers. Parts of a blank and a run split
        the same laid end to end, so one call encodes all of these."""
        offsets = np.frombuffer(parts.buffers()[1], dtype=np.int64)[: len(parts) + 1]
        data = np.frombuffer(parts.buffers()[2], dtype=np.uint8)
        widths = np.diff(offsets)
        first, second = data[offsets[:-1]], data[np.minimum(offsets[:-1] + 1, len(data) - 1)]
        joins = (first == ord(" ")) & (widths > 1) & self.joins[second]
        together = data[np.repeat(joins, widths)].tobytes().decode()
        ids = np.array(self.fast.encode_ordinary(together), dtype="<u4")
        stops = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(widths[joins])) + 1
        alone = [self._alone(part) for part in parts.filter(pa.array(~joins)).to_pylist()]
        lengths = np.zeros(len(parts), dtype=np.int64)
        lengths[joins] = np.diff(stops, prepend=0)
        lengths[~joins] = [len(found) for found in alone]
        # All ids in order of the parts.
        whole = np.empty(lengths.sum(), dtype="<u4")
        mine = np.repeat(joins, lengths)
        whole[mine] = ids
        whole[~mine] = [n for found in alone for n in found]
        return whole, lengths

    def _alone(self, part: str) -> list[int]:
        if len(part) >= LONGEST_SPACE and not part.strip():
            return self.tokenizer.encode(part, add_special_tokens=False).ids
        return self.fast.encode_ordinary(part)


def windows(text: str, most: int) -> Iterator[str]:
    """A long text in pieces that begin where a part does: at a blank between words."""
    low = 0
    while len(text) - low > most and (found := _BETWEEN(text, low + most - 1)):
        yield text[low : found.start() + 1]
        low = found.start() + 1
    yield text[low:]


_BETWEEN = re.compile("[a-z] [a-z]").search


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``state`` holds what is loaded between encoders of one process."""

    def __init__(self, path: str, state: dict | None = None):
        state = {} if state is None else state
        if path not in state:
            state[path] = self._load(path)
        self.tokenizer, self.fast, self.parts = state[path]
        self.other = re.compile(f"[^{SCRIPTS}]").search

    @staticmethod
    def _load(path: str) -> tuple[Tokenizer, tiktoken.Encoding | None, Parts | None]:
        import public_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            table = ranks(json.load(file))
        if table is None:
            return tokenizer, None, None
        pattern = public_tokenizers.PATTERN
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        return tokenizer, fast, Parts(tokenizer, fast, table)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        found: list[list[bytes]] = [[] for _ in texts]
        rows: list[int] = []
        waiting: list[str] = []
        size = 0

        def split() -> None:
            for row, ids in zip(rows, self.parts.encode(waiting) if waiting else ()):
                found[row].append(ids)

        for row, text in enumerate(texts):
            if not text:
                continue
            if self.parts is None or not text.isascii() and self.other(text):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                found[row].append(array("I", ids).tobytes())
                continue
            for piece in windows(text, MOST_CHARS):
                if size + len(piece) > MOST_CHARS:
                    split()
                    rows, waiting, size = [], [], 0
                rows.append(row)
                waiting.append(piece)
                size += len(piece)
        split()
        return [b"".join(parts) for parts in found]
