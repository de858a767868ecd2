"""The one Python function of the engine: strict JSON check and secret scrub.

Spark's JSON readers accept text after the document, reorder keys (VARIANT) or
rewrite numbers, so the exact check and the stored JSON text are made here, in
Arrow batches. Everything else runs on JVM expressions.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from sessionlake.functions.text import REDACTED, SECRET_MARKER, SECRET_PREFIXES

# Keys whose content is always hidden (compared after case folding).
SENSITIVE_KEYS = frozenset(
    [
        "access_token",
        "api_key",
        "authorization",
        "client_secret",
        "password",
        "private_key",
        "refresh_token",
        "secret",
        "token_secret",
    ]
)
_OPAQUE = re.compile(r"[\w\-=]{64,}")

RESULT = StructType(
    [
        StructField("json_error", StringType()),
        StructField("raw_json", StringType()),
        StructField("payload_at", IntegerType()),
        StructField("payload_len", IntegerType()),
    ]
)


def _is_secret(text: str) -> bool:
    bare = text.strip()
    folded = bare.casefold()
    return bool(
        folded.startswith(SECRET_PREFIXES)
        or SECRET_MARKER in folded
        or _OPAQUE.fullmatch(bare)
    )


def scrub(value, hide: bool = False):
    """Copy of a JSON value; ``hide`` is on below a sensitive key."""
    if isinstance(value, dict):
        return {
            key: scrub(item, hide or key.casefold() in SENSITIVE_KEYS)
            for key, item in value.items()
        }
    if isinstance(value, list):
        return [scrub(item, hide) for item in value]
    if hide:
        return None if value is None else REDACTED
    return REDACTED if isinstance(value, str) and _is_secret(value) else value


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def _fill_defaults(event: dict) -> None:
    """Payload and metadata of an event whose head is valid get their empty form."""
    kind, stamp = event.get("type"), event.get("timestamp")
    head_ok = isinstance(kind, str) and kind.strip() and isinstance(stamp, str | None)
    payload = event.get("payload")
    if not head_ok or not isinstance(payload, dict | None):
        return
    if payload is None:
        event["payload"] = {}
    if not isinstance(event.get("metadata"), dict | None):
        event["metadata"] = {}


def _one_line(line: str | None, clean: bool):
    if line is None:
        return None, None, None, None
    try:
        value = json.loads(line.strip())
        if clean and isinstance(value, dict):
            _fill_defaults(value)
        if clean:
            value = scrub(value)
        if not isinstance(value, dict):
            text, start, size = _dump(value), None, None
        else:
            text, start, size = "{", None, None
            for n, (key, item) in enumerate(value.items()):
                text += (", " if n else "") + _dump(key) + ": "
                body = _dump(item)
                if key == "payload":
                    start, size = len(text) + 1, len(body)
                text += body
            text += "}"
        text.encode()
    except (ValueError, RecursionError) as problem:
        return str(problem), None, None, None
    return None, text, start, size


def _batches(clean: bool):
    types = [pa.string(), pa.string(), pa.int32(), pa.int32()]

    def run(lines: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in lines:
            rows = [_one_line(line, clean) for line in batch.to_pylist()]
            columns = zip(*rows) if rows else ([], [], [], [])
            yield pa.StructArray.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], names=RESULT.names
            )

    return run


# Executors get this module with the function; they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Marked nondeterministic so that Catalyst neither repeats nor reorders the call.
_read_and_scrub = F.arrow_udf(_batches(True), RESULT).asNondeterministic()
_read_as_is = F.arrow_udf(_batches(False), RESULT).asNondeterministic()


def strict_json(line: Column, clean: bool = True) -> Column:
    """Struct with the error of a bad line, or the stored text and payload position."""
    return _read_and_scrub(line) if clean else _read_as_is(line)
