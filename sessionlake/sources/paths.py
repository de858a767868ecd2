"""Paths handed to Spark's readers."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_SPECIAL = r"([\\{}\[\]*?])"


def escape_path(path: str) -> str:
    """A path that names one file: its special characters do not make a pattern."""
    return re.sub(_SPECIAL, r"\\\1", path)


def escaped(path: Column) -> Column:
    """The same for a column of paths."""
    return F.regexp_replace(path, _SPECIAL, r"\\$1")
