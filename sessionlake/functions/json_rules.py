"""Rules applied to the strings inside stored JSON, by the engine that runs them on columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

from sessionlake.functions import jsonv
from sessionlake.functions.rules import Rule, redact

# A string that cannot be read must not pass unredacted: it raises.
_STRICT = {**jsonv.NO_LIMITS, "mode": "FAILFAST"}


def _given(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _unescaped(part: Column) -> Column:
    listed = F.concat(F.lit('["'), part, F.lit('"]'))
    read = F.from_json(listed, "array<string>", _STRICT)[0]
    return F.when(part.contains("\\"), read).otherwise(part)


def _escaped(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(3), F.length(listed) - 4)


def redact_json(text: Column, rules: Iterable[Rule]) -> Column:
    """The JSON of ``text`` (a value, or the members of a list) with its strings redacted.

    Keys and everything that is not a string stay as written, and so does a string that
    no rule changes; so the text stays JSON, which a replacement on the text itself would
    not ensure. Null stays null.
    """
    enabled = [rule for rule in rules if rule.enabled]

    def redacted(part: Column) -> Column:
        return _given(
            _unescaped(part),
            lambda plain: _given(
                redact(plain, enabled),
                lambda done: F.when(done == plain, part).otherwise(_escaped(done)),
            ),
        )

    return jsonv.map_strings(text, values=redacted) if enabled else text
