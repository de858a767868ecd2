"""Typed access to VARIANT values.

Casts on VARIANT are lax (5 reads as '5', an object reads as text), so every
accessor tests the kind of the value first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# A number above the 64-bit range keeps its digits; smaller decimals were floats.
_BIG_INTEGER = r"^DECIMAL\((19|[23]\d),0\)$"


# The parser's own limits on strings, numbers and depth are far below a variant's.
NO_LIMITS = {
    name: str(2**31 - 1) for name in ("maxStringLen", "maxNumLen", "maxNestingDepth")
}


def map_strings(
    text: Column,
    values: Callable[[Column], Column] | None = None,
    rest: Callable[[Column], Column] | None = None,
) -> Column:
    """A JSON text with its string values (escaped as they stand, without quotes) changed by
    ``values`` and what is outside of strings by ``rest``; keys stay.

    Escaped characters are masked first, by control characters that JSON cannot hold, so
    that every quote left begins or ends a string: odd parts between quotes are strings.
    A quote before a colon gets a mark: at the end of an odd part the mark tells a key.
    """
    slash, quote, key = "\x01\x01", "\x01\x02", "\x03"

    def unmasked(part: Column) -> Column:
        part = F.replace(part, F.lit(quote), F.lit('\\"'))
        return F.replace(part, F.lit(slash), F.lit("\\\\"))

    def changed(part: Column, n: Column) -> Column:
        outside = rest(part) if rest else part
        if values is None:
            return F.when(n % 2 == 0, outside).otherwise(part)
        inside = F.when(part.endswith(key), part).otherwise(values(unmasked(part)))
        return F.when(n % 2 == 0, outside).otherwise(inside)

    masked = F.replace(text, F.lit("\\\\"), F.lit(slash))
    masked = F.replace(masked, F.lit('\\"'), F.lit(quote))
    if values is None:
        return unmasked(F.array_join(F.transform(F.split(masked, '"', -1), changed), '"'))
    marked = F.regexp_replace(masked, r'"(?=\s*:)', f'{key}"')
    joined = F.array_join(F.transform(F.split(marked, '"', -1), changed), '"')
    return unmasked(F.replace(joined, F.lit(key), F.lit("")))


def _special_numbers_as_null(text: Column) -> Column:
    """NaN and Infinity become null; strings that hold these words stay as they are."""
    return map_strings(
        text, rest=lambda part: F.regexp_replace(part, "NaN|-?Infinity", "null")
    )


def parse(text: Column) -> Column:
    """VARIANT of a JSON text; NaN and Infinity, legal in the logs, read as null."""
    plain = F.when(text.rlike("NaN|Infinity"), _special_numbers_as_null(text)).otherwise(text)
    return F.coalesce(F.try_parse_json(text), F.from_json(plain, "variant", NO_LIMITS))


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(at(value, path))


def as_object(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "map<string,variant>")


def as_array(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def is_object(value: Column, path: str = "$") -> Column:
    """Asks for one field only: an object answers with a struct, all else with null."""
    return F.try_variant_get(value, path, "struct<type:variant>").isNotNull()


def is_container(value: Column, path: str) -> Column:
    return is_object(value, path) | as_array(value, path).isNotNull()


def present(value: Column, path: str) -> Column:
    """The key exists; its value may be a JSON null."""
    return at(value, path).isNotNull()


def is_null(value: Column, path: str) -> Column:
    """The key is missing or holds a JSON null."""
    found = at(value, path)
    return found.isNull() | F.is_variant_null(found)


def not_an_object(value: Column, path: str) -> Column:
    """The key exists but does not hold an object."""
    return present(value, path) & ~is_object(value, path)


def is_string(value: Column, path: str) -> Column:
    return F.coalesce(kind(value, path) == "STRING", F.lit(False))


def string(value: Column, path: str) -> Column:
    """The value if it is a string, else null."""
    return F.when(
        is_string(value, path), F.try_variant_get(value, path, "string")
    )


def filled_string(value: Column, path: str) -> Column:
    """The value if it is a string with visible characters, else null."""
    found = string(value, path)
    return F.when(found.rlike(r"(?U)[^\s\x1c-\x1f]"), found)


def truthy(value: Column, path: str) -> Column:
    """False for missing, null, false, zero, empty text and empty containers."""
    k = kind(value, path)
    text = F.try_variant_get(value, path, "string")
    number = F.try_variant_get(value, path, "double")
    return (
        F.when(k.isNull() | (k == "VOID"), False)
        .when(k == "STRING", text != "")
        .when(k == "BOOLEAN", text == "true")
        .when(k.startswith("OBJECT"), F.size(as_object(value, path)) > 0)
        .when(k.startswith("ARRAY"), F.size(as_array(value, path)) > 0)
        .otherwise(F.coalesce(number != 0, F.lit(True)))
    )


def _number_text(value: Column, path: str, k: Column) -> Column:
    text = F.try_variant_get(value, path, "string")
    as_float = F.try_variant_get(value, path, "double").cast("string")
    is_float = (k.startswith("DECIMAL") & ~k.rlike(_BIG_INTEGER)) | (k == "DOUBLE")
    return F.when(is_float, as_float).otherwise(text)


def column_text(value: Column, path: str) -> Column:
    """Value as a text column stores it: booleans as 1/0, numbers as written."""
    k = kind(value, path)
    text = F.try_variant_get(value, path, "string")
    return (
        F.when(k == "STRING", text)
        .when(k == "BOOLEAN", F.when(text == "true", "1").otherwise("0"))
        .when(
            ~(k == "VOID") & ~k.startswith("OBJECT") & ~k.startswith("ARRAY"),
            _number_text(value, path, k),
        )
    )


def display_text(value: Column, path: str, missing: str = "None") -> Column:
    """Value as shown in reports: None, True/False, numbers and text as they are."""
    k = kind(value, path)
    text = F.try_variant_get(value, path, "string")
    return (
        F.when(k.isNull(), F.lit(missing))
        .when(k == "VOID", "None")
        .when(k == "STRING", text)
        .when(k == "BOOLEAN", F.initcap(text))
        .when(k.startswith("OBJECT") | k.startswith("ARRAY"), text)
        .otherwise(_number_text(value, path, k))
    )


def double(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "double")


def bigint(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "bigint")


def json_record(flat: Column, nested: dict[str, Column]) -> Column:
    """JSON object of a struct plus members that already are JSON texts."""
    head = F.to_json(flat, {"ignoreNullFields": "false"})
    pieces = [F.substr(head, F.lit(1), F.length(head) - 1)]
    for name, text in nested.items():
        pieces += [F.lit(f',"{name}":'), F.coalesce(text, F.lit("null"))]
    return F.concat(*pieces, F.lit("}"))
