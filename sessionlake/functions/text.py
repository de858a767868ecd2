"""String functions as Column expressions (Unicode aware, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters treated as white space in addition to (?U)\s, and the
# characters that end a line.
SPACE = r"\s\x1c-\x1f"
LINE_END = r"\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029"

REDACTED = "[redacted]"

# What secrets start with and what key blocks hold, case folded.
SECRET_PREFIXES = ("bearer ", "sk-", "rk-", "pk_", "akia")
SECRET_MARKER = "-----begin"


def _any_case(folded: str) -> str:
    """Pattern of all texts whose case folding is ``folded``."""
    more = {"k": "\\u212A", "s": "\\u017F"}
    return "".join(
        f"[{c}{c.upper()}{more.get(c, '')}]" if c.isalpha() else c for c in folded
    )


SECRET_PATTERN = (
    rf"\A(?:{'|'.join(map(_any_case, SECRET_PREFIXES))})"
    rf"|{_any_case(SECRET_MARKER)}"
    r"|\A[\p{L}\p{N}\-_=]{64,}\z"
)


def strip(text: Column) -> Column:
    """Drop white space at both ends; the lookbehind keeps long inner runs linear."""
    return F.regexp_replace(
        text, rf"(?U)\A[{SPACE}]+|(?<![{SPACE}])[{SPACE}]+\z", ""
    )


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)(?<![{SPACE}])[{SPACE}]+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"(?U)[^{SPACE}]")


def looks_like_secret(text: Column) -> Column:
    """True for bearer tokens, key prefixes, key blocks and long opaque tokens."""
    return strip(text).rlike(SECRET_PATTERN)


def scrub_text(text: Column) -> Column:
    return F.when(looks_like_secret(text), F.lit(REDACTED)).otherwise(text)


def tag_value(text: Column, tag: str) -> Column:
    """Stripped text between the first ``<tag>`` and the next ``</tag>``, else null."""
    opening, closing = f"<{tag}>", f"</{tag}>"
    start = F.locate(opening, text)
    rest = F.substr(text, start + F.lit(len(opening)))
    end = F.locate(closing, rest)
    return F.when(
        (start > 0) & (end > 0), strip(F.substr(rest, F.lit(1), end - F.lit(1)))
    )


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def shorten(text: Column, limit: int = 120) -> Column:
    """Cut to ``limit`` characters with an ellipsis; small limits count from the end."""
    clean = strip(unix_newlines(text))
    keep = limit - 3
    size = F.lit(keep) if keep >= 0 else F.greatest(F.length(clean) + keep, F.lit(0))
    cut = F.concat(rstrip(F.substr(clean, F.lit(1), size)), F.lit("..."))
    return F.when(F.length(clean) > limit, cut).otherwise(clean)


def indent(text: Column, prefix: str) -> Column:
    """Put ``prefix`` before each line that is not blank."""
    pattern = rf"(?U)(?<![^{LINE_END}])(?=[^{LINE_END}]*[^{SPACE}{LINE_END}])"
    return F.regexp_replace(text, pattern, prefix)
