"""Prompt template: active file, open tabs and request of a user message.

The message is cut into sections at its ``## `` heading lines, so every section
is read on its own and no state has to be carried from line to line.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sessionlake.functions.text import LINE_END, SPACE, rstrip, strip

# The headings of the template.
ACTIVE_FILE = "## Active file:"
OPEN_TABS = "## Open tabs:"
MY_REQUEST = "## My request for Codex:"

_GAP = rf"[{SPACE}&&[^\n]]*"
_SECTION_START = rf"(?Umd)^(?={_GAP}## [^\n]*[^{SPACE}])"


def _sections(message: Column) -> Column:
    lines = F.regexp_replace(message, rf"\r\n|[{LINE_END}]", "\n")
    return F.split(lines, _SECTION_START)


def _heading(section: Column) -> Column:
    return strip(F.substring_index(section, "\n", 1))


def _body(section: Column) -> Column:
    """Lines below the heading; null when there are none."""
    cut = F.locate("\n", section)
    return F.when(cut > 0, F.substr(section, cut + F.lit(1)))


def _tab_lines(section: Column) -> Column:
    """Items up to the first blank line, without their dash."""
    upper = F.element_at(
        F.split(F.concat(F.lit("\n"), _body(section)), rf"(?Ud)\n{_GAP}(?:\n|\z)"), 1
    )
    return F.transform(
        F.split(upper, "\n"), lambda line: strip(F.regexp_replace(strip(line), r"\A-", ""))
    )


def _request_lines(section: Column) -> Column:
    return F.transform(F.split(_body(section), "\n"), rstrip)


def _joined(sections: Column, heading: str, lines) -> Column:
    wanted = F.filter(sections, lambda s: _heading(s).startswith(heading))
    none = F.array().cast("array<string>")
    found = F.flatten(F.transform(wanted, lambda s: F.coalesce(lines(s), none)))
    return F.array_join(F.filter(found, lambda line: line != ""), "\n")


def parse_prompt(message: Column) -> Column:
    """Struct (active_file, open_tabs, my_request); empty parts are null."""
    sections = _sections(message)
    files = F.transform(
        F.filter(sections, lambda s: _heading(s).startswith(ACTIVE_FILE)),
        lambda s: strip(F.substr(_heading(s), F.lit(len(ACTIVE_FILE) + 1))),
    )
    return F.struct(
        F.nullif(F.try_element_at(files, F.lit(-1)), F.lit("")).alias("active_file"),
        F.nullif(_joined(sections, OPEN_TABS, _tab_lines), F.lit("")).alias("open_tabs"),
        F.nullif(
            strip(_joined(sections, MY_REQUEST, _request_lines)), F.lit("")
        ).alias("my_request"),
    )
