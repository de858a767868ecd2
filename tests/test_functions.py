"""Column functions on hand-made values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sessionlake.functions import jsonv
from sessionlake.functions import rules, text
from sessionlake.functions.json_rules import redact_json
from sessionlake.functions.prompt import parse_prompt
from sessionlake.functions.strict_json import scrub, strict_json


def apply(spark, values, make):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string")
    found = rows.select("n", make(F.col("v")).alias("r")).orderBy("n").collect()
    return [r.r for r in found]


def test_strip_and_blank(spark):
    values = ["  a\tb \x1c\n", "", "  \x1f", "x", None]
    assert apply(spark, values, text.strip) == [v.strip() if v is not None else None for v in values]
    assert apply(spark, values[:4], text.is_blank) == [not v.strip() for v in values[:4]]
    assert apply(spark, values[:4], text.rstrip) == [v.rstrip() for v in values[:4]]


def test_secret_strings(spark):
    secret = [
        " Bearer abc", "x -----BEGIN RSA", "sk-1", "RK-1", "pk_1", "AKIA1", "a" * 64,
        "é" * 60 + "-_=1", "ſk-long s", "sK-kelvin",
    ]
    plain = ["bearer", "ask-1", "a" * 63, "a b" * 40, "a" * 64 + "!", "akıa1", "", "pk-1"]
    assert apply(spark, secret + plain, text.looks_like_secret) == [True] * len(secret) + [
        False
    ] * len(plain)
    for value in secret:
        assert scrub(value) == "[redacted]", value
    for value in plain:
        assert scrub(value) == value


def test_tag_value(spark):
    values = ["<cwd>nested<cwd>inner</cwd></cwd>", "<cwd>open", "</cwd><cwd>", "<cwd>\n a \n</cwd>", "<cwd></cwd>"]
    assert apply(spark, values, lambda c: text.tag_value(c, "cwd")) == [
        "nested<cwd>inner", None, None, "a", "",
    ]


def test_shorten(spark):
    def short(value, limit):
        return apply(spark, [value], lambda c: text.shorten(c, limit))[0]

    assert short("a" * 10, 5) == "aa..."
    assert short("abc", 0) == "..."
    assert short("abc", 2) == "ab..."
    assert short(" a\r\nb\rc ", 120) == "a\nb\nc"
    assert short("ab   cdef", 8) == "ab..."


def test_indent_matches_textwrap(spark):
    from textwrap import indent

    values = ["a\n\n  \n b", "a\r\nb\rc", "", "x y\x0bz", "\n\na\n"]
    assert apply(spark, values, lambda c: text.indent(c, "  > ")) == [
        indent(v, "  > ") for v in values
    ]


# --- prompt template -----------------------------------------------------------


def read_prompt(message):
    """Line by line reading, for comparison."""
    active, tabs, wanted, where = None, [], [], ""
    for line in message.splitlines():
        bare = line.strip()
        if bare.startswith("## Active file:"):
            active, where = bare[15:].strip() or None, ""
        elif bare.startswith("## Open tabs:"):
            where = "tabs"
        elif bare.startswith("## My request for Codex:"):
            where = "request"
        elif bare.startswith("## ") or (where == "tabs" and not bare):
            where = ""
        elif where == "tabs":
            tabs.append(bare[1:].strip() if bare[0] == "-" else bare)
        elif where == "request":
            wanted.append(line.rstrip())
    return (
        active,
        "\n".join(t for t in tabs if t) or None,
        "\n".join(w for w in wanted if w).strip() or None,
    )


def test_prompt_template(spark):
    pieces = [
        "## Active file: a.py", "  ## Active file:", "## Open tabs:", "## Open tabs: x", "- tab",
        "-", " plain ", "", "   ", "## Other", "##", "## ", "##x", "## My request for Codex: y",
        "do it  ", "  - not a tab", "##  z",
    ]
    rng = random.Random(3)
    messages = [
        "".join(
            rng.choice(pieces) + rng.choice(["\n", "\r\n", "\n", "\r", "\x0b", " "])
            for _ in range(rng.randint(0, 14))
        )
        + rng.choice(["", "end"])
        for _ in range(2000)
    ]
    got = apply(spark, messages, parse_prompt)
    for message, row in zip(messages, got):
        assert tuple(row) == read_prompt(message), repr(message)


# --- rules -----------------------------------------------------------------------


def run_rules(spark, value, entries):
    frame = spark.createDataFrame([(value,)], "v string")
    row = rules.with_rules(frame, "v", rules.make_rules(spark, entries)).first()
    return row.redacted, row.rule_counts


def test_rules_in_order(spark):
    literal = [
        {"id": "a", "type": "literal", "pattern": "secret"},
        {"id": "b", "type": "LITERAL", "pattern": "Morgan", "ignore_case": False},
        {"id": "c", "type": "regex", "pattern": "nothing"},
        {"id": "d", "type": "regex", "pattern": "keeps", "enabled": False},
    ]
    assert run_rules(spark, "Morgan keeps secret and SECRET", literal) == (
        "<REDACTED> keeps <REDACTED> and <REDACTED>",
        {"a": 2, "b": 1},
    )
    marker = [{"id": "m", "type": "marker", "pattern": r"\[redact\s+(?P<content>.+?)\]", "dotall": True}]
    assert run_rules(spark, "Logs: [redact pass\nword=1] go", marker) == (
        "Logs: <REDACTED> go", {"m": 1},
    )
    odd = [
        {"id": "1", "type": "literal", "pattern": "a.b[c]\\E$", "replacement": "$0\\"},
        {"id": "2", "type": "regex", "pattern": r"[[&&]x(?P<q>['\"])y(?P=q)", "replacement": ""},
        {"id": "3", "type": "regex", "pattern": r"end$"},
    ]
    assert run_rules(spark, "A.B[C]\\e$ [x'y' &x\"y\" end\n", odd) == (
        "$0\\ <REDACTED> <REDACTED> <REDACTED>\n", {"1": 1, "2": 2, "3": 1},
    )


def test_rules_see_earlier_results(spark):
    chained = [
        {"id": "x", "type": "regex", "pattern": "a", "replacement": "bb"},
        {"id": "y", "type": "regex", "pattern": "b", "replacement": "c"},
    ]
    assert run_rules(spark, "ab", chained) == ("ccc", {"x": 1, "y": 3})


@pytest.mark.parametrize(
    "entries",
    [
        {"id": "a"},
        [{"id": "a", "type": "regex"}],
        [{"id": "a", "type": "other", "pattern": "x"}],
        [{"id": "a", "type": "regex", "pattern": " "}],
        [{"id": "a", "type": "regex", "pattern": "x", "scope": "page"}],
        [{"id": "a", "type": "regex", "pattern": "x"}] * 2,
    ],
)
def test_bad_rules(spark, entries):
    with pytest.raises(rules.RuleError):
        rules.make_rules(spark, entries)


@pytest.mark.parametrize("pattern", ["(", "a)", "(?(1)a)", "x{2}{3}"])
def test_bad_pattern_fails_at_load(spark, pattern):
    with pytest.raises(rules.RuleError):
        rules.make_rules(spark, [{"id": "a", "type": "regex", "pattern": pattern}])


def test_repeat_without_a_lower_bound(spark):
    entries = [{"id": "a", "type": "regex", "pattern": "ba{,2}c"}]
    assert run_rules(spark, "bc bac baaac", entries) == ("<REDACTED> <REDACTED> baaac", {"a": 2})


def test_load_rules_from_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('[{"id": "t", "type": "regex", "pattern": "x", "reason": " "}]')
    (rule,) = rules.load_rules(spark, str(path))
    assert (rule.scope, rule.reason, rule.ignore_case) == ("prompt", None, True)
    path.write_text("[]")
    assert rules.load_rules(spark, str(path)) == []


_GOOD = '{"id": "t", "type": "regex", "pattern": "x"}'


@pytest.mark.parametrize(
    "text",
    [f"[{_GOOD}, {_GOOD[:20]}", f'[{_GOOD}, "x"]', f"[{_GOOD}] trailing", f"[{_GOOD}", _GOOD, "null", "", "[[]]"],
)
def test_damaged_rule_file_fails(spark, tmp_path, text):
    path = tmp_path / "rules.json"
    path.write_text(text)
    with pytest.raises(rules.RuleError):
        rules.load_rules(spark, str(path))


def test_values_that_are_not_text(spark):
    entry = {"id": 7, "type": "Literal", "pattern": "a", "enabled": "false", "ignore_case": 0, "dotall": []}
    (rule,) = rules.make_rules(spark, [entry])
    assert (rule.id, rule.enabled, rule.ignore_case, rule.dotall) == ("7", True, False, False)
    with pytest.raises(rules.RuleError):
        rules.make_rules(spark, ["x"])


# --- strict JSON -------------------------------------------------------------------


def test_strict_json(spark):
    import json

    lines = [
        '{"b": 1, "a": {"password": [1, null, {"x": true}]}, "b": 2.0}',
        '{"type": "t", "payload": {"u": "\\u00e9", "n": 1e5}, "z": NaN}',
        '{"a": 1} junk',
        "[1, 2",
        '"sk-abc"',
        '{"type": "t"}',
        '{"type": "t", "payload": null, "metadata": "m"}',
        '{"a": "\\ud800"}',
        " " + '{"type": "t", "payload": {"k": "bearer x"}} ',
    ]
    rows = apply(spark, lines, strict_json)
    assert [r.raw_json for r in rows] == [
        '{"b": 2.0, "a": {"password": ["[redacted]", null, {"x": "[redacted]"}]}}',
        '{"type": "t", "payload": {"u": "é", "n": 100000.0}, "z": NaN}',
        None,
        None,
        '"[redacted]"',
        '{"type": "t", "payload": {}}',
        '{"type": "t", "payload": {}, "metadata": {}}',
        None,
        '{"type": "t", "payload": {"k": "[redacted]"}}',
    ]
    assert rows[2].json_error.startswith("Extra data: line 1 column 10")
    assert rows[7].json_error is not None
    cut = rows[1].raw_json[rows[1].payload_at - 1 :][: rows[1].payload_len]
    assert json.loads(cut) == {"u": "é", "n": 1e5}
    kept = apply(spark, lines[:1], lambda c: strict_json(c, clean=False))[0]
    assert json.loads(kept.raw_json) == json.loads(lines[0])


def test_special_numbers_are_null_and_strings_stay(spark):
    texts = [
        '{"m": "x: NaN, y", "v": NaN, "w": [1, -Infinity, Infinity]}',
        r'{"a\\": "q\" , NaN \\", "b": NaN}',
        '{"m": "NaN"}',
        '{"t": "' + "NaN, " * 50_000 + '", "v": Infinity}',
    ]
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    rows = frame.select("n", F.to_json(jsonv.parse(F.col("t"))).alias("v")).orderBy("n").collect()
    assert rows[0].v == '{"m":"x: NaN, y","v":null,"w":[1,null,null]}'
    assert rows[1].v == r'{"a\\":"q\" , NaN \\","b":null}'
    assert rows[2].v == '{"m":"NaN"}'
    assert rows[3].v.count("NaN, ") == 50_000 and rows[3].v.endswith('"v":null}')


def test_rules_inside_stored_json(spark):
    import json

    entries = [
        {"id": "mail", "type": "regex", "pattern": r"\w+@\w+\.\w+", "replacement": 'a "b" \\ c'},
        {"id": "start", "type": "regex", "pattern": r"^tab\there$", "replacement": "line\nend"},
        {"id": "punctuation", "type": "literal", "pattern": "::", "replacement": ";"},
    ]
    checked = rules.make_rules(spark, entries)
    values = [
        {"ann@b.cd": "to ann@b.cd", "": "x", "n": [1, 2.50, None, True, {"k": "tab\there"}]},
        {": not a key": ":: ann@b.cd", "q": 'say "hi" ann@b.cd', "back": "\\", "two": '\\"'},
        [":", "::", "::a:: : ", "é ann@b.cd 😀", "\u0001 ann@b.cd", ""],
        "a" * 2_000 + " ann@b.cd " + '"\\' * 20_000,
        {"long": ["ann@b.cd, \\"] * 2_000},
    ]

    def plain(value):
        if isinstance(value, str):
            value = re.sub(r"\w+@\w+\.\w+", lambda _: 'a "b" \\ c', value)
            value = re.sub(r"^tab\there$", "line\nend", value)
            return value.replace("::", ";")
        if isinstance(value, list):
            return [plain(item) for item in value]
        if isinstance(value, dict):
            return {key: plain(item) for key, item in value.items()}
        return value

    lines = [json.dumps(value, ensure_ascii=False) for value in values]
    more = ['{"n": 1e400, "m": -0.0, "o" :  NaN, "p": 12345678901234567890123}', "", None, '"a", "ann@b.cd"']
    got = apply(spark, lines + more, lambda c: F.struct(redact_json(c, checked).alias("v")))
    assert [json.loads(row.v) for row in got[: len(values)]] == [plain(v) for v in values]
    assert [row.v for row in got[len(values) :]] == [
        more[0], "", None, r'"a", "a \"b\" \\ c"'
    ]
    plan = spark.range(1).select(redact_json(F.lit("[1]"), checked))
    assert "Python" not in plan._jdf.queryExecution().toString()


def test_json_string_that_cannot_be_read_raises(spark):
    with pytest.raises(Exception, match="MALFORMED|malformed|JSON"):
        apply(spark, [r'["\q a@b.cd"]'], lambda c: F.struct(redact_json(c, rules.DEFAULT_RULES).alias("v")))
