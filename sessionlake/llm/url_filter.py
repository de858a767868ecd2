"""URL filter: rules by host and path, and naive Bayes over segmented names for the rest.

The longest rule that fits decides: its host is the url's host or a parent domain, and the
url's path starts with its path. Other urls are judged by a multinomial naive Bayes
that learns from the urls the rules decide. Its tokens are the words of host and path:
runs of letters are split into words by Viterbi over unigram frequencies of the pages'
own text, and a run of digits is one token ``#``.

All counts cover all pages. Urls with the same runs of letters share a signature; they
are counted first, so the joins see each signature once. The words that can occur in a
name are its substrings, so word frequencies meet names by a join and no vocabulary is
cut or sent around. The last join brings a signature's score to its pages; a hot host
makes a large join partition there, which Spark splits.

Defined cases: a null url, or one without ``://``, has empty host and path and no tokens,
so the share of blocked urls decides; a tie is allowed; a name with no known word splits
by the unknown-word penalty; null html has no words; repeated rows are judged each; an
empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sessionlake.session import stage

LONGEST_WORD = 24
PLACES = 4096  # of a long name, whose parts are found together
TOTAL = ""  # the entry that carries the number of all words
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HIDDEN = re.compile(r"<(script|style)\b", re.IGNORECASE)
_ENDS = {name: re.compile(f"</{name}>", re.IGNORECASE) for name in ("script", "style")}
_WORD = re.compile(r"[^\W\d_]+")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[Rule], value: str) -> Column:
    """``value`` of the longest rule that fits; of equal ones a block wins."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block")):
        below = (host == rule.host) | host.endswith("." + rule.host)
        fits = below & path.startswith(rule.path)
        found = F.when(fits, F.lit(getattr(rule, value))).otherwise(found)
    return found


def name_runs(host: Column, path: Column) -> Column:
    """Runs of letters, and ``#`` for runs of digits, of host and path in order."""
    both = F.lower(F.concat_ws("/", host, path))
    runs = F.regexp_extract_all(both, F.lit(r"\p{L}+|\p{N}+"), F.lit(0))
    return F.transform(runs, lambda r: F.when(r.rlike(r"^\p{N}"), "#").otherwise(r))


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): words of the visible text, summed in each task; TOTAL has all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for html in batch.column("html").to_pylist():
                counts.update(_WORD.findall(visible(html or "").lower()))
            counts[TOTAL] = sum(counts.values())
            kept = {w: n for w, n in counts.items() if len(w) <= LONGEST_WORD}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())],
                ["word", "n"],
            )

    return pages.select("html").mapInArrow(run, "word string, n bigint")


def visible(html: str) -> str:
    """The text of a page, with a space for each tag and each script or style.

    What is never closed is searched for its end once, so this takes linear time."""
    out, done, at, unclosed = [], 0, html.find("<"), set()
    while at >= 0:
        hidden, end = _HIDDEN.match(html, at), -1
        if hidden and (name := hidden[1].lower()) not in unclosed:
            found = _ENDS[name].search(html, hidden.end())
            end = found.end() if found else -1
            unclosed |= set() if found else {name}
        if end < 0:
            end = html.find(">", at) + 1
            if not end:
                break  # no tag ends from here on
        out.append(html[done:at])
        done, at = end, html.find("<", end)
    return " ".join([*out, html[done:]])


def viterbi(name: str, known: dict[tuple[int, int], float], total: float) -> list[str]:
    """The likeliest split; an unknown word costs ten times more with each letter."""
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            unknown = -math.log(total) - (end - start) * math.log(10)
            score = best[start] + known.get((start, end), unknown)
            if score > best[end]:
                best[end], back[end] = score, start
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def segment(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words): every distinct ``name`` in its likeliest words."""
    names = stage(names.withColumn("number", F.monotonically_increasing_id()), "numbered")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: list[int] = []
        words: list[str] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array(words, pa.string())], ["number", "word"]
            )

        for batch in batches:
            for name, number in zip(*(batch.column(c).to_pylist() for c in ("name", "number"))):
                for low in range(0, len(name), PLACES):
                    found = {
                        name[start : start + size]
                        for start in range(low, min(low + PLACES, len(name)))
                        for size in range(1, min(LONGEST_WORD, len(name) - start) + 1)
                    }
                    words.extend(found)
                    numbers.extend([number] * len(found))
                    if len(words) >= PLACES * LONGEST_WORD:
                        yield made()
                        numbers.clear()
                        words.clear()
        yield made()

    held = names.mapInArrow(parts, "number bigint, word string")
    totals = counts.groupBy("word").agg(F.sum("n").alias("n"))
    wanted = held.select("word").distinct()
    known = stage(
        totals.join(wanted, "word", "left_semi").union(totals.where(F.col("word") == TOTAL)), "words"
    )
    total = (known.where(F.col("word") == TOTAL).agg(F.sum("n")).first()[0] or 0) + 1
    score = F.struct("word", F.log(F.col("n") / total).alias("score"))
    found = held.join(known, "word").groupBy("number").agg(F.collect_set(score).alias("known"))
    joined = names.join(found, "number", "left").select("name", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for name, known in zip(*(batch.column(c).to_pylist() for c in ("name", "known"))):
                scores = {k["word"]: k["score"] for k in known or ()}
                places = {
                    (start, end): scores[name[start:end]]
                    for start in range(len(name))
                    for end in range(start + 1, min(start + LONGEST_WORD, len(name)) + 1)
                    if name[start:end] in scores
                }
                words.append(viterbi(name, places, total))
            yield pa.RecordBatch.from_arrays(
                [batch.column("name"), pa.array(words, pa.list_(pa.string()))], ["name", "words"]
            )

    return joined.mapInArrow(run, "name string, words array<string>")


def bayes_scores(signatures: DataFrame, words: DataFrame) -> DataFrame:
    """(signature, score): log odds of block, from how often rules block and allow it."""
    runs = signatures.select(
        "signature", "allowed", "blocked", F.explode(F.split("signature", " ")).alias("name")
    ).where("name <> ''")
    split = words.union(words.sparkSession.createDataFrame([("#", ["#"])], words.schema))
    tokens = stage(
        runs.join(split, "name").select(
            "signature", "allowed", "blocked", F.explode("words").alias("token")
        ),
        "tokens",
    )
    counts = tokens.groupBy("token").agg(
        F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")
    )
    counts = stage(counts, "token_counts")
    allowed, blocked, kinds = counts.agg(F.sum("allowed"), F.sum("blocked"), F.count("*")).first()
    urls = signatures.agg(F.sum("allowed"), F.sum("blocked")).first()
    prior = math.log(((urls[1] or 0) + 1) / ((urls[0] or 0) + 1))
    weight = F.log((F.col("blocked") + 1) / F.lit(float((blocked or 0) + max(kinds, 1)))) - F.log(
        (F.col("allowed") + 1) / F.lit(float((allowed or 0) + max(kinds, 1)))
    )
    weights = counts.select("token", weight.alias("weight"))
    sums = tokens.join(weights, "token").groupBy("signature").agg(F.sum("weight").alias("sum"))
    return signatures.join(sums, "signature", "left").select(
        "signature", (F.coalesce("sum", F.lit(0.0)) + prior).alias("score")
    )


def judge_urls(pages: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``pages`` without ``html``, with host, path, rule, verdict and the method's score, which
    replace columns of their names (and one named ``signature``)."""
    host, path = split_url(F.col("url"))
    made = ("host", "path", "rule", "verdict", "score", "signature")
    parts = pages.withColumns({"__host": host, "__path": path}).drop("html", *made)
    parts = parts.withColumnsRenamed({"__host": "host", "__path": "path"})
    seen = stage(
        parts.withColumns(
            {
                "rule": rule_for(F.col("host"), F.col("path"), rules, "text"),
                "verdict": rule_for(F.col("host"), F.col("path"), rules, "verdict"),
                "signature": F.array_join(name_runs(F.col("host"), F.col("path")), " "),
            }
        ),
        "urls",
    )
    signatures = seen.groupBy("signature").agg(
        F.count_if(F.col("verdict") == "allow").alias("allowed"),
        F.count_if(F.col("verdict") == "block").alias("blocked"),
    )
    signatures = stage(signatures, "signatures")
    names = (
        signatures.select(F.explode(F.split("signature", " ")).alias("name"))
        .where("name NOT IN ('', '#')")
        .distinct()
    )
    words = stage(segment(stage(names, "names"), word_counts(pages)), "segmented")
    scores = bayes_scores(signatures, words)
    judged = F.when(F.col("score") > 0, "block").otherwise("allow")
    return (
        seen.join(scores, "signature")
        .withColumn("verdict", F.coalesce("verdict", judged))
        .drop("signature")
    )
