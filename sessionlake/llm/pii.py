"""Personal data by patterns, and the terms that would reveal it.

Emails, ip addresses, card and phone numbers are found by pattern and checked. Each
distinct one is a protected entity. A term (a word near an entity) reveals it as far as
the corpus shows them together: with document shares p, its disclosure is the pointwise
mutual information log(p(term, entity) / (p(term) p(entity))), never more than the
entity's information -log p(entity). A term is disclosing when that reaches ``threshold``
of the entity's information; its occurrences near the entity become spans of kind
``term``. ``sanitise`` generalises them: an entity becomes its kind in brackets,
a disclosing term the class of its shape, and a term that discloses fully is removed.

All counts cover all documents. One pass over the texts finds entities and counts terms
by document, summed inside each task; only terms near an entity are joined.

Defined cases: a null text is empty; repeated rows count as documents of their own; rows
without personal data have no spans; with no personal data at all nothing is added;
overlapping spans of different kinds all stay; other columns pass through.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sessionlake.session import stage

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: that it cannot shows at the run's start.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
NEAR = 6  # terms on each side of an entity
REACH = 64 * NEAR  # characters in which they are looked for
THRESHOLD = 0.75
HELD_TERMS = 1_000_000  # distinct terms a task counts before it hands them on

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """The check digit rule of card numbers."""
    odd = sum(int(d) for d in digits[-1::-2])
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of LOCAL characters, an at sign and a domain, in linear time: an
    address is looked for from its at sign to both sides."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        done = domain.end() if domain else done
        if domain:
            yield start, done
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Personal data by kind, then place; a match that fails its check is dropped."""
    spans: list[Span] = []
    if "@" in text:
        spans += [("email", *span) for span in emails(text)]
    if not DIGIT.search(text):
        return spans
    if "." in text:
        spans += [
            ("ip", *m.span())
            for m in IP.finditer(text)
            if all(int(part[-4:]) <= 255 and not part[:-4].strip("0") for part in m[0].split("."))
        ]
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [
            ("phone", *m.span())
            for m in PHONE.finditer(text)
            if 9 <= len(digits_of(m[0])) <= 15
        ]
    return spans


def entity_of(kind: str, found: str) -> str:
    """The same number or address however it is written."""
    return f"{kind}:{found.lower() if kind in ('email', 'ip') else digits_of(found)}"


def merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if ends and start <= ends[-1]:
            ends[-1] = max(end, ends[-1])
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def near_terms(text: str, span: Span, covered: tuple[list[int], list[int]]) -> list[re.Match]:
    """Up to NEAR terms on each side, within REACH characters, outside personal data."""
    starts, ends = covered

    def whole(m: re.Match, low: int, high: int) -> bool:
        if m.start() == low and low and text[low - 1].isalpha():
            return False
        if m.end() == high and high < len(text) and text[high].isalpha():
            return False
        at = bisect_right(starts, m.end() - 1) - 1
        return at < 0 or ends[at] <= m.start()

    def inside(low: int, high: int) -> list[re.Match]:
        return [m for m in TERM.finditer(text, low, high) if whole(m, low, high)]

    before = inside(max(0, span[1] - REACH), span[1])
    return before[-NEAR:] + inside(span[2], min(len(text), span[2] + REACH))[:NEAR]


SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
    ]
)
_NEAR_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("entity", T.StringType()),
            T.StructField("term", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
)
FOUND = T.StructType([T.StructField("spans", T.ArrayType(SPAN)), T.StructField("near", _NEAR_TYPE)])
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_NEAR_ARROW = pa.list_(
    pa.struct(
        [("entity", pa.string()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
    )
)
_FOUND_ARROW = pa.struct([("spans", _SPANS_ARROW), ("near", _NEAR_ARROW)])


def _find(text: str | None) -> dict:
    text = text or ""
    spans = base_spans(text)
    if not spans:
        return {"spans": [], "near": []}
    covered, found, near = merged(spans), [], []
    for span in spans:
        kind, start, end = span
        entity = entity_of(kind, text[start:end])
        found.append({"kind": kind, "entity": entity, "start": start, "end": end})
        for m in near_terms(text, span, covered):
            term = {"entity": entity, "term": m[0].lower(), "start": m.start(), "end": m.end()}
            near.append(term)
    return {"spans": found, "near": near}


def with_entities(documents: DataFrame, name: str) -> DataFrame:
    """``documents`` with their base spans, and the terms near them by entity."""
    schema = T.StructType([*documents.schema.fields, T.StructField(name, FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_find(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, _FOUND_ARROW)], [*batch.schema.names, name]
            )

    return documents.mapInArrow(run, schema)


def term_documents(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, with_term): in how many documents each ``wanted`` term stands."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
            ["term", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(set(TERM.findall((text or "").lower())))
                if len(counts) > HELD_TERMS:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    counts = documents.select("text").mapInArrow(run, "term string, n bigint")
    total = counts.groupBy("term").agg(F.sum("n").alias("with_term"))
    return total.join(wanted, "term", "left_semi")


def disclosing(found: DataFrame, documents: DataFrame, threshold: float) -> DataFrame:
    """(entity, term, share) where the term gives away enough of the entity."""
    total = found.count()
    near = found.select("row", F.explode("found.near").alias("e")).select("row", "e.entity", "e.term")
    both = near.distinct().groupBy("entity", "term").agg(F.count("*").alias("with_both"))
    both = stage(both, "near_pairs")
    entities = (
        found.select("row", F.explode("found.spans.entity").alias("entity"))
        .distinct()
        .groupBy("entity")
        .agg(F.count("*").alias("with_entity"))
    )
    terms = term_documents(documents, both.select("term").distinct())
    information = F.log(F.lit(float(total)) / F.col("with_entity"))
    mutual = F.log(
        F.col("with_both") * F.lit(float(total)) / (F.col("with_term") * F.col("with_entity"))
    )
    return (
        both.join(entities, "entity")
        .join(terms, "term")
        .where((information > 0) & (mutual >= threshold * information))
        .select("entity", "term", (mutual / information).alias("share"))
    )


def find_personal_data(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row, doc_id, base, terms): spans as arrays of (kind, start, end)."""
    texts = documents.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return _find_in(with_entities(texts, "found").drop("text"), documents, threshold)


def _find_in(entities: DataFrame, documents: DataFrame, threshold: float) -> DataFrame:
    found = stage(entities, "entities")
    gives_away = disclosing(found, documents, threshold)
    near = found.select("row", F.explode("found.near").alias("e")).select("row", "e.*")
    term = F.struct(F.lit("term").alias("kind"), "start", "end", "share")
    terms = (
        near.join(gives_away, ["entity", "term"])
        .groupBy("row", "start", "end")
        .agg(F.max("share").alias("share"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(term)).alias("terms"))
    )
    base = F.transform("found.spans", lambda s: F.struct(s["kind"], s["start"], s["end"]))
    return found.join(terms, "row", "left").select(
        "row",
        "doc_id",
        base.alias("base"),
        F.coalesce("terms", F.array().cast(terms.schema["terms"].dataType)).alias("terms"),
    )


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def digests(found: DataFrame) -> DataFrame:
    base, terms = spans_text(F.col("base")), spans_text(F.col("terms"))

    def count(kind: str) -> Column:
        of_kind = F.filter("base", lambda s: s["kind"] == kind)
        return F.size(of_kind).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(kind) for kind in KINDS),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(terms, F.lit(""))).alias("spans"),
        F.size("terms").cast("bigint").alias("n_terms"),
    )


def shape(term: str) -> str:
    """What a term is generalised to: a name-like or a plain word."""
    return "[name]" if term[:1].isupper() else "[word]"


def sanitised(text: str, spans: list[Span], shares: list[float]) -> str:
    """``text`` with its spans generalised; a term that discloses all is removed."""
    out, done = [], 0
    for (kind, start, end), share in sorted(zip(spans, shares), key=lambda x: (x[0][1], -x[0][2])):
        if start < done:  # inside a span already replaced; keep nothing of it
            done = max(done, end)
            continue
        out.append(text[done:start])
        out.append(f"[{kind}]" if kind != "term" else "" if share >= 1 else shape(text[start:end]))
        done = end
    return "".join([*out, text[done:]])


def sanitise(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with personal data and disclosing terms taken out of ``text``."""
    held = stage(documents.withColumn("__row", F.monotonically_increasing_id()), "documents")
    texts = held.select("doc_id", "text", F.col("__row").alias("row"))
    found = _find_in(with_entities(texts, "found").drop("text"), held, threshold)
    spans = found.select(
        F.col("row").alias("__row"), F.col("base").alias("__base"), F.col("terms").alias("__terms")
    )
    joined = held.join(spans, "__row", "left")
    schema = joined.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, base, terms in zip(
                *(batch.column(c).to_pylist() for c in ("text", "__base", "__terms"))
            ):
                every = [*(base or ()), *(terms or ())]
                spans = [(s["kind"], s["start"], s["end"]) for s in every]
                shares = [s.get("share", 1.0) for s in every]
                texts.append(text if not text else sanitised(text, spans, shares))
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.column(at).type))

    return joined.mapInArrow(run, schema).select(*documents.columns)
