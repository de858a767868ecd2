"""Decontamination, language, toxicity and personal data against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.llm import decontaminate, fm_index, language, pii, queries, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(documents, items, width=13):
    windows = {}
    for item, text in items:
        found = words(text)
        length = min(width, len(found))
        for at in range(len(found) - length + 1) if length else ():
            windows.setdefault(tuple(found[at : at + length]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    for doc_id, text in documents:
        found, hit, ids = words(text), set(), set()
        for length in lengths:
            for at in range(len(found) - length + 1):
                if tuple(found[at : at + length]) in windows:
                    hit.update(range(at, at + length))
                    ids |= windows[tuple(found[at : at + length])]
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        bad = len(hit) > 0 and 20 * len(hit) >= len(found)
        yield doc_id, len(found), len(hit), len(ids), digest, bad


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(1, 4, 300), np.tile([1, 2, 3, 1], 40)])
    index = fm_index.FMIndex(text, 4, sample=5)
    for length in (1, 2, 5, 9):
        phrases = np.array([text[a : a + length] for a in range(0, 300, 7)] + [[3] * length])
        phrase, place = index.occurrences(phrases)
        want = {
            (p, a)
            for p, ids in enumerate(phrases.tolist())
            for a in range(len(text) - length + 1)
            if text[a : a + length].tolist() == ids
        }
        assert set(zip(phrase.tolist(), place.tolist())) == want and len(phrase) == len(want)


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
@pytest.mark.parametrize("shard_words", [1 << 20, 50])
def test_decontamination(spark, block_bytes, shard_words):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    short = spark.createDataFrame([(900, "the that"), (901, None), (902, "!?")], benchmark.schema)
    every = benchmark.union(short)
    found = decontaminate.digests(
        decontaminate.find_contamination(
            documents, every, shard_words=shard_words, block_bytes=block_bytes
        )
    ).drop("spans")
    want = plain_hits(
        [(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in every.collect()]
    )
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_decontamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "The cat sat on the mat"), (None, "été")], "item_id long, text string")
    found = {(r.doc_id, r.n_words): r for r in decontaminate.digests(decontaminate.find_contamination(odd, items)).collect()}
    assert found[1, 6].contaminated and found[1, 6].n_hit == 6
    assert found[2, 0].n_hit == 0 and not found[2, 0].contaminated
    assert found[8, 6].items_sha256 == hashlib.sha256(b"null").hexdigest()
    kept = decontaminate.keep_clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == 9
    assert decontaminate.keep_clean(odd, items.where("false")).count() == odd.count()
    assert decontaminate.keep_clean(none, items).count() == 0


def test_language_of_held_out_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in documents.collect()}
    found = queries.op4_language(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(truth)
    assert all(0 <= r.score <= 1 for r in found)
    right = [r.lang_pred == truth[r.doc_id] for r in found if r.held_out]
    assert sum(right) / len(right) > 0.97


def test_language_backs_off_to_shorter_grams():
    rows = [("en", 0, "the", 5), ("fr", 0, "le", 5), ("en", 2, "th", 4), ("fr", 1, "é", 3)]
    model = language.Model(rows)
    scores, known = model.words(["the", "thx", "zé", "qq"])
    assert known.tolist() == [True, True, True, False]
    assert [model.langs[i] for i in scores.argmax(axis=1)[:3]] == ["en", "en", "fr"]


def test_language_of_odd_rows(odd, none):
    model = language.fit(odd)
    found = language.predict(odd, model, "lang_pred", "lang_score")
    assert found.columns == [*odd.columns, "lang_pred", "lang_score"]
    by_id = {r.doc_id: r for r in found.collect()}
    assert [by_id[i].lang_pred for i in (2, 3, 4, 7)] == ["und"] * 4 and by_id[2].lang_score == 0
    assert by_id[1].lang_pred == "en" and by_id[8].lang_pred == "fr"
    assert {r.lang_pred for r in language.predict(odd, language.fit(none), "lang_pred", "s").collect()} == {"und"}
    assert language.predict(none, model, "p", "s").count() == 0


def test_toxicity_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = queries.op1_toxicity(spark, sf_dir).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    caught = [r.predicted for r in held if truth[r.doc_id] == 1]
    flagged = [truth[r.doc_id] for r in held if r.predicted]
    assert sum(caught) / len(caught) > 0.8 and sum(flagged) / len(flagged) > 0.9


def test_gram_presence_counts_once_and_stays_in_its_text():
    every = np.ones(1 << toxicity.BUCKET_BITS, dtype=bool)
    rows, features = toxicity.present(["abcabc", "", "ab", "XYZé"], every)
    # abc bca cab, abca bcab cabc, abcab bcabc, abcabc; xyz yzé xyzé
    once = features >> toxicity.BUCKET_BITS == 0
    assert np.bincount(rows[once], minlength=4).tolist() == [9, 0, 0, 3]
    assert rows[~once].tolist() == [0]  # abc stands there twice


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (8, 0), (5, 0), (5, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    found = toxicity.score(odd, model, "p").collect()
    assert len(found) == odd.count() and all(0 <= r.p <= 1 for r in found)
    one_kind = toxicity.fit(odd, labels.where("toxic = 1"))
    assert all(r.p > 0.99 for r in toxicity.score(odd, one_kind, "p").collect())
    assert toxicity.score(none, toxicity.fit(none, labels.where("false")), "p").count() == 0


def plain_spans(text):
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m[0])
        odd, even = digits[-1::-2], digits[-2::-2]
        sums = sum(map(int, odd)) + sum(2 * int(d) - 9 * (int(d) > 4) for d in even)
        if 13 <= len(digits) <= 19 and sums % 10 == 0:
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return spans


CASES = [
    "a@b.c x@y @z. me@mail.example.com.", "1.2.3.4 256.1.1.1 001.02.3.4.5", "4111 1111-1111 1111",
    "4111111111111112", "+1 (555) 123-4567 +12", "+49 30 1234567 tel", "é a@b.de 😀 x@y.zz",
]


def test_base_spans_of_cases():
    for text in CASES:
        assert pii.base_spans(text) == plain_spans(text)


def plain_terms(texts, threshold=pii.THRESHOLD):
    """The whole method without Spark, for the terms of each text."""
    near, df, of_entity, both = [], {}, {}, {}
    for text in texts:
        spans = pii.base_spans(text)
        found = [
            (pii.entity_of(s[0], text[s[1] : s[2]]), m[0].lower(), *m.span())
            for s in spans
            for m in pii.near_terms(text, s, pii.merged(spans))
        ]
        near.append(found)
        for term in set(re.findall(r"[^\W\d_]{3,}", text.lower())):
            df[term] = df.get(term, 0) + 1
        for entity in {pii.entity_of(s[0], text[s[1] : s[2]]) for s in spans}:
            of_entity[entity] = of_entity.get(entity, 0) + 1
        for pair in {f[:2] for f in found}:
            both[pair] = both.get(pair, 0) + 1
    n = len(texts)
    for found in near:
        spans = set()
        for entity, term, start, end in found:
            information = np.log(n / of_entity[entity])
            mutual = np.log(both[entity, term] * n / (df[term] * of_entity[entity]))
            if information > 0 and mutual >= threshold * information - 1e-12:
                spans.add((start, end))
        yield sorted(spans)


def test_personal_data_of_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    found = {r.doc_id: r for r in queries.op9_pii(spark, SF).collect()}
    texts = [r.text or "" for r in rows]
    assert len(found) == len(rows)
    n_terms = 0
    for row, text, terms in zip(rows, texts, plain_terms(texts)):
        got, base = found[row.doc_id], plain_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        every = [joined] * bool(base) + [f"term:{a}:{b}" for a, b in terms]
        assert got.spans == ",".join(every)
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [
            sum(s[0] == k for s in base) for k in pii.KINDS
        ]
        n_terms += len(terms)
    assert n_terms


def test_sanitised_text(spark, odd, none):
    assert pii.sanitised("ask Zora at z@a.bc now", [("term", 4, 8), ("email", 12, 18)], [0.8, 1]) == "ask [name] at [email] now"
    assert pii.sanitised("ask Zora now", [("term", 4, 8)], [1.0]) == "ask  now"
    out = pii.sanitise(odd)
    assert out.columns == odd.columns
    assert sorted(map(repr, out.select("doc_id", "text").collect())) == sorted(map(repr, odd.select("doc_id", "text").collect()))
    assert pii.digests(pii.find_personal_data(none)).count() == 0
    with_mail = odd.withColumn("text", F.concat("text", F.lit(" write to ann@b.cd please")))
    assert spark.createDataFrame([], odd.schema).count() == 0 and pii.sanitise(with_mail).count() == odd.count()
