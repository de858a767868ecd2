"""Very long runs, large numbers and clashing names."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sessionlake.llm import decontaminate, language, pii, top_k, toxicity, url_filter

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
UNSEEN = re.compile(r"<(script|style)\b.*?</\1>|<[^>]*>", re.DOTALL | re.IGNORECASE)


def test_linear_patterns_find_what_plain_ones_find():
    rng = random.Random(4)
    for _ in range(4000):
        size = rng.randint(1, 24)
        text = "".join(rng.choice("a1.@_- ") for _ in range(size))
        assert list(pii.emails(text)) == [m.span() for m in EMAIL.finditer(text)]
        text = "".join(rng.choice("12.. a") for _ in range(size))
        assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in IP.finditer(text)]
        tags = ("<script", "</script>", "<STYLE", "</style>", "<", ">", "a", "<b>", " ")
        text = "".join(rng.choice(tags) for _ in range(size))
        assert url_filter.visible(text) == UNSEEN.sub(" ", text)


@pytest.mark.parametrize("text", ["a" * 10**6 + " x@y.zz", "1" * 10**6 + ".2", "a." * 10**6, "1." * 10**6, "@" * 10**6])
def test_long_runs_take_linear_time(text):
    begin = time.perf_counter()
    spans = pii.base_spans(text)
    url_filter.visible("<script " * 10**5 + text)
    assert time.perf_counter() - begin < 20
    assert [kind for kind, *_ in spans if kind == "email"] == ["email"] * ("x@" in text)


def test_urls_with_long_names(spark):
    name = "theword" * 6000
    rows = [(1, f"http://{name}.org/a", "<p>the word the word</p>"), (2, "http://example.com/en/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    words = url_filter.segment(pages.selectExpr(f"'{name}' AS name").limit(1), url_filter.word_counts(pages))
    assert words.first()["words"] == ["the", "word"] * 6000
    assert {r.page_id: r.rule for r in url_filter.judge_urls(pages).collect()} == {1: None, 2: "example.com/en/"}


def test_products_beyond_double_precision(spark):
    rows = [(0, [1e6, 1 / 256])] + [(i, [1e6, i / 256]) for i in range(1, 9)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = top_k.top_k(vectors, F.col("vec_id") == 0, k=5).orderBy("rank").collect()
    base = (256 * 10**6) ** 2
    assert [(r.vec_id, r.score) for r in found] == [(i, base + i) for i in (8, 7, 6, 5, 4)]
    small = spark.createDataFrame([(0, [1e6, 1.0]), (1, [3.0, 0.5]), (2, [3.0, 0.25])], vectors.schema)
    assert [r.vec_id for r in top_k.top_k(small, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]


def test_new_columns_replace_those_of_their_names(spark, odd):
    labels = spark.createDataFrame([(1, 1), (8, 0)], "doc_id long, toxic int")
    scored = toxicity.score(odd, toxicity.fit(odd, labels))
    assert scored.columns.count("score") == 1 and scored.select("score").count() == odd.count()
    told = language.predict(odd, language.fit(odd), "lang", "text")
    assert sorted(told.columns) == sorted(odd.columns)
    assert {r.lang for r in told.where("doc_id = 8").collect()} == {"fr"}
    items = spark.createDataFrame([(1, "the cat sat")], "item_id long, text string")
    renamed = odd.withColumnRenamed("row", "contamination")
    assert decontaminate.digests(decontaminate.find_contamination(renamed, items)).count() == odd.count()
    pages = odd.selectExpr("doc_id AS page_id", "'http://a.com/x' AS url", "text AS html", "score", "row AS host", "fp AS signature")
    judged = url_filter.judge_urls(pages)
    assert judged.columns == ["page_id", "url", "host", "path", "rule", "verdict", "score"]
    assert {r.host for r in judged.collect()} == {"a.com"}
