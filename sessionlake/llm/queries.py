"""Queries of the training-data operators over the given tables, with SQL where it can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionlake.llm import (
    decontaminate,
    filter_audit,
    language,
    line_dedup,
    merkle,
    packing,
    pii,
    sentence_pieces,
    simhash,
    token_file,
    top_k,
    toxicity,
    url_filter,
)
from sessionlake.session import staging_root

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = language.is_held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(documents, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(documents, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op2_url_filter(spark, sf_dir):
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op3_decontaminate(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(documents, table(spark, sf_dir, "benchmark"))
    return decontaminate.digests(found)


@query
def op4_language(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    held_out = language.is_held_out(F.col("doc_id"), 4, 2)
    model = language.fit(documents.where("doc_id IS NOT NULL").where(~held_out))
    found = language.predict(documents.select("doc_id", "text"), model, "lang_pred", "score")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op5_token_file(spark, sf_dir):
    folder = f"{staging_root(spark)}/sessionlake/{uuid.uuid4().hex}/token_ids"
    token_file.write(table(spark, sf_dir, "documents"), folder)
    return token_file.read(spark, folder)


@query
def op6_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


ORACLES["op6_top_k"] = top_k.SQL


@query
def op7_line_dedup(spark, sf_dir):
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


ORACLES["op7_line_dedup"] = line_dedup.SQL


@query
def op8_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048)


@query
def op9_pii(spark, sf_dir):
    return pii.digests(pii.find_personal_data(table(spark, sf_dir, "documents")))


@query
def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)


@query
def op11_merkle(spark, sf_dir):
    doc_id = F.col("doc_id").cast("string")
    tampered = F.crc32(doc_id) % 5 == 0
    documents = table(spark, sf_dir, "documents")
    found = merkle.manifest(documents, tampered, merkle.lower_ascii(F.col("text")))
    return merkle.verify(found)


ORACLES["op11_merkle"] = merkle.SQL


@query
def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = filter_audit.SQL


@query
def op13_sentence_pieces(spark, sf_dir):
    encoded = sentence_pieces.encode(table(spark, sf_dir, "documents"))
    return sentence_pieces.digests(sentence_pieces.decode(encoded))
