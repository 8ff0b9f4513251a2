"""Registered queries of the operators, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmetric.llm import (chat, extraction, hilbert, jaccard, licenses, lines, mixing, phrases, secrets, spelling,
                           spotsigs, tiling, toxicity)
from lexmetric.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size",
                       (F.round(F.col("target") * 1e6) / 1e6).alias("target"), "taken")


ORACLE["op5_mix_sources"] = mixing.MIX_SQL.replace("{docs}", "documents") + """
SELECT doc_id, size, CAST(ssize AS BIGINT) AS source_size,
       round(target * 1e6) / 1e6 AS target, copies * size AS taken FROM k"""


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = secrets.scan(docs, secrets.train(secrets.labelled_strings(docs)))
    kinds = [secrets.count_kind(F.col("base"), k).alias(f"n_{k}") for k, *_ in secrets.BASE]
    return rows.select("doc_id", *kinds,
                       F.sha2(secrets.render(F.col("base")), 256).alias("base_sha256"),
                       secrets.render(F.col("found")).alias("spans"))


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "cosines")


@query
def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hilbert.assign(table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "cell")


@query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), k=4, num=85, den=100).select(
        "doc_id", "n_shingles", "component_id", "n_links")


@query
def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.fit(pages))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "pages"))


ORACLE["op2_line_dedup"] = lines.dedup_sql()


@query
def op4_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


ORACLE["op11_spelling"] = spelling.VARIANTS_SQL


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLE["op12_collocations"] = phrases.COLLOCATIONS_SQL


@query
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                       F.array_join("base_labels", ",").alias("base_labels"),
                       F.array_join("labels", ",").alias("labels"), "score",
                       F.array_join(F.transform("spans", lambda s: F.concat_ws(
                           ":", s["label"], s["start"], s["end"], s["edits"])), ",").alias("spans"))
