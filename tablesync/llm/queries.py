"""The operators as registered queries over the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.llm import bpe, chat, exact, lines, mixing, near, oracles, piece, ppm, quality, repair, search, secret_scan, warc
from tablesync.llm.common import sha256, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {
    "op2_chat_format": oracles.CHAT_FORMAT,
    "op4_line_dedup": oracles.LINE_DEDUP,
    "op8_quality_rules": oracles.QUALITY_RULES,
    "op9_near_dedup": oracles.NEAR_DEDUP,
    "op10_exact_dedup": oracles.EXACT_DEDUP,
    "op11_repair": oracles.CONVERSATION_REPAIR,
    "op12_ranked_search": oracles.RANKED_SEARCH,
}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", sha256(F.col("text")).alias("kept_sha256")
    )


@_query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.judge(docs).drop("k1", "k2")


@_query
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near.near_components(docs, near.Likeness(shingle=2)).drop("k1", "k2")


@_query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.taken(mixing.copies(docs)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@_query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.decoded(bpe.encode(docs, path), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    )


@_query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.copies(docs).drop("k1", "k2").withColumnRenamed("digest", "text_sha256")


@_query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.explode(F.array(F.lit("user"), F.lit("assistant")))
    tricky = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"), roles.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    tricky = tricky.withColumn("turn", (F.col("role") == "assistant").cast("long"))
    return chat.summaries(chat.examples(given.unionByName(tricky)))


@_query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    samples = secret_scan.samples_by_rule(spark).unionByName(secret_scan.ordinary_samples(docs))
    return secret_scan.digests(secret_scan.scan(docs, secret_scan.train(samples)))


@_query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = ppm.train(docs.filter(~held_out))
    return ppm.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.read_archives(warc.write_archives(pages)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to")
    )


@_query
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), check=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
        "agrees",
    )


@_query
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.summaries(given, repair.repair(repair.damaged(given)))


@_query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return search.search(search.build_index(docs), items, k=50)
