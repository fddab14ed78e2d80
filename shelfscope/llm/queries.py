"""One query per operator over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import byte_bpe, decontam, licenses, runs, secrets
from shelfscope.llm.common import table
from shelfscope.llm.dart_minhash import near_duplicates
from shelfscope.llm.langid import identify_languages
from shelfscope.llm.mixing import mix_sources
from shelfscope.llm.ranking import classify_quality
from shelfscope.llm.rules import COUNTS, quality_rules
from shelfscope.llm.token_scan import count_tokens
from shelfscope.llm.token_store import document_keys, store_digest, write_store
from shelfscope.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return add


@query("op1_license_scan", licenses.oracle())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", licenses.derived_path().alias("path"), "text")
    return licenses.scan_licenses(docs).withColumn("cosine", F.round("cosine", 6))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), TOKENIZER).select("doc_id", "n_tokens")


@query("op4_source_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "block", "slot", "start")


@query("op5_quality_ranking")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_secret_scan", secrets.oracle())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query("op7_token_store")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return store_digest(write_store(docs, TOKENIZER, END_ID), document_keys(docs))


@query("op8_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_first")


@query("op9_decontamination", decontam.ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_digest(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", F.round("anomaly", 6).alias("anomaly"))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


@query("op12_byte_level_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoding_digest(byte_bpe.decode_ids(byte_bpe.encode_texts(table(spark, sf_dir, "documents"), RANKS), RANKS))


def with_made_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the ids, by hash, have their words repeated with a period from some word on (the query's contract)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(words):  # a function of the array, so that it is made once per row
        n = F.size(words).cast("long")
        first = F.pmod(g, n)
        period = F.floor((n - first) / (F.lit(3) + F.pmod(g, F.lit(8)))) + 1
        place = lambda i: F.when(i < first, i).otherwise(first + F.pmod(i - first, period)).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i))), " "))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    made = F.transform(F.array(words), repeated)[0]
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(made, F.lit(""))).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(runs.find_runs(with_made_periods(table(spark, sf_dir, "documents"))))
