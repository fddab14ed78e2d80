"""From raw documents to binary training data: filter, de-duplicate, decontaminate, mix, encode.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; between
stages the rows are written as Parquet to the shared folder and read again.

Any column may be null: a null text counts as empty, a document without an id is one like any other.
Further columns of documents are left behind by the first stage. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm.common import table
from shelfscope.llm.dart_minhash import first_of_each_class
from shelfscope.llm.decontam import clean_documents
from shelfscope.llm.mixing import mixed_documents
from shelfscope.llm.queries import END_ID, TOKENIZER
from shelfscope.llm.ranking import accepted_documents
from shelfscope.llm.token_store import document_keys, store_digest, write_store
from shelfscope.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts; equal texts are kept or dropped together, repeated rows stay repeated."""
    return accepted_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of exact and near copies: that of the smallest id, none before all others.

    Among rows of one id it is that of the smallest hash of the text, and one of equal rows. Documents without words all stay.
    """
    return first_of_each_class(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; those without words have none."""
    return clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that mixes the sources; files are named and rows stand in that order.

    Documents without a source are a source of their own; repeated rows all stay.
    """
    return mixed_documents(docs.select(*COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Store the ids in the order of the rows of the files, and read them back by key: doc_id, start, n_tokens, ids_crc32.

    Every row has its own result, repeated ones and those without an id too; an empty text has the end id alone.
    Documents that don't come straight from files, which only tests pass, are taken by doc_id.
    """
    order = ["file", "row"]
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        placed, order = docs.select("doc_id", "text"), None
    return store_digest(write_store(placed, TOKENIZER, END_ID, order), document_keys(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", encoding_stage),
]

ORACLE_SQL = None  # the stages learn, hash and encode: tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
