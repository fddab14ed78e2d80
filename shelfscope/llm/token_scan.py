"""Token counts of documents in flat files that have no index, only end-of-document ids.

Each file is searched in blocks. A block tells how many ids and ends it holds and where its last
end is; a prefix scan over these summaries, first within files and then over them, gives every
block its place and the start of the document that reaches into it.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import if_small, map_batches, map_partition, texts_of
from shelfscope.llm.tokens import encoder, read_id_files, width_for, write_id_files
from shelfscope.session import cut_lineage, scratch_path

END = 0  # in the files of this module the tokenizer's ids are raised by one, and 0 ends a document
BLOCK_IDS = 1 << 20
NAME = "<Hq"  # whether there is a doc_id, the doc_id; the files' end id follows


def flat_width(vocabulary: int) -> int:
    """Bytes of an id in these files: there is one more id than in the vocabulary."""
    return width_for(vocabulary + 1)


def write_flat_files(docs: DataFrame, tokenizer: str, folder: str) -> None:
    """Flat id files of all texts as the rows come, without a shuffle; null texts are empty.

    The ids go to ``kind=ids``. The rows' doc_ids go to ``kind=names`` in the same pass, file by file and row by
    row in the same order, so that counts can be given to documents; the id files don't depend on them.
    """
    spark = docs.sparkSession

    def encode(batch):
        one = encoder(tokenizer)
        kinds, values = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            raised = np.frombuffer(one(text), f"<u{one.width}").astype(f"<u{flat_width(one.size)}") + 1
            kinds += ["ids", "names"]
            values += [raised.tobytes(), struct.pack(NAME, doc_id is not None, doc_id or 0)]
        return {"kind": kinds, "ids": values}

    rows = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, "kind string, ids binary")
    setting = "spark.sql.maxConcurrentOutputFileWriters"  # both kinds are written at once: rows aren't sorted and keep their order
    before = spark.conf.get(setting)
    spark.conf.set(setting, "4")
    try:
        write_id_files(rows, folder, END, flat_width(encoder(tokenizer).size), by="kind")
    finally:
        spark.conf.set(setting, before)


def read_names(spark: SparkSession, folder: str, width: int) -> DataFrame:
    """doc_no, doc_id: the documents of flat files in file order."""
    record = np.dtype([("known", "<u2"), ("doc_id", "<i8"), ("end", f"<u{width}")])

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column("file_no").to_pylist(), batch.column("content")):
                found = np.frombuffer(content.as_buffer(), record)
                ids = pa.array(np.ascontiguousarray(found["doc_id"]), mask=found["known"] == 0)
                yield {"file_no": [name] * len(found), "record": np.arange(len(found)), "doc_id": ids}

    found = cut_lineage(map_partition(read_id_files(spark, f"{folder}/kind=names"), read, "file_no string, record long, doc_id long"))
    files = found.groupBy("file_no").agg(F.count(F.lit(1)).alias("n"))
    base = files.select("file_no", F.coalesce(F.sum("n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return found.join(if_small(cut_lineage(base)), "file_no").select((F.col("base") + F.col("record")).alias("doc_no"), "doc_id")


def scan_ends(spark: SparkSession, folder: str, end: int = END, width: int = 2, block: int = BLOCK_IDS) -> DataFrame:
    """Documents of flat files in file order: doc_no, start, n_tokens (without the end id), closed.

    A document is what lies between two ends; ids after the last end are one more document that isn't closed.
    No files, no rows.
    """
    dtype = f"<u{width}"

    def blocks(batches):
        for batch in batches:
            for name, content in zip(batch.column("file_no").to_pylist(), batch.column("content")):
                ids = np.frombuffer(content.as_buffer(), dtype)
                for no, first in enumerate(range(0, max(len(ids), 1), block)):
                    part = ids[first : first + block]
                    ends = np.flatnonzero(part == end).astype(np.int64)
                    yield {"file_no": [name], "block_no": [no], "n_ids": [len(part)], "ends": [ends]}

    found = cut_lineage(map_partition(read_id_files(spark, folder), blocks, "file_no string, block_no long, n_ids long, ends array<long>"))
    inside = Window.partitionBy("file_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    n_ends = F.size("ends").cast("long")
    earlier = lambda column: F.coalesce(F.sum(column).over(inside), F.lit(0))
    in_file = found.select("file_no", "block_no", "n_ids", n_ends.alias("n_ends"), F.try_element_at("ends", F.lit(-1)).alias("last")).select(
        "*", earlier(F.col("n_ids")).alias("ids_before"), earlier(F.col("n_ends")).alias("ends_before")
    )
    in_file = in_file.select("*", F.max(F.col("ids_before") + F.col("last")).over(inside).alias("last_before"))
    files = in_file.groupBy("file_no").agg(F.sum("n_ids").alias("file_ids"), F.sum("n_ends").alias("file_ends"), F.max(F.col("ids_before") + F.col("last")).alias("file_last"))
    over = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per file comes together
    files = files.select(
        "file_no",
        "file_ids",
        F.coalesce(F.sum("file_ids").over(over), F.lit(0)).alias("base_ids"),
        F.coalesce(F.sum("file_ends").over(over), F.lit(0)).alias("base_ends"),
        "file_last",
        "file_ends",
    )
    files = cut_lineage(files.withColumn("base_last", F.max(F.col("base_ids") + F.col("file_last")).over(over)))
    place = (
        in_file.join(if_small(files), "file_no")
        .select(
            "file_no",
            "block_no",
            (F.col("base_ids") + F.col("ids_before")).alias("first_id"),
            (F.col("base_ends") + F.col("ends_before")).alias("first_doc"),
            # the id after the last end before the block: where the document that reaches into it starts
            F.coalesce(F.col("base_ids") + F.col("last_before") + 1, F.col("base_last") + 1, F.lit(0)).alias("open_from"),
        )
    )
    each = found.join(place, ["file_no", "block_no"]).select("first_id", "first_doc", "open_from", "ends", F.posexplode("ends").alias("k", "pos"))
    ended = F.col("first_id") + F.col("pos")
    start = F.when(F.col("k") == 0, F.col("open_from")).otherwise(F.col("first_id") + F.try_element_at("ends", F.col("k")) + 1)
    closed = each.select((F.col("first_doc") + F.col("k")).alias("doc_no"), start.alias("start"), (ended - start).alias("n_tokens"), F.lit(True).alias("closed"))
    total = files.agg(F.sum("file_ids").alias("ids"), F.sum("file_ends").alias("ends"), F.max(F.col("base_ids") + F.col("file_last")).alias("last"))
    rest = F.coalesce(F.col("last") + 1, F.lit(0))
    left_open = total.filter(F.col("ids") > rest).select(F.col("ends").alias("doc_no"), rest.alias("start"), (F.col("ids") - rest).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(left_open)


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: doc_id, doc_no (its place in the files), start, n_tokens, by writing flat files and scanning them for ends.

    Every row has its own result, repeated rows and rows without an id too. Null and empty texts have no
    tokens. Places follow the rows as Spark reads them. Further columns are ignored.
    """
    spark = docs.sparkSession
    folder, width = scratch_path(spark, "flat"), flat_width(encoder(tokenizer).size)
    write_flat_files(docs, tokenizer, folder)
    scanned = scan_ends(spark, f"{folder}/kind=ids", END, width)
    return read_names(spark, folder, width).join(scanned, "doc_no").select("doc_id", "doc_no", "start", "n_tokens")
