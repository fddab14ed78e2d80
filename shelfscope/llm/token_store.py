"""Token ids in shards with a minimal perfect hash index from document keys to places.

A shard is a flat id file (see ``tokens``) of records: a header (whether there is an id, the id,
the number of ids that follow) and the ids, the end id last. The index has a row per hash bucket
of some two thousand keys. Within a bucket, keys fall into small cells; each cell stores the
first pilot number that sends all its keys to free slots, until every slot holds one key. A slot
stores a fingerprint of its key, which tells other keys apart, and the key's place.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import if_small, map_batches, map_partition, running_position, texts_of
from shelfscope.llm.tokens import encoder, read_id_files, write_id_files
from shelfscope.session import cut_lineage, scratch_path

HEADER = "<HqI"  # whether there is an id, the id, the number of ids
HEADER_BYTES = struct.calcsize(HEADER)
BUCKET_KEYS = 2_000  # mean keys of a hash bucket
CELL_KEYS = 4  # mean keys of a cell
MOST_PILOTS = 1 << 22
SMALL_SHARDS = 500  # places of at most so many shards, some 80 kB each, are sent to all executors; beyond that shards are joined by name
PLACE = {"shard_no": "<u4", "record": "<u4", "offset": "<u8", "n_tokens": "<u4"}  # what a slot of the index says, and how it is packed
INDEX = "bucket long, n long, pilots binary, fingerprints binary, " + ", ".join(f"{c} binary" for c in PLACE)
NAMES = "file_no string, shard_no long, base long, base_record long"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _slots(a: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    return (_mix(a + pilot * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def perfect_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pilots of the cells so that n distinct keys (hashes a, b) fall on the slots 0..n-1, one each."""
    n = len(a)
    cells = max(1, -(-n // CELL_KEYS))
    cell = (b % np.uint64(cells)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    size = np.bincount(cell, minlength=cells)
    first = np.cumsum(size) - size
    taken, pilots = np.zeros(n, bool), np.zeros(cells, np.uint32)
    for c in np.argsort(-size, kind="stable"):
        if not size[c]:
            break
        keys = a[order[first[c] : first[c] + size[c]]]
        low, step = 0, 64
        while True:
            if low >= MOST_PILOTS:
                raise ValueError("keys of a bucket aren't distinct")
            at = _slots(keys[None, :], np.arange(low, low + step, dtype=np.uint64)[:, None], n)
            good = ~taken[at].any(axis=1)
            if size[c] > 1 and good.any():
                good[good] = (np.diff(np.sort(at[good], axis=1), axis=1) > 0).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                pilots[c], taken[at[k]] = low + k, True
                break
            low, step = low + step, min(step * 2, 4096)
    return pilots


def find_slots(a: np.ndarray, b: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    cell = (b % np.uint64(len(pilots))).astype(np.int64)
    return _slots(a, pilots[cell].astype(np.uint64), n)


def _fingerprint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (_mix(a ^ (b * np.uint64(0xD6E8FEB86659FD93))) >> np.uint64(32)).astype(np.uint32)


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    """Add the two key hashes and the bucket of (doc_id, copy)."""
    a, b = (F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.lit(0).cast("long")), F.col("doc_id").isNull(), F.col("copy")) for seed in (1, 2))
    return keys.withColumns({"a": a, "b": b}).withColumn("bucket", F.pmod(F.xxhash64("a", "b"), F.lit(buckets)))


@dataclass
class TokenStore:
    """A written store: shards of ids, the index, and the number of its buckets.

    ``index`` has bucket, n, pilots, fingerprints and the columns of PLACE, all but the first two packed, by slot.
    """

    spark: SparkSession
    folder: str
    buckets: int
    width: int

    def shards(self) -> DataFrame:
        return read_id_files(self.spark, f"{self.folder}/shards")

    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.folder}/index")

    def names(self) -> DataFrame:
        """shard_no, file_no, base: the files in order and the ids in all files before."""
        return self.spark.read.schema(NAMES).parquet(f"{self.folder}/names")

    def find(self, keys: DataFrame) -> DataFrame:
        """Places of distinct keys (doc_id, copy): doc_id, copy, shard_no, record, offset (bytes), n_tokens.

        Keys that the store doesn't hold have no row, but for one in four billion that has another's fingerprint.
        """

        def look(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(index):
                return pd.DataFrame({c: [] for c in ["doc_id", "copy", *PLACE]})
            row = index.iloc[0]
            a, b = (asked[c].to_numpy(np.int64).view(np.uint64) for c in ("a", "b"))
            at = find_slots(a, b, np.frombuffer(row.pilots, "<u4"), int(row.n))
            there = np.frombuffer(row.fingerprints, "<u4")[at] == _fingerprint(a, b)
            found = asked.loc[there, ["doc_id", "copy"]].copy()
            for name, kind in PLACE.items():
                found[name] = np.frombuffer(row[name], kind)[at[there]].astype(np.int64)
            return found

        asked = _hashed(keys.select("doc_id", F.col("copy").cast("long").alias("copy")), self.buckets)
        asked = asked.select(F.col("doc_id").cast("string").alias("doc_id"), "copy", "a", "b", "bucket")  # pandas has no null integer
        found = asked.groupBy("bucket").cogroup(self.index().groupBy("bucket")).applyInPandas(look, "doc_id string, copy long, " + ", ".join(f"{c} long" for c in PLACE))
        return found.withColumn("doc_id", F.col("doc_id").cast("long"))

    def read(self, keys: DataFrame) -> DataFrame:
        """Documents of distinct keys: doc_id, copy, start (ids of all documents before), n_tokens, ids (little-endian, four bytes each).

        Places are gathered by shard (a shard has at most RECORDS_PER_FILE) and cut out where the shard is read.
        """
        width = self.width

        def cut(batches):
            for batch in batches:
                for content, base, wanted in zip(batch.column("content"), batch.column("base").to_pylist(), batch.column("wanted").to_pylist()):
                    raw = memoryview(content.as_buffer())
                    for some in range(0, len(wanted), 64):
                        rows = wanted[some : some + 64]
                        yield {
                            "doc_id": [r["doc_id"] for r in rows],
                            "copy": [r["copy"] for r in rows],
                            "start": [base + (r["offset"] - HEADER_BYTES * (r["record"] + 1)) // width for r in rows],
                            "n_tokens": [r["n_tokens"] for r in rows],
                            "ids": [np.frombuffer(raw, f"<u{width}", r["n_tokens"], r["offset"]).astype("<u4").tobytes() for r in rows],
                        }

        places = self.find(keys).groupBy("shard_no").agg(F.collect_list(F.struct("doc_id", "copy", "record", "offset", "n_tokens")).alias("wanted"))
        named = places.join(if_small(self.names()), "shard_no").select("file_no", "base", "wanted")
        rows = self.shards().join(if_small(named, SMALL_SHARDS), "file_no").select("content", "base", "wanted")
        return map_partition(rows, cut, "doc_id long, copy long, start long, n_tokens long, ids binary")


def write_store(docs: DataFrame, tokenizer: str, end: int, order: list[str] | None = None) -> TokenStore:
    """Encode all texts, write them in the given order (ascending doc_id if None; ties by a hash of the text), and index them.

    The key of a document is its id and its copy number: 0 for the first row of that id in the order, and so on;
    rows without an id are copies of one key, and come first. Null texts are empty; each document has the end id
    at least. Columns besides doc_id, text and the order's are ignored.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "store")
    one = encoder(tokenizer)
    order = ["doc_id"] if order is None else order
    rows = docs.withColumn("text_hash", F.xxhash64("text")).repartitionByRange(*order, "text_hash").sortWithinPartitions(*order, "text_hash")

    def encode(batch):
        own = encoder(tokenizer)
        records = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            ids = own(text)
            records.append(struct.pack(HEADER, doc_id is not None, doc_id or 0, len(ids) // own.width + 1) + ids)
        return {"ids": records}

    write_id_files(map_batches(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, "ids binary"), f"{folder}/shards", end, one.width)

    entries = cut_lineage(_entries(read_id_files(spark, f"{folder}/shards"), one.width))
    over = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row per file comes together
    files = entries.groupBy("file_no").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("records"))
    names = files.select(
        "file_no",
        (F.row_number().over(Window.orderBy("file_no")) - 1).cast("long").alias("shard_no"),
        F.coalesce(F.sum("tokens").over(over), F.lit(0)).alias("base"),
        F.coalesce(F.sum("records").over(over), F.lit(0)).alias("base_record"),
    )
    names.write.parquet(f"{folder}/names")
    names = spark.read.schema(NAMES).parquet(f"{folder}/names")
    placed = entries.join(if_small(names), "file_no").withColumn("place", F.col("base_record") + F.col("record"))
    keys = running_position(placed.withColumn("_key", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), ["place"], within="_key")
    n = entries.count()
    buckets = max(1, -(-n // BUCKET_KEYS))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        a, b = (group[c].to_numpy(np.int64).view(np.uint64) for c in ("a", "b"))
        pilots = perfect_hash(a, b)
        by_slot = np.argsort(find_slots(a, b, pilots, len(a)))
        packed = {c: [group[c].to_numpy()[by_slot].astype(kind).tobytes()] for c, kind in PLACE.items()}
        return pd.DataFrame({"bucket": [group.bucket.iloc[0]], "n": [len(a)], "pilots": [pilots.astype("<u4").tobytes()], "fingerprints": [_fingerprint(a, b)[by_slot].astype("<u4").tobytes()]} | packed)

    hashed = _hashed(keys.withColumnRenamed("position", "copy"), buckets).select("bucket", "a", "b", *PLACE)
    index = hashed.groupBy("bucket").applyInPandas(build, INDEX)
    index.write.parquet(f"{folder}/index")
    return TokenStore(spark, folder, buckets, one.width)


def _entries(files: DataFrame, width: int) -> DataFrame:
    """file_no, record, doc_id, offset, n_tokens of every record, read from the shards themselves."""

    def walk(batches):
        for batch in batches:
            for name, content in zip(batch.column("file_no").to_pylist(), batch.column("content")):
                raw, at, rows = memoryview(content.as_buffer()), 0, []
                while at < len(raw):
                    known, doc_id, n = struct.unpack_from(HEADER, raw, at)
                    at += HEADER_BYTES
                    rows.append((doc_id if known else None, at, n))
                    at += n * width
                if rows:
                    ids, offsets, counts = zip(*rows)
                    yield {"file_no": [name] * len(rows), "record": list(range(len(rows))), "doc_id": list(ids), "offset": list(offsets), "n_tokens": list(counts)}

    return map_partition(files, walk, "file_no string, record long, doc_id long, offset long, n_tokens long")


def document_keys(docs: DataFrame) -> DataFrame:
    """The keys under which a store holds ``docs``: doc_id, copy."""
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").count()
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("copy"))


def store_digest(store: TokenStore, keys: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of documents read back by key."""
    return store.read(keys).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
