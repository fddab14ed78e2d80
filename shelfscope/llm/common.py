"""What the operators share: tables, Python code on executors, id splits, running positions."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

import shelfscope
from shelfscope.session import cut_lineage

#: Rows and bytes that one Arrow batch hands to Python: bounds a worker's memory, very long texts included.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20

#: A table of (id, hash, few values) with at most this many rows, some 20 MB, may be sent to all executors.
BROADCAST_ROWS = 200_000

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package, wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(shelfscope.__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("shelfscope", os.path.relpath(path, top)))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "shelfscope.zip")  # the driver's; Spark serves it to executors
    with open(path, "wb") as out:
        out.write(packed.getvalue())
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], dict[str, object] | None], schema: str | T.StructType) -> DataFrame:
    """Apply ``function`` to each Arrow batch; it returns the output columns by name (or None for no rows)."""
    return map_partition(df, lambda batches: (function(x) for x in batches), schema)


def map_partition(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, object] | None]], schema: str | T.StructType) -> DataFrame:
    """The same with an iterator over all batches of a partition."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    arrow = to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches):
        for columns in function(batches):
            if columns is not None:
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(divisor))


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """A label per doc_id: repeated and conflicting rows count as their smallest value; nulls drop out."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(column).cast("int").alias("label"))
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text_hash, text and label of the documents of at most ``rows`` ids, the same ones in a repeated run.

    The label rows are drawn by a hash of their id; as there are at most ``rows`` of them they are sent to all
    executors. ``labels`` has doc_id and label, one row per id.
    """
    drawn = first_by_hash(labels, "doc_id", rows)
    return keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).join(F.broadcast(drawn), "doc_id")


def one_per_id(sample: DataFrame) -> list:
    """The rows of a sample (doc_id, text_hash and what was taken from the text), one per id: that of the smallest hash."""
    rest = [c for c in sample.columns if c != "doc_id"]
    return [r.row for r in sample.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row")).collect()]


def first_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of the smallest hash of ``key``: a bounded sample that a repeated run draws again."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def literal_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A small fixed table that is part of the plan."""
    fields = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows])
    return spark.range(1).select(F.inline(fields))


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for sending to all executors if it has few rows; beyond that Spark joins it by key."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key with over this share of all rows is hot; so there are at most HOT_KEYS of them, whatever the data.
HOT_KEYS = 1_000


def join_to_owner(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Join (inner) rows to the one row of ``owners`` (narrow) per key, without bringing the rows of a hot key together.

    ``owners``, a written table, has the number of rows of its key as ``_rows``. Hot keys, at most HOT_KEYS by their
    definition, are sent to all executors with what belongs to them; the other rows are joined by key. ``rows``
    should be cheap to read twice; null keys meet none.
    """
    size, total = owners.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    if size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(owners.drop("_rows")), key)
    is_hot = F.col("_rows") * HOT_KEYS > total
    hot, rest = owners.filter(is_hot).drop("_rows"), owners.filter(~is_hot).drop("_rows")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def keyed(docs: DataFrame) -> DataFrame:
    """Add text_hash, which with doc_id names a row; rows equal in both have the same text and the same results."""
    return docs.withColumn("text_hash", F.xxhash64("text"))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, and the whole row as ``row``, so that no column of it can clash with an operator's."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def join_by_key(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Join rows found per (doc_id, text_hash), at most one each, to keyed documents; null ids meet null ids."""
    other = found.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    match = docs.doc_id.eqNullSafe(other._id) & (docs.text_hash == other._hash)
    return docs.join(if_small(other), match, how).drop("_id", "_hash")


def label_scores(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Scored rows (doc_id, text_hash, scores) of labelled ids with their ``label``, one row per id: that of the smallest hash.

    ``labels`` has doc_id and label, one row per id. Rows of an id are combined before they are shuffled.
    """
    rest = [c for c in scored.columns if c != "doc_id"]
    first = scored.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row"))
    return first.join(labels, "doc_id").select("doc_id", "row.*", "label")


def sums_by_score(labelled: DataFrame, score: str) -> DataFrame:
    """Per distinct value of ``score``: ``good`` and ``bad`` labels of all rows up to and with it (written table).

    Values are dealt into ranges, each summed by itself and shifted by the totals of the ranges before.
    """
    counts = labelled.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"))
    placed = cut_lineage(counts.repartitionByRange("score").sortWithinPartitions("score").withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range comes together
    totals = placed.groupBy("_range").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    base = totals.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in "gb"])
    summed = placed.select("_range", "score", F.sum("good").over(inside).alias("good"), F.sum("bad").over(inside).alias("bad"))
    return cut_lineage(summed.join(if_small(base), "_range").select("score", (F.col("good") + F.col("g")).alias("good"), (F.col("bad") + F.col("b")).alias("bad")))


def running_position(df: DataFrame, order: list[str], weight: str | None = None, within: str | None = None) -> DataFrame:
    """Rows in the given order with ``position``: the sum of ``weight`` (1 if None) over all rows before, of the same ``within`` if given.

    Rows are dealt into ranges and written once, so that every later read sees the same ranges; each range is
    summed by itself and shifted by the totals of the ranges before. Only those totals, one row per range and
    value of ``within``, come together. Ties in ``order`` get positions one after another.
    """
    keys = [within, *order] if within else order
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut_lineage(ranged.withColumns({"_range": F.spark_partition_id(), "_row": row}))
    amount = F.col(weight) if weight else F.lit(1).cast("long")
    group = ["_range", within] if within else ["_range"]
    inside = F.sum(amount).over(Window.partitionBy(*group).orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - amount
    totals = placed.groupBy(*group).agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(within) if within else Window.partitionBy()
    base = totals.select(*group, (F.sum("_sum").over(earlier.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_sum")).alias("_base"))
    return placed.withColumn("position", inside).join(if_small(base), group).withColumn("position", F.col("position") + F.col("_base")).drop("_range", "_row", "_base")
