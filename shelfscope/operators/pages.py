"""Pages of a view by place: the view is put in order once, and each page then reads only its own rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.operators.views import view_order
from shelfscope.session import cut_lineage

PLACES_PER_FILE = 1_000_000


def with_places(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``place``, the row's zero-based number in the order.

    Rows are dealt into ranges of the order, sorted and written; each range is then shifted by the sizes of the
    ranges before. Only those sizes, one per range, come together.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut_lineage(dealt.withColumns({"_range": F.spark_partition_id(), "_row": row}))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(sizes.select("_range", before.alias("_before")))  # one row per range
    return ranged.join(shifts, "_range").withColumn("place", F.col("_before") + F.col("_row")).drop("_range", "_row", "_before")


def write_pages(view: DataFrame, order: str, path: str) -> None:
    """Keep a view (with its metrics) in one of the named orders, as files of a million places at most."""
    placed = with_places(view, view_order(order))
    placed.write.mode("overwrite").option("maxRecordsPerFile", PLACES_PER_FILE).parquet(path)


def read_page(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """``count`` rows from place ``first`` on, in order: files and row groups of other places are passed over."""
    rows = spark.read.parquet(path).filter((F.col("place") >= first) & (F.col("place") < first + count))
    return rows.coalesce(1).sortWithinPartitions("place")  # the rows of one page
