"""Price series kept up to date run by run, instead of being computed from the whole history each time.

``{kept}/lowest`` and ``{kept}/shops`` hold the last runs of every product, in folders by a hash of the product. A run that
is added reads itself and the folders its products are in. ``{kept}/runs`` names the runs that were added; it is written
before a run is applied, so that a run that comes again, also after a failure half-way, is seen as such: its products are
then computed anew from the history, as a changed run may bring back points that were cut before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope import fixed_values as fixed
from shelfscope.operators import history as Hi
from shelfscope.session import cut_lineage, if_there

BUCKETS = 64
LOWEST_DDL = "canonical_key string, run_ts timestamp_ntz, p double"
SHOP_DDL = (
    "canonical_key string, platform string, run_ts timestamp_ntz, precio double, descuento_pct double, "
    "promo_etiqueta string, precio_efectivo double"
)
RUNS_DDL = "run_ts timestamp_ntz, buckets int"

# Folder -> columns, how a series is made from observations, what a series is of, and how many runs of it are kept.
KINDS = {
    "lowest": (LOWEST_DDL, Hi.lowest_prices, ["canonical_key"], fixed.HISTORY_RUNS),
    "shops": (SHOP_DDL, Hi.shop_prices, ["canonical_key", "platform"], fixed.DETAIL_RUNS),
}


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def added_runs(spark: SparkSession, kept: str) -> DataFrame:
    return if_there(spark, lambda: spark.read.schema(RUNS_DDL).parquet(f"{kept}/runs"), RUNS_DDL)


def _table(spark: SparkSession, kept: str, kind: str) -> DataFrame:
    """All rows with their bucket; a row without a product only marks a bucket that may be empty."""
    ddl = KINDS[kind][0] + ", bucket int"
    return if_there(spark, lambda: spark.read.schema(ddl).parquet(f"{kept}/{kind}"), ddl)


def _one_of(runs: list) -> Column:
    return F.expr("run_ts IN (" + ", ".join(f"TIMESTAMP_NTZ'{t:%Y-%m-%d %H:%M:%S.%f}'" for t in runs) + ")")


def catch_up(spark: SparkSession, history: str, kept: str, runs: list) -> None:
    """Add these runs; the first time also all others that the history already has."""
    if added_runs(spark, kept).isEmpty():
        known = Hi.read_history(spark, history).select("run_ts").distinct().collect()  # one per run
        runs = sorted({r.run_ts for r in known} | set(runs))
    add_runs(spark, history, kept, runs)


def add_runs(spark: SparkSession, history: str, kept: str, runs: list, buckets: int = BUCKETS) -> None:
    """Bring the kept series up to date with these runs (run times), which the history has by now.

    Runs may come late, in any order, and again with other rows. ``buckets`` holds for the first call; later ones
    keep to it.
    """
    ledger = added_runs(spark, kept)
    first = ledger.agg(F.max("buckets")).first()[0]  # one number
    buckets = first or buckets
    again = [r.run_ts for r in ledger.filter(_one_of(runs)).select("run_ts").distinct().collect()]
    named = spark.createDataFrame([(t, buckets) for t in runs], RUNS_DDL)
    named.coalesce(1).write.mode("append").parquet(f"{kept}/runs")
    fresh = [t for t in runs if t not in again]
    for kind, (_, compute, group, last) in KINDS.items():
        if fresh:
            new = cut_lineage(compute(Hi.read_history(spark, history, runs=fresh)))
            _merge(spark, kept, kind, new, new.select("canonical_key").distinct(), _one_of(fresh), group, last, buckets)
        if again:
            before = _table(spark, kept, kind).filter(_one_of(again)).select("canonical_key")
            now = compute(Hi.read_history(spark, history, runs=again)).select("canonical_key")
            changed = cut_lineage(before.unionByName(now).distinct())
            whole = compute(Hi.read_history(spark, history).join(changed, "canonical_key", "left_semi"))
            known = whole.join(F.broadcast(added_runs(spark, kept).select("run_ts").distinct()), "run_ts", "left_semi")
            _merge(spark, kept, kind, known, changed, None, group, last, buckets)


def _merge(
    spark: SparkSession, kept: str, kind: str, new: DataFrame, keys: DataFrame, replaced: Column | None, group: list[str], last: int, buckets: int
) -> None:
    """Put rows of the products ``keys`` in place of the kept ones: of those that are ``replaced``, or of all.

    Only buckets of these products are read and written.
    """
    touched = [r.bucket for r in keys.select(bucket_of(F.col("canonical_key"), buckets).alias("bucket")).distinct().collect()]  # `buckets` numbers at most
    old = _table(spark, kept, kind).filter(F.col("bucket").isin(touched) & F.col("canonical_key").isNotNull()).drop("bucket")
    stay = old.filter(~replaced) if replaced is not None else old.join(keys, "canonical_key", "left_anti")
    rows = Hi.keep_last_runs(stay.unionByName(new), group, last).withColumn("bucket", bucket_of(F.col("canonical_key"), buckets))
    marks = spark.createDataFrame([(b,) for b in touched], "bucket int")
    merged = cut_lineage(rows.unionByName(marks, allowMissingColumns=True))
    dealt = merged.hint("rebalance", "bucket").sortWithinPartitions("bucket", "canonical_key")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{kept}/{kind}")


def kept_price_series(spark: SparkSession, kept: str) -> DataFrame:
    """As ``history.price_series`` over all added runs."""
    return Hi.with_enough_points(_table(spark, kept, "lowest").filter(F.col("canonical_key").isNotNull()).drop("bucket"))


def kept_shop_series(spark: SparkSession, kept: str) -> DataFrame:
    """As ``history.shop_series`` over all added runs."""
    return Hi.with_enough_points(_table(spark, kept, "shops").filter(F.col("canonical_key").isNotNull()).drop("bucket"))
