"""Price history: append, evolve, and the series published from it.

The history is one Parquet table with a folder per month and run, for runs appended by batch jobs and by streams. A run is
committed by overwriting its folder, so committing it again leaves its rows once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope import fixed_values as fixed
from shelfscope.functions.numbers import filled, round_exact, truthy
from shelfscope.schemas import OBSERVATION_DDL, struct_of
from shelfscope.session import cut_lineage, if_there


def to_observations(offers: DataFrame, run_ts: Column) -> DataFrame:
    """The ten stored columns of a run; the effective price only of multi-unit promotions."""
    return offers.select(
        F.coalesce("canonical_key", F.lit("")).alias("canonical_key"),
        "platform",
        F.col("external_product_id").cast("string").alias("external_product_id"),
        run_ts.cast("timestamp_ntz").alias("run_ts"),
        "precio_actual",
        "descuento_pct",
        "precio_por_100ml",
        "stock",
        F.when(filled(F.col("promo_etiqueta")), F.col("promo_etiqueta")).alias("promo_etiqueta"),
        F.when(F.col("promo_tipo") == "multi", F.col("promo_precio_efectivo")).alias(
            "promo_precio_efectivo"
        ),
    )


RUN_FORMAT = "yyyyMMddHHmmssSSSSSS"
TABLE_DDL = OBSERVATION_DDL + ", run_month string, run string"


def in_run_folders(observations: DataFrame) -> DataFrame:
    """Add the names of the month's and of the run's folder."""
    return observations.withColumns({"run_month": F.date_format("run_ts", "yyyy-MM"), "run": F.date_format("run_ts", RUN_FORMAT)})


def _commit(rows: DataFrame, path: str) -> None:
    """Replace the folders of the rows' runs; files have the size that Spark advises, a big run gets several."""
    dealt = rows.hint("rebalance", "run_month", "run").sortWithinPartitions("run_month", "run", "canonical_key")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_month", "run").parquet(path)


def append_history(observations: DataFrame, path: str) -> None:
    """Commit whole runs: what the table has of these runs is replaced, all other runs stay."""
    _commit(in_run_folders(observations), path)


def append_shops(observations: DataFrame, path: str) -> None:
    """Commit some shops of some runs, as they come: what the table has of the other shops of these runs stays."""
    spark = observations.sparkSession
    new = cut_lineage(in_run_folders(observations))
    runs = new.select("run_month", "run").distinct().collect()  # the runs of one commit
    units = new.select("run_month", "run", "platform").distinct()
    here = _table(spark, path).filter(F.col("run_month").isin([r.run_month for r in runs]) & F.col("run").isin([r.run for r in runs]))
    others = here.join(units, ["run_month", "run", "platform"], "left_anti")
    _commit(cut_lineage(others.unionByName(new)), path)


def compact_history(spark: SparkSession, path: str, months: list[str]) -> None:
    """Rewrite the runs of these months (as 2024-01) in files of the advised size, sorted by product."""
    _commit(cut_lineage(_table(spark, path).filter(F.col("run_month").isin(months))), path)


def _table(spark: SparkSession, path: str) -> DataFrame:
    return if_there(spark, lambda: spark.read.schema(TABLE_DDL).parquet(path), TABLE_DDL)


def read_history(spark: SparkSession, path: str, since: str | None = None, runs: list | None = None) -> DataFrame:
    """History of any age, empty if there is none yet; files without the promotion columns give nulls there.

    ``since`` (a day) and ``runs`` (run times) read the folders of those runs only.
    """
    rows = _table(spark, path)
    if since:
        rows = rows.filter((F.col("run_month") >= since[:7]) & (F.col("run") >= since[:10].replace("-", "")))
    if runs is not None:
        rows = rows.filter(F.col("run_month").isin([f"{t:%Y-%m}" for t in runs]) & F.col("run").isin([f"{t:%Y%m%d%H%M%S%f}" for t in runs]))
    return rows.drop("run_month", "run")


def with_missing_columns(old: DataFrame) -> DataFrame:
    """Old observations brought to the present columns."""
    empty = old.sparkSession.createDataFrame([], struct_of(OBSERVATION_DDL))
    return empty.unionByName(old, allowMissingColumns=True)


def _counted(observations: DataFrame) -> DataFrame:
    return observations.filter("precio_actual > 0 AND stock > 0 AND canonical_key <> ''")


def lowest_prices(observations: DataFrame) -> DataFrame:
    """Lowest available price per product and run."""
    return (
        _counted(observations)
        .groupBy("canonical_key", "run_ts")
        .agg(F.min("precio_actual").alias("p"))
        .withColumn("p", round_exact(F.col("p")))
    )


def shop_prices(observations: DataFrame) -> DataFrame:
    """Per product, shop and run: price, discount, promotion label and effective price."""
    return (
        _counted(observations)
        .groupBy("canonical_key", "platform", "run_ts")
        .agg(
            F.min("precio_actual").alias("p"),
            F.max("descuento_pct").alias("d"),
            F.max("promo_etiqueta").alias("pe"),
            F.min("promo_precio_efectivo").alias("pp"),
        )
        .select(
            "canonical_key",
            "platform",
            "run_ts",
            round_exact(F.col("p")).alias("precio"),
            round_exact(F.coalesce("d", F.lit(0.0)).cast("double"), 1).alias("descuento_pct"),
            F.when(filled(F.col("pe")), F.col("pe")).alias("promo_etiqueta"),
            F.when(filled(F.col("pe")) & truthy(F.col("pp")), round_exact(F.col("pp"))).alias(
                "precio_efectivo"
            ),
        )
    )


def keep_last_runs(series: DataFrame, group: list[str], runs: int) -> DataFrame:
    """Last runs of each series; most rows are cut before they are shuffled."""
    newest = W.partitionBy(*group).orderBy(F.desc("run_ts"))
    return series.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= runs).drop("_n")


def with_enough_points(series: DataFrame, minimum: int = 2) -> DataFrame:
    """Products with at least so many points."""
    counted = series.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("canonical_key")))
    return counted.filter(F.col("_n") >= minimum).drop("_n")


def price_series(observations: DataFrame, runs: int = fixed.HISTORY_RUNS) -> DataFrame:
    """Last runs of the lowest price, for products with two points or more."""
    return with_enough_points(keep_last_runs(lowest_prices(observations), ["canonical_key"], runs))


def shop_series(observations: DataFrame, runs: int = fixed.DETAIL_RUNS) -> DataFrame:
    """Last runs per product and shop, for products with two points or more in total."""
    trimmed = keep_last_runs(shop_prices(observations), ["canonical_key", "platform"], runs)
    return with_enough_points(trimmed)


def series_document(series: DataFrame) -> DataFrame:
    """One row per product: its points in time order (as many as runs were kept)."""
    points = F.array_sort(F.collect_list(F.struct("run_ts", "p")))
    return series.groupBy("canonical_key").agg(points.alias("points"))


def shop_series_document(series: DataFrame) -> DataFrame:
    """One row per product: shop to points in time order."""
    point = F.struct("run_ts", "precio", "descuento_pct", "promo_etiqueta", "precio_efectivo")
    shops = series.groupBy("canonical_key", "platform").agg(F.array_sort(F.collect_list(point)).alias("points"))
    return shops.groupBy("canonical_key").agg(
        F.map_from_entries(F.collect_list(F.struct("platform", "points"))).alias("series")
    )


def last_seen(observations: DataFrame) -> DataFrame:
    """Last run in which a shop brought data."""
    return observations.groupBy("platform").agg(F.max("run_ts").alias("last_seen"))
