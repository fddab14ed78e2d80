"""Daily views of price series: day close, cheapest shop, direction, trend, chart extent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope import fixed_values as fixed
from shelfscope.functions.labels import local_day
from shelfscope.functions.numbers import list_price


def day_close(series: DataFrame) -> DataFrame:
    """Last observation of each local day per product and shop."""
    fields = F.struct("precio", "descuento_pct", "promo_etiqueta", "precio_efectivo")
    return (
        series.withColumn("dia", local_day(F.col("run_ts")))
        .groupBy("canonical_key", "platform", "dia")
        .agg(F.max_by(fields, "run_ts").alias("_last"))
        .select("canonical_key", "platform", "dia", "_last.*")
    )


def last_days_of_product(days: DataFrame, count: int = fixed.DAY_TABLE_DAYS) -> DataFrame:
    """Rows in the last distinct days of each product."""
    newest = W.partitionBy("canonical_key").orderBy(F.desc("dia"))
    return days.withColumn("_n", F.dense_rank().over(newest)).filter(F.col("_n") <= count).drop("_n")


def day_table(series: DataFrame, count: int = fixed.DAY_TABLE_DAYS) -> DataFrame:
    """Day closes of the visible days: cheapest of the day, direction since the day before.

    The day before is the previous day on which the shop had a price.
    """
    shown = last_days_of_product(day_close(series), count)
    day = W.partitionBy("canonical_key", "dia")
    shop = W.partitionBy("canonical_key", "platform").orderBy("dia")
    before = F.lag("precio").over(shop)
    return (
        shown.withColumn("es_minimo", F.col("precio") == F.min("precio").over(day))
        .withColumn("_before", before)
        .withColumn(
            "direccion",
            F.when(F.col("precio") < F.col("_before"), "baja")
            .when(F.col("precio") > F.col("_before"), "sube")
            .otherwise(""),
        )
        .drop("_before")
    )


def store_day_view(
    series: DataFrame, products: DataFrame, platform: str, count: int = fixed.STORE_VIEW_DAYS
) -> DataFrame:
    """One shop: day closes of chosen products over the last days that any of them has.

    ``products`` holds canonical_key; the days are few, so they are the broadcast side.
    """
    closes = day_close(series.filter(F.col("platform") == platform)).join(
        products.select("canonical_key"), "canonical_key", "left_semi"
    )
    days = closes.select("dia").distinct().orderBy(F.desc("dia")).limit(count)
    return closes.join(F.broadcast(days), "dia", "left_semi").select(
        "canonical_key",
        "dia",
        "precio",
        "descuento_pct",
        list_price(F.col("precio"), F.col("descuento_pct")).alias("precio_lista"),
        "promo_etiqueta",
        "precio_efectivo",
    )


def trends(series: DataFrame) -> DataFrame:
    """First against last point of the lowest price, with range."""
    first, last = F.min_by("p", "run_ts"), F.max_by("p", "run_ts")
    direction = F.when(last < first, "down").when(last > first, "up").otherwise("flat")
    spread = F.max("p") - F.min("p")
    return series.groupBy("canonical_key").agg(
        F.count(F.lit(1)).alias("points"),
        F.min("p").alias("low"),
        F.max("p").alias("high"),
        F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias("span"),
        direction.alias("trend"),
    )


def last_price_per_shop(series: DataFrame) -> DataFrame:
    return series.groupBy("canonical_key", "platform").agg(F.max_by("precio", "run_ts").alias("precio"))


def chart_extent(series: DataFrame) -> DataFrame:
    """Price range and number of distinct times of a product's chart."""
    spread = F.max("precio") - F.min("precio")
    return series.groupBy("canonical_key").agg(
        F.count_distinct("run_ts").alias("times"),
        F.min("precio").alias("low"),
        F.max("precio").alias("high"),
        F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias("span"),
    )


def chart_times(series: DataFrame) -> DataFrame:
    """Union of the times of all shops of a product, numbered from 0."""
    times = series.select("canonical_key", "run_ts").distinct()
    order = W.partitionBy("canonical_key").orderBy("run_ts")
    return times.withColumn("t", F.row_number().over(order) - 1)
