"""Price matrix: the cheapest offer of each product in each shop, best shop and saving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope import fixed_values as fixed
from shelfscope.functions.numbers import available, round_exact, truthy

CELL_FIELDS = [
    "nombre",
    "precio_actual",
    "precio_anterior",
    "descuento_pct",
    "precio_por_100ml",
    "stock",
]
PRODUCT_FIELDS = [
    "canonical_id",
    "canonical_key",
    "brand_display",
    "sub_brand",
    "variant_slug",
    "volume_ml",
    "container",
    "pack_qty",
    "display_name",
    "gtin",
    "n_platforms",
    "match_method",
    "review_needed",
]


def price_cell() -> Column:
    """What one shop shows for a product; a price of zero is no price."""
    promo = F.when(
        (F.col("promo_tipo") == "multi") & truthy(F.col("promo_precio_efectivo")),
        F.struct(
            F.coalesce("promo_etiqueta", F.lit("")).alias("etiqueta"),
            F.coalesce("promo_texto", F.lit("")).alias("texto"),
            F.coalesce("promo_unidades", F.lit(0)).alias("unidades"),
            F.col("promo_precio_efectivo").alias("precio_efectivo"),
        ),
    )
    return F.struct(
        *CELL_FIELDS,
        available(F.col("precio_actual"), F.col("stock")).alias("disponible"),
        promo.alias("promo"),
    )


def cheapest_cells(offers: DataFrame) -> DataFrame:
    """Per product and shop the cheapest offer, first on a tie, whatever its stock.

    ``first_ord`` is the first of all the shop's offers of the product.
    """
    price = F.coalesce(F.nullif("precio_actual", F.lit(0.0)), F.lit(fixed.NO_PRICE))
    return offers.groupBy("canonical_id", "platform").agg(
        F.min_by(price_cell(), F.struct(price, "offer_ord")).alias("cell"),
        F.min("offer_ord").alias("first_ord"),
    )


def _sorted_median(values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(values)
    low = F.get(values, F.floor((n - 1) / 2).cast("int"))
    high = F.get(values, F.floor(n / 2).cast("int"))
    return F.when(n % 2 == 1, low).otherwise((low + high) / F.lit(2.0))


def guard_outliers(cells: DataFrame) -> DataFrame:
    """One row per product: its cells in offer order, with corrupt prices flagged.

    The list of a product holds one cell per shop, so it stays as short as the shop list.
    """
    grouped = cells.groupBy("canonical_id").agg(
        F.array_sort(F.collect_list(F.struct("first_ord", "platform", "cell"))).alias("_cells")
    )
    prices = F.array_sort(
        F.transform(
            F.filter("_cells", lambda c: c["cell"]["disponible"]), lambda c: c["cell"]["precio_actual"]
        )
    )
    floor = F.when(
        F.size("_prices") >= fixed.OUTLIER_MIN_PRICES,
        F.lit(fixed.OUTLIER_SHARE) * _sorted_median(F.col("_prices")),
    )
    flagged = F.transform(
        "_cells",
        lambda c: F.struct(
            c["first_ord"].alias("first_ord"),
            c["platform"].alias("platform"),
            c["cell"].alias("cell"),
            (
                c["cell"]["disponible"]
                & F.coalesce(c["cell"]["precio_actual"] < F.col("_floor"), F.lit(False))
            ).alias("suspect"),
        ),
    )
    return (
        grouped.withColumn("_prices", prices)
        .withColumn("_floor", floor)
        .select("canonical_id", flagged.alias("cells"))
    )


def with_best(rows: DataFrame) -> DataFrame:
    """Best shop (first of the product on a tie) and saving among the prices that count."""
    counted = F.transform(
        F.filter("cells", lambda c: c["cell"]["disponible"] & ~c["suspect"]),
        lambda c: F.struct(c["cell"]["precio_actual"].alias("p"), c["first_ord"].alias("o"), c["platform"].alias("platform")),
    )
    spread = F.array_max("_counted.p") - F.array_min("_counted.p")
    return (
        rows.withColumn("_counted", counted)
        .withColumn("mejor", F.array_min("_counted")["platform"])
        .withColumn(
            "ahorro_abs", F.when(F.size("_counted") > 1, round_exact(spread)).otherwise(F.lit(0.0))
        )
        .drop("_counted")
    )


def build_matrix(canonicals: DataFrame, offers: DataFrame) -> DataFrame:
    """One row per product: its fields, ``precios`` (shop to cell), best shop, saving."""
    rows = with_best(guard_outliers(cheapest_cells(offers)))
    entries = F.transform(
        "cells",
        lambda c: F.struct(
            c["platform"],
            F.struct(
                *[c["cell"][f].alias(f) for f in [*CELL_FIELDS, "disponible", "promo"]],
                c["suspect"].alias("suspect"),
            ),
        ),
    )
    return (
        canonicals.select(*PRODUCT_FIELDS)
        .join(rows, "canonical_id")
        .select(*PRODUCT_FIELDS, F.map_from_entries(entries).alias("precios"), "mejor", "ahorro_abs")
    )


def matrix_order() -> list[Column]:
    return [
        F.desc("n_platforms"),
        F.asc("brand_display"),
        F.coalesce("volume_ml", F.lit(0)).asc(),
        F.asc("canonical_id"),
    ]


def matrix_cells(matrix: DataFrame) -> DataFrame:
    """Matrix as one row per product and shop."""
    return matrix.select("canonical_id", F.explode("precios").alias("platform", "cell")).select(
        "canonical_id", "platform", "cell.*"
    )


def flat_matrix(matrix: DataFrame, platforms: list[str]) -> DataFrame:
    """Export form: base columns and price, discount, stock of every shop; '' if absent."""
    base = [
        F.col("brand_display").alias("marca"),
        F.col("variant_slug").alias("variante"),
        F.col("volume_ml").alias("volumen_ml"),
        F.coalesce("container", F.lit("")).alias("container"),
        "pack_qty",
        "display_name",
        "gtin",
        "n_platforms",
        F.coalesce("mejor", F.lit("")).alias("mejor"),
        "ahorro_abs",
    ]
    shops = []
    for p in platforms:
        cell = F.col("precios")[p]
        for field, suffix in (("precio_actual", "precio"), ("descuento_pct", "desc_pct"), ("stock", "stock")):
            shops.append(F.coalesce(cell[field].cast("string"), F.lit("")).alias(f"{p}_{suffix}"))
    return matrix.select(*base, *shops)


def run_summary(offers: DataFrame, canonicals: DataFrame) -> DataFrame:
    """Offers, products, products in several shops, reliable and tentative ones."""
    many = F.col("n_platforms") > 1
    products = canonicals.agg(
        F.count(F.lit(1)).alias("canonicos"),
        F.count_if(many).alias("comparables"),
        F.count_if(many & ~F.col("review_needed")).alias("confiables"),
        F.count_if("review_needed").alias("en_revision"),
    )
    counted = offers.agg(F.count(F.lit(1)).alias("offers"))
    return counted.join(F.broadcast(products), F.lit(True)).select(
        "offers", "canonicos", "comparables", "confiables", "en_revision"
    )
