"""Interactive views of the matrix: metrics, filters, orders, facets, tree, first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.functions.labels import model_label
from shelfscope.functions.numbers import truthy


def _lowest(cells: Column, wanted, value) -> Column:
    return F.array_min(F.transform(F.filter(cells, wanted), value))


def with_metrics(matrix: DataFrame) -> DataFrame:
    """Per product: lowest price, lowest with promotions, lowest per 100 ml, best discount.

    Missing values are null here and sort last.
    """
    cells = F.map_values("precios")
    sold = lambda c: c["disponible"] & truthy(c["precio_actual"])
    by_volume = lambda c: c["disponible"] & truthy(c["precio_por_100ml"])
    with_promo = lambda c: F.least(
        c["precio_actual"], F.nullif(c["promo"]["precio_efectivo"], F.lit(0.0))
    )
    discounts = F.transform(cells, lambda c: F.coalesce(c["descuento_pct"], F.lit(0.0)))
    return matrix.withColumns(
        {
            "min_price": _lowest(cells, sold, lambda c: c["precio_actual"]),
            "min_price_promo": _lowest(cells, sold, with_promo),
            "min_per_100ml": _lowest(cells, by_volume, lambda c: c["precio_por_100ml"]),
            "max_discount": F.coalesce(F.array_max(discounts), F.lit(0.0)),
            "has_promo": F.exists(cells, lambda c: truthy(c["promo"]["precio_efectivo"])),
        }
    )


def view_filter(
    text: str = "",
    brand: str = "",
    size: int | None = None,
    comparable: bool = False,
    on_offer: bool = False,
    with_promo: bool = False,
) -> Column:
    """All chosen conditions together, over rows with metrics."""
    chosen = [F.lit(True)]
    if text:
        chosen.append(F.contains(F.lower("display_name"), F.lit(text.lower())))
    if brand:
        chosen.append(F.col("brand_display") == brand)
    if size is not None:
        chosen.append(F.col("volume_ml") == size)
    if comparable:
        chosen.append(F.col("n_platforms") > 1)
    if on_offer:
        chosen.append((F.col("max_discount") > 0) | F.col("has_promo"))
    if with_promo:
        chosen.append(F.col("has_promo"))
    condition = chosen[0]
    for extra in chosen[1:]:
        condition = condition & extra
    return condition


VIEW_ORDERS = {
    "default": lambda: [F.desc("n_platforms"), F.asc("brand_display")],
    "cheap": lambda: [F.asc_nulls_last("min_price")],
    "promo": lambda: [F.asc_nulls_last("min_price_promo")],
    "discount": lambda: [F.desc("max_discount")],
    "per100": lambda: [F.asc_nulls_last("min_per_100ml")],
    "brand": lambda: [F.asc("brand_display")],
}


def view_order(order: str = "default") -> list[Column]:
    """One of the named orders; equal rows stay in matrix order."""
    ties = [F.desc("n_platforms"), F.asc("brand_display"), F.coalesce("volume_ml", F.lit(0)).asc(), F.asc("canonical_id")]
    return [*VIEW_ORDERS[order](), *ties]


def ordered_view(matrix: DataFrame, order: str = "default") -> DataFrame:
    return matrix.orderBy(*view_order(order))


def first_rows(view: DataFrame, count: int, skip: int = 0) -> DataFrame:
    return view.offset(skip).limit(count) if skip else view.limit(count)


def offers_by_price(cells: DataFrame, per_100ml: bool = False) -> DataFrame:
    """Shops of a product by price, those not available last, else in shop order."""
    value = F.col("precio_por_100ml" if per_100ml else "precio_actual")
    shown = F.when(F.col("disponible"), value)
    order = W.partitionBy("canonical_id").orderBy(F.asc_nulls_last(shown), "platform")
    return cells.withColumn("puesto", F.row_number().over(order))


def visible_platforms(matrix: DataFrame, hidden: list[str]) -> DataFrame:
    return matrix.withColumn("precios", F.map_filter("precios", lambda p, _: ~p.isin(hidden)))


def brand_facet(matrix: DataFrame) -> DataFrame:
    return matrix.select("brand_display").distinct().orderBy("brand_display")


def size_facet(matrix: DataFrame) -> DataFrame:
    return matrix.filter(truthy(F.col("volume_ml"))).select("volume_ml").distinct().orderBy("volume_ml")


def brand_tree(matrix: DataFrame) -> DataFrame:
    """Products per brand and model, with models and products per brand."""
    models = (
        matrix.select(
            F.coalesce(F.nullif("brand_display", F.lit("")), F.lit("—")).alias("brand"),
            model_label(F.col("variant_slug")).alias("model"),
        )
        .groupBy("brand", "model")
        .agg(F.count(F.lit(1)).alias("configs"))
    )
    brand = W.partitionBy("brand")
    return models.withColumns(
        {
            "models_of_brand": F.count(F.lit(1)).over(brand),
            "configs_of_brand": F.sum("configs").over(brand),
        }
    ).orderBy("brand", "model")


def sold_by(matrix: DataFrame, platform: str) -> DataFrame:
    return matrix.filter(F.map_contains_key("precios", platform))


def picked(matrix: DataFrame, ids: DataFrame) -> DataFrame:
    """Chosen products (``ids`` holds canonical_id)."""
    return matrix.join(ids, "canonical_id", "left_semi")


def with_history(matrix: DataFrame, document: DataFrame) -> DataFrame:
    """Each product with its history, if it has one."""
    return matrix.join(document, "canonical_key", "left")
