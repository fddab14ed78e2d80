"""Source payloads to unified listings, one normaliser per kind of source.

Each takes rows with a ``payload`` struct plus any key columns and returns the key
columns and the product fields. Fetching is not part of the library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfscope import fixed_values as fixed
from shelfscope.functions import text as T
from shelfscope.functions.numbers import discount_pct, filled, price_per_100ml, truthy
from shelfscope.functions.promo import PROMO_TYPE, best_promo, promo_columns
from shelfscope.schemas import (
    CATALOG_DDL,
    PRODUCT_FIELDS,
    QUICK_COMMERCE_DDL,
    SEARCH_DDL,
    STOREFRONT_PRODUCT,
    struct_of,
)

RAW_FIELDS = [
    "id",
    "nombre",
    "marca",
    "volumen_ml",
    "precio_actual",
    "precio_anterior",
    "stock",
    "gtin",
    "promo_textos",
    "beer_color",
    "beer_style",
    "abv",
    "is_zero_alcohol",
    "origen",
]


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _number(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _first(*values: Column) -> Column:
    """First value that is not null and not empty, else ''."""
    return F.coalesce(*[F.when(filled(v), v) for v in values], F.lit(""))


def _or_price(value: Column, price: Column) -> Column:
    return F.when(truthy(value), value).otherwise(price)


def finish_products(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Derived fields shared by all sources: type, discount, price per 100 ml, promotion."""
    price, before = F.col("precio_actual"), F.col("precio_anterior")
    derived = T.computed_once(
        rows,
        {
            "tipo": T.type_text(F.col("nombre"), F.col("marca"), F.col("beer_color"), F.col("beer_style")),
            "_promo": F.coalesce(best_promo(F.col("promo_textos"), price), F.lit(None).cast(PROMO_TYPE)),
        },
    )
    return derived.select(
        "*",
        discount_pct(price, before).alias("descuento_pct"),
        price_per_100ml(price, F.col("volumen_ml")).alias("precio_por_100ml"),
        *promo_columns(F.col("_promo")),
    ).select(*keys, *PRODUCT_FIELDS)


def _keys(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "payload"]


def _beerless() -> dict[str, Column]:
    return {
        "beer_color": F.lit(""),
        "beer_style": F.lit(""),
        "abv": F.lit(None).cast("double"),
        "is_zero_alcohol": F.lit(False),
        "origen": F.lit(""),
    }


NO_TEXTS = "array<string>"


def quick_commerce_products(df: DataFrame) -> DataFrame:
    """REST items: structured size, optional price before."""
    p, keys = F.col("payload"), _keys(df)
    price = _number(p["pricing"]["price"])
    fields = {
        "id": _text(p["id"]),
        "nombre": _text(p["name"]),
        "marca": _text(p["defaultBrandName"]),
        "volumen_ml": T.to_ml(p["size"]["content"], p["size"]["unit"]),
        "precio_actual": price,
        "precio_anterior": _or_price(p["pricing"]["beforePrice"], price),
        "stock": p["stock"],
        "gtin": _text(p["gtin"]),
        "promo_textos": F.lit(None).cast(NO_TEXTS),
        **_beerless(),
    }
    return finish_products(_raw(df, keys, fields), keys)


def _raw(df: DataFrame, keys: list[str], fields: dict[str, Column]) -> DataFrame:
    return df.select(*keys, *[fields[name].alias(name) for name in RAW_FIELDS])


def discount_texts(entries: Column) -> Column:
    """Texts of discount entries, each a JSON object or a plain text, in reading order."""
    labels = ["description", "name", "label", "title"]
    schema = "struct<" + ",".join(f"{name}:string" for name in labels) + ">"

    def texts(entry: Column) -> Column:
        parsed = F.from_json(entry, schema)
        return F.when(
            entry.startswith("{"), F.array(*[parsed[name] for name in labels])
        ).otherwise(F.array(entry))

    return F.filter(F.flatten(F.transform(entries, texts)), filled)


def storefront_products(df: DataFrame) -> DataFrame:
    """Products of a storefront page, with beer attributes and free promotion texts."""
    p, keys = F.col("payload"), _keys(df)
    a = p["attributes"]
    price = _number(p["price"])
    fields = {
        "id": _text(p["product_id"]),
        "nombre": _text(p["name"]),
        "marca": _text(p["trademark"]),
        "volumen_ml": T.to_ml(p["quantity"], p["unit_type"]),
        "precio_actual": price,
        "precio_anterior": _or_price(p["real_price"], price),
        "stock": F.when(truthy(p["stock"]), p["stock"]).otherwise(
            F.when(p["in_stock"], F.lit(1)).otherwise(F.lit(0))
        ),
        "gtin": _text(p["ean"]),
        "promo_textos": discount_texts(p["complex_discounts"]),
        "beer_color": _text(a["beer_color"]),
        "beer_style": _text(a["beer_style"]),
        "abv": a["abv"],
        "is_zero_alcohol": F.coalesce(a["is_zero_alcohol"], F.lit(False)),
        "origen": _text(a["beer_origin"]),
    }
    return finish_products(_raw(df, keys, fields), keys)


def catalog_products(df: DataFrame) -> DataFrame:
    """Catalog entries: first item and its first seller; entries without items are dropped."""
    p, keys = F.col("payload"), _keys(df)
    item = F.get(p["items"], F.lit(0))
    offer = F.get(item["sellers"], F.lit(0))["commertialOffer"]
    price = _number(offer["Price"])
    listed = _or_price(offer["ListPrice"], price)
    junk = truthy(listed) & truthy(price) & (listed > price * F.lit(fixed.JUNK_LIST_PRICE_FACTOR))
    name = _first(p["productName"], item["nameComplete"])
    teasers = F.concat(
        F.coalesce(offer["Teasers"], F.array()), F.coalesce(offer["PromotionTeasers"], F.array())
    )
    fields = {
        "id": _first(p["productId"], item["itemId"], item["ean"], name),
        "nombre": name,
        "marca": _text(p["brand"]),
        "volumen_ml": T.volume_from_name(name),
        "precio_actual": price,
        "precio_anterior": F.when(junk, price).otherwise(listed),
        "stock": F.coalesce(offer["AvailableQuantity"], F.lit(0)),
        "gtin": _text(item["ean"]),
        "promo_textos": F.transform(teasers, lambda t: _first(t["Name"], t["<Name>k__BackingField"])),
        **_beerless(),
    }
    return finish_products(_raw(df.filter(F.size(p["items"]) > 0), keys, fields), keys)


def median_price(prices: Column) -> Column:
    """Median of the list prices of all branches, without nulls and zeros; null if none."""
    known = F.array_sort(F.filter(F.transform(prices, lambda x: x["listPrice"]), truthy))
    n = F.size(known)
    middle = F.get(known, F.floor(n / 2).cast("int"))
    below = F.get(known, F.floor((n - 1) / 2).cast("int"))
    return F.when(n > 0, F.when(n % 2 == 1, middle).otherwise((below + middle) / F.lit(2.0)))


def search_products(df: DataFrame) -> DataFrame:
    """Search hits: median branch price, accessories and corrupt prices dropped."""
    p, keys = F.col("payload"), _keys(df)
    d = p["data"]
    rows = T.computed_once(
        df,
        {"_name": _first(d["sku_display_name"], p["value"]), "_price": median_price(d["price"])},
    )
    rows = T.computed_once(rows, {"_volume": T.volume_from_name(F.col("_name"))})
    price, name = F.col("_price"), F.col("_name")
    unit = price_per_100ml(price, F.col("_volume"))
    kept = rows.filter(
        (name != "")
        & ~name.rlike(T.RAW + fixed.ACCESSORY)
        & (price >= fixed.MIN_PRICE)
        & (F.coalesce(unit, F.lit(fixed.MIN_PRICE_PER_100ML)) >= fixed.MIN_PRICE_PER_100ML)
    )
    listed = _or_price(d["product_list_price"], price)
    plausible = (price < listed) & (listed <= price * F.lit(fixed.PLAUSIBLE_LIST_PRICE_FACTOR))
    fields = {
        "id": _first(d["id"], d["sku_plu"], p["value"]),
        "nombre": name,
        "marca": _text(d["product_brand"]),
        "volumen_ml": F.col("_volume"),
        "precio_actual": price,
        "precio_anterior": F.when(plausible, listed).otherwise(price),
        "stock": F.lit(1),
        "gtin": F.lit(""),
        "promo_textos": F.transform(d["discounts"], lambda x: _text(x["discountText"])),
        **_beerless(),
    }
    return finish_products(_raw(kept, keys, fields), keys)


def embedded_page(html: Column) -> Column:
    """Body of the first embedded page-state script, null if there is none."""
    return F.nullif(F.regexp_extract(html, fixed.EMBEDDED_JSON, 1), F.lit(""))


def lenient(value: Column, kind: StructType, path: str = "$") -> Column:
    """Fields of a variant by a schema, each by itself: one of another type than declared is null, and the others stay."""
    fields = []
    for f in kind:
        inner = f"{path}.{f.name}"
        nested = isinstance(f.dataType, StructType)
        fields.append((lenient(value, f.dataType, inner) if nested else F.try_variant_get(value, inner, f.dataType.simpleString())).alias(f.name))
    return F.struct(*fields)


def storefront_page_products(df: DataFrame, html: str, node: Column) -> DataFrame:
    """Products in the page state of each page: one row per product, column ``payload``.

    ``node`` names the page's own entry of the state (store and aisle). The state is read as it comes: a field or a
    component of another type than expected is left out, the page's other products stay.
    """
    keys = [c for c in df.columns if c != html]
    nodes = F.try_variant_get(F.try_parse_json(embedded_page(F.col(html))), "$.props.pageProps.fallback", "map<string,variant>")
    components = F.try_variant_get(F.try_element_at(nodes, node), "$.aisle_detail_response.data.components", "array<variant>")
    lists = F.transform(components, lambda c: F.try_variant_get(c, "$.resource.products", "array<variant>"))
    products = F.flatten(F.filter(lists, lambda x: x.isNotNull()))
    each = T.computed_once(df, {"_products": products}).select(*keys, F.posexplode("_products").alias("pos", "_product"))
    return each.select(*keys, "pos", lenient(F.col("_product"), struct_of(f"p {STOREFRONT_PRODUCT}")["p"].dataType).alias("payload"))


def build_id(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, fixed.BUILD_ID, 1), F.lit(""))


def first_build_id(pages: DataFrame, group: list[str], html: str, order: str) -> DataFrame:
    """First page build of each source, in page order."""
    found = pages.withColumn("_id", build_id(F.col(html)))
    return found.groupBy(*group).agg(
        F.min_by("_id", F.when(F.col("_id").isNotNull(), F.col(order))).alias("build_id")
    )


def dedupe_products(products: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """One row per id of a snapshot: last value, position of the first; empty ids dropped."""
    fields = [c for c in products.columns if c not in (*keys, "id", pos)]
    return (
        products.filter(filled(F.col("id")))
        .groupBy(*keys, "id")
        .agg(F.min(pos).alias(pos), F.max_by(F.struct(*fields), pos).alias("_last"))
        .select(*keys, "id", pos, "_last.*")
    )


PAYLOAD_SCHEMAS = {
    "quick_commerce": QUICK_COMMERCE_DDL,
    "catalog": CATALOG_DDL,
    "search": SEARCH_DDL,
}


def read_payload(df: DataFrame, kind: str, column: str = "json") -> DataFrame:
    """Parse a JSON text column into ``payload``; rows that do not parse are dropped."""
    parsed = F.from_json(F.col(column), struct_of(PAYLOAD_SCHEMAS[kind]))
    return T.computed_once(df, {"payload": parsed}).filter(F.col("payload").isNotNull()).drop(column)


Normalizer = Callable[[DataFrame], DataFrame]

NORMALIZERS: dict[str, Normalizer] = {
    "pedidosya": quick_commerce_products,
    "rappi": storefront_products,
    "carrefour": catalog_products,
    "jumbo": catalog_products,
    "disco": catalog_products,
    "vea": catalog_products,
    "dia": catalog_products,
    "coto": search_products,
}


def available_platforms(registry: dict[str, Normalizer] = NORMALIZERS) -> list[str]:
    return sorted(registry)


def normalizer_of(platform: str, registry: dict[str, Normalizer] = NORMALIZERS) -> Normalizer:
    if platform not in registry:
        raise KeyError(f"no normaliser for {platform!r}; known: {available_platforms(registry)}")
    return registry[platform]


def normalize_sources(
    payloads: dict[str, DataFrame], registry: dict[str, Normalizer] = NORMALIZERS
) -> DataFrame:
    """Listings of all shops: each shop's rows go through its normaliser, then a union.

    Shops sharing a normaliser and a table are read once if given under a joint name
    "a,b"; ``platform`` must then be a key column of the rows.
    """
    parts = []
    for names, rows in payloads.items():
        first = names.split(",")[0]
        tagged = rows if "platform" in rows.columns else rows.withColumn("platform", F.lit(first))
        parts.append(normalizer_of(first, registry)(tagged))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union
