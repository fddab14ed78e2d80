"""Queries for scans, source normalisers and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscope import fixed_values as fixed
from shelfscope.functions import labels as L
from shelfscope.functions import numbers as N
from shelfscope.functions import text as T
from shelfscope.functions.promo import best_promo, parse_promo, promo_columns
from shelfscope.operators import health as H
from shelfscope.operators.normalize import resolve_volume
from shelfscope.plans import fixtures as fx
from shelfscope.plans import oracle_parts as O
from shelfscope.plans.oracle_parts import statement
from shelfscope.plans.registry import landed, offers, query
from shelfscope.sources import landing, payloads
from shelfscope.sources.aliases import builtin_aliases

# --- A: scans -----------------------------------------------------------------------

# The landed snapshots hold all observations: a run per year, three stores per shop.
LANDED = """SELECT platform, CAST(l_linenumber % 3 AS VARCHAR) AS store, year(run_ts) AS y, count(*) AS listings,
  CAST(sum(stock) AS BIGINT) AS stock, CAST(count(*) FILTER (WHERE descuento_pct > 0) AS BIGINT) AS reduced FROM obs_products GROUP BY 1, 2, 3"""
LATE = "platform IN ('dia', 'jumbo')"


def _totals(envelopes, *more):
    """Per shop: the store its listings came from, their number, stock, and how many are reduced."""
    listings = envelopes.select("platform", "external_store_id", *more, F.explode("productos").alias("p"))
    return listings.groupBy("platform", F.col("external_store_id").alias("store"), *more).agg(
        F.count(F.lit(1)).alias("listings"), F.sum("p.stock").alias("stock"), F.count_if(F.col("p.descuento_pct") > 0).alias("reduced")
    )


@query(
    "a01_latest_snapshot_per_platform",
    statement(
        f"""WITH landed AS ({LANDED}) SELECT platform, store, listings, stock, reduced FROM landed
        WHERE store = '2' AND y = CASE WHEN {LATE} THEN 2000 ELSE 2001 END AND platform <> 'vea'""",
        "obs_products",
    ),
)
def latest_snapshot(spark, sf):
    """Last by name: the late shops' last run has an earlier name; vea's last one is not whole, coto's never arrived."""
    return _totals(landing.load_latest(spark, landed(spark, sf)))


@query(
    "a02_snapshots_of_one_run",
    statement(f"WITH landed AS ({LANDED}) SELECT platform, store, listings, stock, reduced FROM landed WHERE store = '2' AND y = 1999", "obs_products"),
)
def run_snapshots(spark, sf):
    return _totals(landing.load_run(spark, landed(spark, sf), "1999"))


@query(
    "a03_newest_usable_snapshot",
    statement(f"WITH landed AS ({LANDED}) SELECT platform, store, listings, stock, reduced FROM landed WHERE store = '2' AND y = 2001 AND platform <> 'vea'", "obs_products"),
)
def newest_snapshot(spark, sf):
    return _totals(landing.load_newest(spark, landed(spark, sf)))


@query(
    "a04_stale_fallback",
    statement(
        f"""WITH landed AS ({LANDED}) SELECT platform, store, listings, stock, reduced, {LATE} AS stale,
        CASE WHEN {LATE} THEN '2001-12-31T20:00:00Z' END AS captured_at
        FROM landed WHERE store = '2' AND y = 2001 AND platform <> 'dia'""",
        "obs_products",
    ),
)
def stale_fallback(spark, sf):
    """The last run, and the late shops' newest snapshots; that of dia is too old."""
    root = landed(spark, sf)
    run = landing.load_run(spark, root, "run-2001")
    expected = H.expected_platforms(fx.observations(spark, sf))
    newest = landing.load_newest(spark, root, H.missing_platforms(expected, run))
    now = F.to_timestamp(F.lit("2002-01-01T00:00:00Z"))
    return _totals(H.with_stale_fallback(run, newest, expected, now, 24.0), "stale", "captured_at")


@query(
    "a05_offers_of_snapshots",
    statement(
        """SELECT platform, CAST(external_product_id AS VARCHAR) AS external_product_id, nombre, precio_actual, stock, promo_etiqueta,
        CAST(floor(offer_ord / 1099511627776) AS BIGINT) AS shop, row_number() OVER (PARTITION BY platform ORDER BY external_product_id) - 1 AS position
        FROM products""",
        "products",
    ),
)
def snapshot_offers(spark, sf):
    rows = fx.as_products(fx.snapshot(spark, sf))
    return landing.build_offers(
        landing.with_platform_rank(_envelopes(rows).withColumnRenamed("plataforma", "platform"), [F.col("platform")])
    ).select(
        "platform",
        "external_product_id",
        "nombre",
        "precio_actual",
        "stock",
        "promo_etiqueta",
        F.floor(F.col("offer_ord") / F.lit(1 << 40)).alias("shop"),
        (F.col("offer_ord") % F.lit(1 << 40)).alias("position"),
    )


def _envelopes(rows):
    """Fixture listings as landed envelopes, at their place in the shop's snapshot."""
    from shelfscope.operators.resolve import OFFERS_PER_BUCKET, dense_rank_at_scale

    placed = dense_rank_at_scale(rows, "offer_ord", "_rank", OFFERS_PER_BUCKET)
    starts = placed.groupBy("platform").agg(F.min("_rank").alias("_start"))
    return _placed_envelopes(placed.join(F.broadcast(starts), "platform").withColumn("pos", F.col("_rank") - F.col("_start")))


def _placed_envelopes(rows):
    """Fixture listings that have their place, ``pos``, as landed envelopes."""
    listed = rows.select(
        "platform",
        F.col("platform").alias("external_store_id"),
        F.lit("Store").alias("tienda"),
        F.lit("").alias("direccion"),
        F.lit("2024-01-01T00:00:00Z").alias("fecha_scrapeo"),
        F.create_map(F.lit("method"), F.lit("tables")).alias("source"),
        "pos",
        F.col("external_product_id").cast("string").alias("id"),
        "nombre", "marca", "tipo", "volumen_ml", "precio_actual", "precio_anterior", "descuento_pct",
        "precio_por_100ml", "stock", "gtin", "promo_etiqueta", "promo_texto", "promo_tipo", "promo_unidades",
        "promo_precio_efectivo",
        F.lit("").alias("beer_color"),
        F.lit("").alias("beer_style"),
        F.lit(None).cast("double").alias("abv"),
        "is_zero_alcohol",
        F.lit("").alias("origen"),
    )
    return landing.build_envelopes(listed)


@query(
    "a06_alias_use",
    statement(
        """SELECT b.alias, b.line, count(n.nombre) AS exact_hits FROM brand_alias b LEFT JOIN
        (SELECT n.nombre, n.marca_norm FROM snap s JOIN normal n ON n.nombre = s.nombre AND n.marca = s.marca) n
        ON n.marca_norm = b.alias GROUP BY 1, 2""",
        "brand_alias", "snap", "normal",
    ),
)
def alias_use(spark, sf):
    from shelfscope.sources.aliases import BRAND_COLUMNS, clean_aliases, parse_fixed

    listed = [(*row, i) for i, row in enumerate(parse_fixed(fixed.BRAND_ALIASES))]
    aliases = clean_aliases(spark.createDataFrame(listed, [*BRAND_COLUMNS, "line"]))
    used = (
        fx.snapshot(spark, sf)
        .groupBy(T.norm_text(F.col("marca")).alias("alias_norm"))
        .agg(F.count(F.lit(1)).alias("exact_hits"))
    )
    return F.broadcast(aliases).join(used, "alias_norm", "left").select(
        F.col("alias_norm").alias("alias"), F.col("line").cast("int").alias("line"),
        F.coalesce("exact_hits", F.lit(0)).alias("exact_hits"),
    )


@query(
    "a07_active_stores",
    """SELECT s_name AS store_name, n_name AS platform FROM supplier JOIN nation ON n_nationkey = s_nationkey
    WHERE coalesce(CASE WHEN s_acctbal < 0 THEN FALSE WHEN s_suppkey % 3 = 0 THEN NULL ELSE TRUE END, TRUE)
    AND n_name IN (SELECT n_name FROM nation WHERE n_regionkey IN (1, 2))""",
)
def active_stores(spark, sf):
    nations = fx.table(spark, sf, "nation")
    stores = (
        fx.table(spark, sf, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_name").alias("store_name"),
            F.col("n_name").alias("platform"),
            F.expr("CASE WHEN s_acctbal < 0 THEN FALSE WHEN s_suppkey % 3 = 0 THEN NULL ELSE TRUE END").alias("active"),
        )
    )
    wanted = [r.n_name for r in nations.filter("n_regionkey IN (1, 2)").select("n_name").collect()]
    return landing.active_stores(stores, wanted).select("store_name", "platform")


# --- B: source normalisers -----------------------------------------------------------

COMMON = "id, nombre, tipo, volumen_ml, precio_actual, precio_anterior, descuento_pct, precio_por_100ml, stock, gtin"
OUT = ["id", "nombre", "tipo", "volumen_ml", "precio_actual", "precio_anterior", "descuento_pct", "precio_por_100ml", "stock", "gtin"]
PROMO_OUT = ["promo_etiqueta", "promo_texto", "promo_tipo", "promo_unidades", "promo_precio_efectivo"]


def _snap_products(spark, sf):
    return fx.as_products(fx.snapshot(spark, sf))


def _as_json(rows, kind, **fields):
    """Payload texts as a shop would send them, read back with the declared schema."""
    json = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return payloads.read_payload(rows.select("platform", json.alias("json")), kind)


def _quick(rows):
    volume = F.col("volumen_ml")
    return _as_json(
        rows,
        "quick_commerce",
        id=F.col("external_product_id"),
        name=F.col("nombre"),
        defaultBrandName=F.nullif("marca", F.lit("")),
        size=F.struct(
            F.when(volume >= 1000, volume / F.lit(1000.0)).otherwise(volume.cast("double")).alias("content"),
            F.when(volume >= 1000, " L").otherwise("cm³").alias("unit"),
        ),
        pricing=F.struct(
            F.col("precio_actual").alias("price"),
            F.when(F.col("descuento_pct") > 3, F.col("precio_anterior")).alias("beforePrice"),
        ),
        stock=F.when(F.col("stock") != 3, F.col("stock")),
        gtin=F.nullif("gtin", F.lit("")),
    )


def _expected(before: str, stock: str, gtin: str = "gtin", volume: str = "volumen_ml") -> str:
    return f"""CAST(external_product_id AS VARCHAR) AS id, nombre, tipo, {volume} AS volumen_ml, precio_actual, {before} AS precio_anterior,
      {O.discount('precio_actual', before)} AS descuento_pct, {O.per_100ml('precio_actual', volume)} AS precio_por_100ml,
      {stock} AS stock, {gtin} AS gtin"""


QUICK_SQL = _expected("CASE WHEN descuento_pct > 3 AND precio_anterior <> 0 THEN precio_anterior ELSE precio_actual END", "CASE WHEN stock <> 3 THEN stock END")


@query("b01_quick_commerce_products", statement(f"SELECT platform, {QUICK_SQL} FROM products", "products"))
def quick_commerce(spark, sf):
    return payloads.quick_commerce_products(_quick(_snap_products(spark, sf))).select("platform", *OUT)


@query(
    "b02_products_in_page_state",
    """SELECT page_id, CAST(c AS BIGINT) * 2 + i AS pos, CAST(page_id AS VARCHAR) || '-' || CAST(c AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS product_id,
    'Cerveza ' || split_part(url, '/', 3) AS name, CAST(length(html) + i AS DOUBLE) AS price
    FROM pages, (VALUES (0), (1)) a(c), (VALUES (0), (1)) b(i)
    WHERE page_id % 7 <> 3""",
)
def page_state(spark, sf):
    return _page_products(spark, sf, F.lit(False))


@query(
    "b02_pages_with_odd_fields",
    """SELECT page_id, CAST(c AS BIGINT) * 2 + i AS pos, CAST(page_id AS VARCHAR) || '-' || CAST(c AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS product_id,
    'Cerveza ' || split_part(url, '/', 3) AS name, CASE WHEN NOT (page_id % 5 = 0 AND c = 0 AND i = 1) THEN CAST(length(html) + i AS DOUBLE) END AS price
    FROM pages, (VALUES (0), (1)) a(c), (VALUES (0), (1)) b(i)
    WHERE page_id % 7 <> 3""",
)
def page_state_with_odd_fields(spark, sf):
    """A price that is no number costs that price and nothing else."""
    return _page_products(spark, sf, F.col("page_id") % 5 == 0)


def _page_products(spark, sf, odd):
    pages = fx.table(spark, sf, "pages")

    def product(c, i):
        return F.struct(
            F.concat_ws("-", F.col("page_id").cast("string"), F.lit(str(c)), F.lit(str(i))).alias("product_id"),
            F.concat(F.lit("Cerveza "), F.split("url", "/")[2]).alias("name"),
            (F.length("html") + i).cast("double").alias("price"),
        )

    components = F.array(
        *[F.struct(F.struct(F.array(product(c, 0), product(c, 1)).alias("products")).alias("resource")) for c in (0, 1)]
    )
    entry = F.struct(F.struct(F.struct(components.alias("components")).alias("data")).alias("aisle_detail_response"))
    node = F.concat(F.lit("storefront/"), F.col("page_id").cast("string"))
    state = F.struct(F.struct(F.struct(F.create_map(node, entry, F.lit("other"), entry).alias("fallback")).alias("pageProps")).alias("props"))
    text = F.to_json(state)
    text = F.when(odd, F.regexp_replace(text, r'("product_id":"[^"]*-0-1","name":"[^"]*","price":)[0-9.E]+', '$1"n/a"')).otherwise(text)
    script = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), text, F.lit("</script><script></script>"))
    full = pages.select(
        "page_id",
        F.when(F.col("page_id") % 7 != 3, F.concat("html", script)).otherwise(F.col("html")).alias("html"),
    )
    named = F.concat(F.lit("storefront/"), F.col("page_id").cast("string"))
    found = payloads.storefront_page_products(full, "html", named)
    return found.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "payload.product_id", "payload.name", "payload.price"
    )


@query(
    "b03_first_page_build",
    r"""SELECT lang, arg_min(token, page_id) AS build_id FROM (SELECT page_id,
    nullif(regexp_extract(html, 'lang="([^"]*)"', 1), '') AS lang,
    CASE WHEN page_id % 3 <> 0 THEN nullif(regexp_extract(html, '<title>([^"<]+)<', 1), '') END AS token FROM pages) WHERE TRUE GROUP BY lang""",
)
def page_builds(spark, sf):
    title = F.nullif(F.regexp_extract("html", '<title>([^"<]+)<', 1), F.lit(""))
    stamped = F.when(
        (F.col("page_id") % 3 != 0) & title.isNotNull(),
        F.concat("html", F.lit('{"buildId":"'), title, F.lit('"}')),
    ).otherwise(F.col("html"))
    pages = fx.table(spark, sf, "pages").select(
        "page_id", F.nullif(F.regexp_extract("html", 'lang="([^"]*)"', 1), F.lit("")).alias("lang"), stamped.alias("html")
    )
    return payloads.first_build_id(pages, ["lang"], "html", "page_id")


def _storefront(rows):
    fields = F.struct(
        F.col("external_product_id").cast("string").alias("product_id"),
        F.col("nombre").alias("name"),
        F.nullif("marca", F.lit("")).alias("trademark"),
        F.col("volumen_ml").cast("double").alias("quantity"),
        F.lit("ml").alias("unit_type"),
        F.col("precio_actual").alias("price"),
        F.when(F.col("descuento_pct") > 3, F.col("precio_anterior")).alias("real_price"),
        F.nullif("stock", F.lit(0)).alias("stock"),
        (F.col("l_linenumber") > 3).alias("in_stock"),
        F.nullif("gtin", F.lit("")).alias("ean"),
        F.array(
            F.to_json(F.struct(F.lit("Envío gratis").alias("description"), F.col("promo_raw").alias("label"))),
            F.lit("25%Dto"),
        ).alias("complex_discounts"),
        F.struct(
            F.lit("dorada").alias("beer_color"),
            F.lit(None).cast("string").alias("beer_style"),
            (F.col("l_linenumber") / F.lit(2.0)).alias("abv"),
            (F.col("l_linenumber") == 5).alias("is_zero_alcohol"),
            F.lit(None).cast("string").alias("beer_origin"),
        ).alias("attributes"),
    )
    return rows.select("platform", fields.alias("payload"))


STORE_SQL = _expected(
    "CASE WHEN descuento_pct > 3 AND precio_anterior <> 0 THEN precio_anterior ELSE precio_actual END",
    "CASE WHEN stock <> 0 THEN stock WHEN l_linenumber > 3 THEN 1 ELSE 0 END",
)
PROMO_COLUMNS = ", ".join(PROMO_OUT)


@query(
    "b04_storefront_products",
    statement(
        f"""SELECT platform, {STORE_SQL}, {PROMO_COLUMNS}, l_linenumber / CAST(2 AS DOUBLE) AS abv,
        l_linenumber = 5 AS is_zero_alcohol, 'dorada' AS beer_color FROM products""",
        "products",
    ),
)
def storefront(spark, sf):
    return payloads.storefront_products(_storefront(_snap_products(spark, sf))).select(
        "platform", *OUT, *PROMO_OUT, "abv", "is_zero_alcohol", "beer_color"
    )


def _catalog(rows):
    listed = F.when(F.col("l_linenumber") == 7, F.col("precio_actual") * 82).when(
        F.col("l_linenumber") > 2, F.col("precio_anterior")
    )
    teaser = lambda column, text: F.array(F.struct(text.alias(column)))
    offer = F.struct(
        F.col("precio_actual").alias("Price"),
        listed.alias("ListPrice"),
        F.col("stock").alias("AvailableQuantity"),
        teaser("Name", F.lit("Envío")).alias("Teasers"),
        teaser("<Name>k__BackingField", F.col("promo_raw")).alias("PromotionTeasers"),
    )
    other = F.struct(F.lit(1.0).alias("Price"))
    item = F.struct(
        F.lit("x").alias("itemId"),
        F.col("nombre").alias("nameComplete"),
        F.col("gtin").alias("ean"),
        F.array(F.struct(offer.alias("commertialOffer"))).alias("sellers"),
    )
    return _as_json(
        rows,
        "catalog",
        productId=F.col("external_product_id").cast("string"),
        productName=F.when(F.col("l_linenumber") % 2 == 0, F.col("nombre")),
        brand=F.col("marca"),
        items=F.filter(F.array(item), lambda _: F.col("l_linenumber") != 1),
        ignored=other,
    )


CATALOG_BEFORE = "CASE WHEN l_linenumber BETWEEN 3 AND 6 AND precio_anterior <> 0 THEN precio_anterior ELSE precio_actual END"
CATALOG_SQL = _expected(CATALOG_BEFORE, "stock")


@query(
    "b05_catalog_products",
    statement(f"SELECT platform, {CATALOG_SQL}, {PROMO_COLUMNS} FROM products WHERE l_linenumber <> 1", "products"),
)
def catalog(spark, sf):
    return payloads.catalog_products(_catalog(_snap_products(spark, sf))).select("platform", *OUT, *PROMO_OUT)


def _branches(price):
    return F.array(price, price * F.lit(2.0), F.lit(None).cast("double"), F.lit(0.0), price * F.lit(0.5))


@query(
    "b06_median_branch_price",
    statement(
        """SELECT platform, external_product_id, CASE WHEN precio_actual <> 0 THEN
        CASE WHEN stock % 2 = 0 THEN precio_actual ELSE (precio_actual * CAST(0.5 AS DOUBLE) + precio_actual) / CAST(2 AS DOUBLE) END END AS mediana FROM snap""",
        "snap",
    ),
)
def branch_median(spark, sf):
    price = F.col("precio_actual")
    prices = F.when(F.col("stock") % 2 == 0, _branches(price)).otherwise(F.array(price, price * F.lit(0.5)))
    return fx.snapshot(spark, sf).select(
        "platform",
        "external_product_id",
        payloads.median_price(F.transform(prices, lambda x: F.struct(x.alias("listPrice")))).alias("mediana"),
    )


def _search(rows):
    name = F.when(F.col("l_linenumber") == 3, F.concat(F.lit("Vaso "), "nombre")).otherwise(F.col("nombre"))
    return _as_json(
        rows,
        "search",
        value=name,
        data=F.struct(
            F.col("external_product_id").alias("id"),
            F.nullif(F.when(F.col("l_linenumber") > 1, name), F.lit("")).alias("sku_display_name"),
            F.col("marca").alias("product_brand"),
            (F.col("precio_actual") * F.when(F.col("l_linenumber") == 4, F.lit(3.0)).otherwise(F.lit(1.5))).alias("product_list_price"),
            F.transform(_branches(F.col("precio_actual")), lambda x: F.struct(x.alias("listPrice"))).alias("price"),
            F.array(F.struct(F.col("promo_raw").alias("discountText"))).alias("discounts"),
        ),
    )


SEARCH_SQL = _expected(
    "CASE WHEN l_linenumber = 4 THEN precio_actual ELSE precio_actual * CAST(1.5 AS DOUBLE) END", "1", "''"
)
SEARCH_WHERE = (
    f"l_linenumber <> 3 AND precio_actual >= 300 AND coalesce({O.per_100ml('precio_actual', 'volumen_ml')}, 60) >= 60"
)


@query(
    "b07_search_products",
    statement(f"SELECT platform, {SEARCH_SQL}, {PROMO_COLUMNS} FROM products WHERE {SEARCH_WHERE}", "products"),
)
def search(spark, sf):
    return payloads.search_products(_search(_snap_products(spark, sf))).select("platform", *OUT, *PROMO_OUT)


@query(
    "b08_last_value_first_position",
    statement(
        """SELECT platform, id, run_ts, precio_actual, stock FROM (SELECT platform, CAST(external_product_id AS VARCHAR) AS id,
        first_value(run_ts) OVER w AS run_ts, last_value(precio_actual) OVER w AS precio_actual, last_value(stock) OVER w AS stock,
        row_number() OVER w AS rn FROM obs WHERE external_product_id % 17 <> 0 WINDOW w AS (PARTITION BY platform, external_product_id
        ORDER BY run_ts, l_orderkey, l_linenumber, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE rn = 1""",
        "obs",
    ),
)
def dedupe(spark, sf):
    rows = fx.observations(spark, sf).select(
        "platform",
        F.when(F.col("external_product_id") % 17 == 0, F.lit("")).otherwise(F.col("external_product_id").cast("string")).alias("id"),
        F.struct("run_ts", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("pos"),
        "precio_actual",
        "stock",
    )
    return payloads.dedupe_products(rows, ["platform"]).select("platform", "id", "pos.run_ts", "precio_actual", "stock")


@query(
    "b09_accepted_snapshots",
    statement(
        """SELECT o.platform, o.run_ts, o.external_product_id, o.precio_actual FROM obs o JOIN (SELECT platform, run_ts FROM obs
        GROUP BY 1, 2 HAVING count(*) >= 5) g ON g.platform = o.platform AND g.run_ts = o.run_ts""",
        "obs",
    ),
)
def acceptance(spark, sf):
    return landing.accepted_snapshots(fx.observations(spark, sf), ["platform", "run_ts"]).select(
        "platform", "run_ts", "external_product_id", "precio_actual"
    )


@query(
    "b10_all_sources",
    statement(
        f"""SELECT platform, {QUICK_SQL} FROM products WHERE platform = 'pedidosya'
        UNION ALL SELECT platform, {STORE_SQL} FROM products WHERE platform = 'rappi'
        UNION ALL SELECT platform, {SEARCH_SQL} FROM products WHERE platform = 'coto' AND {SEARCH_WHERE}
        UNION ALL SELECT platform, {CATALOG_SQL} FROM products WHERE platform NOT IN ('pedidosya', 'rappi', 'coto') AND l_linenumber <> 1""",
        "products",
    ),
)
def all_sources(spark, sf):
    rows = _snap_products(spark, sf)
    catalogs = ["carrefour", "jumbo", "disco", "vea", "dia"]
    return payloads.normalize_sources(
        {
            "pedidosya": _quick(rows.filter("platform = 'pedidosya'")),
            "rappi": _storefront(rows.filter("platform = 'rappi'")),
            "coto": _search(rows.filter("platform = 'coto'")),
            ",".join(catalogs): _catalog(rows.filter(F.col("platform").isin(catalogs))),
        }
    ).select("platform", *OUT)


@query(
    "b11_envelope_counts",
    statement(
        """SELECT platform, run_ts, CAST(count(*) AS INTEGER) AS total,
        CAST(count(*) FILTER (WHERE descuento_pct > 0) AS INTEGER) AS con_descuento FROM obs_products GROUP BY 1, 2""",
        "obs_products",
    ),
)
def envelope_counts(spark, sf):
    return landing.envelope_counts(fx.as_products(fx.observations(spark, sf)), ["platform", "run_ts"])


# --- C: scalar functions --------------------------------------------------------------

UNITS = ["ml", "CC", "cm3", " L", "litros", "cl", "", "u"]
UNIT_SQL = "CASE l_suppkey % 8 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(UNITS)) + " END"


@query(
    "c01_to_ml",
    f"SELECT l_orderkey, l_linenumber, l_quantity, l_suppkey, {O.to_ml('(l_quantity * l_discount)', UNIT_SQL)} AS ml FROM lineitem",
)
def to_ml(spark, sf):
    unit = F.expr(UNIT_SQL)
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_suppkey",
        T.to_ml(F.col("l_quantity") * F.col("l_discount"), unit).alias("ml"),
    )


DOC_TEXT = "text || ' ' || CAST(n_chars AS VARCHAR) || CASE doc_id % 5 WHEN 0 THEN ' ml' WHEN 1 THEN ',5L' WHEN 2 THEN 'cc lata' WHEN 3 THEN 'litro' ELSE ' cl x 6' END"


def _documents(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", "lang", "text", F.expr(DOC_TEXT.replace("VARCHAR", "STRING")).alias("t"))


@query(
    "c02_volume_from_name",
    f"SELECT doc_id, {O.volume('t')} AS ml FROM (SELECT doc_id, {DOC_TEXT} AS t FROM documents)",
)
def volume_from_name(spark, sf):
    return _documents(spark, sf).select("doc_id", T.volume_from_name(F.col("t")).alias("ml"))


@query(
    "c03_type_text",
    statement(
        f"""SELECT platform, external_product_id, CASE WHEN t <> '' THEN t WHEN l_linenumber % 2 = 0 THEN 'estilo' ELSE 'dorada' END AS tipo
        FROM (SELECT *, {O.type_text("CASE WHEN l_linenumber = 4 THEN 'Cerveza ' || marca || ' 473 ml,' ELSE nombre END", 'marca')} AS t FROM snap)""",
        "snap",
    ),
)
def type_text(spark, sf):
    name = F.when(F.col("l_linenumber") == 4, F.concat(F.lit("Cerveza "), "marca", F.lit(" 473 ml,"))).otherwise(F.col("nombre"))
    style = F.when(F.col("l_linenumber") % 2 == 0, F.lit("estilo")).otherwise(F.lit(""))
    return fx.snapshot(spark, sf).select(
        "platform", "external_product_id",
        T.type_text(name, F.col("marca"), F.lit("dorada"), style).alias("tipo"),
    )


@query(
    "c04_c05_discount_and_unit_price",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, a AS price, {O.discount('a', 'b')} AS descuento_pct, {O.per_100ml('a', 'v')} AS por_100ml
    FROM (SELECT *, l_extendedprice / (l_orderkey + 1) AS a, l_extendedprice / l_quantity AS b, CAST(l_partkey % 1000 AS INTEGER) AS v FROM lineitem)""",
)
def discount_and_unit(spark, sf):
    rows = fx.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice / (l_orderkey + 1) AS a",
        "l_extendedprice / l_quantity AS b", "CAST(l_partkey % 1000 AS INT) AS v",
    )
    a, b, v = F.col("a"), F.col("b"), F.col("v")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", a.alias("price"),
        N.discount_pct(a, b).alias("descuento_pct"), N.price_per_100ml(a, v).alias("por_100ml"),
    )


PROMO_TEXTS = [
    "2x1", "Llevá 3 X 2 hoy", "1x2", "7x3 2do al 70%", "2da unidad al 50%", "segunda unidad 80% off", "Estrella Galicia 2x1",
    "Mi CRF 20%", "4×3", "2do al 130%", "", "25%Dto", "2 al 60 %", "2º al 50%",
]
PROMO_SQL = f"CASE (l_orderkey + l_linenumber) % {len(PROMO_TEXTS)} " + " ".join(
    f"WHEN {i} THEN '{t}'" for i, t in enumerate(PROMO_TEXTS)
) + " END"


@query(
    "c06_c07_c08_promotion_texts",
    f"""SELECT l_orderkey, l_linenumber, l_suppkey, p AS precio, t AS texto, {O.promo_fields('t', 'p')}
    FROM (SELECT *, {PROMO_SQL} AS t, CASE WHEN l_linenumber = 2 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice / 7 END AS p FROM lineitem)""",
)
def promotions(spark, sf):
    rows = fx.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_suppkey",
        "CASE WHEN l_linenumber = 2 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice / 7 END AS precio", f"{PROMO_SQL} AS texto",
    )
    parsed = T.computed_once(rows, {"_promo": parse_promo(F.col("texto"), F.col("precio"))})
    return parsed.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "precio", "texto", *promo_columns(F.col("_promo"))
    )


@query(
    "c09_best_promotion",
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_partkey, pos, texto, {O.promo_fields('texto', 'l_extendedprice')}
      FROM (SELECT l.*, pos, list_extract([{', '.join(f"'{t}'" for t in PROMO_TEXTS)}],
        CAST((l_orderkey + pos * 3) % {len(PROMO_TEXTS)} AS INTEGER) + 1) AS texto FROM lineitem l, (VALUES (0), (1), (2)) v(pos)))
    SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, promo_etiqueta, promo_texto, promo_tipo, promo_precio_efectivo
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice ORDER BY
      CASE WHEN promo_tipo = 'multi' THEN 0 WHEN promo_tipo <> '' THEN 1 ELSE 2 END,
      CASE WHEN promo_tipo = 'multi' THEN promo_precio_efectivo END, pos) AS rn FROM t) WHERE rn = 1""",
)
def best_promotion(spark, sf):
    listed = F.array(*[F.lit(t) for t in PROMO_TEXTS])
    texts = F.array(
        *[F.get(listed, ((F.col("l_orderkey") + pos * 3) % len(PROMO_TEXTS)).cast("int")) for pos in range(3)]
    )
    keys = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"]
    rows = T.computed_once(
        fx.table(spark, sf, "lineitem").select(*keys), {"_promo": best_promo(texts, F.col("l_extendedprice"))}
    )
    flat = rows.select(*keys, *promo_columns(F.col("_promo"))).drop("promo_unidades")
    return flat.dropDuplicates(keys)


@query(
    "c10_c11_normal_text",
    f"SELECT doc_id, strip_accents(lower(text)) AS plain, {O.norm('text')} AS normal FROM documents",
)
def normal_text(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", T.strip_accents(F.lower("text")).alias("plain"), T.norm_text(F.col("text")).alias("normal")
    )


OTHER_SCRIPTS = ("aeiouéèüàçñöä", "άέίόύйёЇήΰΩЌѓ")  # letters of a text and what stands for them, to have texts of other scripts


@query(
    "c10_accents_of_other_scripts",
    f"SELECT doc_id, md5(strip_accents(translate(text, '{OTHER_SCRIPTS[0]}', '{OTHER_SCRIPTS[1]}'))) AS plain_md5 FROM documents",
)
def accents_of_other_scripts(spark, sf):
    docs = _documents(spark, sf)
    return docs.select("doc_id", F.md5(T.strip_accents(F.translate("text", *OTHER_SCRIPTS)).cast("binary")).alias("plain_md5"))


@query(
    "c12_c17_zero_alcohol",
    statement(
        f"""SELECT platform, external_product_id, {O.zero_alcohol("tipo || ' ' || nombre")} AS variante_cero,
        {O.zero_alcohol("tipo || ' ' || nombre")} OR l_linenumber = 5 AS is_zero FROM products""",
        "products",
    ),
)
def zero_alcohol(spark, sf):
    zero = T.mentions_zero_alcohol(F.col("tipo"), F.col("nombre"))
    return _snap_products(spark, sf).select(
        "platform", "external_product_id", zero.alias("variante_cero"), (zero | (F.col("l_linenumber") == 5)).alias("is_zero")
    )


@query(
    "c13_d04_canonical_volume",
    statement(
        "SELECT p_partkey, v AS volumen_ml, coalesce(a.canon, nullif(v, 0)) AS canon FROM (SELECT p_partkey, CAST(p_partkey % 800 AS INTEGER) AS v FROM part) LEFT JOIN volume_alias a ON a.raw = v",
        "volume_alias",
    ),
)
def canonical_volume(spark, sf):
    rows = fx.table(spark, sf, "part").selectExpr("p_partkey", "CAST(p_partkey % 800 AS INT) AS volumen_ml")
    return rows.select("p_partkey", "volumen_ml", resolve_volume(builtin_aliases()).alias("canon"))


@query(
    "c14_c15_container_and_pack",
    f"""SELECT doc_id, {O.container('n')} AS envase, CAST({O.pack('n')} AS INTEGER) AS pack
    FROM (SELECT doc_id, {O.norm("t || CASE doc_id % 4 WHEN 0 THEN ' porrón' WHEN 1 THEN ' pack de 12x473' WHEN 2 THEN ' x 60' ELSE ' long-neck' END")} AS n
      FROM (SELECT doc_id, {DOC_TEXT} AS t FROM documents))""",
)
def container_and_pack(spark, sf):
    ending = F.expr("CASE doc_id % 4 WHEN 0 THEN ' porrón' WHEN 1 THEN ' pack de 12x473' WHEN 2 THEN ' x 60' ELSE ' long-neck' END")
    rows = T.computed_once(_documents(spark, sf), {"n": T.norm_text(F.concat("t", ending))})
    return rows.select("doc_id", T.container(F.col("n")).alias("envase"), T.pack_quantity(F.col("n")).alias("pack"))


@query(
    "c16_gtin",
    statement("SELECT platform, external_product_id, ltrim(trim('  00' || gtin || ' '), '0') AS gtin_norm FROM snap", "snap"),
)
def gtin(spark, sf):
    return fx.snapshot(spark, sf).select(
        "platform", "external_product_id",
        T.normal_gtin(F.concat(F.lit("  00"), "gtin", F.lit(" "))).alias("gtin_norm"),
    )


NORMAL_COLUMNS = [
    "platform", "external_product_id", "nombre_norm", "brand_slug", "brand_display", "sub_brand", "variant_slug",
    "volume_ml_canon", "container", "pack_qty", "is_zero", "gtin_norm", "structural_key",
]


@query("c18_c19_normalised_offers", statement(f"SELECT {', '.join(NORMAL_COLUMNS)} FROM offers", "offers"))
def normalised(spark, sf):
    return fx.offers(spark, sf).select(*NORMAL_COLUMNS)


@query(
    "c20_c21_own_key_and_name",
    statement(
        """SELECT platform, external_product_id, own_key AS canonical_key, concat_ws(' ', brand_display, nullif(sub_brand, ''),
        CASE WHEN variant_slug <> 'unknown' THEN array_to_string(list_transform(string_split(replace(variant_slug, '-', ' '), ' '),
          lambda w: upper(w[1]) || w[2:]), ' ') END,
        CASE WHEN coalesce(volume_ml_canon, 0) <> 0 THEN CAST(volume_ml_canon AS VARCHAR) || 'ml' END, container,
        CASE WHEN pack_qty > 1 THEN 'x' || CAST(pack_qty AS VARCHAR) END) AS display_name FROM offers""",
        "offers",
    ),
)
def own_key(spark, sf):
    from shelfscope.operators.normalize import with_own_key

    return with_own_key(offers(spark, sf)).select(
        "platform", "external_product_id", "canonical_key",
        L.display_name(
            F.col("brand_display"), F.col("sub_brand"), F.col("variant_slug"), F.col("volume_ml_canon"),
            F.col("container"), F.col("pack_qty"),
        ).alias("display_name"),
    )


@query(
    "c22_c23_price_cells",
    statement(
        """SELECT platform, external_product_id, precio_actual, stock, coalesce(stock, 0) <> 0 AND coalesce(precio_actual, 0) > 0 AS disponible,
        CASE WHEN promo_tipo = 'multi' AND coalesce(promo_precio_efectivo, 0) <> 0 THEN promo_etiqueta END AS etiqueta,
        CASE WHEN promo_tipo = 'multi' AND coalesce(promo_precio_efectivo, 0) <> 0 THEN promo_precio_efectivo END AS precio_efectivo FROM products""",
        "products",
    ),
)
def price_cells(spark, sf):
    from shelfscope.operators.matrix import price_cell

    cells = T.computed_once(_snap_products(spark, sf), {"cell": price_cell()})
    return cells.select(
        "platform", "external_product_id", "cell.precio_actual", "cell.stock", "cell.disponible",
        F.col("cell.promo.etiqueta").alias("etiqueta"), F.col("cell.promo.precio_efectivo").alias("precio_efectivo"),
    )


NOW = "2024-02-01 00:00:00"


@query(
    "c24_c25_c31_ages",
    f"""SELECT event_id, iso, CASE WHEN event_id % 9 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE s / CAST(3600 AS DOUBLE) END AS horas,
    CASE WHEN event_id % 9 = 0 THEN '—' WHEN s < 60 THEN 'hace instantes' WHEN m < 60 THEN 'hace ' || CAST(m AS VARCHAR) || 'm'
      WHEN h < 48 THEN 'hace ' || CAST(h AS VARCHAR) || 'h ' || CAST(m % 60 AS VARCHAR) || 'm'
      ELSE 'hace ' || CAST(d AS VARCHAR) || ' día' || CASE WHEN d <> 1 THEN 's' ELSE '' END END AS edad
    FROM (SELECT *, CAST(floor(m / 60) AS BIGINT) AS h, CAST(floor(m / 1440) AS BIGINT) AS d FROM
      (SELECT *, CAST(floor(s / 60) AS BIGINT) AS m FROM (SELECT event_id,
        CASE WHEN event_id % 9 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS iso,
        epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', ts)) AS s FROM events)))""",
)
def ages(spark, sf):
    now = F.to_timestamp(F.lit(NOW))
    iso = F.when(F.col("event_id") % 9 == 0, F.lit("")).otherwise(L.iso_utc(F.col("ts")))
    rows = T.computed_once(fx.table(spark, sf, "events").select("event_id", "ts"), {"iso": iso})
    return rows.select(
        "event_id", "iso", L.age_hours(F.col("iso"), now).alias("horas"), L.age_label(F.col("iso"), now).alias("edad")
    )


@query("c26_local_day", "SELECT event_id, CAST(ts - INTERVAL 3 HOUR AS DATE) AS dia FROM events")
def local_days(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", L.local_day(F.col("ts")).alias("dia"))


@query(
    "c27_c28_price_views",
    statement(
        """SELECT platform, external_product_id, CASE WHEN descuento_pct > 0 THEN precio_actual / (CAST(1 AS DOUBLE) - descuento_pct / CAST(100 AS DOUBLE)) END AS precio_lista,
        CASE WHEN coalesce(volumen_ml, 0) <> 0 THEN precio_actual * (CAST(100 AS DOUBLE) / volumen_ml) ELSE precio_actual END AS por_100ml,
        CASE WHEN coalesce(volumen_ml, 0) <> 0 THEN promo_precio_efectivo * (CAST(100 AS DOUBLE) / volumen_ml) ELSE promo_precio_efectivo END AS promo_por_100ml FROM products""",
        "products",
    ),
)
def price_views(spark, sf):
    price, volume = F.col("precio_actual"), F.col("volumen_ml")
    return _snap_products(spark, sf).select(
        "platform", "external_product_id",
        N.list_price(price, F.col("descuento_pct")).alias("precio_lista"),
        N.per_100ml_view(price, volume).alias("por_100ml"),
        N.per_100ml_view(F.col("promo_precio_efectivo"), volume).alias("promo_por_100ml"),
    )


SIZES_SQL = "[" + ", ".join(f"{s}::DOUBLE" for s in fixed.STANDARD_SIZES_ML) + "]"


@query(
    "c29_c30_labels",
    statement(
        f"""SELECT platform, external_product_id, concat_ws(' · ', CASE WHEN coalesce(s, 0) <> 0 THEN CAST(s AS VARCHAR) || 'cc' ELSE 's/tamaño' END, container,
          CASE WHEN pack_qty > 1 THEN 'pack x' || CAST(pack_qty AS VARCHAR) END) AS config,
        CASE WHEN variant_slug = 'unknown' THEN '' ELSE replace(variant_slug, '-', ' ') END AS variante,
        CASE WHEN variant_slug = 'unknown' THEN 'Clásica' ELSE replace(variant_slug, '-', ' ') END AS modelo
        FROM (SELECT *, CASE WHEN pack_qty > 1 AND v <> 0 AND len(list_filter({SIZES_SQL}, lambda z: abs(z - v / pack_qty) <= 6)) > 0
          THEN CAST(floor(v / pack_qty + 0.5::DOUBLE) AS INTEGER) ELSE v END AS s
          FROM (SELECT *, CASE WHEN pack_qty > 1 AND external_product_id % 2 = 0 THEN volume_ml_canon * pack_qty ELSE volume_ml_canon END AS v FROM offers))""",
        "offers",
    ),
)
def config_labels(spark, sf):
    total = F.when(
        (F.col("pack_qty") > 1) & (F.col("external_product_id") % 2 == 0), F.col("volume_ml_canon") * F.col("pack_qty")
    ).otherwise(F.col("volume_ml_canon"))
    return offers(spark, sf).select(
        "platform", "external_product_id",
        L.config_label(total, F.col("container"), F.col("pack_qty")).alias("config"),
        L.variant_label(F.col("variant_slug")).alias("variante"),
        L.model_label(F.col("variant_slug")).alias("modelo"),
    )
