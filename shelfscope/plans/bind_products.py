"""Queries for joins, product resolution, matrix, history, views, health and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscope import fixed_values as fixed
from shelfscope.functions.labels import iso_utc
from shelfscope.operators import daily as D
from shelfscope.operators import health as H
from shelfscope.operators import history as Hi
from shelfscope.operators import matrix as M
from shelfscope.operators import resolve as R
from shelfscope.operators import series
from shelfscope.operators import views as V
from shelfscope.operators.pages import read_page, write_pages
from shelfscope.operators.similarity import similar_names, word_set
from shelfscope.operators.sinks import MARK, published
from shelfscope.plans import fixtures as fx
from shelfscope.plans import oracle_resolve  # noqa: F401 - defines the statement parts
from shelfscope.plans.catalog_run import Run, publish
from shelfscope.plans.oracle_parts import statement
from shelfscope.plans.registry import history, landed, matrix, offers, query, resolved, shared
from shelfscope.session import cut_lineage, scratch_path
from shelfscope.sources.aliases import builtin_aliases
from shelfscope.streaming.alarms import alarm_stream, error_window_stream

OFFER = ["platform", "external_product_id"]


def labelled(spark, sf):
    return R.label_exact(offers(spark, sf))


# --- D: joins -----------------------------------------------------------------------


@query(
    "d01_brand_by_exact_alias",
    statement(
        """SELECT s.platform, s.external_product_id, b.slug AS brand_slug, b.sub AS sub_brand FROM snap s
        JOIN normal n ON n.nombre = s.nombre AND n.marca = s.marca LEFT JOIN brand_alias b ON b.alias = n.marca_norm""",
        "snap", "normal", "brand_alias",
    ),
)
def brand_exact(spark, sf):
    from shelfscope.functions.text import computed_once, norm_text

    brands = builtin_aliases().brands
    rows = computed_once(fx.snapshot(spark, sf), {"m": norm_text(F.col("marca"))})
    rows = rows.withColumn("_line", brands.exact("m"))
    return rows.select(*OFFER, brands.value("_line", 1).alias("brand_slug"), brands.value("_line", 3).alias("sub_brand"))


@query(
    "d02_d03_alias_join_any_size",
    statement("SELECT platform, external_product_id, brand_slug, brand_display, sub_brand, variant_slug, structural_key FROM offers", "offers"),
)
def alias_join(spark, sf):
    """The form for big alias tables: n-gram equi-join over the distinct texts."""
    from shelfscope.operators.normalize import normalize_offers_by_join
    from shelfscope.sources.aliases import BRAND_COLUMNS, VARIANT_COLUMNS, clean_aliases, parse_fixed

    def frame(text, columns):
        rows = [(*row, i) for i, row in enumerate(parse_fixed(text))]
        return clean_aliases(spark.createDataFrame(rows, [*columns, "line"]))

    brands, variants = frame(fixed.BRAND_ALIASES, BRAND_COLUMNS), frame(fixed.VARIANT_ALIASES, VARIANT_COLUMNS)
    rows = cut_lineage(fx.as_products(fx.snapshot(spark, sf)))
    return normalize_offers_by_join(rows, brands, variants, builtin_aliases()).select(
        *OFFER, "brand_slug", "brand_display", "sub_brand", "variant_slug", "structural_key"
    )


@query(
    "d05_d06_e01_e02_exact_labels",
    statement("SELECT platform, external_product_id, label0 AS label, rooted FROM labelled", "labelled"),
)
def exact_labels(spark, sf):
    return labelled(spark, sf).select(*OFFER, "label", "rooted")


def _names(spark, sf):
    rows = labelled(spark, sf).select(
        R.block_key().alias("block"), word_set(F.col("nombre_norm")).alias("words"), "rooted"
    )
    return cut_lineage(rows.groupBy("block", "words").agg(F.lit(True).alias("is_open")))


@query(
    "d07_e03_e04_similar_names",
    statement("SELECT block, least(words_a, words_b) AS low, greatest(words_a, words_b) AS high, score FROM scored WHERE score >= 90", "scored"),
)
def fuzzy_pairs(spark, sf):
    pairs = similar_names(_names(spark, sf))
    return pairs.select("block", F.least("words_a", "words_b").alias("low"), F.greatest("words_a", "words_b").alias("high"), "score")


# --- E: products ----------------------------------------------------------------------

E_COLUMNS = ["canonical_id", "canonical_key", "brand_slug", "brand_display", "sub_brand", "variant_slug", "volume_ml", "container",
             "pack_qty", "gtin", "display_name", "n_platforms", "match_method", "review_needed"]


@query(
    "e05_components",
    statement(
        "SELECT platform, external_product_id, min(offer_ord) OVER (PARTITION BY label) AS component FROM resolved", "resolved"
    ),
)
def components(spark, sf):
    rows = cut_lineage(R.label_fuzzy(labelled(spark, sf)).select(*OFFER, "offer_ord", "label"))
    firsts = rows.groupBy("label").agg(F.min("offer_ord").alias("component"))
    return rows.join(firsts.hint("shuffle_hash"), "label").select(*OFFER, "component")


@query(
    "e06_canonical_ids",
    statement("SELECT platform, external_product_id, canonical_id, canonical_key FROM matched", "matched"),
)
def canonical_ids(spark, sf):
    return resolved(spark, sf)[0].select(*OFFER, "canonical_id", "canonical_key")


def exact(spark, sf):
    return cut_lineage(labelled(spark, sf))


@query(
    "e07_representatives",
    statement(
        """SELECT label, platform, nombre, offer_ord FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY
        CASE WHEN gtin_norm <> '' THEN 0 ELSE 1 END, CASE platform WHEN 'pedidosya' THEN 0 WHEN 'rappi' THEN 1 ELSE 9 END,
        length(nombre), offer_ord) AS rn FROM resolved_exact) WHERE rn = 1""",
        "resolved_exact",
    ),
)
def representatives(spark, sf):
    return R.representatives(exact(spark, sf)).select("label", "rep.platform", "rep.nombre", "rep.offer_ord")


@query(
    "e08_e09_majorities",
    statement("SELECT label, variant_slug, container, is_zero, sub_brand, gtin FROM canonicals_exact", "canonicals_exact"),
)
def majorities(spark, sf):
    rows = exact(spark, sf)
    codes = rows.groupBy("label").agg(F.coalesce(F.max(F.nullif("gtin_norm", F.lit(""))), F.lit("")).alias("gtin"))
    return R.majorities(rows).join(codes, "label").select("label", "variant_slug", "container", "is_zero", "sub_brand", "gtin")


@query(
    "e10_e11_link_methods",
    statement("SELECT label, n_platforms, match_method, review_needed FROM canonicals_exact", "canonicals_exact"),
)
def link_methods(spark, sf):
    return R.link_methods(exact(spark, sf))


@query("e12_products", statement(f"SELECT {', '.join(E_COLUMNS)} FROM canonicals", "canonicals"))
def products(spark, sf):
    """Whole resolver from the tables, nothing shared with other queries."""
    _, canonicals = R.assign_canonicals(cut_lineage(fx.offers(spark, sf)))
    return canonicals.select(*E_COLUMNS)


# --- F: matrix ------------------------------------------------------------------------


@query(
    "d08_f01_cheapest_offers",
    statement("SELECT canonical_id, platform, nombre, precio_actual, stock, disponible, efectivo, first_ord FROM cells", "cells"),
)
def cheapest(spark, sf):
    return M.cheapest_cells(resolved(spark, sf)[0]).select(
        "canonical_id", "platform", "cell.nombre", "cell.precio_actual", "cell.stock", "cell.disponible",
        F.col("cell.promo.precio_efectivo").alias("efectivo"), "first_ord",
    )


@query(
    "f02_outlier_guard",
    statement("SELECT canonical_id, platform, precio_actual, disponible, suspect FROM guarded", "guarded"),
)
def outliers(spark, sf):
    rows = M.guard_outliers(M.cheapest_cells(resolved(spark, sf)[0]))
    return rows.select("canonical_id", F.explode("cells").alias("c")).select(
        "canonical_id", "c.platform", "c.cell.precio_actual", "c.cell.disponible", "c.suspect"
    )


MATRIX_COLUMNS = [*M.PRODUCT_FIELDS, "mejor", "ahorro_abs"]


@query("f03_f04_f05_h01_matrix", statement(f"SELECT {', '.join(MATRIX_COLUMNS)} FROM matrix", "matrix"))
def price_matrix(spark, sf):
    matched, canonicals = resolved(spark, sf)
    return M.build_matrix(canonicals, matched).orderBy(*M.matrix_order()).select(*MATRIX_COLUMNS)


@query(
    "f06_f07_run_summary",
    statement(
        """SELECT (SELECT count(*) FROM matched) AS offers, count(*) AS canonicos, count(*) FILTER (WHERE n_platforms > 1) AS comparables,
        count(*) FILTER (WHERE n_platforms > 1 AND NOT review_needed) AS confiables, count(*) FILTER (WHERE review_needed) AS en_revision FROM canonicals""",
        "matched", "canonicals",
    ),
)
def summary(spark, sf):
    return M.run_summary(*resolved(spark, sf))


@query(
    "f11_f12_f13_row_metrics",
    statement("SELECT canonical_id, min_price, min_price_promo, min_per_100ml, max_discount, has_promo FROM metrics", "metrics"),
)
def metrics(spark, sf):
    return V.with_metrics(matrix(spark, sf)).select(
        "canonical_id", "min_price", "min_price_promo", "min_per_100ml", "max_discount", "has_promo"
    )


@query("f14_brand_facet", statement("SELECT DISTINCT brand_display FROM canonicals", "canonicals"))
def brand_facet(spark, sf):
    return V.brand_facet(matrix(spark, sf))


@query("f14_size_facet", statement("SELECT DISTINCT volume_ml FROM canonicals WHERE coalesce(volume_ml, 0) <> 0", "canonicals"))
def size_facet(spark, sf):
    return V.size_facet(matrix(spark, sf))


@query(
    "f15_brand_tree",
    statement(
        """SELECT brand, model, configs, CAST(count(*) OVER (PARTITION BY brand) AS BIGINT) AS models_of_brand,
        CAST(sum(configs) OVER (PARTITION BY brand) AS BIGINT) AS configs_of_brand
        FROM (SELECT brand_display AS brand, CASE WHEN variant_slug = 'unknown' THEN 'Clásica' ELSE replace(variant_slug, '-', ' ') END AS model,
          count(*) AS configs FROM canonicals GROUP BY 1, 2)""",
        "canonicals",
    ),
)
def brand_tree(spark, sf):
    return V.brand_tree(matrix(spark, sf))


@query("f18_platforms", statement("SELECT DISTINCT platform FROM snap", "snap"))
def platforms(spark, sf):
    return offers(spark, sf).select("platform").distinct().orderBy("platform")


# --- F, G: history --------------------------------------------------------------------


@query("a08_f08_lowest_prices", statement("SELECT canonical_key, run_ts, p FROM lowest", "lowest"))
def lowest(spark, sf):
    return Hi.lowest_prices(fx.history(spark, sf))


SHOP_COLUMNS = ["canonical_key", "platform", "run_ts", "precio", "descuento_pct", "promo_etiqueta", "precio_efectivo"]


@query("f09_shop_prices", statement(f"SELECT {', '.join(SHOP_COLUMNS)} FROM shop_prices", "shop_prices"))
def shop_prices(spark, sf):
    return Hi.shop_prices(fx.history(spark, sf)).select(*SHOP_COLUMNS)


@query("f10_last_seen", statement("SELECT platform, max(run_ts) AS last_seen FROM obs GROUP BY platform", "obs"))
def last_seen(spark, sf):
    return Hi.last_seen(fx.observations(spark, sf))


@query("g01_last_runs_per_product", statement("SELECT canonical_key, run_ts, p FROM series", "series"))
def price_series(spark, sf):
    return Hi.price_series(history(spark, sf))


@query("g02_last_runs_per_shop", statement(f"SELECT {', '.join(SHOP_COLUMNS)} FROM shop_series", "shop_series"))
def shop_series(spark, sf):
    return Hi.shop_series(history(spark, sf)).select(*SHOP_COLUMNS)


DAY_COLUMNS = ["canonical_key", "platform", "dia", "precio", "descuento_pct", "promo_etiqueta", "precio_efectivo"]


@query("g03_day_close", statement(f"SELECT {', '.join(DAY_COLUMNS)} FROM closes", "closes"))
def day_close(spark, sf):
    return D.day_close(Hi.shop_series(history(spark, sf))).select(*DAY_COLUMNS)


@query(
    "f16_g04_g07_day_table",
    statement(
        """SELECT canonical_key, platform, dia, precio, precio = min(precio) OVER (PARTITION BY canonical_key, dia) AS es_minimo,
        CASE WHEN precio < lag(precio) OVER w THEN 'baja' WHEN precio > lag(precio) OVER w THEN 'sube' ELSE '' END AS direccion
        FROM shown_days WINDOW w AS (PARTITION BY canonical_key, platform ORDER BY dia)""",
        "shown_days",
    ),
)
def day_table(spark, sf):
    return D.day_table(Hi.shop_series(history(spark, sf))).select(
        "canonical_key", "platform", "dia", "precio", "es_minimo", "direccion"
    )


@query(
    "g05_trends",
    statement(
        """SELECT canonical_key, count(*) AS points, min(p) AS low, max(p) AS high,
        CASE WHEN max(p) - min(p) = 0 THEN CAST(1 AS DOUBLE) ELSE max(p) - min(p) END AS span,
        CASE WHEN arg_max(p, run_ts) < arg_min(p, run_ts) THEN 'down' WHEN arg_max(p, run_ts) > arg_min(p, run_ts) THEN 'up' ELSE 'flat' END AS trend
        FROM series GROUP BY canonical_key""",
        "series",
    ),
)
def trends(spark, sf):
    return D.trends(Hi.price_series(history(spark, sf)))


@query(
    "g06_last_price_per_shop",
    statement("SELECT canonical_key, platform, arg_max(precio, run_ts) AS precio FROM shop_series GROUP BY 1, 2", "shop_series"),
)
def last_prices(spark, sf):
    return D.last_price_per_shop(Hi.shop_series(history(spark, sf)))


@query(
    "f17_chart_extent",
    statement(
        """SELECT canonical_key, count(DISTINCT run_ts) AS times, min(precio) AS low, max(precio) AS high,
        CASE WHEN max(precio) - min(precio) = 0 THEN CAST(1 AS DOUBLE) ELSE max(precio) - min(precio) END AS span FROM shop_series GROUP BY 1""",
        "shop_series",
    ),
)
def chart_extent(spark, sf):
    return D.chart_extent(Hi.shop_series(history(spark, sf)))


@query(
    "f17_i04_chart_times",
    statement(
        "SELECT canonical_key, run_ts, CAST(dense_rank() OVER (PARTITION BY canonical_key ORDER BY run_ts) - 1 AS INTEGER) AS t FROM (SELECT DISTINCT canonical_key, run_ts FROM shop_series)",
        "shop_series",
    ),
)
def chart_times(spark, sf):
    return D.chart_times(Hi.shop_series(history(spark, sf)))


PICKED = "quilmes|rubia%"


@query(
    "g07_store_day_view",
    statement(
        """WITH c AS (SELECT * FROM closes WHERE platform = 'dia' AND canonical_key LIKE 'quilmes|rubia%'),
        d AS (SELECT DISTINCT dia FROM c ORDER BY dia DESC LIMIT 14)
        SELECT canonical_key, dia, precio, descuento_pct, CASE WHEN descuento_pct > 0 THEN precio / (CAST(1 AS DOUBLE) - descuento_pct / CAST(100 AS DOUBLE)) END AS precio_lista,
        promo_etiqueta, precio_efectivo FROM c WHERE dia IN (SELECT dia FROM d)""",
        "closes",
    ),
)
def store_days(spark, sf):
    series = Hi.shop_series(history(spark, sf))
    chosen = series.filter(F.col("canonical_key").like(PICKED)).select("canonical_key").distinct()
    return D.store_day_view(series, chosen, "dia")


# --- D, H, I: rows with history, orders, sets -------------------------------------------


@query(
    "d11_products_with_history",
    statement(
        """SELECT m.canonical_id, m.canonical_key, count(s.run_ts) AS points, arg_max(s.p, s.run_ts) AS last_price
        FROM matrix m LEFT JOIN series s ON s.canonical_key = m.canonical_key GROUP BY 1, 2""",
        "matrix", "series",
    ),
)
def with_history(spark, sf):
    document = Hi.series_document(Hi.price_series(history(spark, sf)))
    rows = V.with_history(matrix(spark, sf), document)
    points = F.coalesce(F.nullif(F.size("points"), F.lit(-1)), F.lit(0))
    return rows.select(
        "canonical_id", "canonical_key", points.cast("bigint").alias("points"), F.try_element_at("points", F.lit(-1))["p"].alias("last_price")
    )


@query(
    "d12_h05_rows_of_one_shop",
    statement(
        """SELECT m.canonical_id, m.display_name, c.precio_actual FROM matrix m JOIN cells c ON c.canonical_id = m.canonical_id AND c.platform = 'coto'
        ORDER BY m.n_platforms DESC, m.brand_display, coalesce(m.volume_ml, 0), m.canonical_id LIMIT 12""",
        "matrix", "cells",
    ),
)
def one_shop(spark, sf):
    rows = V.ordered_view(V.sold_by(matrix(spark, sf), "coto"))
    return V.first_rows(rows, fixed.STORE_VIEW_PRODUCTS).select(
        "canonical_id", "display_name", F.col("precios")["coto"]["precio_actual"].alias("precio_actual")
    )


@query(
    "d12_picked_products",
    statement(
        "SELECT canonical_id, display_name FROM matrix WHERE canonical_id IN (SELECT canonical_id FROM matched WHERE stock = 6)",
        "matrix", "matched",
    ),
)
def picked_products(spark, sf):
    ids = resolved(spark, sf)[0].filter("stock = 6").select("canonical_id")
    return V.picked(matrix(spark, sf), ids).select("canonical_id", "display_name")


ORDERS = {
    "default": "n_platforms DESC, brand_display",
    "cheap": "min_price ASC NULLS LAST",
    "promo": "min_price_promo ASC NULLS LAST",
    "discount": "max_discount DESC",
    "per100": "min_per_100ml ASC NULLS LAST",
    "brand": "brand_display",
}


def _order_query(name: str, order: str) -> None:
    page = fixed.FIRST_PAGE_ROWS

    @query(
        f"h02_h05_first_page_{name}",
        statement(
            f"""SELECT canonical_id, display_name, min_price, max_discount FROM metrics
            ORDER BY {order}, n_platforms DESC, brand_display, coalesce(volume_ml, 0), canonical_id LIMIT {page}""",
            "metrics",
        ),
    )
    def first_page(spark, sf):
        rows = V.ordered_view(V.with_metrics(matrix(spark, sf)), name)
        return V.first_rows(rows, page).select("canonical_id", "display_name", "min_price", "max_discount")


for _name, _order in ORDERS.items():
    _order_query(_name, _order)


@query(
    "h05_second_page",
    statement(
        f"""SELECT canonical_id, display_name FROM matrix ORDER BY n_platforms DESC, brand_display, coalesce(volume_ml, 0), canonical_id
        LIMIT {fixed.NEXT_PAGE_ROWS} OFFSET {fixed.FIRST_PAGE_ROWS}""",
        "matrix",
    ),
)
def second_page(spark, sf):
    rows = V.ordered_view(matrix(spark, sf))
    return V.first_rows(rows, fixed.NEXT_PAGE_ROWS, fixed.FIRST_PAGE_ROWS).select("canonical_id", "display_name")


@query(
    "h05_pages_by_place",
    statement(
        f"""SELECT canonical_id, display_name, min_price, CAST(row_number() OVER (ORDER BY {ORDERS['cheap']}, n_platforms DESC, brand_display, coalesce(volume_ml, 0), canonical_id) - 1 AS BIGINT) AS place
        FROM metrics ORDER BY place LIMIT {2 * fixed.NEXT_PAGE_ROWS} OFFSET {fixed.FIRST_PAGE_ROWS}""",
        "metrics",
    ),
)
def pages_by_place(spark, sf):
    """The second and third page of the cheapest products, read from a view that is kept in this order."""
    path = scratch_path(spark, "pages")
    write_pages(V.with_metrics(matrix(spark, sf)).select("canonical_id", "display_name", "n_platforms", "brand_display", "volume_ml", "min_price"), "cheap", path)
    pages = [read_page(spark, path, fixed.FIRST_PAGE_ROWS + i * fixed.NEXT_PAGE_ROWS, fixed.NEXT_PAGE_ROWS) for i in (0, 1)]
    return pages[0].unionByName(pages[1]).select("canonical_id", "display_name", "min_price", "place")


@query(
    "h03_shops_by_price",
    statement(
        """SELECT canonical_id, platform, CAST(row_number() OVER (PARTITION BY canonical_id ORDER BY CASE WHEN disponible THEN precio_actual END NULLS LAST, platform) AS INTEGER) AS puesto,
        CAST(row_number() OVER (PARTITION BY canonical_id ORDER BY CASE WHEN disponible THEN precio_por_100ml END NULLS LAST, platform) AS INTEGER) AS puesto_100ml FROM cells""",
        "cells",
    ),
)
def shops_by_price(spark, sf):
    cells = M.matrix_cells(matrix(spark, sf))
    by_price = V.offers_by_price(cells)
    return V.offers_by_price(by_price.withColumnRenamed("puesto", "_p"), per_100ml=True).select(
        "canonical_id", "platform", F.col("_p").alias("puesto"), F.col("puesto").alias("puesto_100ml")
    )


@query(
    "h04_configs_of_a_brand",
    statement(
        "SELECT canonical_id, display_name, volume_ml, pack_qty FROM matrix WHERE brand_display = 'Patagonia' ORDER BY coalesce(volume_ml, 0), pack_qty, canonical_id",
        "matrix",
    ),
)
def configs(spark, sf):
    rows = matrix(spark, sf).filter(V.view_filter(brand="Patagonia"))
    return rows.orderBy(F.coalesce("volume_ml", F.lit(0)), "pack_qty", "canonical_id").select(
        "canonical_id", "display_name", "volume_ml", "pack_qty"
    )


OUTAGES = {"coto": 1, "dia": 2, "jumbo": 9, "vea": 30}  # days before the last run since when a shop brings nothing


def _runs(spark, sf):
    """Per shop its last run, and the last run of all; some shops stopped bringing data at some day."""
    rows = fx.observations(spark, sf)
    days = F.coalesce(F.create_map(*[F.lit(x) for pair in OUTAGES.items() for x in pair])[F.col("platform")], F.lit(0))
    until = F.broadcast(rows.agg(F.max("run_ts").alias("end")))  # one row
    seen = rows.join(until, F.lit(True)).filter(F.col("run_ts") <= F.col("end") - F.make_dt_interval(days))
    last = seen.groupBy("platform").agg(F.max("run_ts").alias("last_run"))
    return cut_lineage(last.join(F.broadcast(last.agg(F.max("last_run").alias("top"))), F.lit(True)))


def _health(spark, sf):
    runs = _runs(spark, sf)
    recent = F.col("last_run") >= F.col("top") - F.expr("INTERVAL 3 DAY")
    stale = runs.filter(recent & (F.col("last_run") < F.col("top")))
    return H.platform_health(
        runs,
        runs.filter(recent),
        runs.select("platform", F.col("last_run").alias("last_seen")),
        stale.withColumn("captured_at", iso_utc(F.col("last_run"))),
    )


HEALTH_COLUMNS = "platform, ok, stale, captured_at, last_seen"


@query("d09_i01_j09_platform_health", statement(f"SELECT {HEALTH_COLUMNS} FROM health", "health"))
def health(spark, sf):
    return _health(spark, sf)


@query("j10_down_platforms", statement(f"SELECT {HEALTH_COLUMNS} FROM health WHERE NOT ok", "health"))
def down(spark, sf):
    return H.down(_health(spark, sf))


@query("j10_outdated_platforms", statement(f"SELECT {HEALTH_COLUMNS} FROM health WHERE ok AND stale", "health"))
def outdated(spark, sf):
    return H.outdated(_health(spark, sf))


@query(
    "d10_i02_i05_missing_platforms",
    statement("SELECT platform FROM last_runs WHERE last_run < (SELECT max(last_run) FROM last_runs)", "last_runs"),
)
def missing(spark, sf):
    runs = _runs(spark, sf)
    return H.missing_platforms(H.expected_platforms(runs), runs.filter("last_run = top"))


# --- J: filters and sinks -----------------------------------------------------------


@query(
    "j01_filtered_view",
    statement(
        """SELECT canonical_id, display_name, min_price FROM metrics WHERE contains(lower(display_name), 'lata') AND volume_ml = 473
        AND n_platforms > 1 AND (max_discount > 0 OR has_promo) AND has_promo""",
        "metrics",
    ),
)
def filtered(spark, sf):
    chosen = V.view_filter("LATA", size=473, comparable=True, on_offer=True, with_promo=True)
    return V.with_metrics(matrix(spark, sf)).filter(chosen).select("canonical_id", "display_name", "min_price")


@query(
    "j02_visible_platforms",
    statement("SELECT canonical_id, platform, precio_actual FROM cells WHERE platform NOT IN ('coto', 'rappi')", "cells"),
)
def visible(spark, sf):
    return M.matrix_cells(V.visible_platforms(matrix(spark, sf), ["coto", "rappi"])).select(
        "canonical_id", "platform", "precio_actual"
    )


@query(
    "j03_matrix_document",
    statement(
        "SELECT 'x' AS reference_address, CAST(8 AS INTEGER) AS shops, count(*) AS total_canonicos, count(*) FILTER (WHERE n_platforms > 1) AS comparables FROM canonicals",
        "canonicals",
    ),
)
def matrix_document(spark, sf):
    from shelfscope.operators.sinks import matrix_header, write_matrix_json

    rows = matrix(spark, sf)
    header = matrix_header(rows, fx.PLATFORMS, "x", F.lit("2024-01-01T00:00:00Z"), _health(spark, sf))
    path = scratch_path(spark, "matrix")
    write_matrix_json(rows, header, path)
    back = spark.read.json(f"{path}/header", schema="reference_address string, platforms array<string>, total_canonicos bigint, comparables bigint")
    return back.select("reference_address", F.size("platforms").alias("shops"), "total_canonicos", "comparables")


FLAT = ", ".join(
    f"coalesce(max(CAST(CASE WHEN c.platform = '{p}' THEN c.{f} END AS VARCHAR)), '') AS {p}_{s}"
    for p in fx.PLATFORMS
    for f, s in (("stock", "stock"),)
)
FLAT_PRICES = ", ".join(
    f"max(CASE WHEN c.platform = '{p}' THEN c.{f} END) AS {p}_{s}"
    for p in fx.PLATFORMS
    for f, s in (("precio_actual", "precio"), ("descuento_pct", "desc_pct"))
)
BASE = "m.brand_display AS marca, m.variant_slug AS variante, m.volume_ml AS volumen_ml, coalesce(m.container, '') AS container, m.pack_qty, m.display_name, m.gtin, m.n_platforms, coalesce(m.mejor, '') AS mejor, m.ahorro_abs"


@query(
    "j04_flat_matrix",
    statement(
        f"SELECT {BASE}, {FLAT}, {FLAT_PRICES} FROM matrix m JOIN cells c ON c.canonical_id = m.canonical_id GROUP BY m.canonical_id, m.brand_display, m.variant_slug, m.volume_ml, m.container, m.pack_qty, m.display_name, m.gtin, m.n_platforms, m.mejor, m.ahorro_abs",
        "matrix", "cells",
    ),
)
def flat(spark, sf):
    """Export table; the numbers are read back from their text, as a user of the file would."""
    table = M.flat_matrix(matrix(spark, sf), fx.PLATFORMS)
    numbers = {
        c: F.nullif(c, F.lit("")).cast("double") for c in table.columns if c.endswith(("_precio", "_desc_pct"))
    }
    return table.withColumns(numbers)


def _publication(spark, sf):
    """Folder of the outputs published from the shared matrix."""

    def build():
        matched, canonicals = resolved(spark, sf)
        out = scratch_path(spark, "out")
        publish(Run(matched, canonicals, matrix(spark, sf)), out, None, "x", "2024-01-01T00:00:00Z", _health(spark, sf))
        return published(spark, out)

    return shared(spark, sf, "publication", build)


@query(
    "j03_published_products",
    statement("SELECT canonical_id, canonical_key, display_name, n_platforms, match_method, mejor, ahorro_abs FROM matrix", "matrix"),
)
def published_products(spark, sf):
    schema = "canonical_id bigint, canonical_key string, display_name string, n_platforms bigint, match_method string, mejor string, ahorro_abs double"
    return spark.read.schema(schema).json(f"{_publication(spark, sf)}/matrix_json/products")


@query(
    "j04_published_sheet",
    statement("SELECT brand_display AS marca, display_name, n_platforms, coalesce(mejor, '') AS mejor, ahorro_abs, CAST(1 AS BIGINT) AS files FROM matrix", "matrix"),
)
def published_sheet(spark, sf):
    """The table as one marked file, read back."""
    rows = spark.read.csv(f"{_publication(spark, sf)}/matrix_csv", header=True, multiLine=True)
    rows = rows.withColumnRenamed(rows.columns[0], rows.columns[0].lstrip(MARK))
    return rows.select(
        "marca", "display_name", F.col("n_platforms").cast("bigint").alias("n_platforms"), F.coalesce("mejor", F.lit("")).alias("mejor"),
        F.col("ahorro_abs").cast("double").alias("ahorro_abs"), F.lit(len(rows.inputFiles())).cast("bigint").alias("files"),
    )


def _kept(spark, sf):
    """Series kept over a history of monthly runs that come in four commits; the first lacks a shop in one year, which the last brings.

    Returns their folder.
    """

    def build():
        rows = history(spark, sf)
        path, kept = scratch_path(spark, "history"), scratch_path(spark, "series")
        year, month = F.year("run_ts"), F.date_trunc("month", "run_ts").cast("timestamp_ntz")
        commits = [(year <= 1997) & ~((year == 1996) & (F.col("platform") == "vea")), year.isin(1999, 2000), year.isin(1998, 2001), year == 1996]
        for commit in commits:
            some = rows.filter(commit).withColumn("run_ts", month)  # chosen before its time is changed: the history isn't written again
            Hi.append_history(some, path)
            series.add_runs(spark, path, kept, [r.run_ts for r in some.select("run_ts").distinct().collect()], buckets=8)
        return kept

    return shared(spark, sf, "kept series", build)


@query("f08_g01_kept_series", statement("SELECT canonical_key, run_ts, p FROM monthly_series", "monthly_series"))
def kept_series(spark, sf):
    return series.kept_price_series(spark, _kept(spark, sf)).select("canonical_key", "run_ts", "p")


@query("f09_g02_kept_shop_series", statement(f"SELECT {', '.join(SHOP_COLUMNS)} FROM monthly_shop_series", "monthly_shop_series"))
def kept_shop_series(spark, sf):
    return series.kept_shop_series(spark, _kept(spark, sf)).select(*SHOP_COLUMNS)


OBSERVED = """canonical_key, platform, CAST(external_product_id AS VARCHAR) AS external_product_id, TIMESTAMP '2024-01-01' AS run_ts, precio_actual,
  descuento_pct, precio_por_100ml, stock, nullif(promo_etiqueta, '') AS promo_etiqueta, CASE WHEN promo_tipo = 'multi' THEN promo_precio_efectivo END AS promo_precio_efectivo"""


@query("j05_appended_observations", statement(f"SELECT {OBSERVED} FROM matched", "matched"))
def appended(spark, sf):
    """The same run twice, and one from before that is not asked for."""
    path = scratch_path(spark, "history")
    rows = resolved(spark, sf)[0]
    for run in ("2024-01-01", "2023-11-30", "2024-01-01"):
        Hi.append_history(Hi.to_observations(rows, F.lit(f"{run} 00:00:00")), path)
    return Hi.read_history(spark, path, since="2023-12-31")


@query(
    "j06_old_history",
    statement(
        """SELECT canonical_key, platform, run_ts, precio_actual, CASE WHEN run_ts >= TIMESTAMP '1997-01-01' THEN promo_etiqueta END AS promo_etiqueta FROM history""",
        "history",
    ),
)
def old_history(spark, sf):
    rows = history(spark, sf)
    edge = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    old = rows.filter(F.col("run_ts") < edge).drop("promo_etiqueta", "promo_precio_efectivo")
    return (
        Hi.with_missing_columns(old)
        .unionByName(rows.filter(F.col("run_ts") >= edge))
        .select("canonical_key", "platform", "run_ts", "precio_actual", "promo_etiqueta")
    )


@query(
    "j07_published_series",
    statement("SELECT canonical_key, count(*) AS points, min(p) AS low, max(run_ts) AS last_run FROM series GROUP BY 1", "series"),
)
def published_series(spark, sf):
    document = Hi.series_document(Hi.price_series(history(spark, sf)))
    return document.select(
        "canonical_key",
        F.size("points").cast("bigint").alias("points"),
        F.array_min("points.p").alias("low"),
        F.element_at("points", -1)["run_ts"].alias("last_run"),
    )


@query(
    "j07_published_shop_series",
    statement(
        "SELECT canonical_key, platform, count(*) AS points, arg_max(precio, run_ts) AS last_price FROM shop_series GROUP BY 1, 2", "shop_series"
    ),
)
def published_shop_series(spark, sf):
    document = Hi.shop_series_document(Hi.shop_series(history(spark, sf)))
    return document.select("canonical_key", F.explode("series").alias("platform", "p")).select(
        "canonical_key", "platform", F.size("p").cast("bigint").alias("points"), F.element_at("p", -1)["precio"].alias("last_price")
    )


@query(
    "j08_publication_guard",
    statement("SELECT count(DISTINCT platform) AS platforms, count(*) AS offers, count(DISTINCT platform) >= 2 AS published FROM snap", "snap"),
)
def guard(spark, sf):
    return H.publication(offers(spark, sf))


@query(
    "j11_landed_layout",
    statement("SELECT platform, CAST(count(*) AS BIGINT) AS listings, CAST(count(*) FILTER (WHERE descuento_pct > 0) AS BIGINT) AS con_descuento FROM products GROUP BY 1", "products"),
)
def landed_layout(spark, sf):
    from shelfscope.plans.bind_sources import _placed_envelopes
    from shelfscope.sources.landing import land_snapshots, load_run

    path = scratch_path(spark, "raw")
    lines = cut_lineage(fx.latest_lines(spark, sf))
    rows = fx.as_products_by_text(fx.listed(fx.placed_lines(lines), "pos"), fx.listed(lines))
    land_snapshots(_placed_envelopes(rows), path, "run-1", "gzip")
    rows = load_run(spark, path, "run-1")
    return rows.groupBy("platform").agg(
        F.sum(F.size("productos")).alias("listings"), F.max("con_descuento").cast("bigint").alias("con_descuento")
    )


@query("j12_whole_run", statement(f"SELECT {', '.join(MATRIX_COLUMNS)} FROM matrix", "matrix"))
def whole_run(spark, sf):
    """From the tables to the matrix in one go, nothing shared with other queries."""
    matched, canonicals = R.assign_canonicals(cut_lineage(fx.offers(spark, sf)))
    return M.build_matrix(canonicals, matched).select(*MATRIX_COLUMNS)


# --- K: alarms and streams ----------------------------------------------------------

WINDOWS = "SELECT time_bucket(INTERVAL '2 hours', ts) AS window_start, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1"


@query(
    "k01_source_alarm",
    f"""SELECT window_start, errors, errors >= 1 AND coalesce(lag(errors) OVER w >= 1 AND lag(window_start) OVER w = window_start - INTERVAL 2 HOUR, FALSE) AS alarm
    FROM ({WINDOWS}) WINDOW w AS (ORDER BY window_start)""",
)
def alarm(spark, sf):
    events = fx.table(spark, sf, "events").select("ts", (F.col("event_type") == "error").alias("is_error"))
    return H.alarms(H.error_windows(events))


@query(
    "k01_source_alarm_stream",
    f"SELECT window_start, errors FROM ({WINDOWS}) WHERE window_start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR",
)
def error_windows_on_stream(spark, sf):
    return _streamed(spark, sf, error_window_stream, "window_start timestamp, errors bigint")


def _streamed(spark, sf, job, schema):
    """What a streaming job over the events has written when all of them are read."""
    events = (
        spark.readStream.schema(fx.table(spark, sf, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
        .select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("is_error"))
    )
    path = scratch_path(spark, "windows")
    (
        job(events)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", scratch_path(spark, "stream"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(schema).parquet(path).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "k01_alarm_on_stream",
    f"""SELECT * FROM (SELECT window_start, errors, errors >= 1 AND coalesce(lag(errors) OVER w >= 1 AND lag(window_start) OVER w = window_start - INTERVAL 2 HOUR, FALSE) AS alarm
    FROM ({WINDOWS}) WINDOW w AS (ORDER BY window_start)) WHERE window_start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""",
)
def alarm_on_stream(spark, sf):
    return _streamed(spark, sf, alarm_stream, "window_start timestamp, errors bigint, alarm boolean")


@query(
    "k02_incremental_history",
    statement(
        """SELECT platform, run_ts, count(*) AS n, CAST(sum(stock) AS BIGINT) AS stock FROM (SELECT platform, stock, CASE WHEN platform = 'dia' AND year(run_ts) = 2001
        THEN TIMESTAMP '2001-12-01' ELSE make_timestamp(year(run_ts), 12, 31, 20, 0, 0) END AS run_ts FROM obs WHERE l_linenumber % 3 = 2) GROUP BY 1, 2""",
        "obs",
    ),
)
def incremental(spark, sf):
    """One history from a batch job and from a stream over the landed snapshots, with a run that both append, and that is appended again."""
    from shelfscope.operators.normalize import normalize_offers_by_text, with_own_key
    from shelfscope.sources.landing import build_offers, load_run
    from shelfscope.streaming.ingest import append_landed

    root, path, checkpoint = landed(spark, sf), scratch_path(spark, "history"), scratch_path(spark, "stream")

    def keyed(envelopes):
        rows = cut_lineage(build_offers(envelopes.withColumn("platform_rank", F.lit(0))))
        return with_own_key(normalize_offers_by_text(rows)).withColumn("run_ts", F.to_timestamp_ntz("scraped_at", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))

    batch = cut_lineage(Hi.to_observations(keyed(load_run(spark, root, "run-1999")), F.col("run_ts")))
    Hi.append_history(batch, path)
    append_landed(spark, root, keyed, path, checkpoint)
    Hi.append_history(batch, path)
    append_landed(spark, root, keyed, path, checkpoint)
    rows = Hi.read_history(spark, path)
    return rows.groupBy("platform", "run_ts").agg(F.count(F.lit(1)).alias("n"), F.sum("stock").alias("stock"))
