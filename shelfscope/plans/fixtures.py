"""Price listings derived from the given TPC-H-like tables.

``observations`` has one row per order line; ``snapshot`` is the latest listing of
each product in each shop, shaped like the landed schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.functions import text as T
from shelfscope.functions.numbers import discount_pct, price_per_100ml
from shelfscope.functions.promo import priced_promo, promo_columns, promo_terms
from shelfscope.operators.normalize import join_texts, normalize_offers_by_text, text_dictionary, with_own_key
from shelfscope.operators.resolve import OFFERS_PER_BUCKET, dense_rank_at_scale
from shelfscope.session import cut_lineage, scratch_path
from shelfscope.sources.landing import build_envelopes, land_snapshots, write_parts

PLATFORMS = ["carrefour", "coto", "dia", "disco", "jumbo", "pedidosya", "rappi", "vea"]
POSITIONS_PER_PLATFORM = 1 << 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a small table of few splits; a big one has enough and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores <= 64 else df


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spread(table(spark, sf_dir, "lineitem")), table(spark, sf_dir, "part"))


def listings(lines: DataFrame, parts: DataFrame) -> DataFrame:
    return listed(lines.join(parts, lines["l_partkey"] == parts["p_partkey"]))


def listed(lines: DataFrame, *more: str) -> DataFrame:
    """Lines joined to their parts as listings; ``more`` columns are kept."""
    return lines.selectExpr(
        *more,
        """CASE l_suppkey % 8 WHEN 0 THEN 'carrefour' WHEN 1 THEN 'coto' WHEN 2 THEN 'dia'
           WHEN 3 THEN 'disco' WHEN 4 THEN 'jumbo' WHEN 5 THEN 'pedidosya' WHEN 6 THEN 'rappi'
           ELSE 'vea' END AS platform""",
        "p_partkey AS external_product_id",
        "l_shipdate AS run_ts",
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_extendedprice",
        """CONCAT('Cerveza ',
           CASE p_partkey % 6 WHEN 0 THEN 'Quilmes' WHEN 1 THEN 'Stella Artois'
             WHEN 2 THEN 'Andes Origen' WHEN 3 THEN 'Quilmes 1890' WHEN 4 THEN 'Patagonia'
             ELSE 'Pampa' END, ' ',
           CASE p_partkey % 7 WHEN 0 THEN 'Rubia' WHEN 1 THEN 'IPA' WHEN 2 THEN 'Roja'
             WHEN 3 THEN 'Negra' WHEN 4 THEN 'Única' WHEN 5 THEN '0.0' ELSE 'Scotch Ale' END, ' ',
           CASE WHEN p_size % 5 = 0 THEN 'pack x 6 ' ELSE '' END,
           CASE p_size % 4 WHEN 0 THEN '473ml' WHEN 1 THEN '354 cc' WHEN 2 THEN '1 L'
             ELSE '269 Ml' END,
           CASE l_suppkey % 3 WHEN 0 THEN ' Lata' WHEN 1 THEN ' Porrón' ELSE '' END) AS nombre""",
        """CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CASE p_partkey % 6 WHEN 0 THEN 'Quilmes'
           WHEN 1 THEN 'Stella' WHEN 2 THEN 'Andes Origen' WHEN 3 THEN '1890'
           WHEN 4 THEN 'Patagonia' ELSE 'Pampa Brewing' END END AS marca""",
        """CASE WHEN l_suppkey % 8 IN (1, 6) OR p_partkey % 11 = 0 THEN ''
           ELSE CONCAT('0779', CAST(p_partkey AS STRING)) END AS gtin""",
        """CASE WHEN p_partkey % 13 = 0 AND l_suppkey % 8 = 0 THEN CAST(0 AS DOUBLE)
           ELSE FLOOR(ROUND(p_retailprice * 100) * (80 + (l_suppkey * 7 + l_linenumber) % 41)
             * (CASE WHEN l_linenumber = 7 AND l_suppkey % 8 = 1 THEN 30 ELSE 100 END)
             / CAST(10000 AS DOUBLE)) / CAST(100 AS DOUBLE) END AS precio_actual""",
        "CAST(ROUND(l_discount * 100) AS INT) AS descuento_pct",
        "CAST(l_quantity AS INT) % 7 AS stock",
        """CASE l_linenumber % 6 WHEN 0 THEN '2x1' WHEN 1 THEN '2do al 50%'
           WHEN 2 THEN 'Tarjeta Banco 15%' WHEN 3 THEN '3x2 en la góndola' WHEN 4 THEN ''
           ELSE '25%Dto' END AS promo_raw""",
    )


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"]
PART = ["p_partkey", "p_size", "p_retailprice"]


def _shop() -> Column:
    """Number of a line's shop, as ``listed`` names it."""
    shop = F.col("l_suppkey") % 8
    return F.when(shop.between(0, 6), shop).otherwise(F.lit(7))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest listing per shop and product; the top-1 is cut before the shuffle, and texts are made for what it leaves."""
    return listed(latest_lines(spark, sf_dir)).withColumn("offer_ord", offer_order(F.col("platform"), F.col("external_product_id")))


def latest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bare lines, with their parts, of the latest listings."""
    lines = spread(table(spark, sf_dir, "lineitem").select(*LINE))
    parts = table(spark, sf_dir, "part").select(*PART).dropDuplicates(["p_partkey"])
    latest = W.partitionBy("_shop", "l_partkey").orderBy(
        F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"
    )
    last = lines.withColumn("_shop", _shop()).withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").drop("_rn", "_shop")
    return last.join(parts, F.col("l_partkey") == F.col("p_partkey"))


def placed_lines(lines: DataFrame) -> DataFrame:
    """``latest_lines`` with ``pos``, the place in the shop's snapshot; they are gone through twice, before any text is made."""
    keyed = lines.withColumns({"_shop": _shop(), "_ord": _shop() * POSITIONS_PER_PLATFORM + F.col("p_partkey")})
    placed = dense_rank_at_scale(keyed, "_ord", "_rank", OFFERS_PER_BUCKET)
    starts = placed.groupBy("_shop").agg(F.min("_rank").alias("_start"))
    placed = placed.join(F.broadcast(starts), "_shop")
    return placed.withColumn("pos", F.col("_rank") - F.col("_start")).drop("_shop", "_ord", "_rank", "_start")


def offer_order(platform, position):
    """One number for (shop order, position in the shop's snapshot)."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PLATFORMS]), platform) - 1
    return rank * F.lit(POSITIONS_PER_PLATFORM) + position


def _name_columns() -> dict[str, Column]:
    return {"tipo": T.type_text(F.col("nombre"), F.col("marca")), "volumen_ml": T.volume_from_name(F.col("nombre"))}


def as_products(rows: DataFrame) -> DataFrame:
    """Fixture rows with the fields of a landed listing."""
    return _with_prices(T.computed_once(rows, {**_name_columns(), "_terms": promo_terms(F.col("promo_raw"))}))


def as_products_by_text(rows: DataFrame, plain: DataFrame | None = None) -> DataFrame:
    """The same as ``as_products``, with each distinct name, brand and promotion text read once; ``rows`` are gone through twice.

    ``plain`` has the same texts and is cheaper to go through, if it is given.
    """
    return _with_texts(rows, *_distinct_texts(rows if plain is None else plain))


def _distinct_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the distinct names with brands, and the distinct promotion texts, say."""
    texts = cut_lineage(rows.select("nombre", "marca", "promo_raw").distinct())
    names = cut_lineage(T.computed_once(texts.select("nombre", "marca").distinct(), _name_columns()))
    return names, T.computed_once(texts.select("promo_raw").distinct(), {"_terms": promo_terms(F.col("promo_raw"))})


def _with_texts(rows: DataFrame, names: DataFrame, promos: DataFrame) -> DataFrame:
    return _with_prices(join_texts(join_texts(rows, names, ["nombre", "marca"]), promos, ["promo_raw"]))


def normalised_by_text(rows: DataFrame) -> DataFrame:
    """Normalised offers of fixture rows; the dictionary is made of their distinct texts, so ``rows`` are gone through twice in all."""
    names, promos = _distinct_texts(rows)
    return normalize_offers_by_text(_with_texts(rows, names, promos), dictionary=cut_lineage(text_dictionary(names)))


def _with_prices(rows: DataFrame) -> DataFrame:
    price = F.col("precio_actual")
    before = price * (F.lit(1.0) + F.col("descuento_pct") / F.lit(100.0))
    return (
        T.computed_once(rows, {"precio_anterior": before, "_promo": priced_promo(F.col("_terms"), price)})
        .withColumns(
            {
                "descuento_pct": discount_pct(price, F.col("precio_anterior")),
                "precio_por_100ml": price_per_100ml(price, F.col("volumen_ml")),
                "is_zero_alcohol": F.lit(False),
            }
        )
        .select("*", *promo_columns(F.col("_promo")))
        .drop("_promo", "_terms")
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised offers of the latest snapshot."""
    return normalised_by_text(cut_lineage(snapshot(spark, sf_dir)))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price observations of all runs, keyed by each row's own canonical key.

    The bare lines with their parts are written, not the listings' texts, which are made when the lines are read.
    """
    lines = spread(table(spark, sf_dir, "lineitem").select(*LINE))
    lines = lines.join(table(spark, sf_dir, "part").select(*PART), F.col("l_partkey") == F.col("p_partkey"))
    rows = with_own_key(normalised_by_text(listed(cut_lineage(lines.drop("l_partkey")))))
    return rows.select(
        "canonical_key",
        "platform",
        F.col("external_product_id").cast("string").alias("external_product_id"),
        "run_ts",
        "precio_actual",
        "descuento_pct",
        "precio_por_100ml",
        "stock",
        F.nullif("promo_etiqueta", F.lit("")).alias("promo_etiqueta"),
        F.when(F.col("promo_tipo") == "multi", F.col("promo_precio_efectivo")).alias(
            "promo_precio_efectivo"
        ),
    )


LATE_SHOPS = ["dia", "jumbo"]  # their last run is landed apart and later, as by a scraper that runs elsewhere
LAST_YEAR = 2001
SNAPSHOT_PART = 20


def yearly_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations as listings of yearly snapshots of three stores per shop: platform, external_store_id, run, fecha_scrapeo, pos, fields.

    Places are given to the bare lines, which are written by run; a listing's texts are made when its run is read.
    """
    lines = spread(table(spark, sf_dir, "lineitem").select(*LINE))
    year = F.year("l_shipdate")
    late = _shop().isin([PLATFORMS.index(p) for p in LATE_SHOPS]) & (year == LAST_YEAR)
    place = ((_shop() + 1) * 3 + F.col("l_linenumber") % 3) * 100 + year - 1990
    keyed = lines.join(table(spark, sf_dir, "part").select(*PART), F.col("l_partkey") == F.col("p_partkey")).withColumns(
        {
            "run": F.concat(F.when(late, F.lit("home-")).otherwise(F.lit("run-")), year),
            "_snapshot": place.cast("long"),
            "_ord": place.cast("long") * POSITIONS_PER_PLATFORM + F.col("l_orderkey") * 8 + F.col("l_linenumber"),
        }
    )
    path = scratch_path(spark, "yearly")
    ranked = dense_rank_at_scale(keyed, "_ord", "_rank").drop("_ord")
    ranked.write.partitionBy("run").parquet(path)
    ranked = spark.read.schema(ranked.schema).parquet(path)
    starts = ranked.groupBy("_snapshot").agg(F.min("_rank").alias("_start"))
    placed = ranked.join(F.broadcast(cut_lineage(starts)), "_snapshot").withColumn("pos", F.col("_rank") - F.col("_start"))
    rows = as_products_by_text(listed(placed, "run", "pos"))
    day = F.when((F.col("platform") == "dia") & F.col("run").startswith("home-"), F.lit("-12-01T00:00:00Z")).otherwise(F.lit("-12-31T20:00:00Z"))
    empty = {"beer_color": F.lit(""), "beer_style": F.lit(""), "abv": F.lit(None).cast("double"), "origen": F.lit("")}
    return rows.withColumns(
        {
            **empty,
            "external_store_id": (F.col("l_linenumber") % 3).cast("string"),
            "fecha_scrapeo": F.concat(F.year("run_ts"), day),
            "tienda": F.lit("Store"),
            "direccion": F.lit(""),
            "source": F.create_map(F.lit("method"), F.lit("tables")),
            "id": F.col("external_product_id").cast("string"),
        }
    )


def land_all(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Land every yearly snapshot, run after run; then the late shops; then two that go wrong.

    coto's newest snapshot lacks its first parts and has no manifest row. vea's newest one was whole, but landing it
    again broke off.
    """
    rows = yearly_snapshots(spark, sf_dir)
    runs = [f"run-{y}" for y in range(1995, LAST_YEAR + 1)] + [f"home-{LAST_YEAR}"]
    for run in runs:
        land_snapshots(build_envelopes(rows.filter(F.col("run") == run), SNAPSHOT_PART), root, run, "gzip")
    again = build_envelopes(rows.filter(F.col("run") == f"run-{LAST_YEAR}"), SNAPSHOT_PART)
    write_parts(again.filter((F.col("plataforma") == "coto") & (F.col("desde") > 0)), root, f"run-{LAST_YEAR + 1}", "broken-off", "gzip")
    vea = again.filter(F.col("plataforma") == "vea")
    land_snapshots(vea, root, f"run-{LAST_YEAR + 2}", "gzip")
    write_parts(vea, root, f"run-{LAST_YEAR + 2}", "broken-off", "gzip")
