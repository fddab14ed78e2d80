"""Steps whose cost must grow no faster than their input, and the faster forms against the plain ones."""

import glob
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import health as H
from shelfscope.operators import normalize
from shelfscope.operators import resolve as R
from shelfscope.plans import fixtures as fx
from shelfscope.schemas import PRODUCT_FIELDS
from shelfscope.session import cut_lineage
from shelfscope.sources import landing


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_small_tables(spark):
    """As if every table were too big to be sent whole, unless the code says that it is small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def listings(spark, n=50):
    fields = ", ".join(f"CAST({'id' if f == 'id' else 'NULL'} AS {t}) AS {f}" for f, t in PRODUCT_FIELDS.items())
    keys = "SELECT 'dia' AS platform, '1' AS external_store_id, 't' AS tienda, '' AS direccion, '2024-01-01T00:00:00Z' AS fecha_scrapeo"
    return spark.sql(f"{keys}, map('a', 'b') AS source, id AS pos, {fields} FROM range({n})")


def test_parts_of_snapshots_are_not_dealt_by_store(spark, no_small_tables):
    assert "SortMergeJoin" not in plan(landing.build_envelopes(listings(spark), 7))


def test_landed_parts_are_compressed_and_read_back(spark, tmp_path):
    root = str(tmp_path)
    landing.land_snapshots(landing.build_envelopes(listings(spark), 7), root, "run-1", "gzip")
    assert glob.glob(f"{root}/platform=dia/store=1/run_id=run-1/*.json.gz")
    for rows in (landing.load_run(spark, root, "run-1"), landing.read_envelopes(spark, root, root).filter("name = 'run-1'")):
        assert rows.agg(F.sum(F.size("productos"))).first()[0] == 50


def test_stale_snapshots_are_not_dealt_by_shop(spark, no_small_tables):
    envelopes = spark.createDataFrame([("dia", [1], "2024-01-01T00:00:00Z")], "platform string, productos array<int>, fecha_scrapeo string")
    shops = spark.createDataFrame([("dia",), ("vea",)], "platform string")
    found = H.with_stale_fallback(envelopes, envelopes, shops, F.to_timestamp(F.lit("2024-01-01T01:00:00Z")))
    joins = [x for x in plan(found).splitlines() if "Join" in x and "LeftSemi" in x]
    assert joins and all("Broadcast" in x for x in joins)


LINE = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz"


def lines(spark):
    day = datetime(2001, 5, 1)
    rows = [(o, p, s, o % 7 + 1, 5.0, 10.0, 0.04, day) for o, (p, s) in enumerate((p, s) for p in (1, 2, 35, 66, None) for s in (0, 1, 2, 9, 15, None))]
    return spark.createDataFrame([*rows, rows[0], (99, 1, 0, 3, 4.0, 1.0, None, day), (3, 2, 1, None, 1.0, 1.0, 0.1, None)], LINE)


def parts(spark):
    return spark.createDataFrame([(1, 4, 3.5), (2, 5, None), (35, None, 2.0), (66, 3, 9.0), (66, 3, 9.0)], "p_partkey bigint, p_size int, p_retailprice double")


def test_listings_by_distinct_texts(spark):
    rows = fx.listings(lines(spark), parts(spark))
    found, plain = fx.as_products_by_text(rows), fx.as_products(rows)
    same = sorted(plain.columns)
    assert sorted(found.columns) == same
    assert sorted(map(str, found.select(same).collect())) == sorted(map(str, plain.select(same).collect()))


def test_snapshot_takes_one_line_of_each_product_and_shop(spark, tmp_path):
    lines(spark).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts(spark).write.parquet(f"{tmp_path}/part.parquet")
    found = fx.snapshot(spark, str(tmp_path))
    every = fx.observations(spark, str(tmp_path))
    assert found.count() == every.select("platform", "external_product_id").distinct().count()
    assert found.filter("platform = 'carrefour' AND external_product_id = 1").first().l_orderkey == 0
    dealt = [x for x in plan(found).splitlines() if "Exchange hashpartitioning" in x]
    assert not any("nombre" in x for x in dealt)


def test_yearly_snapshots_number_their_listings(spark, tmp_path):
    lines(spark).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts(spark).write.parquet(f"{tmp_path}/part.parquet")
    rows = fx.yearly_snapshots(spark, str(tmp_path))
    kept = fx.observations(spark, str(tmp_path)).filter("run_ts IS NOT NULL AND l_linenumber IS NOT NULL")
    assert rows.count() == kept.count()
    sizes = rows.groupBy("platform", "external_store_id", "run").agg(F.count("*").alias("n"), F.count_distinct("pos").alias("d"), F.max("pos").alias("m"))
    assert all(r.n == r.d == r.m + 1 for r in sizes.collect())
    assert {r.run for r in rows.filter("platform = 'dia'").select("run").distinct().collect()} == {"home-2001"}
    assert {r.fecha_scrapeo for r in rows.filter("platform = 'dia'").collect()} == {"2001-12-01T00:00:00Z"}


def offers(spark, n=40):
    """Half of the offers have a code, some of the others a key that a code owns."""
    return spark.range(n).selectExpr(
        "id AS offer_ord", "IF(id % 2 = 0, concat('g', id % 6), '') AS gtin_norm", "IF(id % 4 < 2, concat('k', id % 4), NULL) AS structural_key",
        "IF(id % 3 = 0, 'dia', 'vea') AS platform", "'x' AS brand_slug", "'X' AS brand_display", "'' AS sub_brand", "'unknown' AS variant_slug",
        "473 AS volume_ml_canon", "'lata' AS container", "1 AS pack_qty", "false AS is_zero", "concat('cerveza x ', id % 4, ' zzz') AS nombre",
        "concat('cerveza x ', id % 4, ' zzz') AS nombre_norm",
    )


def test_offers_are_not_sorted_to_get_their_product(spark, no_small_tables):
    matched, canonicals = R.assign_canonicals(offers(spark))
    joins = [x for x in plan(matched).splitlines() if "Join" in x]
    assert joins and all("ShuffledHashJoin" in x for x in joins)
    assert matched.count() == 40
    assert sorted(r.canonical_id for r in canonicals.collect()) == list(range(canonicals.count()))


def test_only_offers_without_code_are_looked_up(spark, no_small_tables):
    exact = R.label_exact(offers(spark))
    side = plan(exact).split("Join")[0]
    assert "Union" in side  # offers with a code stand beside the join, not below it
    labels = {r.offer_ord: r.label for r in exact.collect()}
    assert labels[0] == "g:g0" and labels[4] == "g:g4" and labels[1] == "k:k1" and labels[3] == "o:3" and len(labels) == 40


def test_ranks_do_not_depend_on_the_span(spark):
    df = spark.range(100).selectExpr("id * id * 7 AS n")
    for span in (1, 64, 1 << 20):
        assert sorted((r.n, r.r) for r in R.dense_rank_at_scale(df, "n", "r", span).collect()) == [(i * i * 7, i) for i in range(100)]


def tables(spark, path, years=(2001,)):
    for year in years:
        dated = lines(spark).withColumn("l_shipdate", F.col("l_shipdate") + F.make_ym_interval(F.lit(year - 2001)))
        dated.write.mode("append").parquet(f"{path}/lineitem.parquet")
    parts(spark).write.parquet(f"{path}/part.parquet")
    return str(path)


def written(monkeypatch, *modules):
    """Columns of every step that these modules write."""
    steps, plain = [], cut_lineage
    for module in modules:
        monkeypatch.setattr(module, "cut_lineage", lambda df: steps.append(df.columns) or plain(df))
    return steps


def test_history_reads_texts_once_and_writes_bare_lines(spark, tmp_path, monkeypatch):
    sf, steps, read = tables(spark, tmp_path), written(monkeypatch, fx, normalize), []
    resolve = normalize._resolved
    monkeypatch.setattr(normalize, "_resolved", lambda df, aliases: read.append(df) or resolve(df, aliases))
    found = fx.history(spark, sf)
    assert not any("nombre" in columns and ("l_shipdate" in columns or "run_ts" in columns) for columns in steps)
    assert len(read) == 1 and "Join" not in plan(read[0])  # made of the texts, not of listings joined to them
    rows = normalize.with_own_key(normalize.normalize_offers(fx.as_products(fx.observations(spark, sf))))
    rows = rows.withColumn("promo_etiqueta", F.nullif("promo_etiqueta", F.lit(""))).withColumn(
        "promo_precio_efectivo", F.when(F.col("promo_tipo") == "multi", F.col("promo_precio_efectivo"))
    )
    plainly = rows.withColumn("external_product_id", F.col("external_product_id").cast("string")).select(found.columns)
    assert found.count() > 0
    assert sorted(map(str, found.collect())) == sorted(map(str, plainly.collect()))


def test_history_leaves_out_the_code(spark, tmp_path):
    assert "0779" not in plan(fx.history(spark, tables(spark, tmp_path)))


def test_listings_get_their_place_before_their_texts(spark, tmp_path, no_small_tables):
    sf = tables(spark, tmp_path)
    bare = fx.latest_lines(spark, sf)
    placed = fx.placed_lines(bare)
    assert not any("nombre" in x or "Cerveza" in x for x in plan(placed).splitlines())
    shops = {}
    for r in fx.listed(placed, "pos").select("platform", "external_product_id", "pos").collect():
        shops.setdefault(r.platform, []).append((r.external_product_id, r.pos))
    assert shops and all([p for _, p in sorted(rows)] == list(range(len(rows))) for rows in shops.values())
    assert sum(map(len, shops.values())) == fx.snapshot(spark, sf).count()


def test_landed_layout_writes_bare_lines_only(spark, tmp_path, monkeypatch):
    from shelfscope.plans import bind_products

    steps = written(monkeypatch, bind_products, fx)
    found = bind_products.landed_layout(spark, tables(spark, tmp_path))
    assert steps and not any("nombre" in columns and "precio_actual" in columns for columns in steps)
    counts = fx.snapshot(spark, str(tmp_path)).groupBy("platform").count().collect()
    assert {(r.platform, r.listings) for r in found.collect()} == {(r.platform, r["count"]) for r in counts}


def test_kept_series_write_no_second_history(spark, tmp_path, monkeypatch):
    from shelfscope.plans import bind_products

    steps = written(monkeypatch, bind_products)
    bind_products._kept(spark, tables(spark, tmp_path, (1995, 1996, 1999, 2001)))
    assert not any("precio_actual" in columns for columns in steps)
