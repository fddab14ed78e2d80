import json

from pyspark.sql import functions as F

from shelfscope.operators import history as Hi
from shelfscope.operators import sinks
from shelfscope.plans.catalog_run import local_run, service_run
from shelfscope.sources import landing


def product(i, name, price, gtin="", stock=5, brand="Quilmes", volume=473):
    return dict(
        id=str(i), nombre=name, marca=brand, tipo="", volumen_ml=volume, precio_actual=price, precio_anterior=price,
        descuento_pct=0.0, precio_por_100ml=None, stock=stock, gtin=gtin, promo_tipo="multi", promo_etiqueta="2x1",
        promo_texto="2x1", promo_unidades=2, promo_precio_efectivo=price / 2, is_zero_alcohol=False,
    )


def land(root, platform, name, products, captured="2024-01-01T00:00:00Z"):
    folder = root / platform
    folder.mkdir(parents=True, exist_ok=True)
    body = dict(plataforma=platform, external_store_id="1", fecha_scrapeo=captured, source={}, productos=products)
    (folder / name).write_text(json.dumps(body, indent=1), encoding="utf-8")


def shops(root):
    land(root, "dia", "a.json", [product(1, "vieja", 1.0)])
    land(root, "dia", "b.json", [product(1, "Cerveza Quilmes Rubia 473 ml lata", 1000.0, "0779")])
    land(root, "jumbo", "a.json", [product(9, "Quilmes Rubia 473ml", 1100.0, "779"), product(10, "Quilmes Roja 473ml", 0.0, stock=0)])
    land(root, "coto", "a.json", [product(7, "Quilmes rubia 473 ml", 153.0)])
    land(root, "vea", "a.json", [])


def test_local_run_end_to_end(spark, tmp_path):
    shops(tmp_path / "raw")
    for run in ("2024-01-01T10:00:00Z", "2024-01-01T14:00:00Z"):
        result = local_run(spark, str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "hist"), "Calle 1", run)
    rows = {r.display_name: r for r in result.matrix.collect()}
    best = rows["Quilmes Rubia 473ml lata"]
    assert best.mejor == "dia" and best.ahorro_abs == 100.0 and best.n_platforms == 3 and best.match_method == "gtin"
    assert best.precios["coto"].suspect and not best.precios["dia"].suspect
    empty = rows["Quilmes Roja 473ml"]
    assert empty.mejor is None and empty.ahorro_abs == 0.0 and not empty.precios["jumbo"].disponible
    summary = result.summary.first()
    assert (summary.offers, summary.canonicos, summary.comparables) == (4, 2, 1)
    stored = Hi.read_history(spark, str(tmp_path / "hist"))
    assert stored.count() == 8
    assert Hi.price_series(stored).count() == 2
    out = sinks.published(spark, str(tmp_path / "out"))
    header = spark.read.json(f"{out}/matrix_json/header").first()
    assert header.platforms == ["coto", "dia", "jumbo"] and header.comparables == 1
    part = next((tmp_path / "out/versions" / out.rsplit("/", 1)[1] / "matrix_csv").glob("*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbfmarca,")


def test_service_run_fallback_guard_and_health(spark, tmp_path):
    raw = tmp_path / "raw"
    land(raw, "dia", "run-2.json", [product(1, "Quilmes Rubia 473ml", 1000.0)])
    land(raw, "jumbo", "run-1.json", [product(2, "Quilmes Rubia 473ml", 900.0)], "2024-01-01T20:00:00Z")
    land(raw, "vea", "run-1.json", [product(3, "Quilmes Rubia 473ml", 800.0)], "2023-12-01T00:00:00Z")
    (raw / "coto").mkdir()
    (raw / "coto" / "run-1.json").write_text("{broken")
    root = str(raw)
    envelopes = landing.read_envelopes(spark, root, root)
    run = landing.of_run(envelopes, "run-2")
    newest = landing.newest_usable(envelopes)
    stores = spark.createDataFrame([(p,) for p in ("dia", "jumbo", "vea", "coto")], "platform string")
    args = (spark, run, newest, stores, str(tmp_path / "out"), str(tmp_path / "hist"), "Calle 1", "2024-01-02T00:00:00Z")
    result = service_run(*args)
    assert result.published
    assert {r.platform for r in result.offers.select("platform").collect()} == {"dia", "jumbo"}
    health = spark.read.json(f"{sinks.published(spark, str(tmp_path / 'out'))}/matrix_json/header").first().platform_health
    state = {h.platform: (h.ok, h.stale) for h in health}
    assert state == {"dia": (True, False), "jumbo": (True, True), "vea": (False, False), "coto": (False, False)}
    assert not service_run(*args, min_platforms=3).published


def test_landing_in_parts_and_back(spark, tmp_path):
    products = spark.createDataFrame(
        [(i, str(i), f"n{i}", float(i)) for i in range(7)], "pos long, id string, nombre string, descuento_pct double"
    )
    for name, kind in landing.PRODUCT_FIELDS.items():
        if name not in products.columns:
            products = products.withColumn(name, F.lit(None).cast(kind))
    keyed = products.withColumns(
        {
            "platform": F.lit("dia"), "external_store_id": F.lit("s"), "tienda": F.lit("t"), "direccion": F.lit("d"),
            "fecha_scrapeo": F.lit("2024-01-01T00:00:00Z"), "source": F.create_map(F.lit("a"), F.lit("b")),
        }
    )
    landing.land_snapshots(landing.build_envelopes(keyed, part_size=3), str(tmp_path / "raw"), "run-1")
    rows = landing.with_platform_rank(landing.read_landed(spark, str(tmp_path / "raw")), [F.col("platform")])
    offers = landing.build_offers(rows).orderBy("offer_ord").collect()
    assert [(r.offer_ord, r.external_product_id) for r in offers] == [(i, str(i)) for i in range(7)]
    assert rows.select("total", "con_descuento").distinct().collect() == [(7, 6)]
