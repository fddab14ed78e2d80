"""Pages of a kept view, and JSON that drifts from its declared form."""

import json

from pyspark.sql import functions as F

from shelfscope.operators import views as V
from shelfscope.operators.pages import read_page, write_pages
from shelfscope.sources import landing, payloads


def test_pages_equal_offsets_without_sorting_all(spark, tmp_path):
    rows = spark.range(1000).select(
        F.col("id").alias("canonical_id"),
        (F.col("id") * 7919 % 13).alias("n_platforms"),
        F.concat(F.lit("b"), (F.col("id") % 5).cast("string")).alias("brand_display"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 4).alias("volume_ml"),
        F.when(F.col("id") % 11 > 0, (F.col("id") * 31 % 17).cast("double")).alias("min_price"),
    )
    for order in ("default", "cheap", "brand"):
        path = str(tmp_path / order)
        write_pages(rows, order, path)
        for first, count in ((0, 12), (150, 200), (990, 50), (2000, 5)):
            page = read_page(spark, path, first, count)
            wanted = [r.canonical_id for r in V.first_rows(V.ordered_view(rows, order), count, first).collect()]
            assert [r.canonical_id for r in page.collect()] == wanted
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Exchange" not in plan and "GreaterThanOrEqual(place" in plan
    write_pages(rows.limit(0), "cheap", str(tmp_path / "none"))
    assert read_page(spark, str(tmp_path / "none"), 0, 5).count() == 0


def test_odd_fields_of_a_page_cost_only_themselves(spark):
    def page(products, **more):
        entry = {"aisle_detail_response": {"data": {"components": [{"resource": {"products": products}}, {"resource": "none"}, 3, {"resource": {"products": [{"product_id": "z"}]}}]}}}
        state = {"props": {"pageProps": {"fallback": {"here": entry, "other": 5}}}} | more
        return '<html><script id="__NEXT_DATA__" type="application/json">' + json.dumps(state) + "</script></html>"

    products = [
        {"product_id": 12, "name": "a", "price": "n/a", "stock": [1], "in_stock": True, "attributes": {"abv": 4.5, "is_zero_alcohol": "?"}},
        {"product_id": "b", "name": {"x": 1}, "price": 10, "complex_discounts": ["2x1", {"name": "3x2"}], "attributes": "none"},
        "no product",
    ]
    rows = [(1, page(products)), (2, page("none")), (3, "<html></html>"), (4, page([], props=7)), (5, None), (6, page([])[:-40])]
    df = spark.createDataFrame(rows, "n int, html string")
    found = payloads.storefront_page_products(df, "html", F.lit("here")).orderBy("n", "pos").collect()
    assert [(r.n, r.payload.product_id, r.payload.price) for r in found] == [(1, "12", None), (1, "b", 10.0), (1, None, None), (1, "z", None), (2, "z", None)]
    assert found[0].payload.attributes.abv == 4.5 and found[0].payload.in_stock and found[0].payload.stock is None
    assert found[1].payload.complex_discounts == ["2x1", '{"name":"3x2"}']


def test_stores_keep_their_odd_settings(spark, tmp_path):
    stores = [
        {"platform": "dia", "external_store_id": "1", "store_name": "a", "config": {"zone": 3, "aisles": ["x"], "deep": {"id": "q"}}},
        {"platform": "vea", "external_store_id": "2", "store_name": "b", "active": False, "config": "none"},
        {"platform": "coto", "external_store_id": "3", "store_name": "c"},
    ]
    path = tmp_path / "stores.json"
    path.write_text(json.dumps({"reference_address": "x", "stores": stores}, indent=1))
    rows = landing.read_stores(spark, str(path))
    chosen = landing.active_stores(rows).select("platform", landing.store_setting("$.zone", "int").alias("zone"), landing.store_setting("$.deep.id").alias("id"))
    assert sorted(map(tuple, chosen.collect())) == [("coto", None, None), ("dia", 3, "q")]
