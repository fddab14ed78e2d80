import unicodedata

import pytest
from pyspark.sql import functions as F

from shelfscope.functions import numbers as N
from shelfscope.functions import text as T
from shelfscope.functions.labels import age_hours, config_label, local_day
from shelfscope.functions.promo import best_promo, parse_promo
from shelfscope.operators.normalize import normalize_offers, normalize_offers_by_join
from shelfscope.sources.aliases import AliasTable, builtin_aliases, clean_aliases
from shelfscope.sources import payloads


def test_rounding_equals_exact_half_even(spark):
    values = [2.675, 1.005, 0.125, 2.5, 1638.125, 1234.565, 99.995, 0.0, 7.0 / 3, 1e9 / 7]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", N.round_exact(F.col("x")).alias("r2"), N.round_exact(F.col("x"), 1).alias("r1")).collect()
    for row in got:
        assert row.r2 == round(row.x, 2)
        assert row.r1 == round(row.x, 1)


PROMOS = [
    ("2x1", 1000.0, "multi", "2x1", 500.0),
    ("3x2 en la góndola", 900.0, "multi", "3x2", 600.0),
    ("1x2", 900.0, None, None, None),
    ("2do al 50%", 1000.0, "multi", "2do −50%", 750.0),
    ("7x3 y 2da al 70%", 1000.0, "multi", "2do −70%", 650.0),
    ("2º al 50%", 1000.0, None, None, None),
    ("Tarjeta Banco 15%", 1000.0, "tarjeta", "", None),
    ("Estrella Galicia 2x1", 1000.0, "tarjeta", "", None),
    ("2x1", 0.0, "multi", "2x1", None),
    ("", 10.0, None, None, None),
]


def test_promotions(spark):
    df = spark.createDataFrame([(t, p) for t, p, *_ in PROMOS], "t string, p double")
    rows = df.select(parse_promo(F.col("t"), F.col("p")).alias("m")).collect()
    for (text, _, kind, label, price), row in zip(PROMOS, rows):
        found = row.m and (row.m.tipo, row.m.etiqueta, row.m.precio_efectivo)
        assert found == ((kind, label, price) if kind else None), text


def test_best_promotion(spark):
    cases = [
        (["Tarjeta 10%", "2do al 50%", "2x1", "4x2"], "2x1"),
        (["nada", "Banco 5%"], ""),
        (["nada"], None),
        (None, None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "t array<string>")
    got = df.select(best_promo(F.col("t"), F.lit(1000.0)).alias("m")).collect()
    assert [r.m and r.m.etiqueta for r in got] == [c[1] for c in cases]


def test_normal_text_equals_unicode_rule(spark):
    samples = ["Única ÑANDÚ", "ﬁne ½ litro", "Ångström ²x", "ｆｕｌｌ　ｗｉｄｅ", "", None, "ÀÉÎõü-Ç!", "straße №5", "é combining"]

    def rule(s):
        plain = "".join(c for c in unicodedata.normalize("NFKD", (s or "").lower()) if not unicodedata.combining(c))
        return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in plain).split())

    df = spark.createDataFrame([(s,) for s in samples], "s string")
    assert [r.n for r in df.select(T.norm_text(F.col("s")).alias("n")).collect()] == [rule(s) for s in samples]


def test_accents_of_every_code_point(spark):
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = ["|".join(map(chr, codes[i : i + 4000])) for i in range(0, len(codes), 4000)]
    rows += ["Ωμέγα й ё Ї", "각힣가 plain", "ﬁ½\U0001d400é"]
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    df = spark.createDataFrame(list(enumerate(rows)), "i int, s string").repartition(8)
    for r in df.select("s", T.strip_accents(F.col("s")).alias("n")).collect():
        assert r.n == "|".join(map(plain, r.s.split("|"))) if "|" in r.s else plain(r.s)
    assert {r.n for r in df.filter("s LIKE 'Ω%'").select(T.strip_accents(F.col("s")).alias("n")).collect()} == {"Ωμεγα и е І"}


def test_volume_pack_container_type(spark):
    names = ["Cerveza Quilmes 473 ml lata", "Pack x 6 473ml", "x 60", "6 x 473cc", "Andes 1,5 L porrón", "dos litros", "60x3 x 4"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    norm = T.norm_text(F.col("n"))
    rows = df.select(
        T.volume_from_name(F.col("n")).alias("v"), T.pack_quantity(norm).alias("p"), T.container(norm).alias("c"),
        T.type_text(F.col("n"), F.lit("Quilmes"), F.lit("dorada"), F.lit("")).alias("t"),
    ).collect()
    assert [r.v for r in rows] == [473, 473, None, 473, 1500, None, None]
    assert [r.p for r in rows] == [1, 6, 1, 6, 1, 1, 1]
    # "473cc" is one word, so it does not name a can
    assert [r.c for r in rows] == ["lata", None, None, None, "botella", None, None]
    assert rows[0].t == "lata"


OFFERS = [
    ("Cerveza 1890 Quilmes 473 ml", "1890", "quilmes", "1890"),
    ("Stella Artois 1 L", "", "stella-artois", ""),
    ("Andes Origen Roja 473", "Otra", "andes-origen", ""),
    ("Sin Marca 473", "Mi Marca", "mi-marca", ""),
    ("6pack raro", "", "6pack", ""),
    ("", "", "desconocida", ""),
]


def _offers(spark):
    rows = [(n, m, "", 354, "", False) for n, m, *_ in OFFERS]
    return spark.createDataFrame(rows, "nombre string, marca string, tipo string, volumen_ml int, gtin string, is_zero_alcohol boolean")


def test_brand_rules_and_join_form(spark):
    got = normalize_offers(_offers(spark)).select("nombre", "brand_slug", "sub_brand", "brand_display", "volume_ml_canon").collect()
    assert [(r.brand_slug, r.sub_brand) for r in got] == [(s, u) for *_, s, u in OFFERS]
    assert got[4].brand_display == "6Pack" and got[5].brand_display == "Desconocida" and got[0].volume_ml_canon == 355
    tables = builtin_aliases()
    brands = clean_aliases(spark.createDataFrame([(*r, i) for i, r in enumerate(tables.brands.rows)], ["alias_norm", "brand_slug", "brand_display", "sub_brand", "line"]))
    variants = clean_aliases(spark.createDataFrame([(*r, i) for i, r in enumerate(tables.variants.rows)], ["alias_norm", "variant_slug", "line"]))
    columns = ["nombre", "brand_slug", "brand_display", "sub_brand", "variant_slug", "structural_key"]
    joined = normalize_offers_by_join(_offers(spark), brands, variants, tables).select(*columns)
    assert sorted(map(str, joined.collect())) == sorted(map(str, normalize_offers(_offers(spark)).select(*columns).collect()))


def test_alias_table_size_check_and_repeats(spark):
    frame = clean_aliases(spark.createDataFrame([("Á", "x", 0), ("b", "y", 1), ("a", "z", 2)], ["alias_norm", "variant_slug", "line"]))
    assert AliasTable.of(frame, ["alias_norm", "variant_slug"]).rows == [["a", "z"], ["b", "y"]]
    assert AliasTable.of(frame, ["alias_norm", "variant_slug"], limit=1) is None


def test_labels_and_times(spark):
    row = spark.range(1).select(
        config_label(F.lit(2838), F.lit("lata"), F.lit(6)).alias("a"),
        config_label(F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(1)).alias("b"),
        local_day(F.lit("2024-01-02 02:42:00").cast("timestamp")).cast("string").alias("day"),
        age_hours(F.lit("nonsense"), F.current_timestamp()).alias("bad"),
        age_hours(F.lit("2024-01-01T00:00:00Z"), F.to_timestamp(F.lit("2024-01-01T06:30:00Z"))).alias("h"),
    ).first()
    assert (row.a, row.b, row.day, row.bad, row.h) == ("473cc · lata · pack x6", "s/tamaño", "2024-01-01", float("inf"), 6.5)


def test_unknown_platform_has_no_normalizer():
    assert payloads.available_platforms()[0] == "carrefour"
    with pytest.raises(KeyError):
        payloads.normalizer_of("nowhere")


def test_texts_are_resolved_once_and_kept(spark, tmp_path, monkeypatch):
    from shelfscope.operators import normalize as N

    rows = _offers(spark).unionByName(_offers(spark).withColumn("gtin", F.lit("007"))).unionByName(
        spark.createDataFrame([(None, None, None, None, None, None), (None, "", None, 0, "", True), ("", None, "", 354, "1", None)], _offers(spark).schema)
    )
    wanted = normalize_offers(rows)
    key = lambda df: sorted((str(r) for r in df.select(*wanted.columns).collect()))
    assert key(N.normalize_offers_by_text(rows)) == key(wanted)
    path = str(tmp_path / "texts")
    some = N.extend_dictionary(rows.filter("gtin = '007'"), path)
    before = some.count()
    words = N.extend_dictionary(rows, path)
    assert (before, words.count(), words.select("_text").distinct().count()) == (6, 9, 9)
    assert N.extend_dictionary(rows, path).count() == 9
    monkeypatch.setattr(N, "SMALL_DICTIONARY", 0)
    assert key(N.normalize_offers_by_text(rows, dictionary=words)) == key(wanted)
