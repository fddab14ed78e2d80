import random

import pytest
from pyspark.sql import functions as F

from brute import components, token_set_score
from shelfscope.operators.resolve import (
    assign_canonicals,
    dense_rank_at_scale,
    label_exact,
    label_fuzzy,
)
from shelfscope.operators.similarity import score_pairs, similar_names, word_set

WORDS = ["quilmes", "quilmas", "rubia", "rubya", "roja", "lata", "473ml", "cerveza", "x", "ale", "aale", "negra"]
SCHEMA = (
    "offer_ord long, platform string, nombre string, nombre_norm string, brand_slug string, "
    "brand_display string, sub_brand string, variant_slug string, volume_ml_canon int, container string, "
    "pack_qty int, gtin_norm string, is_zero boolean, structural_key string"
)


def random_offers(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 5)))
        variant = rng.choice(["unknown", "unknown", "rubia", "roja"])
        volume = rng.choice([None, 473])
        zero = rng.random() < 0.1
        key = f"q|{variant}|{volume}|1|{zero}" if variant != "unknown" and volume and rng.random() < 0.7 else None
        rows.append(
            dict(
                offer_ord=i * 3,
                platform=rng.choice(["a", "b", "c"]),
                nombre=name,
                nombre_norm=name,
                brand_slug=rng.choice(["q", "q", "s"]),
                brand_display="Q",
                sub_brand="",
                variant_slug=variant,
                volume_ml_canon=volume,
                container=None,
                pack_qty=1,
                gtin_norm=rng.choice(["", "", "", "1", "2"]),
                is_zero=zero,
                structural_key=key,
            )
        )
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_components_equal_sequential_greedy(spark, seed):
    rows = random_offers(seed, 40 + 12 * seed)
    expected = components(rows)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = label_fuzzy(label_exact(df)).select("offer_ord", "label").collect()
    first = {}
    for row in sorted(got, key=lambda r: r.offer_ord):
        first.setdefault(row.label, row.offer_ord // 3)
    assert [first[r.label] for r in sorted(got, key=lambda r: r.offer_ord)] == expected


def test_one_hot_name_stays_linear_and_right(spark):
    """A third of the offers share one name without code: joined, and not by pairs of rows."""
    rows = random_offers(99, 90)
    for r in rows[::3]:
        r.update(nombre_norm="cerveza", nombre="cerveza", brand_slug="q", volume_ml_canon=None,
                 variant_slug="unknown", gtin_norm="", structural_key=None, is_zero=False)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = label_fuzzy(label_exact(df)).select("offer_ord", "label").orderBy("offer_ord").collect()
    first = {}
    for row in got:
        first.setdefault(row.label, row.offer_ord // 3)
    assert [first[r.label] for r in got] == components(rows)


def test_scores_and_candidates_equal_brute_force(spark):
    rng = random.Random(5)
    letters = "abcd "
    names = {" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 24))).split()) for _ in range(120)}
    names |= {" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6))) for _ in range(120)}
    df = spark.createDataFrame([(n,) for n in names], "name string").select(
        F.lit("k").alias("block"), word_set(F.col("name")).alias("words"), F.lit(True).alias("is_open")
    ).distinct()
    sets = sorted(r.words for r in df.collect())
    expected = {
        frozenset((a, b))
        for i, a in enumerate(sets)
        for b in sets[i + 1 :]
        if token_set_score(a, b) >= 90
    }
    got = similar_names(df).collect()
    assert len(got) == len({frozenset((r.words_a, r.words_b)) for r in got})
    assert {frozenset((r.words_a, r.words_b)) for r in got} == expected
    pairs = [(rng.choice(sets), rng.choice(sets)) for _ in range(300)]
    scored = score_pairs(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    for row in scored:
        assert row.score == pytest.approx(token_set_score(row.a, row.b), abs=1e-9), (row.a, row.b)


def test_invariants_of_products(spark):
    rows = random_offers(11, 80)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    offers, canonicals = assign_canonicals(df)
    ids = sorted(r.canonical_id for r in canonicals.select("canonical_id").collect())
    assert ids == list(range(len(ids)))
    codes = offers.filter("gtin_norm <> ''").groupBy("canonical_id").agg(F.count_distinct("gtin_norm").alias("n"))
    assert codes.filter("n > 1").isEmpty()
    assert offers.count() == 80


def test_dense_rank_over_many_ranges(spark):
    numbers = [0, 5, 1 << 20, (1 << 20) + 7, 3 << 20, 9 << 40]
    df = spark.createDataFrame([(n,) for n in reversed(numbers)], "n long")
    got = {r.n: r.r for r in dense_rank_at_scale(df, "n", "r").collect()}
    assert got == {n: i for i, n in enumerate(numbers)}


def test_common_subsequence_of_long_texts_and_without_python(spark, data):
    from brute import lcs

    from shelfscope.operators.similarity import common_subsequence
    from shelfscope.plans.bind_products import fuzzy_pairs

    rng = random.Random(9)
    pairs = [tuple("".join(rng.choices("abc d", k=rng.randint(0, n))) for n in sizes) for sizes in [(5, 5), (60, 61), (61, 130), (200, 190)] for _ in range(40)]
    pairs += [("a" * 60, "a" * 60), ("a" * 120, "a" * 121), ("ab" * 60, "ba" * 60)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", common_subsequence(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == lcs(r.a, r.b) for r in rows)
    plan = fuzzy_pairs(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
