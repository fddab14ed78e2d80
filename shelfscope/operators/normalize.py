"""Listing rows to comparable offers: brand, variant, volume, container, pack, key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope import fixed_values as fixed
from shelfscope.functions import text as T
from shelfscope.functions.labels import canonical_key
from shelfscope.functions.numbers import filled, truthy
from shelfscope.session import cut_lineage, if_there
from shelfscope.sources.aliases import (
    AliasTables,
    brand_order,
    builtin_aliases,
    match_aliases_by_join,
    variant_order,
)


def _first_word(normal: Column) -> Column:
    return F.when(normal == "", F.lit(fixed.UNKNOWN_BRAND)).otherwise(F.split(normal, " ")[0])


def brand_fallback(brand_raw: Column, brand_norm: Column, name_norm: Column) -> Column:
    """Raw brand as a slug, else the first word of the name."""
    word = _first_word(name_norm)
    return F.when(
        brand_norm != "",
        F.struct(
            F.replace(brand_norm, F.lit(" "), F.lit("-")).alias("slug"),
            F.regexp_replace(brand_raw, r"(?U)^\s+|\s+$", "").alias("display"),
            F.lit("").alias("sub"),
        ),
    ).otherwise(
        F.struct(word.alias("slug"), T.title_words(word).alias("display"), F.lit("").alias("sub"))
    )


def name_texts() -> dict[str, Column]:
    """Normal forms that all resolvers read."""
    name, kind = T.norm_text(F.col("nombre")), T.norm_text(F.col("tipo"))
    return {
        "nombre_norm": name,
        "marca_norm": T.norm_text(F.col("marca")),
        "_kind_norm": kind,
        "_zero": T.mentions_zero_alcohol(F.col("tipo"), F.col("nombre")),
    }


def padded_texts() -> dict[str, Column]:
    """Name, and type with name, with a space on both sides for whole-word tests."""
    space = F.lit(" ")
    return {
        "_name_padded": F.concat(space, "nombre_norm", space),
        "_words_padded": F.concat(space, "_kind_norm", space, "nombre_norm", space),
    }


def alias_hits(tables: AliasTables) -> dict[str, Column]:
    """Lines of the alias tables that apply: exact brand, else longest alias in the name;
    for the variant the alias of most words in type and name, unless it is zero alcohol."""
    return {
        "_brand": F.coalesce(
            tables.brands.exact("marca_norm"),
            tables.brands.contained("_name_padded", brand_order),
        ),
        "_variant": F.when(
            ~F.col("_zero"), tables.variants.contained("_words_padded", variant_order)
        ),
    }


def brand_columns(tables: AliasTables) -> dict[str, Column]:
    fallback = brand_fallback(F.col("marca"), F.col("marca_norm"), F.col("nombre_norm"))
    return {
        name: F.when(F.col("_brand").isNull(), fallback[part]).otherwise(
            tables.brands.value("_brand", i)
        )
        for i, (name, part) in enumerate(
            {"brand_slug": "slug", "brand_display": "display", "sub_brand": "sub"}.items(), 1
        )
    }


def variant_column(slug: Column) -> Column:
    return F.when(F.col("_zero"), F.lit(fixed.ZERO_VARIANT)).otherwise(
        F.coalesce(slug, F.lit(fixed.UNKNOWN_VARIANT))
    )


def resolve_volume(tables: AliasTables, volume: str = "volumen_ml") -> Column:
    """Whole millilitres after the volume aliases; zero and null give null."""
    whole = F.col(volume).cast("int")
    line = tables.volumes.exact_text(f"CAST(CAST({volume} AS INT) AS STRING)")
    known = tables.volumes.value(line, 1).cast("int")
    return F.when(truthy(F.col(volume)), F.coalesce(known, whole))


def structural_key() -> Column:
    """Comparable identity as text; null if the variant or the volume is not known."""
    return F.when(
        (F.col("variant_slug") != fixed.UNKNOWN_VARIANT) & truthy(F.col("volume_ml_canon")),
        F.concat_ws(
            "|",
            "brand_slug",
            "variant_slug",
            F.col("volume_ml_canon").cast("string"),
            F.col("pack_qty").cast("string"),
            F.col("is_zero").cast("string"),
        ),
    )


def normalize_offers(df: DataFrame, tables: AliasTables | None = None) -> DataFrame:
    """All derived identity columns, in one narrow pass without a shuffle."""
    tables = tables or builtin_aliases()
    return _finish(_resolved(df, tables), tables)


def _resolved(df: DataFrame, tables: AliasTables) -> DataFrame:
    """Brand and variant of each row, by its texts."""
    texts = T.computed_once(T.computed_once(df, name_texts()), padded_texts())
    hits = T.computed_once(texts, alias_hits(tables))
    variant = variant_column(tables.variants.value("_variant", 1))
    return hits.withColumns({**brand_columns(tables), "variant_slug": variant}).drop("_brand", "_variant")


def _finish(df: DataFrame, tables: AliasTables) -> DataFrame:
    derived = {
        "volume_ml_canon": resolve_volume(tables),
        "container": T.container(F.col("nombre_norm")),
        "pack_qty": T.pack_quantity(F.col("nombre_norm")),
        "gtin_norm": T.normal_gtin(F.col("gtin")),
        "is_zero": F.coalesce("is_zero_alcohol", F.lit(False)) | F.col("_zero"),
    }
    return (
        T.computed_once(df, derived)
        .withColumn("structural_key", structural_key())
        .drop("_zero", "_kind_norm", "marca_norm", "_name_padded", "_words_padded")
    )


TEXTS = ["nombre", "tipo", "marca"]
TEXT_COLUMNS = ["nombre_norm", "brand_slug", "brand_display", "sub_brand", "variant_slug", "container", "pack_qty", "_zero"]
SMALL_DICTIONARY = 50_000  # entries that are sent to all executors, some 15 MB; a bigger one is joined by hash


def text_dictionary(texts: DataFrame, tables: AliasTables | None = None) -> DataFrame:
    """What follows from the texts of a listing alone: per distinct name, type and brand, with their hash ``_text``."""
    keyed = texts.select(*TEXTS).distinct().withColumn("_text", F.xxhash64(*TEXTS))
    rows = _resolved(keyed, tables or builtin_aliases())
    derived = {"container": T.container(F.col("nombre_norm")), "pack_qty": T.pack_quantity(F.col("nombre_norm"))}
    return T.computed_once(rows, derived).select("_text", *TEXTS, *TEXT_COLUMNS)


def extend_dictionary(df: DataFrame, path: str, tables: AliasTables | None = None) -> DataFrame:
    """The kept dictionary at ``path`` with the texts of ``df`` that it lacked; only those are resolved.

    It holds for one set of alias tables: with other ones keep another dictionary.
    """
    spark = df.sparkSession
    schema = text_dictionary(df.limit(0), tables).schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    known = lambda: if_there(spark, lambda: spark.read.schema(schema).parquet(path), ddl)
    here = known().select(F.col("_text").alias("_hash"), *[F.col(c).alias(f"_{c}") for c in TEXTS])
    same = [F.xxhash64(*TEXTS) == F.col("_hash"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in TEXTS]]
    lacking = df.select(*TEXTS).distinct().join(here, same, "left_anti")
    text_dictionary(cut_lineage(lacking), tables).write.mode("append").parquet(path)
    return known()


def join_texts(df: DataFrame, entries: DataFrame, texts: list[str]) -> DataFrame:
    """Rows with what ``entries`` says of their texts, which may be null; it has one row for all texts of ``df``."""
    entries = cut_lineage(entries)
    if entries.limit(SMALL_DICTIONARY + 1).count() <= SMALL_DICTIONARY:
        entries = F.broadcast(entries)
    keyed = entries.withColumnsRenamed({c: f"_{c}" for c in texts})
    return df.join(keyed, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in texts]).drop(*[f"_{c}" for c in texts])


def normalize_offers_by_text(df: DataFrame, tables: AliasTables | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """The same as ``normalize_offers``, with each distinct name, type and brand resolved once.

    ``dictionary`` has all texts of ``df``; without one it is made for this call. Listings repeat their texts from
    run to run and shop to shop, so resolving texts is the smaller part of resolving rows; the rows are joined to it by the
    texts' hash.
    """
    tables = tables or builtin_aliases()
    entries = cut_lineage(text_dictionary(df, tables)) if dictionary is None else dictionary
    entries = entries.select(F.col("_text").alias("_hash"), *[F.col(c).alias(f"_{c}") for c in TEXTS], *TEXT_COLUMNS)
    if entries.limit(SMALL_DICTIONARY + 1).count() <= SMALL_DICTIONARY:
        entries = F.broadcast(entries)
    same = [F.xxhash64(*TEXTS) == F.col("_hash"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in TEXTS]]
    joined = df.join(entries, same).drop("_hash", *[f"_{c}" for c in TEXTS])
    derived = {
        "volume_ml_canon": resolve_volume(tables),
        "is_zero": F.coalesce("is_zero_alcohol", F.lit(False)) | F.col("_zero"),
    }
    rows = T.computed_once(joined, derived)
    # Cheap enough to be copied, and left out where it is not asked for, as by the history.
    return rows.withColumns({"gtin_norm": T.normal_gtin(F.col("gtin")), "structural_key": structural_key()}).drop("_zero")


def normalize_offers_by_join(
    df: DataFrame, brands: DataFrame, variants: DataFrame, tables: AliasTables, max_words: int = 4
) -> DataFrame:
    """Same result for alias tables too big to be plan literals (volumes stay small)."""
    base = T.computed_once(df, name_texts()).withColumn(
        "_words", F.concat_ws(" ", "_kind_norm", "nombre_norm")
    )
    parts = {"brand_slug": "slug", "brand_display": "display", "sub_brand": "sub"}
    exact = brands.select(F.col("alias_norm").alias("marca_norm"), F.struct(*parts).alias("_exact"))
    length = -F.length("alias_norm")
    named = match_aliases_by_join(
        base.join(exact, "marca_norm", "left"), "nombre_norm", brands, length, list(parts), max_words
    )
    fallback = brand_fallback(F.col("marca"), F.col("marca_norm"), F.col("nombre_norm"))
    resolved = named.withColumns(
        {name: F.coalesce(F.col("_exact")[name], F.col(name), fallback[part]) for name, part in parts.items()}
    )
    words = -F.size(F.split("alias_norm", " "))
    varied = match_aliases_by_join(resolved, "_words", variants, words, ["variant_slug"], max_words)
    varied = varied.withColumn("variant_slug", variant_column(F.col("variant_slug")))
    return _finish(varied.drop("_exact", "_words"), tables)


def with_own_key(offers: DataFrame) -> DataFrame:
    """Canonical key from the row's own attributes (before any grouping)."""
    return offers.withColumn(
        "canonical_key",
        canonical_key(
            F.col("brand_slug"),
            F.col("sub_brand"),
            F.col("variant_slug"),
            F.col("volume_ml_canon"),
            F.col("container"),
            F.col("pack_qty"),
            F.col("is_zero"),
        ),
    )
