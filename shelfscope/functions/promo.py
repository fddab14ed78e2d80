"""Promotion texts: type, label, units and price per unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfscope import fixed_values as fixed
from shelfscope.functions.numbers import filled, let, round_exact, truthy
from shelfscope.functions.text import RAW, whole_number

PROMO_TYPE = (
    "struct<tipo:string,texto:string,etiqueta:string,unidades:int,precio_efectivo:double>"
)


def _promo(kind: str, text: Column, label: Column, units: Column, price: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("tipo"),
        text.alias("texto"),
        label.alias("etiqueta"),
        units.cast("int").alias("unidades"),
        price.cast("double").alias("precio_efectivo"),
    )


def promo_terms(text: Column) -> Column:
    """What the text of a promotion says, whatever the price; null for an empty text."""
    terms = F.struct(
        F.btrim(text).alias("text"),
        text.rlike(RAW + fixed.PROMO_CARD).alias("card"),
        whole_number(F.regexp_extract(text, RAW + fixed.PROMO_N_FOR_M, 1)).alias("n"),
        whole_number(F.regexp_extract(text, RAW + fixed.PROMO_N_FOR_M, 2)).alias("m"),
        whole_number(F.regexp_extract(text, RAW + fixed.PROMO_SECOND_UNIT, 1)).alias("off"),
    )
    return F.when(filled(text), terms)


def priced_promo(terms: Column, price: Column) -> Column:
    """Promotion of the terms of a text, null if none is recognised.

    Payment-method promotions come first and have no effective price; a pattern
    "n for m" out of bounds falls through to "second unit at x %".
    """
    none = F.lit(None).cast(PROMO_TYPE)
    return F.when(terms.isNull(), none).otherwise(
        F.when(terms["card"], _promo("tarjeta", terms["text"], F.lit(""), F.lit(0), F.lit(None))).otherwise(_multi_unit(terms, price))
    )


def parse_promo(text: Column, price: Column) -> Column:
    """Promotion of one text, null if none is recognised."""
    both = F.struct(promo_terms(text).alias("terms"), price.alias("price"))
    return let(both, lambda p: priced_promo(p["terms"], p["price"]))


def _multi_unit(p: Column, price: Column) -> Column:
    """Promotion of the numbers found in a text."""
    text, n, m, off = (p[name] for name in ("text", "n", "m", "off"))

    def exact(value: Column) -> Column:
        return let(value, lambda v: F.when(truthy(price) & truthy(v), round_exact(v)))

    label = F.concat(F.lit("2do −"), off.cast("string"), F.lit("%"))
    second = price * (F.lit(2.0) - off / F.lit(100.0)) / F.lit(2.0)
    return F.when(
        (m >= 1) & (m < n) & (n <= 6),
        _promo("multi", text, F.concat_ws("x", n, m), n, exact(price * m / n)),
    ).when((off > 0) & (off <= 100), _promo("multi", text, label, F.lit(2), exact(second)))


def best_promo(texts: Column, price: Column) -> Column:
    """Of several texts: the lowest effective price, first on a tie; else the first recognised."""
    found = F.filter(F.transform(texts, lambda t: parse_promo(t, price)), lambda p: p.isNotNull())
    priced = F.filter(
        found, lambda p: (p["tipo"] == "multi") & truthy(p["precio_efectivo"])
    )
    ranked = F.transform(
        priced,
        lambda p, i: F.struct(p["precio_efectivo"].alias("price"), i.alias("pos"), p.alias("promo")),
    )
    return F.coalesce(F.array_min(ranked)["promo"], F.get(found, F.lit(0)))


def promo_columns(promo: Column) -> list[Column]:
    """The five flat promotion fields of a listing."""
    return [
        F.coalesce(promo["etiqueta"], F.lit("")).alias("promo_etiqueta"),
        F.coalesce(promo["texto"], F.lit("")).alias("promo_texto"),
        F.coalesce(promo["tipo"], F.lit("")).alias("promo_tipo"),
        F.coalesce(promo["unidades"], F.lit(0)).alias("promo_unidades"),
        promo["precio_efectivo"].alias("promo_precio_efectivo"),
    ]
