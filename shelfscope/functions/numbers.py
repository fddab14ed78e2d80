"""Number expressions: rounding, discounts, unit prices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1, splits a double into two halves


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def round_exact(x: Column, digits: int = 2) -> Column:
    """Half-even rounding of the exact binary value (2.675 gives 2.67).

    ``x * 10**digits`` may land on a half only because the product was rounded;
    the error term of the product then tells on which side the true value lies.
    """
    scale = F.lit(float(10**digits))
    scaled = x * scale
    high = x * F.lit(_SPLIT) - (x * F.lit(_SPLIT) - x)
    error = (high * scale - scaled) + (x - high) * scale
    on_half = (scaled - F.floor(scaled).cast("double")) == F.lit(0.5)
    return (
        F.when(on_half & (error > 0), F.ceil(scaled).cast("double"))
        .when(on_half & (error < 0), F.floor(scaled).cast("double"))
        .otherwise(F.rint(scaled))
        / scale
    )


def truthy(x: Column) -> Column:
    """True for a number that is neither null nor zero."""
    return F.coalesce(x != 0, F.lit(False))


def filled(x: Column) -> Column:
    """True for a text that is neither null nor empty."""
    return F.coalesce(x != "", F.lit(False))


def discount_pct(price: Column, before: Column) -> Column:
    applies = truthy(before) & truthy(price) & (before > price)
    return F.when(
        applies, F.rint((F.lit(1.0) - price / before) * F.lit(10000.0)) / F.lit(100.0)
    ).otherwise(F.lit(0.0))


def price_per_100ml(price: Column, volume_ml: Column) -> Column:
    return F.when(
        truthy(price) & truthy(volume_ml),
        F.rint(price / volume_ml * F.lit(10000.0)) / F.lit(100.0),
    )


def list_price(price: Column, discount: Column) -> Column:
    """Price before a discount in percent; null without discount."""
    return F.when(
        F.coalesce(discount, F.lit(0.0)) > 0, price / (F.lit(1.0) - discount / F.lit(100.0))
    )


def per_100ml_view(price: Column, volume_ml: Column) -> Column:
    """Any price taken to 100 ml of the product's own volume; as is without volume."""
    return F.when(truthy(volume_ml), price * (F.lit(100.0) / volume_ml)).otherwise(price)


def available(price: Column, stock: Column) -> Column:
    return truthy(stock) & (F.coalesce(price, F.lit(0.0)) > 0)
