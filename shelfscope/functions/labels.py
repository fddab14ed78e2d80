"""Display labels, ages and local days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfscope import fixed_values as fixed
from shelfscope.functions.numbers import filled, truthy
from shelfscope.functions.text import title_words


def variant_label(slug: Column) -> Column:
    return F.when(filled(slug) & (slug != fixed.UNKNOWN_VARIANT), F.replace(slug, F.lit("-"), F.lit(" "))).otherwise(F.lit(""))


def model_label(slug: Column) -> Column:
    label = variant_label(slug)
    return F.when(label == "", F.lit("Clásica")).otherwise(label)


def config_label(volume_ml: Column, container: Column, pack: Column) -> Column:
    """Size per unit (packs of a standard size), container and pack."""
    unit = volume_ml / pack
    sizes = F.array(*[F.lit(float(s)) for s in fixed.STANDARD_SIZES_ML])
    standard = F.exists(sizes, lambda s: F.abs(s - unit) <= fixed.STANDARD_SIZE_SLACK_ML)
    size = F.when(
        (pack > 1) & truthy(volume_ml) & standard, F.floor(unit + F.lit(0.5)).cast("int")
    ).otherwise(volume_ml)
    return F.concat_ws(
        " · ",
        F.when(truthy(size), F.concat(size.cast("string"), F.lit("cc"))).otherwise(F.lit("s/tamaño")),
        F.when(filled(container), container),
        F.when(pack > 1, F.concat(F.lit("pack x"), pack.cast("string"))),
    )


def display_name(
    brand: Column, sub_brand: Column, variant: Column, volume_ml: Column, container: Column, pack: Column
) -> Column:
    return F.concat_ws(
        " ",
        brand,
        F.when(filled(sub_brand), sub_brand),
        F.when(variant_label(variant) != "", title_words(variant_label(variant))),
        F.when(truthy(volume_ml), F.concat(volume_ml.cast("string"), F.lit("ml"))),
        F.when(filled(container), container),
        F.when(pack > 1, F.concat(F.lit("x"), pack.cast("string"))),
    )


def canonical_key(
    brand_slug: Column,
    sub_brand: Column,
    variant: Column,
    volume_ml: Column,
    container: Column,
    pack: Column,
    is_zero: Column,
) -> Column:
    """Identity that stays the same from run to run."""
    brand = F.concat_ws("-", brand_slug, F.when(filled(sub_brand), sub_brand))
    return F.concat_ws(
        "|",
        brand,
        variant,
        F.when(truthy(volume_ml), volume_ml.cast("string")).otherwise(F.lit("")),
        F.coalesce(container, F.lit("")),
        pack.cast("string"),
        F.when(is_zero, F.lit("z")).otherwise(F.lit("")),
    )


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _epoch(iso: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(iso)) / F.lit(1_000_000.0)


def age_seconds(iso: Column, now: Column) -> Column:
    """Seconds from an ISO text to ``now`` (a timestamp); null if it cannot be read."""
    return F.unix_micros(now) / F.lit(1_000_000.0) - _epoch(iso)


def age_hours(iso: Column, now: Column) -> Column:
    """Infinite for a missing or unreadable time, so that it never counts as fresh."""
    return F.coalesce(age_seconds(iso, now) / F.lit(3600.0), F.lit(float("inf")))


def age_label(iso: Column, now: Column) -> Column:
    seconds = age_seconds(iso, now)
    minutes = F.floor(seconds / 60)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (
        F.when(~filled(iso), F.lit("—"))
        .when(seconds < 60, F.lit("hace instantes"))
        .when(minutes < 60, F.concat(F.lit("hace "), minutes.cast("string"), F.lit("m")))
        .when(
            hours < 48,
            F.concat(F.lit("hace "), hours.cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")),
        )
        .otherwise(
            F.concat(
                F.lit("hace "), days.cast("string"), F.lit(" día"), F.when(days != 1, F.lit("s")).otherwise(F.lit(""))
            )
        )
    )


def local_day(ts: Column, zone: str = fixed.LOCAL_ZONE) -> Column:
    """Calendar day in the shop's zone of a UTC time."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))
