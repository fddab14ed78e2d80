"""Source health: fresh and stale snapshots, missing shops, publication guard, alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope import fixed_values as fixed
from shelfscope.functions.labels import age_hours


def expected_platforms(stores: DataFrame) -> DataFrame:
    return stores.select("platform").distinct()


def with_stale_fallback(
    run: DataFrame,
    newest: DataFrame,
    expected: DataFrame,
    now: Column,
    max_age_hours: float = fixed.MAX_SNAPSHOT_AGE_HOURS,
    filled_if: str = "size(productos) > 0",
) -> DataFrame:
    """Snapshots of the run plus, for shops that did not arrive, their newest usable one.

    ``run`` and ``newest`` hold one envelope per shop. Adds ``stale`` and ``captured_at``.
    """
    absent = missing_platforms(expected, run)
    usable = (
        newest.join(F.broadcast(absent), "platform", "left_semi")  # one row per shop
        .filter(filled_if)
        .filter(age_hours(F.col("fecha_scrapeo"), now) <= max_age_hours)
    )
    fresh = run.withColumns({"stale": F.lit(False), "captured_at": F.lit(None).cast("string")})
    return fresh.unionByName(
        usable.withColumns({"stale": F.lit(True), "captured_at": F.col("fecha_scrapeo")}),
        allowMissingColumns=True,
    )


def platform_health(
    expected: DataFrame, present: DataFrame, last_seen: DataFrame, stale: DataFrame
) -> DataFrame:
    """One row per expected or present shop. ``stale``: platform, captured_at."""
    return (
        expected.select("platform")
        .unionByName(present.select("platform"))
        .distinct()
        .join(present.select("platform").distinct().withColumn("_here", F.lit(True)), "platform", "left")
        .join(stale.select("platform", "captured_at", F.lit(True).alias("_stale")), "platform", "left")
        .join(last_seen, "platform", "left")
        .select(
            "platform",
            F.col("_here").isNotNull().alias("ok"),
            F.col("_stale").isNotNull().alias("stale"),
            "captured_at",
            F.when(F.col("_here").isNull(), F.col("last_seen")).alias("last_seen"),
        )
        .orderBy("platform")
    )


def missing_platforms(expected: DataFrame, present: DataFrame) -> DataFrame:
    return expected.select("platform").distinct().join(present.select("platform").distinct(), "platform", "left_anti")


def publication(offers: DataFrame, minimum: int = fixed.MIN_PUBLISH_PLATFORMS) -> DataFrame:
    """One row: number of shops, offers, and whether the run may be published."""
    return offers.agg(
        F.count_distinct("platform").alias("platforms"), F.count(F.lit(1)).alias("offers")
    ).withColumn("published", F.col("platforms") >= minimum)


def may_publish(offers: DataFrame, minimum: int = fixed.MIN_PUBLISH_PLATFORMS) -> bool:
    return publication(offers, minimum).first()["published"]


def down(health: DataFrame) -> DataFrame:
    return health.filter(~F.col("ok"))


def outdated(health: DataFrame) -> DataFrame:
    return health.filter(F.col("ok") & F.col("stale"))


def error_windows(events: DataFrame) -> DataFrame:
    """Failures per tumbling window (``ts``, ``is_error``)."""
    return (
        events.groupBy(F.window("ts", fixed.ALARM_WINDOW).alias("w"))
        .agg(F.count_if("is_error").alias("errors"))
        .select(F.col("w.start").alias("window_start"), "errors")
    )


def alarms(windows: DataFrame) -> DataFrame:
    """Alarm where consecutive windows breach; a window without data does not breach.

    Windows are aggregated already (twelve a day), so their order fits one task.
    """
    order = W.orderBy("window_start")
    breach = F.col("errors") >= fixed.ALARM_THRESHOLD
    length = F.expr(f"INTERVAL {fixed.ALARM_WINDOW}")
    alarm = breach
    for back in range(1, fixed.ALARM_PERIODS):
        earlier = F.lag(F.struct("window_start", "errors"), back).over(order)
        alarm = alarm & F.coalesce(
            (earlier["window_start"] + length * F.lit(back) == F.col("window_start"))
            & (earlier["errors"] >= fixed.ALARM_THRESHOLD),
            F.lit(False),
        )
    return windows.withColumn("alarm", alarm)
