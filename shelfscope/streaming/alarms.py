"""Source-failure alarm on a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope import fixed_values as fixed


def _windows(events: DataFrame, lateness: str) -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", fixed.ALARM_WINDOW).alias("w")).agg(F.count_if("is_error").alias("errors"))


def error_window_stream(events: DataFrame, lateness: str = fixed.ALARM_WINDOW) -> DataFrame:
    """Closed windows with their number of failures; late events within the watermark count.

    State is one counter per open window.
    """
    return _windows(events, lateness).select(F.col("w.start").alias("window_start"), "errors")


def alarm_stream(events: DataFrame, lateness: str = fixed.ALARM_WINDOW) -> DataFrame:
    """The same windows with the alarm: raised where so many consecutive windows, this one the last, all breach.

    The closed windows are gathered by a second event-time aggregation, over windows as long as all that an alarm
    looks at, one starting with each window. A window without events is missing there, and so doesn't breach; a
    gathering whose own last window is missing tells nothing. State is one counter per open window, and a few per open gathering.
    """
    count, unit = fixed.ALARM_WINDOW.split()
    reach = f"{int(count) * fixed.ALARM_PERIODS} {unit}"
    length = F.expr(f"INTERVAL {fixed.ALARM_WINDOW}")
    closed = _windows(events, lateness).withColumn("at", F.window_time("w"))
    gathered = closed.groupBy(F.window("at", reach, fixed.ALARM_WINDOW).alias("g")).agg(
        F.max("w.start").alias("window_start"),
        F.max_by("errors", "w.start").alias("errors"),
        F.count_if(F.col("errors") >= fixed.ALARM_THRESHOLD).alias("breaches"),
    )
    last = F.col("window_start") + length == F.col("g.end")
    return gathered.filter(last).select("window_start", "errors", (F.col("breaches") == fixed.ALARM_PERIODS).alias("alarm"))
