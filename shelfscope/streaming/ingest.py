"""Incremental append of newly landed snapshots to the history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.operators.history import append_shops, to_observations
from shelfscope.schemas import MANIFEST_DDL
from shelfscope.sources.landing import landed_rows, manifest


def landed_stream(spark: SparkSession, root: str) -> DataFrame:
    """A row for each snapshot as soon as it has landed whole."""
    return spark.readStream.schema(MANIFEST_DDL).json(f"{root.rstrip('/')}/_manifests")


def newest_of(landed: DataFrame, runs: list[str], platforms: list[str]) -> DataFrame:
    """Of these runs and shops, the rows of the manifest that count: those of each shop's last store."""
    rows = landed.filter(F.col("run_id").isin(runs) & F.col("platform").isin(platforms))
    last = rows.groupBy("platform", "run_id").agg(F.max_by("landing", "store").alias("landing")).select("landing")
    return rows.join(F.broadcast(last), "landing", "left_semi")


def append_landed(spark: SparkSession, root: str, to_offers: Callable[[DataFrame], DataFrame], history: str, checkpoint: str) -> None:
    """Append all runs that have landed since the last call to the history, and stop.

    ``to_offers`` turns envelopes (with run_id) into keyed offers with run_ts. The stream tells which shops of which
    runs are new; their snapshots are read as a whole and replace these shops' rows of these runs. So a batch that runs
    again after a failure, a snapshot that lands again and a run that a batch job has appended too all leave their rows once.
    """

    def save(batch: DataFrame, _: int) -> None:
        new = batch.select("run_id", "platform").distinct().collect()  # shops of the runs that landed in between
        if new:
            runs, shops = sorted({r.run_id for r in new}), sorted({r.platform for r in new})
            chosen = newest_of(manifest(spark, root), runs, shops)
            append_shops(to_observations(to_offers(landed_rows(spark, root, chosen)), F.col("run_ts")), history)

    query = (
        landed_stream(spark, root).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
