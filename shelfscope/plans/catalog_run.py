"""A whole run: landed snapshots to products, matrix, outputs and history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope import fixed_values as fixed
from shelfscope.functions.labels import iso_utc
from shelfscope.operators import health as H
from shelfscope.operators import history as Hi
from shelfscope.operators import series, sinks
from shelfscope.operators.matrix import build_matrix, run_summary
from shelfscope.operators.normalize import normalize_offers_by_text
from shelfscope.operators.resolve import assign_canonicals
from shelfscope.session import cut_lineage
from shelfscope.sources.aliases import AliasTables
from shelfscope.sources.landing import build_offers, load_latest, load_newest, load_run, with_platform_rank


NO_HEALTH = "platform string, ok boolean, stale boolean, captured_at string, last_seen timestamp_ntz"


@dataclass
class Run:
    """Results of a run; one that may not be published has raw offers only."""

    offers: DataFrame
    canonicals: DataFrame | None = None
    matrix: DataFrame | None = None
    summary: DataFrame | None = None
    published: bool = True


def resolve_run(envelopes: DataFrame, tables: AliasTables | None = None) -> Run:
    """Envelopes (with platform_rank) to products and matrix."""
    offers, canonicals = assign_canonicals(cut_lineage(normalize_offers_by_text(build_offers(envelopes), tables)))
    return Run(offers, canonicals, build_matrix(canonicals, offers), run_summary(offers, canonicals))


def local_run(spark: SparkSession, raw: str, out: str, history: str | None, address: str, run_ts: str) -> Run:
    """Latest snapshot of every shop folder to all outputs."""
    envelopes = with_platform_rank(load_latest(spark, raw), [F.col("platform")])
    run = resolve_run(envelopes)
    publish(run, out, history, address, run_ts, spark.createDataFrame([], NO_HEALTH))
    return run


def landed_run(spark: SparkSession, raw: str, run_id: str, stores: DataFrame, out: str, history: str, address: str, run_ts: str, **limits) -> Run:
    """One scheduled run from the landed snapshots: those of the run, and the newest of the shops that didn't arrive."""
    arrived = cut_lineage(load_run(spark, raw, run_id))
    absent = H.missing_platforms(H.expected_platforms(stores), arrived)
    return service_run(spark, arrived, load_newest(spark, raw, absent), stores, out, history, address, run_ts, **limits)


def service_run(
    spark: SparkSession,
    run_envelopes: DataFrame,
    newest: DataFrame,
    stores: DataFrame,
    out: str,
    history: str,
    address: str,
    run_ts: str,
    max_age_hours: float = fixed.MAX_SNAPSHOT_AGE_HOURS,
    min_platforms: int = fixed.MIN_PUBLISH_PLATFORMS,
) -> Run:
    """One scheduled run: stale fallback, publication guard, resolving, health, outputs, history.

    Stale snapshots come after those of the run. With too few shops nothing is resolved or written. Health is taken
    before this run is appended.
    """
    expected = H.expected_platforms(stores)
    now = F.to_timestamp(F.lit(run_ts))
    chosen = cut_lineage(H.with_stale_fallback(run_envelopes, newest, expected, now, max_age_hours))
    envelopes = with_platform_rank(chosen, [F.col("stale"), F.col("platform")])
    offers = build_offers(envelopes)
    if not H.may_publish(offers, min_platforms):
        return Run(offers, published=False)
    run = resolve_run(envelopes)
    present = run.offers.select("platform").distinct()
    stale = chosen.filter("stale").select("platform", "captured_at").distinct()
    seen = Hi.last_seen(Hi.read_history(spark, history))
    state = cut_lineage(H.platform_health(expected, present, seen, stale))
    publish(run, out, history, address, run_ts, state)
    return run


def publish(run: Run, out: str, history: str | None, address: str, run_ts: str, health: DataFrame) -> None:
    """Append the run to the history, write all outputs to a new version, check them, and make it the current one.

    A failure at any step leaves the last publication as it was; the same run can then be published again.
    """
    spark = run.matrix.sparkSession
    matrix = cut_lineage(run.matrix)
    rows = matrix.count()
    # One row per shop: the columns of the published table.
    platforms = [r.platform for r in run.offers.select("platform").distinct().orderBy("platform").collect()]
    stamp = F.to_timestamp(F.lit(run_ts))
    target = sinks.Publication(spark, out, run_ts)
    header = sinks.matrix_header(matrix, platforms, address, iso_utc(stamp), health)
    sinks.write_matrix_json(matrix, header, target.path("matrix_json"))
    target.check("matrix_json", spark.read.schema("canonical_id bigint").json(target.path("matrix_json/products")), rows)
    sinks.write_matrix_csv(matrix, platforms, target.path("matrix_csv"))
    target.check("matrix_csv", spark.read.csv(target.path("matrix_csv"), header=True, multiLine=True), rows)
    if history:
        observations = Hi.to_observations(run.offers, stamp)
        Hi.append_history(observations, history)
        when = spark.range(1).select(stamp.cast("timestamp_ntz")).first()[0]
        kept = f"{history.rstrip('/')}_series"
        series.catch_up(spark, history, kept, [when])
        documents = {
            "history": Hi.series_document(series.kept_price_series(spark, kept)),
            "history_detail": Hi.shop_series_document(series.kept_shop_series(spark, kept)),
        }
        for name, document in documents.items():
            document = cut_lineage(document)
            sinks.write_documents(document, target.path(name))
            target.check(name, spark.read.schema("canonical_key string").json(target.path(name)), document.count())
    target.publish()
