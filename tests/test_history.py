"""Landed snapshots in parts, the history table, kept series, alarms on a stream, publication."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import health as H
from shelfscope.operators import history as Hi
from shelfscope.operators import series, sinks
from shelfscope.plans.catalog_run import landed_run, local_run, service_run
from shelfscope.schemas import OBSERVATION_DDL
from shelfscope.sources import landing
from shelfscope.streaming.alarms import alarm_stream
from shelfscope.streaming.ingest import append_landed
from test_runs import land, product, shops


def listed(spark, platform, n, store="1", price=100.0, captured="2024-01-01T00:00:00Z"):
    rows = spark.range(n).select(
        F.col("id").alias("pos"),
        F.col("id").cast("string").alias("id"),
        F.format_string("Quilmes Rubia %d ml", F.col("id") + 300).alias("nombre"),
        F.lit("Quilmes").alias("marca"),
        (F.col("id") + 300).cast("int").alias("volumen_ml"),
        F.lit(price).alias("precio_actual"),
        (F.col("id") % 3).cast("double").alias("descuento_pct"),
        F.lit(5).alias("stock"),
    )
    for name, kind in landing.PRODUCT_FIELDS.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    place = {"platform": platform, "external_store_id": store, "tienda": "t", "direccion": "d", "fecha_scrapeo": captured}
    return rows.withColumns({k: F.lit(v) for k, v in place.items()}).withColumn("source", F.create_map(F.lit("a"), F.lit("b")))


def envelopes(spark, *args, part=5, **more):
    return landing.build_envelopes(listed(spark, *args, **more), part)


def sizes(rows):
    return {r[0]: r[1] for r in rows.groupBy("platform").agg(F.sum(F.size("productos"))).collect()}


RUN = "2024-01-01T10=00"  # the folder's name needs an escape


def test_snapshots_in_parts_come_back_whole(spark, tmp_path):
    root = str(tmp_path / "raw")
    landing.land_snapshots(envelopes(spark, "dia", 23), root, RUN)
    landing.land_snapshots(envelopes(spark, "dia", 23), root, RUN)  # again: replaced
    landing.land_snapshots(envelopes(spark, "vea", 9, store=""), root, RUN)
    landing.write_parts(envelopes(spark, "coto", 23).filter("desde > 0"), root, RUN, "broken off")
    (tmp_path / "raw" / "rappi").mkdir()
    lines = [json.dumps(dict(plataforma="rappi", productos=[product(i, "x", 1.0)])) for i in range(4)]
    (tmp_path / "raw" / "rappi" / f"{RUN}.json").write_text("\n".join(lines) + "\n\n")
    land(tmp_path / "raw", "jumbo", f"{RUN}.json", [product(1, "x", 1.0), product(2, "x", 1.0)])
    (tmp_path / "raw" / "disco").mkdir()
    (tmp_path / "raw" / "disco" / f"{RUN}.json").write_text("{broken")
    wanted = {"dia": 23, "vea": 9, "rappi": 4, "jumbo": 2}
    assert sizes(landing.load_latest(spark, root)) == wanted
    assert sizes(landing.load_run(spark, root, RUN)) == wanted
    assert sizes(landing.load_newest(spark, root)) == wanted
    every = landing.read_envelopes(spark, root, root)
    assert sizes(landing.of_run(every, RUN)) == wanted
    assert sizes(landing.newest_usable(every)) == wanted
    assert landing.build_offers(landing.with_platform_rank(landing.load_latest(spark, root), [F.col("platform")])).count() == 38


def test_which_snapshot_counts(spark, tmp_path):
    root = str(tmp_path / "raw")
    landing.land_snapshots(envelopes(spark, "dia", 7, store="a"), root, "run-2")
    landing.land_snapshots(envelopes(spark, "dia", 8, store="b"), root, "run-2")
    landing.land_snapshots(envelopes(spark, "dia", 9, store="a"), root, "run-1")
    assert sizes(landing.load_latest(spark, root)) == {"dia": 8}  # last name, last store
    assert sizes(landing.load_run(spark, root, "run-1")) == {"dia": 9}
    assert sizes(landing.load_newest(spark, root)) == {"dia": 9}
    landing.write_parts(envelopes(spark, "dia", 9, store="a"), root, "run-1", "broken off")  # landed again by half
    assert sizes(landing.load_newest(spark, root)) == {}
    assert sizes(landing.load_latest(spark, root)) == {"dia": 8}
    part = next((tmp_path / "raw/platform=dia/store=b/run_id=run-2").glob("*.json"))
    (part.parent / f".{part.name}.crc").unlink()
    part.write_text(part.read_text()[:-40])  # cut off
    assert sizes(landing.load_latest(spark, root)) == {}
    none = landing.load_newest(spark, root, spark.createDataFrame([("vea",)], "platform string"))
    assert none.count() == 0
    assert landing.load_latest(spark, str(tmp_path / "nothing")).count() == 0


def test_reading_a_run_lists_no_other_runs(spark, tmp_path):
    root = str(tmp_path / "raw")
    for run in ("run-1", "run-2"):
        landing.land_snapshots(envelopes(spark, "dia", 12), root, run)
    files = landing.read_landed(spark, root, ["run-2"]).inputFiles()
    assert files and all("run_id=run-2" in f for f in files)


def test_runs_over_snapshots_in_parts(spark, tmp_path):
    root = str(tmp_path / "raw")
    stores = spark.createDataFrame([("dia",), ("vea",), ("coto",)], "platform string")
    landing.land_snapshots(envelopes(spark, "dia", 23, captured="2024-01-02T00:00:00Z"), root, "run-2")
    landing.land_snapshots(envelopes(spark, "vea", 12, captured="2024-01-01T22:00:00Z"), root, "run-1")
    args = (spark, root, "run-2", stores, str(tmp_path / "out"), str(tmp_path / "hist"), "Calle 1", "2024-01-02T00:00:00Z")
    run = landed_run(*args)
    assert run.published and run.offers.count() == 35 and run.summary.first().offers == 35
    assert Hi.read_history(spark, str(tmp_path / "hist")).count() == 35
    local = local_run(spark, root, str(tmp_path / "out2"), None, "Calle 1", "2024-01-02T00:00:00Z")
    assert local.offers.count() == 35


def observed(spark, rows):
    """(product, shop, run day, price, discount) as observations."""
    full = [(k, s, "1", dt.datetime(2024, 1, 1) + dt.timedelta(days=d), p, c, None, 3, "2x1" if c > 5 else None, p / 2) for k, s, d, p, c in rows]
    return spark.createDataFrame(full, OBSERVATION_DDL)


def plain(rows):
    return sorted(tuple(r) for r in rows.collect())


def test_a_run_appended_again_counts_once(spark, tmp_path):
    path = str(tmp_path / "hist")
    first = observed(spark, [("a", "dia", 0, 1.0, 0.0), ("a", "vea", 0, 2.0, 0.0)])
    for _ in range(2):
        Hi.append_history(first, path)
    assert plain(Hi.read_history(spark, path)) == plain(first)
    Hi.append_shops(observed(spark, [("b", "vea", 0, 3.0, 0.0), ("b", "vea", 1, 3.0, 0.0)]), path)
    wanted = observed(spark, [("a", "dia", 0, 1.0, 0.0), ("b", "vea", 0, 3.0, 0.0), ("b", "vea", 1, 3.0, 0.0)])
    assert plain(Hi.read_history(spark, path)) == plain(wanted)
    Hi.compact_history(spark, path, ["2024-01"])
    assert plain(Hi.read_history(spark, path)) == plain(wanted)
    Hi.append_history(first, path)
    assert Hi.read_history(spark, path).count() == 3


def test_history_reads_only_folders_it_needs(spark, tmp_path):
    path = str(tmp_path / "hist")
    Hi.append_history(observed(spark, [("a", "dia", d, 1.0, 0.0) for d in range(70)]), path)
    since = Hi.read_history(spark, path, since="2024-03-01")
    plan = since._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "run_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert since.count() == 10
    one = Hi.read_history(spark, path, runs=[dt.datetime(2024, 1, 5)])
    assert one.count() == 1 and "(run#" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1]
    assert Hi.read_history(spark, str(tmp_path / "none")).count() == 0


def test_kept_series_equal_full_series_after_any_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(series.KINDS, "lowest", (*series.KINDS["lowest"][:3], 4))
    monkeypatch.setitem(series.KINDS, "shops", (*series.KINDS["shops"][:3], 3))
    path, kept, rng = str(tmp_path / "hist"), str(tmp_path / "kept"), random.Random(4)
    Hi.append_history(observed(spark, [("k0", "dia", 50, 9.0, 0.0)]), path)

    def some(day):
        return [(f"k{k}", s, day, float(rng.randint(1, 9)), float(rng.randint(0, 9))) for k in range(4) for s in ("dia", "vea") if rng.random() < 0.6]

    for days in ([0], [1, 2, 7], [5], [3, 8], [7, 6], [0]):  # late ones, and some again with other rows
        rows = [r for d in days for r in (some(d) or [("k1", "dia", d, 5.0, 0.0)])]
        Hi.append_history(observed(spark, rows), path)
        runs = [dt.datetime(2024, 1, 1) + dt.timedelta(days=d) for d in days]
        series.catch_up(spark, path, kept, runs) if days == [0] else series.add_runs(spark, path, kept, runs, buckets=3)
    whole = Hi.read_history(spark, path)
    assert plain(series.kept_price_series(spark, kept)) == plain(Hi.price_series(whole, 4).select("canonical_key", "run_ts", "p"))
    names = series.kept_shop_series(spark, kept).columns
    assert plain(series.kept_shop_series(spark, kept)) == plain(Hi.shop_series(whole, 3).select(*names))


def test_an_added_run_touches_only_its_buckets(spark, tmp_path):
    path, kept = str(tmp_path / "hist"), str(tmp_path / "kept")
    Hi.append_history(observed(spark, [(f"k{k}", "dia", 0, 1.0, 0.0) for k in range(40)]), path)
    series.add_runs(spark, path, kept, [dt.datetime(2024, 1, 1)])
    before = set((tmp_path / "kept/lowest").glob("bucket=*/*.parquet"))
    Hi.append_history(observed(spark, [("k3", "dia", 1, 1.0, 0.0)]), path)
    series.add_runs(spark, path, kept, [dt.datetime(2024, 1, 2)])
    after = set((tmp_path / "kept/lowest").glob("bucket=*/*.parquet"))
    assert len({p.parent for p in after - before}) == 1 and len(before) > 10


def test_stream_and_batch_in_one_history(spark, tmp_path):
    root, path, checkpoint = str(tmp_path / "raw"), str(tmp_path / "hist"), str(tmp_path / "check")

    def offers(rows):
        found = landing.build_offers(rows.withColumn("platform_rank", F.lit(0)))
        return found.withColumns({"canonical_key": F.col("id"), "run_ts": F.to_timestamp_ntz("scraped_at", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))})

    append_landed(spark, _landed(spark, root, "dia", 12, "run-1"), offers, path, checkpoint)
    landing.write_parts(envelopes(spark, "vea", 9), root, "run-1", "still landing")
    append_landed(spark, root, offers, path, checkpoint)
    assert Hi.read_history(spark, path).count() == 12
    _landed(spark, root, "vea", 9, "run-1")
    _landed(spark, root, "dia", 11, "run-1")  # again, with one less
    append_landed(spark, root, offers, path, checkpoint)
    Hi.append_history(Hi.to_observations(offers(landing.load_run(spark, root, "run-1")), F.col("run_ts")), path)
    rows = Hi.read_history(spark, path)
    assert {r.platform: r["count"] for r in rows.groupBy("platform").count().collect()} == {"dia": 11, "vea": 9}


def _landed(spark, root, platform, n, run):
    landing.land_snapshots(envelopes(spark, platform, n), root, run)
    return root


def test_alarm_on_a_stream_with_late_and_missing_windows(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    at = lambda hours: day + dt.timedelta(hours=hours)
    arrivals = [
        [(0.5, True), (2.5, True), (4.5, False), (1.0, False)],  # an alarm at 2
        [(3.9, True), (5.0, True), (10.5, True), (7.0, False)],  # late, but in time: 4 breaches after all; 8 is missing
        [(12.1, True), (13.0, False), (1.5, True), (15.0, False)],  # 1.5 is too late and changes nothing
        [(20.0, True), (22.5, True), (30.0, False)],
    ]
    folder = tmp_path / "events"
    query = None
    for no, rows in enumerate(arrivals):
        frame = spark.createDataFrame([(at(h), e) for h, e in rows], "ts timestamp, is_error boolean")
        frame.coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("ts timestamp, is_error boolean").parquet(str(folder))
        writer = alarm_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query = writer.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    found = {(r.window_start, r.errors, r.alarm) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    kept = [r for no, rows in enumerate(arrivals) for r in rows if r[0] != 1.5]
    batch = H.alarms(H.error_windows(spark.createDataFrame([(at(h), e) for h, e in kept], "ts timestamp, is_error boolean")))
    wanted = {(r.window_start, r.errors, r.alarm) for r in batch.collect() if r.window_start + dt.timedelta(hours=2) <= at(30.0 - 2)}
    assert found == wanted
    assert {(r[0] - day).total_seconds() / 3600 for r in found if r[2]} == {2.0, 4.0, 12.0, 22.0}


@pytest.mark.parametrize("step", ["write_matrix_csv", "write_documents"])
def test_a_failed_publication_leaves_the_last_one(spark, tmp_path, monkeypatch, step):
    shops(tmp_path / "raw")
    args = (spark, str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "hist"), "Calle 1")
    local_run(*args, "2024-01-01T10:00:00Z")
    good = sinks.published(spark, str(tmp_path / "out"))

    def fail(*_):
        raise OSError("the disk is full")

    with monkeypatch.context() as broken:
        broken.setattr(sinks, step, fail)
        with pytest.raises(OSError):
            local_run(*args, "2024-01-01T14:00:00Z")
    assert sinks.published(spark, str(tmp_path / "out")) == good
    assert spark.read.json(f"{good}/matrix_json/header").first().generated_at == "2024-01-01T10:00:00Z"
    local_run(*args, "2024-01-01T14:00:00Z")  # again
    now = sinks.published(spark, str(tmp_path / "out"))
    assert now != good and Hi.read_history(spark, str(tmp_path / "hist")).count() == 8
    assert spark.read.json(f"{now}/history").count() == 1
    assert len(list((tmp_path / "out/versions" / now.rsplit("/", 1)[1] / "matrix_csv").glob("*.csv"))) == 1


def test_lost_rows_are_noticed(spark, tmp_path):
    target = sinks.Publication(spark, str(tmp_path), "now")
    with pytest.raises(RuntimeError):
        target.check("rows", spark.range(3), 4)
    assert sinks.published(spark, str(tmp_path)) is None


def test_too_few_shops_resolve_nothing(spark, tmp_path, monkeypatch):
    import shelfscope.plans.catalog_run as runs

    root = _landed(spark, str(tmp_path / "raw"), "dia", 6, "run-1")
    stores = spark.createDataFrame([("dia",), ("vea",)], "platform string")
    monkeypatch.setattr(runs, "assign_canonicals", lambda *_: pytest.fail("resolved"))
    rows = landing.load_run(spark, root, "run-1")
    run = service_run(spark, rows, rows.limit(0), stores, str(tmp_path / "out"), str(tmp_path / "hist"), "x", "2024-01-01T01:00:00Z")
    assert not run.published and run.matrix is None and not (tmp_path / "out").exists()


def test_a_fault_in_the_history_is_no_first_run(spark, tmp_path):
    (tmp_path / "hist").mkdir()
    (tmp_path / "hist" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        Hi.last_seen(Hi.read_history(spark, str(tmp_path / "hist"))).collect()
