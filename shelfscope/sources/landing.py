"""Landed snapshot files: choosing the right ones and turning them into offers.

A snapshot, all listings of one store in one run, is the unit. ``land_snapshots`` writes it in parts, one envelope per
line, below ``{root}/platform=.../store=.../run_id=.../``, and then adds a row to the manifest
``{root}/_manifests``: a snapshot is there once that row is, and is whole if its parts and listings are as many as the row
says. Local runs leave loose files ``{root}/{platform}/*.json`` instead, each a snapshot of its own, written as one JSON
text or line by line.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope import fixed_values as fixed
from shelfscope.schemas import ENVELOPE_DDL, MANIFEST_DDL, PRODUCT_FIELDS, STORES_DDL, struct_of
from shelfscope.session import cut_lineage, if_there

ENVELOPE_PART = 5000
RUN_FOLDER = "/run_id=[^/]*/"
SNAPSHOT = ["platform", "store", "run_id"]
LANDED_FILES = "*.{json,json.gz}"  # parts below run folders may be compressed
COUNTED_DDL = "fecha_scrapeo string, landing string, productos array<struct<id:string>>"  # what the manifest tells of a part


def platform_of(path: Column, root: str) -> Column:
    """Shop of a landed file: the first folder below the root."""
    below = re.escape(root.rstrip("/").split(":")[-1].replace("//", ""))
    return F.regexp_extract(path, below + r"/(?:platform=)?([^/]+)/", 1)


def snapshot_of(path: Column) -> Column:
    """A run folder holds one snapshot in several parts; elsewhere each file is one."""
    return F.regexp_replace(path, r"(/run_id=[^/]*)/.*", "$1")


def name_of(path: Column) -> Column:
    """Name of a snapshot: the run of a run folder, else the file's name without its ending."""
    last = F.regexp_replace(F.element_at(F.split(snapshot_of(path), "/"), -1), r"^run_id=|\.json$", "")
    return F.try_url_decode(F.try_url_decode(last))  # once for the folder's name, once for the path


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths and times of all landed files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return files.option("pathGlobFilter", LANDED_FILES).load(root).select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        platform_of(F.col("path"), root).alias("folder"),
        "modificationTime",
    )


def read_envelopes(spark: SparkSession, paths: list[str] | str, root: str) -> DataFrame:
    """All envelopes below the paths, one row each; what is not JSON has ``_corrupt_record`` set.

    Parts below run folders are read line by line. A loose file is read as a whole: it is one text, or has one
    envelope in every line.
    """
    schema = struct_of(ENVELOPE_DDL).add("_corrupt_record", "string")
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", LANDED_FILES)
    path, modified = F.col("_metadata.file_path"), F.col("_metadata.file_modification_time")
    place = [path.alias("path"), modified.alias("modified")]
    parts = reader.schema(schema).json(paths, mode="PERMISSIVE").select("*", *place).filter(F.col("path").rlike(RUN_FOLDER))
    plain = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(paths, wholetext=True)
    lines = F.filter(F.transform(F.split("value", "\n"), F.trim), lambda x: x != "")
    by_line = F.forall(lines, lambda x: x.startswith("{") & x.endswith("}"))
    texts = plain.select("value", *place).filter(~F.col("path").rlike(RUN_FOLDER))
    texts = texts.select(F.explode(F.when((F.size(lines) > 1) & by_line, lines).otherwise(F.array("value"))).alias("value"), "path", "modified")
    read = texts.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e"), "path", "modified")
    broken = F.coalesce(F.col("e._corrupt_record"), F.when(F.col("e").isNull(), F.col("value")))
    loose = read.select("e.*", "value", "path", "modified", broken.alias("_broken")).withColumn("_corrupt_record", F.col("_broken")).drop("_broken", "value")
    return parts.unionByName(loose).withColumns({"folder": platform_of(F.col("path"), root), "snapshot": snapshot_of(F.col("path")), "name": name_of(F.col("path"))})


def whole_snapshots(envelopes: DataFrame, key: list[str]) -> DataFrame:
    """Keys of the snapshots all of whose envelopes are JSON and, if in parts, hold as many listings as they say in all."""
    listings = F.coalesce(F.size("productos"), F.lit(0))
    state = envelopes.groupBy(*key).agg(
        F.bool_or(F.col("_corrupt_record").isNotNull()).alias("_broken"),
        F.bool_or(F.col("desde").isNotNull()).alias("_in_parts"),
        F.max("total").alias("_total"),
        F.sum(listings).alias("_listings"),
    )
    return state.filter(~F.col("_broken") & (~F.col("_in_parts") | (F.col("_listings") == F.coalesce("_total", F.lit(-1))))).select(*key)


def latest_by_name(snapshots: DataFrame, platform: str = "platform", name: str = "file_name", *ties: str) -> DataFrame:
    """Last snapshot by name of each shop."""
    newest = W.partitionBy(platform).orderBy(F.desc(name), *[F.desc(t) for t in ties])
    return snapshots.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def of_run(envelopes: DataFrame, run_id: str) -> DataFrame:
    """Whole snapshots of one run; the last listed per shop wins, with all its parts.

    ``envelopes``: as ``read_envelopes`` gives them. The run id ends the snapshot's name.
    """
    rows = envelopes.filter(F.col("name").endswith(run_id)).withColumn("platform", F.coalesce("plataforma", "folder"))
    rows = rows.join(whole_snapshots(rows, ["snapshot"]), "snapshot", "left_semi")
    listed = W.partitionBy("platform").orderBy(F.desc("snapshot"))
    return rows.withColumn("_n", F.rank().over(listed)).filter("_n = 1").drop("_n")


def newest_usable(envelopes: DataFrame) -> DataFrame:
    """Newest snapshot of each shop by modification time, with all its parts; none if that one is not JSON or not whole."""
    times = envelopes.groupBy("folder", "snapshot").agg(F.max("modified").alias("modified"))
    newest = latest_by_name(times, "folder", "modified", "snapshot").select("snapshot")
    rows = envelopes.join(newest, "snapshot", "left_semi")
    return rows.join(whole_snapshots(rows, ["snapshot"]), "snapshot", "left_semi").withColumn("platform", F.col("folder"))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The last manifest row of every landed snapshot; no rows if nothing was ever landed below the root."""
    rows = if_there(spark, lambda: spark.read.schema(MANIFEST_DDL).json(f"{root.rstrip('/')}/_manifests"), MANIFEST_DDL)
    rest = [f.name for f in struct_of(MANIFEST_DDL) if f.name not in SNAPSHOT]
    last = F.max_by(F.struct(*rest), F.struct("landed_at", "landing"))
    return rows.groupBy(*SNAPSHOT).agg(last.alias("m")).select(*SNAPSHOT, "m.*")


def folder_name(value: str) -> str:
    """A value as Spark writes it into the name of a partition's folder."""
    return re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value)


def read_landed(spark: SparkSession, root: str, runs: list[str] | None = None, fields: str = ENVELOPE_DDL) -> DataFrame:
    """Envelopes below shop, store and run folders, line by line; with ``runs`` no other run's folders are listed or read."""
    root = root.rstrip("/")
    schema = fields + ", platform string, store string, run_id string"
    names = "*" if runs is None else "{" + ",".join(folder_name(r).replace(",", "\\,") for r in runs) + "}"
    reader = spark.read.schema(schema).option("basePath", root)
    return if_there(spark, lambda: reader.json(f"{root}/platform=*/store=*/run_id={names}"), schema)


def landed_rows(spark: SparkSession, root: str, chosen: DataFrame) -> DataFrame:
    """Envelopes of the chosen rows of ``manifest`` whose parts and listings are all there; only their runs' folders are read.

    ``chosen`` has a row per shop or per store of a run, so it is sent to all executors.
    """
    runs = [r.run_id for r in chosen.select("run_id").distinct().collect()]
    promised = F.broadcast(chosen.select("landing", F.col("parts").alias("_parts"), F.col("listings").alias("_listings")))
    rows = read_landed(spark, root, runs).join(promised, "landing")
    found = rows.groupBy("landing", "_parts", "_listings").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("productos")).alias("listed"))
    whole = found.filter((F.col("n") == F.col("_parts")) & (F.col("listed") == F.col("_listings"))).select("landing")
    return rows.join(F.broadcast(whole), "landing", "left_semi").drop("_parts", "_listings")


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """One row per snapshot: platform, name, snapshot (sorts as listed), modified, and what is needed to read it. No contents are read.

    Landed ones come from the manifest; loose files are looked for in the shops' folders and the stores' folders below.
    """
    root = root.rstrip("/")
    landed = manifest(spark, root).select(
        "platform", F.col("run_id").alias("name"), F.concat_ws("/", *SNAPSHOT).alias("snapshot"), F.col("landed_at").alias("modified"),
        "run_id", "landing", "parts", "listings", F.lit(None).cast("string").alias("path"),
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json")
    listed = if_there(spark, lambda: files.load(f"{root}/{{[^_.]*,[^_.]*/*}}/*.json"), "path string, modificationTime timestamp, length bigint, content binary")
    folder = platform_of(F.col("path"), root)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "")
    loose = listed.select(folder.alias("platform"), name.alias("name"), F.concat_ws("/", folder, F.col("path")).alias("snapshot"), F.col("modificationTime").alias("modified"), "path")
    return landed.unionByName(loose, allowMissingColumns=True)


def read_snapshots(spark: SparkSession, root: str, chosen: DataFrame) -> DataFrame:
    """Envelopes of the chosen rows of ``list_snapshots``, those that are whole; with platform and snapshot."""
    chosen = cut_lineage(chosen)  # a row per shop or per store; what it was chosen by is not read again
    rows = landed_rows(spark, root, chosen.filter(F.col("landing").isNotNull())).withColumn("snapshot", F.concat_ws("/", *SNAPSHOT))
    paths = [r.path for r in chosen.filter(F.col("path").isNotNull()).select("path").collect()]
    if paths:
        files = read_envelopes(spark, paths, root)
        files = files.join(whole_snapshots(files, ["snapshot"]), "snapshot", "left_semi")
        files = files.withColumns({"platform": F.col("folder"), "snapshot": F.concat_ws("/", "folder", "path")})
        rows = rows.unionByName(files.drop("folder", "name", "modified", "path", "_corrupt_record"), allowMissingColumns=True)
    return rows


def load_latest(spark: SparkSession, root: str) -> DataFrame:
    """Latest snapshot per shop by name. Only the chosen snapshots are read; one that was landed by half has no name yet."""
    return read_snapshots(spark, root, latest_by_name(list_snapshots(spark, root), "platform", "name", "snapshot"))


def load_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Whole snapshots of one run: per shop that of the store listed last. The run id ends the snapshot's name."""
    rows = read_snapshots(spark, root, list_snapshots(spark, root).filter(F.col("name").endswith(run_id)))
    rows = rows.withColumn("platform", F.coalesce("plataforma", "platform"))
    last = rows.groupBy("platform").agg(F.max("snapshot").alias("snapshot"))
    return rows.join(F.broadcast(last), ["platform", "snapshot"], "left_semi")


def load_newest(spark: SparkSession, root: str, platforms: DataFrame | None = None) -> DataFrame:
    """Newest snapshot of each shop (of ``platforms``) by time; none for a shop whose newest one is not whole."""
    listed = list_snapshots(spark, root)
    if platforms is not None:
        listed = listed.join(F.broadcast(platforms.select("platform").distinct()), "platform", "left_semi")
    return read_snapshots(spark, root, latest_by_name(listed, "platform", "modified", "snapshot"))


def with_platform_rank(envelopes: DataFrame, order: list[Column]) -> DataFrame:
    """Position of each shop in the given order (sorts the shops only)."""
    shops = envelopes.groupBy("platform").agg(*[F.min(c).alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [F.col(f"_o{i}") for i in range(len(order))]
    ranked = shops.select("platform", (F.row_number().over(W.orderBy(*keys)) - 1).alias("platform_rank"))
    return envelopes.join(F.broadcast(ranked), "platform")


def build_offers(envelopes: DataFrame) -> DataFrame:
    """One row per listing with the fields of the schema, its shop and its position.

    ``platform_rank`` gives the order of the shops; an empty snapshot gives no rows.
    """
    rows = envelopes.select(
        "platform",
        "platform_rank",
        F.coalesce("external_store_id", F.lit("")).alias("store"),
        F.coalesce("fecha_scrapeo", F.lit("")).alias("scraped_at"),
        F.coalesce("desde", F.lit(0)).alias("desde"),
        F.posexplode("productos").alias("pos", "product"),
    )
    return rows.select(
        *[F.col("product")[f].alias(f) for f in PRODUCT_FIELDS],
        F.coalesce(F.col("product")["id"], F.lit("")).alias("external_product_id"),
        "platform",
        "store",
        "scraped_at",
        (F.col("platform_rank").cast("long") * F.lit(1 << 40) + F.col("desde") + F.col("pos")).alias("offer_ord"),
    )


def read_stores(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(STORES_DDL).json(path, multiLine=True)
    return rows.select("reference_address", F.explode("stores").alias("s")).select(
        "reference_address", "s.*"
    )


def store_setting(path: str, kind: str = "string") -> Column:
    """A value of a store's own settings, null where it is missing or of another type."""
    return F.try_variant_get("config", path, kind)


def active_stores(stores: DataFrame, platforms: list[str] | None = None) -> DataFrame:
    """Stores not switched off, of the wanted platforms if any are given."""
    rows = stores.filter(F.coalesce("active", F.lit(True)))
    return rows.filter(F.col("platform").isin(platforms)) if platforms else rows


def envelope_counts(products: DataFrame, keys: list[str]) -> DataFrame:
    """Listings and discounted listings of each snapshot."""
    return products.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("total"),
        F.count_if(F.col("descuento_pct") > 0).cast("int").alias("con_descuento"),
    )


def build_envelopes(products: DataFrame, part_size: int = ENVELOPE_PART) -> DataFrame:
    """Envelopes of the snapshots, in parts of at most ``part_size`` positions.

    ``products``: platform, external_store_id, tienda, direccion, fecha_scrapeo, source,
    pos and the product fields. ``desde`` is the first position of the part.
    """
    keys = ["platform", "external_store_id", "tienda", "direccion", "fecha_scrapeo"]
    listed = F.sort_array(F.collect_list(F.struct("pos", *PRODUCT_FIELDS)))
    part = F.floor(F.col("pos") / F.lit(part_size)).cast("bigint") * F.lit(part_size)
    parts = (
        products.withColumn("desde", part)
        .groupBy(*keys, "desde")
        .agg(F.any_value("source").alias("source"), listed.alias("_listed"))
        .withColumn("productos", F.transform("_listed", lambda p: p.dropFields("pos")))
    )
    return (
        parts.join(F.broadcast(envelope_counts(products, keys)), keys)  # one row per store
        .withColumnRenamed("platform", "plataforma")
        .drop("_listed")
    )


def accepted_snapshots(products: DataFrame, keys: list[str], minimum: int = fixed.MIN_SNAPSHOT_PRODUCTS) -> DataFrame:
    """Listings of the snapshots that bring enough products; a poor one never replaces a good one."""
    good = products.groupBy(*keys).count().filter(F.col("count") >= minimum).drop("count")
    return products.join(good, keys, "left_semi")


def write_parts(envelopes: DataFrame, root: str, run_id: str, landing: str, compression: str = "none") -> None:
    """Write envelopes below their shop, store and run folders; a folder that is written again is replaced. Big runs are best compressed (gzip)."""
    keys = {"platform": F.col("plataforma"), "store": F.coalesce("external_store_id", F.lit("")), "run_id": F.lit(run_id)}
    rows = envelopes.withColumns(keys).withColumn("landing", F.concat_ws("/", F.lit(landing), "platform", "store"))
    written = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SNAPSHOT)
    written.json(root, compression=compression)


def land_snapshots(envelopes: DataFrame, root: str, run_id: str, compression: str = "none") -> None:
    """Land one run's snapshots: the parts first, then a row per snapshot in the manifest.

    Landing a snapshot again replaces it. Until its new row is there, the old row doesn't fit its parts any more, and
    it counts as not whole.
    """
    spark, landing = envelopes.sparkSession, uuid.uuid4().hex
    write_parts(envelopes, root, run_id, landing, compression)
    written = read_landed(spark, root, [run_id], COUNTED_DDL).filter(F.col("landing").startswith(landing))
    rows = written.groupBy(*SNAPSHOT, "landing").agg(
        F.count(F.lit(1)).alias("parts"), F.sum(F.size("productos")).alias("listings"), F.max("fecha_scrapeo").alias("captured")
    )
    rows = rows.withColumn("landed_at", F.current_timestamp())
    rows.write.mode("append").partitionBy("run_id").json(f"{root.rstrip('/')}/_manifests")
