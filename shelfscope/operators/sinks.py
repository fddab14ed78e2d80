"""Published outputs: matrix document and table, histories; all of them at once or none.

Outputs are written to a folder of their own version and checked; only then a row in ``{out}/published`` makes that
version the current one. Until then, and after any failure, readers see the version before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.operators.matrix import flat_matrix, matrix_order
from shelfscope.session import if_there

SHEET_ROWS = 1_048_575  # what a spreadsheet takes below a header; a longer table is no spreadsheet and gets several files
PUBLISHED_DDL = "version string, generated_at string, outputs map<string,bigint>, published_at timestamp"
MARK = "﻿"  # byte order mark, so that spreadsheet programs read UTF-8


def matrix_header(matrix: DataFrame, platforms: list[str], address: str, generated_at: Column, health: DataFrame) -> DataFrame:
    """One row: counts, shops and their health (as many entries as shops)."""
    state = health.agg(F.array_sort(F.collect_list(F.struct("platform", "ok", "stale", "captured_at", "last_seen"))).alias("platform_health"))
    counts = matrix.agg(
        F.count(F.lit(1)).alias("total_canonicos"), F.count_if(F.col("n_platforms") > 1).alias("comparables")
    )
    return counts.join(F.broadcast(state), F.lit(True)).select(
        F.lit(address).alias("reference_address"),
        generated_at.alias("generated_at"),
        F.array(*[F.lit(p) for p in platforms]).alias("platforms"),
        "platform_health",
        "total_canonicos",
        "comparables",
    )


def write_matrix_json(matrix: DataFrame, header: DataFrame, path: str) -> None:
    """Header and products side by side; the products in matrix order, in many files."""
    header.write.mode("overwrite").json(f"{path}/header")
    matrix.orderBy(*matrix_order()).write.mode("overwrite").json(f"{path}/products")


def write_matrix_csv(matrix: DataFrame, platforms: list[str], path: str) -> None:
    """Flat matrix in matrix order, as one file that starts with the mark.

    More rows than a spreadsheet takes are written in parallel to several files, each with the marked header.
    """
    flat = flat_matrix(matrix.orderBy(*matrix_order()), platforms)
    if matrix.limit(SHEET_ROWS + 1).count() <= SHEET_ROWS:
        flat = flat.coalesce(1)
    first = flat.columns[0]
    marked = flat.withColumnRenamed(first, MARK + first)
    marked.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_documents(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").json(path)


class Publication:
    """Outputs of one run on their way to be published together."""

    def __init__(self, spark: SparkSession, out: str, generated_at: str):
        self.spark, self.out, self.generated_at = spark, out.rstrip("/"), generated_at
        self.version = uuid.uuid4().hex
        self.outputs: dict[str, int] = {}

    def path(self, output: str) -> str:
        return f"{self.out}/versions/{self.version}/{output}"

    def check(self, output: str, written: DataFrame, rows: int) -> None:
        """Compare what was written with what was to be written."""
        found = written.count()
        if found != rows:
            raise RuntimeError(f"{output}: {found} rows written of {rows}")
        self.outputs[output] = found

    def publish(self) -> None:
        """Make this version the current one: one row, written in one commit."""
        row = self.spark.createDataFrame([(self.version, self.generated_at, self.outputs)], PUBLISHED_DDL.rsplit(",", 1)[0])
        row.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{self.out}/published")


def published(spark: SparkSession, out: str) -> str | None:
    """Folder of the current version, None before the first."""
    out = out.rstrip("/")
    rows = if_there(spark, lambda: spark.read.schema(PUBLISHED_DDL).json(f"{out}/published"), PUBLISHED_DDL)
    last = rows.agg(F.max_by("version", F.struct("published_at", "generated_at"))).first()[0]
    return None if last is None else f"{out}/versions/{last}"
