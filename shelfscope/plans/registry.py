"""Named queries over the given tables, each with the SQL statement it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfscope.operators.matrix import build_matrix
from shelfscope.operators.resolve import assign_canonicals
from shelfscope.plans import fixtures as fx
from shelfscope.session import cut_lineage, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return add


_SHARED: dict[tuple[str, str, str], object] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """Result that several views read, written once per session to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def forget_shared() -> None:
    _SHARED.clear()


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "offers", lambda: cut_lineage(fx.offers(spark, sf_dir)))


def resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def build():
        matched, canonicals = assign_canonicals(offers(spark, sf_dir))
        return cut_lineage(matched), canonicals

    return shared(spark, sf_dir, "resolved", build)


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        matched, canonicals = resolved(spark, sf_dir)
        return cut_lineage(build_matrix(canonicals, matched))

    return shared(spark, sf_dir, "matrix", build)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "history", lambda: cut_lineage(fx.history(spark, sf_dir)))


def landed(spark: SparkSession, sf_dir: str) -> str:
    """Folder of landed snapshots."""

    def build():
        root = scratch_path(spark, "landed")
        fx.land_all(spark, sf_dir, root)
        return root

    return shared(spark, sf_dir, "landed", build)
