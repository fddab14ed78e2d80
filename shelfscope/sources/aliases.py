"""Curated alias tables: read, clean, and resolve.

A table that passes the size check is written into the plan as literals, so that
resolving needs no shuffle; a bigger one is matched by an equi-join on word n-grams.
"""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope import fixed_values as fixed
from shelfscope.functions.text import norm_text

MAX_INLINE_ROWS = 256
BRAND_COLUMNS = ["alias_norm", "brand_slug", "brand_display", "sub_brand"]
VARIANT_COLUMNS = ["alias_norm", "variant_slug"]
VOLUME_COLUMNS = ["raw_ml", "canonical_ml"]


def read_alias_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One curated CSV file with a header, plus its line order (one file, one split)."""
    schema = ", ".join(f"{c} string" for c in columns)
    rows = spark.read.csv(path, header=True, schema=schema, multiLine=True)
    return clean_aliases(rows.withColumn("line", F.monotonically_increasing_id()))


def clean_aliases(rows: DataFrame) -> DataFrame:
    """Normalised alias keys; a repeated key keeps its first line and its last value."""
    key, *values = [c for c in rows.columns if c != "line"]
    clean = F.col(key) if key == "raw_ml" else norm_text(F.col(key))
    return (
        rows.select(clean.alias(key), "line", *[F.trim(F.coalesce(v, F.lit(""))).alias(v) for v in values])
        .groupBy(key)
        .agg(
            F.max_by(F.struct(*values), "line").alias("value"),
            F.min("line").alias("line"),
        )
        .select(key, "value.*", "line")
    )


def parse_fixed(text: str) -> list[list[str]]:
    """Rows of a built-in table, with the same rule for repeated keys."""
    rows: dict[str, list[str]] = {}
    for row in csv.reader(io.StringIO(text)):
        rows[row[0]] = row
    return list(rows.values())


@dataclass(frozen=True)
class AliasTable:
    """Small alias table held as plan literals: rows in line order, alias first."""

    rows: list[list[str]]

    @staticmethod
    def of(frame: DataFrame, columns: list[str], limit: int = MAX_INLINE_ROWS) -> AliasTable | None:
        """Take a table into the plan if it is small enough, else None (use the join form)."""
        found = frame.select(*columns, "line").limit(limit + 1).collect()
        if len(found) > limit:
            return None
        return AliasTable([[str(r[c]) for c in columns] for r in sorted(found, key=lambda r: r["line"])])

    def exact(self, text: str) -> Column:
        """Line of an equal alias, null if none."""
        return F.expr(self.exact_text(text))

    def exact_text(self, text: str) -> str:
        return f"nullif(array_position({self._array(0)}, {text}), 0L)"

    def contained(self, normal: str, order) -> Column:
        """Line of the first alias, in the given order, contained as whole words.

        On normalised text words end at spaces only, so padding both sides is enough.
        """
        ranked = sorted(range(len(self.rows)), key=lambda i: order(self.rows[i][0]))
        cases = " ".join(
            f"WHEN contains({normal}, {sql_text(f' {self.rows[i][0]} ')}) THEN {i + 1}L" for i in ranked
        )
        return F.expr(f"CASE {cases} END")

    def value(self, line: str, column: int) -> Column:
        return F.expr(f"get({self._array(column)}, CAST({line} - 1 AS INT))")

    def _array(self, column: int) -> str:
        return f"array({', '.join(sql_text(row[column]) for row in self.rows)})"


def sql_text(value: str) -> str:
    """A text literal of Spark SQL."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def brand_order(alias: str) -> int:
    return -len(alias)


def variant_order(alias: str) -> int:
    return -len(alias.split())


@dataclass(frozen=True)
class AliasTables:
    brands: AliasTable
    variants: AliasTable
    volumes: AliasTable


def builtin_aliases() -> AliasTables:
    return AliasTables(
        AliasTable(parse_fixed(fixed.BRAND_ALIASES)),
        AliasTable(parse_fixed(fixed.VARIANT_ALIASES)),
        AliasTable(parse_fixed(fixed.VOLUME_ALIASES)),
    )


def match_aliases_by_join(
    rows: DataFrame, text: str, aliases: DataFrame, rank: Column, values: list[str], max_words: int
) -> DataFrame:
    """Resolve against an alias table of any size; adds ``values`` (null if no hit).

    Works on the distinct texts: word n-grams are joined to the aliases on equality,
    the best hit per text is kept, and the hits are joined back.
    """
    words = F.split(F.col(text), " ")
    grams = F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.lit(max_words)),
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))),
                    lambda i: F.array_join(F.slice(words, i, n), " "),
                ),
            )
        )
    )
    best = (
        rows.select(text)
        .distinct()
        .select(text, F.explode(grams).alias("alias_norm"))
        .join(aliases.withColumn("_rank", rank), "alias_norm")
        .groupBy(text)
        .agg(F.min_by(F.struct(*values), F.struct("_rank", "line")).alias("_hit"))
        .select(text, *[F.col("_hit")[v].alias(v) for v in values])
    )
    return rows.join(best, text, "left")
