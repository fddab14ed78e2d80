"""Benchmark decontamination by a prefix-filtered join on word shingles.

A benchmark item is cut into windows of ten words. A text contains a window only if it contains
the window's rarest shingle, so that one (the prefix that exact containment needs) is joined;
its place gives the place of the window, which must lie within the text; then shingles that cover
the window must stand at their places. Everything is done by DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shelfscope.functions.text import computed_once
from shelfscope.llm.common import if_small, join_by_key, keyed, packed, unpacked
from shelfscope.session import cut_lineage

WINDOW = 10  # words of a window; a shorter item is one window
SHINGLE = 3  # words of a shingle; a shorter window is one shingle
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Benchmark shingles up to this number are sent to all executors (some 40 MB); more are joined by key.
BROADCAST_SHINGLES = 400_000
KEY = ["doc_id", "text_hash"]


def words_of(text: Column) -> Column:
    """Words in order, A-Z as small letters; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), CAPITALS, CAPITALS.lower())
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _joined(words: str, size: int) -> Column:
    """All runs of ``size`` words of an array column, as texts."""
    last = F.size(words) - size + 1
    run = lambda i: F.concat_ws(" ", *[F.col(words)[i + k] for k in range(size)])
    return F.when(last > 0, F.transform(F.sequence(F.lit(0), last - 1), run)).otherwise(F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct windows over all items: window (its words joined), length, and the items that have it."""
    items = computed_once(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), {"words": words_of(F.col("text"))}).filter(F.size("words") > 0)
    whole = F.array(F.array_join("words", " "))
    return (
        items.select("item_id", F.least(F.size("words"), F.lit(WINDOW)).alias("length"), F.explode(F.when(F.size("words") < WINDOW, whole).otherwise(_joined("words", WINDOW))).alias("window"))
        .groupBy("window", "length")
        .agg(F.collect_set(F.col("item_id")).alias("items"))
    )


def window_shingles(windows: DataFrame) -> DataFrame:
    """window, length, size, offset, shingle: every shingle of every window."""
    sized = computed_once(windows.select("window", "length", F.least("length", F.lit(SHINGLE)).alias("size")), {"words": F.split("window", " ")})
    shingles = F.lit(None).cast("array<string>")
    for size in range(1, SHINGLE + 1):
        shingles = F.when(F.col("size") == size, _joined("words", size)).otherwise(shingles)
    return sized.select("window", "length", "size", F.posexplode(shingles).alias("offset", "shingle"))


def _places(docs: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """One row per document (size 0), and one for each place of a benchmark shingle in it: doc_id, text_hash, n_words, size, pos, shingle."""
    rows = computed_once(docs.select(*KEY, "text"), {"words": words_of(F.col("text"))})  # else the words are searched anew for each shingle
    known = if_small(shingles.select("size", "shingle").distinct(), BROADCAST_SHINGLES)
    found = None
    for size in sizes or [SHINGLE]:
        first = found is None
        runs = F.concat(F.array(F.lit("")), _joined("words", size)) if first else _joined("words", size)  # "" stands for the row itself
        each = rows.select(*KEY, F.size("words").alias("n_words"), runs.alias("runs")).select(*KEY, "n_words", F.posexplode("runs").alias("pos", "shingle"))
        wanted = known.filter(F.col("size") == size).select("shingle")
        if first:
            wanted = wanted.union(wanted.sparkSession.range(1).select(F.lit("")))
        each = each.join(if_small(wanted, BROADCAST_SHINGLES), "shingle").select(*KEY, "n_words", F.when(F.col("shingle") == "", 0).otherwise(size).alias("size"), (F.col("pos") - int(first)).alias("pos"), "shingle")
        found = each if first else found.unionByName(each)
    return found


def window_hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): doc_id, text_hash, n_words of each keyed document; and doc_id, text_hash, window, start, length of each occurrence."""
    windows = cut_lineage(item_windows(benchmark))
    shingles = cut_lineage(window_shingles(windows))
    sizes = sorted(r.size for r in shingles.select("size").distinct().collect())  # at most SHINGLE values
    places = cut_lineage(_places(docs, shingles, sizes))
    rows, places = places.filter("size = 0").select(*KEY, "n_words"), places.filter("size > 0")

    rarity = places.groupBy("size", "shingle").agg(F.count(F.lit(1)).alias("n"))
    prefix = (
        shingles.join(rarity, ["size", "shingle"], "left")
        .groupBy("window", "length", "size")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest"))
        .filter("rarest.n > 0")
        .select("window", "length", "size", "rarest.shingle", "rarest.offset")
    )
    start = F.col("pos") - F.col("offset")
    within = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    maybe = places.join(if_small(prefix), ["size", "shingle"]).filter(within).select(*KEY, "window", "length", "size", start.alias("start")).distinct()
    covering = (F.col("offset") % F.col("size") == 0) | (F.col("offset") == F.col("length") - F.col("size"))
    cover = shingles.filter(covering).select("window", "offset", "shingle")
    needed = F.ceil(F.col("length") / F.col("size"))
    asked = maybe.join(if_small(cover), "window").withColumn("pos", F.col("start") + F.col("offset"))
    there = places.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "text_hash", "size", "pos", "shingle")])
    match = asked.doc_id.eqNullSafe(there._doc_id)
    for c in ("text_hash", "size", "pos", "shingle"):
        match = match & (asked[c] == there[f"_{c}"])
    hits = (
        asked.join(there, match, "left_semi")
        .groupBy(*KEY, "window", "length", "size", "start")
        .agg(F.count_distinct("offset").alias("n"))
        .filter(F.col("n") == needed)
        .select(*KEY, "window", "start", "length")
    )
    return rows, hits.join(if_small(windows.select("window", "items")), "window")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit, items (sorted array of ids), contaminated.

    A word is hit if it lies in an occurrence of a window; a shorter item is one window of all its words.
    Null, empty and wordless texts have no words; repeated rows get equal results; items without an id hit
    words but aren't listed; an empty benchmark hits nothing.
    """
    docs = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows, hits = window_hits(docs, benchmark)
    hits = cut_lineage(hits)
    end = F.col("start") + F.col("length")
    before = Window.partitionBy(*KEY).orderBy("start", end).rowsBetween(Window.unboundedPreceding, -1)
    fresh = end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0)))
    hit = hits.select(*KEY, "start", "length").distinct().withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy(*KEY).agg(F.sum("fresh").alias("n_hit"))
    items = hits.select(*KEY, F.explode("items").alias("item")).groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("items"))
    both = hit.join(items.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").drop("_id", "_hash")
    found = join_by_key(rows, cut_lineage(both), "left")
    return found.select(
        *KEY,
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without a hit."""
    found = contamination(docs, benchmark).filter("contaminated").select(*KEY).distinct()
    return unpacked(join_by_key(packed(docs), cut_lineage(found), "left_anti"))


def contamination_digest(found: DataFrame) -> DataFrame:
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


# The digest as DuckDB SQL: windows and places joined as whole texts of ten words.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '{WORD}') AS w FROM benchmark),
i AS (SELECT item_id, least(len(w), {WINDOW}) AS n, unnest(generate_series(1, greatest(len(w) - {WINDOW} + 1, 1))) AS s, w FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS t FROM i),
p AS (SELECT rn, n, s, array_to_string(w[s : s + n - 1], ' ') AS t
  FROM (SELECT rn, n, w, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM v))),
h AS (SELECT rn, s, p.n, item_id FROM p JOIN v ON p.n = v.n AND p.t = v.t),
k AS (SELECT rn, count(DISTINCT x) AS n_hit FROM (SELECT rn, unnest(generate_series(s, s + n - 1)) AS x FROM h) GROUP BY rn),
m AS (SELECT rn, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (rn) LEFT JOIN m USING (rn)"""
