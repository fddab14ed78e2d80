"""License scans: TF-IDF cosine to templates, and licences inherited from directories above.

Every line of a text is compared with the templates as a header; a licence file is compared as a
whole too. So are, across line ends, all windows of as many terms as a template or a notice has:
headers that are wrapped or stand within longer lines, licence texts and tags. Weights come from the
number of documents that hold a term. A line or window can only reach the least cosine if it holds
one of the few heavy terms that no template's vector can do without; only such ones are weighed. A
licence file speaks for its directory, and documents without a licence of their own take that of the
nearest directory above. All done by DataFrame functions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.functions.text import computed_once
from shelfscope.llm.common import if_small
from shelfscope.session import cut_lineage

# Phrases by which licences are declared.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("0BSD", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "All rights reserved"),
)
# Further phrases, of notices, tags and the titles of full texts, that windows are compared with.
NOTICES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "under the Apache License, Version 2.0"),
    ("Apache-2.0", "under the Apache 2.0 License"),
    ("MIT", "under the MIT License"),
    ("MIT", "The MIT License"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License as published by the Free Software Foundation; either version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("GPL-3.0", "under the GPLv3"),
    ("GPL-2.0", "GNU GPL v2"),
    ("GPL-3.0", "GNU GPL v3"),
    ("GPL-3.0", "GNU GPL version 3"),
    ("LGPL-2.1", "GNU LGPL v2.1"),
    ("LGPL-2.1", "GNU LGPL version 2.1"),
    ("LGPL-3.0", "GNU LGPL v3"),
    ("LGPL-3.0", "GNU LGPL version 3"),
    ("LGPL-3.0", "under the LGPLv3"),
    ("AGPL-3.0", "GNU AGPL v3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License as published by the Free Software Foundation, either version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License as published by the Free Software Foundation, either version 3"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD", "under the BSD license"),
    ("BSD", "under a BSD license"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "under the ISC License"),
    ("BSL-1.0", "Boost Software License Version 1.0"),
    ("Zlib", "under the zlib License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("Apache-2.0", "MIT", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense")),
)
# A licence is not taken where a text also declares one that goes with the same words and says more.
YIELDS = {"BSD": ("BSD-2-Clause", "BSD-3-Clause"), "BSD-2-Clause": ("BSD-3-Clause",), "0BSD": ("ISC",)}
LAST = "Proprietary"  # its phrase stands in many texts of other licences, and yields to all of them
FILE_NAMES = ("license", "licence", "copying", "notice")  # names of licence files, before any ending
LEAST_COSINE = 0.7
STRETCH = 1_024  # terms of a text whose windows are found at a time: bounds a row, however long the text
SALTS = 16  # parts into which the documents of a directory are dealt
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # terms are what lies between, A-Z as small letters


def _terms(text: str) -> list[str]:
    return [t for t in "".join(c if c.isalnum() else " " for c in text.lower()).split()]


TEMPLATE_TERMS = [(name, _terms(text)) for name, text in TEMPLATES]
VOCABULARY = sorted({t for _, terms in TEMPLATE_TERMS for t in terms})
WINDOW_TERMS = TEMPLATE_TERMS + [(name, _terms(text)) for name, text in NOTICES]
WINDOW_VOCABULARY = sorted({t for _, terms in WINDOW_TERMS for t in terms})


def _array(terms: Iterable[str]) -> Column:
    """Fixed terms as one literal, which is sooner built than one for each."""
    return F.split(F.lit(" ".join(terms)), " ")


def _table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A fixed table as one literal."""
    names = [field.split()[0] for field in schema.split(", ")]
    fields = F.from_json(F.lit(json.dumps([dict(zip(names, row)) for row in rows])), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(fields))


def terms_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, CAPITALS, CAPITALS.lower()), SEPARATOR), "")


def term_weights(docs: DataFrame) -> tuple[dict[str, float], float]:
    """idf of every template term over all documents, and that of a term no document holds."""
    held = docs.select(F.explode(F.array_intersect(terms_of(F.coalesce("text", F.lit(""))), _array(WINDOW_VOCABULARY))).alias("term"))
    found = {r.term: r.n for r in held.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most the vocabulary
    n = docs.count()
    return {t: math.log((1 + n) / (1 + found.get(t, 0))) + 1 for t in WINDOW_VOCABULARY}, math.log(1 + n) + 1


def needed_terms(weights: dict[str, float], least: float = LEAST_COSINE, templates: list[tuple[str, list[str]]] = TEMPLATE_TERMS) -> list[str]:
    """Terms of which a line must hold one to reach the cosine with any template.

    Without the heaviest terms of a template's vector the rest is shorter than ``least`` of it, and so is any cosine.
    """
    needed = set()
    for _, terms in templates:
        parts = sorted(((terms.count(t) * weights[t], t) for t in set(terms)), reverse=True)
        left = whole = sum(x * x for x, _ in parts)
        for x, t in parts:
            if left < least * least * whole:
                break
            needed.add(t)
            left -= x * x
    return sorted(needed)


def key_terms(license: str, terms: list[str]) -> set[str]:
    """Terms of a phrase that no window may lack: all of a short phrase, else those of the licence's name."""
    return set(terms) if len(terms) < 5 else set(_terms(license)) & set(terms)


def windows(rows: DataFrame, weights: dict[str, float], least: float) -> DataFrame:
    """path, text_hash, length, line, terms: runs of as many terms as a phrase has that may reach the cosine with one.

    Every run around a term needed by a phrase of its length is taken that holds the key terms of such a phrase.
    ``line`` is the run's first term; a text that is shorter than a phrase is one run.
    """
    by_length: dict[int, list[tuple[str, list[str]]]] = {}
    for license, terms in WINDOW_TERMS:
        by_length.setdefault(len(terms), []).append((license, terms))
    needed = {n: _array(needed_terms(weights, least, phrases)) for n, phrases in by_length.items()}
    any_needed = _array(needed_terms(weights, least, WINDOW_TERMS))
    texts = computed_once(rows, {"terms": terms_of(F.col("text"))}).filter(F.arrays_overlap("terms", any_needed)).select("path", "text_hash", "terms")
    # each stretch goes on so far that it holds all windows that start in its first terms
    cut = lambda k: F.struct(k.alias("first"), F.slice("terms", k + 1, F.lit(STRETCH + max(by_length) - 1)).alias("terms"))
    stretches = F.transform(F.sequence(F.lit(0), F.size("terms") - 1, F.lit(STRETCH)), cut)
    texts = texts.select("path", "text_hash", F.explode(stretches).alias("s")).select("path", "text_hash", "s.*").filter(F.arrays_overlap("terms", any_needed))
    numbered = F.transform("terms", lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    texts = computed_once(texts, {"hits": F.filter(numbered, lambda x: F.array_contains(any_needed, x.t))})

    def runs(n: int) -> Column:
        last = F.least(F.when(F.col("first") == 0, F.greatest(F.size("terms") - n, F.lit(0))).otherwise(F.size("terms") - n), F.lit(STRETCH - 1))
        start = lambda x: F.greatest(x.i - (n - 1), F.lit(0))
        near = F.filter("hits", lambda x: F.array_contains(needed[n], x.t) & (start(x) <= last))
        around = F.transform(near, lambda x: F.sequence(start(x), F.least(x.i, last)))
        found = F.transform(F.array_distinct(F.flatten(around)), lambda i: F.struct(F.lit(n).alias("length"), (F.col("first") + i).alias("line"), F.slice("terms", i + 1, n).alias("terms")))
        keys = {tuple(sorted(key_terms(*phrase))) for phrase in by_length[n]}
        if () in keys:
            return found
        held = [_array(k) for k in sorted(keys)]
        return F.filter(found, lambda x: F.greatest(*[F.size(F.array_except(k, x.terms)) == 0 for k in held], F.lit(False)))

    return texts.select("path", "text_hash", F.explode(F.flatten(F.array(*[runs(n) for n in sorted(by_length)]))).alias("w")).select("path", "text_hash", "w.*")


def own_licenses(docs: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """path, text_hash, license, cosine, whole: the best licence of every document that declares one.

    ``docs`` has path and text; rows of equal path and text are one. Lines and files are compared with TEMPLATES,
    windows with the phrases of their length whose key terms they hold. The highest cosine decides among the
    licences that don't yield to another one found (YIELDS, LAST); ties go to the first licence by name, cosines being
    rounded to nine digits.
    """
    spark = docs.sparkSession
    weights, unknown = term_weights(docs)
    needed = _array(needed_terms(weights, least))
    rows = docs.select("path", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    name = F.lower(F.regexp_extract("path", r"([^/.]*)[^/]*$", 1))
    lines = rows.select("path", "text_hash", F.posexplode(F.split("text", "\n")).alias("line", "part"))
    files = rows.filter(name.isin(*FILE_NAMES)).select("path", "text_hash", F.lit(-1).alias("line"), F.col("text").alias("part"))
    units = computed_once(lines.unionByName(files), {"terms": terms_of(F.col("part"))}).filter(F.arrays_overlap("terms", needed))
    units = units.select("path", "text_hash", F.lit(0).alias("length"), "line", "terms").unionByName(windows(rows, weights, least))
    # rows of equal path and text have the same units: each is taken once
    unit = ["path", "text_hash", "length", "line"]
    units = units.select(*unit, "terms").distinct()
    counted = units.select(*unit, F.explode("terms").alias("term")).groupBy(*unit, "term").agg(F.count(F.lit(1)).alias("n"))
    known = _table(spark, "term string, weight double, notice boolean", [(t, w, t not in VOCABULARY) for t, w in weights.items()])
    vectors = []
    phrases = [(0, *x) for x in TEMPLATE_TERMS] + [(len(x[1]), *x) for x in WINDOW_TERMS]
    for no, (length, license, terms) in enumerate(phrases):
        parts = {t: terms.count(t) * weights[t] for t in set(terms)}
        norm = math.sqrt(sum(x * x for _, x in sorted(parts.items())))
        keys = key_terms(license, terms) if length else set()
        vectors += [(no, length, license, t, x / norm, int(t in keys), len(keys), terms.count(t)) for t, x in sorted(parts.items())]
    templates = _table(spark, "template int, length int, license string, term string, part double, key int, keys int, times int", vectors)  # as long as the phrases
    # lines weigh the terms of TEMPLATES only, windows those of NOTICES too
    weight = F.when((F.col("length") > 0) | ~F.col("notice"), F.col("weight"))
    weighed = counted.join(F.broadcast(known), "term", "left").withColumn("x", F.col("n") * F.coalesce(weight, F.lit(unknown)))
    norms = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    # in windows a term counts as often as the phrase has it, lest one that is repeated make up for the others
    share = F.when(F.col("length") > 0, F.least("n", "times") / F.col("n")).otherwise(1.0)
    dots = weighed.join(F.broadcast(templates), ["term", "length"]).groupBy(*unit, "template", "license", "keys").agg(F.sum(F.col("x") * F.col("part") * share).alias("dot"), F.sum("key").alias("held"))
    dots = dots.filter(F.col("held") == F.col("keys"))
    same = F.col("path").eqNullSafe(F.col("p")) & (F.col("text_hash") == F.col("h")) & (F.col("length") == F.col("n")) & (F.col("line") == F.col("l"))
    both = dots.join(norms.toDF("p", "h", "n", "l", "norm"), same)
    scored = both.select("path", "text_hash", "line", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine")).filter(F.col("cosine") >= least)
    each = scored.groupBy("path", "text_hash", "license").agg(F.max("cosine").alias("cosine"))
    found = F.collect_list(F.struct((-F.col("cosine")).alias("c"), "license")).alias("found")  # as long as the licences
    return each.groupBy("path", "text_hash").agg(found).select("path", "text_hash", best("found").alias("b")).select("path", "text_hash", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def best(found: str) -> Column:
    """The best of an array of (c, license), c being the cosine below 0, after those that yield to another one of it."""
    names = F.col(f"{found}.license")
    yields = lambda x: F.greatest(
        (x.license == LAST) & (F.size(F.array_remove(names, LAST)) > 0),
        *[(x.license == less) & F.arrays_overlap(names, _array(more)) for less, more in YIELDS.items()],
    )
    return F.array_min(F.filter(found, lambda x: ~yields(x)))


def directory_licenses(own: DataFrame) -> DataFrame:
    """dir, license: what the licence files of a directory say, as if they were one text: see ``own_licenses``."""
    name = F.lower(F.regexp_extract("path", r"([^/.]*)[^/]*$", 1))
    files = own.filter(name.isin(*FILE_NAMES)).withColumn("dir", directory("path"))
    each = files.groupBy("dir", "license").agg(F.max("cosine").alias("cosine"))
    found = F.collect_list(F.struct((-F.col("cosine")).alias("c"), "license")).alias("found")
    return each.groupBy("dir").agg(found).select("dir", best("found").license.alias("license"))


def directory(path: str) -> Column:
    """The path without its last part, '' at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherited(directories: DataFrame, declared: DataFrame) -> DataFrame:
    """dir, license, from_dir: for each of the directories the licence of the nearest one declared at or above it."""
    parts = F.split("dir", "/")
    above = directories.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("from_dir"))
    near = above.join(if_small(declared.withColumnRenamed("dir", "from_dir")), "from_dir")
    return near.groupBy("dir").agg(F.max_by(F.struct("license", "from_dir"), F.length("from_dir")).alias("b")).select("dir", "b.license", "b.from_dir")


def scan_licenses(docs: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """Per row: the columns doc_id and path of ``docs`` (doc_id, path, text), license, origin, cosine, from_dir.

    origin is 'own' for a licence declared in the text, 'inherited' for that of the nearest directory at or
    above the document's that has a licence file with a licence, 'none' otherwise (license null). Null texts
    are empty; documents without a path inherit nothing; repeated rows get equal results; further columns
    are ignored; whole texts are searched, however long.
    """
    docs = docs.select("doc_id", "path", "text")
    own = cut_lineage(own_licenses(docs, least))
    declared = cut_lineage(directory_licenses(own))
    rows = docs.select("doc_id", "path", F.xxhash64("text").alias("text_hash"), F.coalesce(directory("path"), F.lit("/")).alias("dir"))
    dirs = rows.filter(F.col("path").isNotNull()).select("dir").distinct()
    taken = cut_lineage(inherited(dirs, declared))
    found = own.toDF("_path", "_hash", "own", "cosine")
    match = rows.path.eqNullSafe(found._path) & (rows.text_hash == found._hash)
    rows = rows.join(if_small(found), match, "left").drop("_path", "_hash")
    salted = taken.select("dir", F.col("license").alias("taken"), "from_dir", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod("text_hash", F.lit(SALTS)).cast("int")).join(if_small(salted), ["dir", "salt"], "left")
    has_own = F.col("own").isNotNull()
    from_above = ~has_own & F.col("path").isNotNull() & F.col("taken").isNotNull()
    return rows.select(
        "doc_id",
        "path",
        F.when(has_own, F.col("own")).when(from_above, F.col("taken")).alias("license"),
        F.when(has_own, "own").when(from_above, "inherited").otherwise("none").alias("origin"),
        "cosine",
        F.when(from_above, F.col("from_dir")).alias("from_dir"),
    )


# Path of a document where the table has none: a tree per source, with a licence file for every 16 and for every 256 ids.
PATH_SQL = """coalesce(source, 'unknown') || '/' || CAST(doc_id // 256 AS VARCHAR) || CASE
  WHEN doc_id % 256 = 0 THEN '/LICENSE'
  WHEN doc_id % 16 = 0 THEN '/' || CAST(doc_id // 16 AS VARCHAR) || '/LICENSE'
  ELSE '/' || CAST(doc_id // 16 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.txt' END"""


def derived_path() -> Column:
    """The same for Spark."""
    return F.expr(PATH_SQL.replace("doc_id // 256", "doc_id div 256").replace("doc_id // 16", "doc_id div 16").replace("VARCHAR", "STRING"))


def oracle(least: float = LEAST_COSINE) -> str:
    """The scan of documents under derived paths as DuckDB SQL."""
    phrases = ", ".join(f"({no}, '{name}', '{' '.join(terms)}')" for no, (name, terms) in enumerate(TEMPLATE_TERMS))
    names = ", ".join(f"'{n}'" for n in FILE_NAMES)
    others = sorted({name for name, _ in WINDOW_TERMS} - {LAST})
    pairs = ", ".join(f"('{less}', '{more}')" for less, all_more in [*YIELDS.items(), (LAST, others)] for more in all_more)
    words = f"list_filter(regexp_split_to_array(translate({{}}, '{CAPITALS}', '{CAPITALS.lower()}'), '{SEPARATOR}'), lambda x: x <> '')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {PATH_SQL} AS path, coalesce(text, '') AS text FROM documents),
tt AS (SELECT no, license, unnest(string_split(phrase, ' ')) AS term FROM (VALUES {phrases}) v(no, license, phrase)),
df AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT rn, unnest({words.format('text')}) AS term FROM d) JOIN (SELECT DISTINCT term FROM tt) USING (term) GROUP BY term),
w AS (SELECT term, ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(n, 0))) + 1 AS weight FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term)),
tv AS (SELECT no, license, term, count(*) * any_value(weight) AS x FROM tt JOIN w USING (term) GROUP BY ALL),
tn AS (SELECT no, license, term, x / sqrt(sum(x * x) OVER (PARTITION BY no)) AS part FROM tv),
u AS (SELECT rn, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS part FROM d
  UNION ALL SELECT rn, -1, text FROM d WHERE lower(regexp_extract(path, '([^/.]*)[^/]*$', 1)) IN ({names})),
c AS (SELECT rn, line, term, count(*) AS n FROM (SELECT rn, line, unnest({words.format('part')}) AS term FROM u) GROUP BY ALL),
x AS (SELECT rn, line, term, n * coalesce(weight, ln(1 + (SELECT count(*) FROM d)) + 1) AS x FROM c LEFT JOIN w USING (term)),
n AS (SELECT rn, line, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
s AS (SELECT rn, license, round(sum(x * part) / any_value(norm), 9) AS cosine FROM x JOIN tn USING (term) JOIN n USING (rn, line) GROUP BY rn, line, no, license),
y AS (SELECT * FROM (VALUES {pairs}) v(less, more)),
o AS (SELECT rn, license, cosine FROM s WHERE cosine >= {least}
  AND NOT EXISTS (SELECT 1 FROM s t JOIN y ON t.license = y.more WHERE t.cosine >= {least} AND t.rn = s.rn AND y.less = s.license)
  QUALIFY row_number() OVER (PARTITION BY rn ORDER BY cosine DESC, license) = 1),
e AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, license, cosine FROM o JOIN d USING (rn) WHERE lower(regexp_extract(path, '([^/.]*)[^/]*$', 1)) IN ({names})),
f AS (SELECT dir, license FROM e WHERE NOT EXISTS (SELECT 1 FROM e t JOIN y ON t.license = y.more WHERE t.dir = e.dir AND y.less = e.license)
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, license) = 1),
a AS (SELECT d.rn, f.dir, f.license FROM d JOIN f ON starts_with(d.path, f.dir || '/') QUALIFY row_number() OVER (PARTITION BY d.rn ORDER BY length(f.dir) DESC) = 1)
SELECT doc_id, path, coalesce(o.license, a.license) AS license,
  CASE WHEN o.license IS NOT NULL THEN 'own' WHEN a.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  round(cosine, 6) AS cosine, CASE WHEN o.license IS NULL THEN a.dir END AS from_dir
FROM d LEFT JOIN o USING (rn) LEFT JOIN a USING (rn)"""
