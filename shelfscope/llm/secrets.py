"""Secret scans with a trigram inverted index.

Every rule's pattern implies strings that a text must hold to match. Their trigrams form a
Boolean query (all trigrams of one of the strings), answered by intersecting posting lists of
texts per trigram; only the texts found are searched with the pattern itself. Rules without
mandatory trigrams search every text. All work on rows is done by DataFrame functions.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.text import computed_once
from shelfscope.llm.common import join_by_key, keyed, literal_table
from shelfscope.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """A match counts if its ``group`` has at least ``least`` characters; base rules come first in ties."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# The kinds, their patterns and least lengths, in the order that breaks ties.
RULES = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16, base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),  # the runs of 32 or more are the runs that aren't dropped
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
)
MOST_STRINGS = 64  # a part of a pattern that stands for more strings than this implies none
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that a matching text fulfils, all of them; a clause is a list of trigram sets, one of which the lower-case text holds.

    Runs of a pattern with few possible strings are spelt out; whatever repeats without bound or has many
    characters to choose from ends a run. No clause: the pattern must be searched everywhere.
    """
    runs: list[set[str]] = []
    rest = _spell(sre_parser.parse(pattern), {""}, runs)
    clauses = []
    for run in [*runs, rest]:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if run and frozenset() not in sets:
            least = [x for x in sets if not any(y < x for y in sets)]
            clauses.append(sorted(least, key=sorted))
    return clauses


def _spell(nodes, run: set[str], runs: list[set[str]]) -> set[str]:
    """Extend the strings of the open run by what the nodes can match; closed runs go to ``runs``."""
    for node in nodes:
        choices = _strings(node)
        longer = {a + b for a in run for b in choices} if choices else set()
        if choices and len(longer) <= MOST_STRINGS:
            run = longer
        else:
            runs.append(run)
            run = choices if choices and len(choices) <= MOST_STRINGS else {""}
    return run


def _strings(node) -> set[str] | None:
    """All lower-case strings that the node can match, if they are few."""
    op, value = node
    if op is sre.LITERAL:
        return {chr(value).lower()}
    if op is sre.IN:
        if all(o is sre.LITERAL for o, _ in value):
            return {chr(v).lower() for _, v in value}
        return None
    if op is sre.SUBPATTERN:
        return _sequence(value[3])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and value[1] <= 3:
        once = _sequence(value[2])
        if once is None:
            return None
        found, longer = set() if value[0] else {""}, {""}
        for n in range(1, value[1] + 1):
            longer = {a + b for a in longer for b in once}
            found |= longer if n >= value[0] else set()
        return found
    return None


def _sequence(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        choices = _strings(node)
        if choices is None or len(found) * len(choices) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in choices}
    return found


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Posting lists of the given trigrams over keyed documents: trigram, doc_id, text_hash. A trigram is listed once per row."""
    low = computed_once(docs, {"low": F.translate("text", CAPITALS, CAPITALS.lower())})
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in trigrams]))
    return low.select("doc_id", "text_hash", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame | None:
    """doc_id, text_hash, kinds: the rows in which rules with mandatory trigrams may match, one row per id and text."""
    wanted = [(r.kind, c, a, g, len(trigrams)) for r in rules for c, clause in enumerate(trigram_query(r.pattern)) for a, trigrams in enumerate(clause) for g in sorted(trigrams)]
    if not wanted:
        return None
    queries = literal_table(docs.sparkSession, ["kind", "clause", "choice", "trigram", "needed"], wanted)
    clauses = {r.kind: len(trigram_query(r.pattern)) for r in rules}
    lists = postings(docs, sorted({w[3] for w in wanted}))
    held = (
        lists.join(F.broadcast(queries), "trigram")  # as long as the rules are
        .groupBy("doc_id", "text_hash", "kind", "clause", "choice", "needed")
        .agg(F.count_distinct("trigram").alias("n"))
        .filter("n = needed")
    )
    needed = F.create_map(*[F.lit(x) for kv in clauses.items() for x in kv])
    return (
        held.groupBy("doc_id", "text_hash", "kind")
        .agg(F.count_distinct("clause").alias("n"))
        .filter(F.col("n") == needed[F.col("kind")])
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def _running_totals(values: Column) -> Column:
    """Inclusive sums of an array of numbers, in steps of 512 so that long arrays aren't copied once per element."""
    long = F.transform(values, lambda x: x.cast("long"))
    parts = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(512)), lambda i: F.slice(long, i, F.lit(512)))
    grow = lambda total, x: F.array_append(total, F.coalesce(F.try_element_at(total, F.lit(-1)), F.lit(0).cast("long")) + x)
    nothing = F.array().cast("array<bigint>")
    within = F.transform(parts, lambda p: F.aggregate(p, nothing, grow))
    before = F.aggregate(within, F.array(F.lit(0).cast("long")), lambda total, w: F.array_append(total, F.element_at(total, -1) + F.element_at(w, -1)))
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(within, F.slice(before, F.lit(1), F.size(within)), lambda w, b: F.transform(w, lambda x: x + b)))).otherwise(nothing)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id and ``spans``, an array of (start, no, kind, end) by start, then by the order of the rules.

    Positions count code points, the end is exclusive; matches of a rule don't overlap and are the leftmost
    ones. Null texts are empty. Rows of equal id and text share their candidates and get equal results; rows
    without an id are found by their text.
    """
    docs = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    found = candidates(docs, rules)
    if found is None:
        rows = docs.withColumn("kinds", F.lit(None).cast("array<string>"))
    else:
        rows = join_by_key(docs, cut_lineage(found), "left")
    text = F.col("text")
    parts = {}
    for rule in rules:
        search = text.rlike(rule.pattern)
        if trigram_query(rule.pattern):
            search = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) & search
        pattern = F.lit(rule.pattern)
        lengths = lambda column: F.transform(column, lambda x: F.char_length(x))
        parts[rule.kind] = F.when(
            search,
            F.struct(
                lengths(F.split(text, rule.pattern, -1)).alias("gaps"),
                lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("own"),
                lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("counted"),
            ),
        )
    measured = computed_once(rows, parts).select("doc_id", *parts)
    nothing = F.array().cast("array<struct<start:bigint,no:int,kind:string,end:bigint>>")
    spans = []
    for no, rule in enumerate(rules):
        gap, own, counted = (F.col(rule.kind)[x] for x in ("gaps", "own", "counted"))
        ends = F.zip_with(_running_totals(F.slice(gap, F.lit(1), F.size(own))), _running_totals(own), lambda g, o: g + o)
        each = F.zip_with(
            F.arrays_zip(ends.alias("end"), own.alias("own")),
            counted,
            lambda x, n: F.when(n >= rule.least, F.struct((x["end"] - x["own"]).alias("start"), F.lit(no).alias("no"), F.lit(rule.kind).alias("kind"), x["end"].alias("end"))),
        )
        spans.append(F.when(F.col(rule.kind).isNotNull(), F.array_compact(each)).otherwise(nothing))
    return computed_once(measured.select("doc_id", *parts), {"spans": F.array_sort(F.concat(*spans))}).select("doc_id", "spans")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts per base kind, the hash over the base spans and all spans as text."""
    base = [r.kind for r in rules if r.base]

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(span_text(of(*base)), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def oracle() -> str:
    """The digest as DuckDB SQL."""
    each = " UNION ALL ".join(
        f"SELECT doc_id, rn, {no} AS no, '{r.kind}' AS kind, unnest(regexp_extract_all(text, {_quoted(r.pattern)}, 0)) AS own, "
        f"unnest(regexp_extract_all(text, {_quoted(r.pattern)}, {r.group})) AS counted, unnest(string_split_regex(text, {_quoted(r.pattern)})[:-2]) AS gap, "
        f"{r.least} AS least FROM t WHERE regexp_matches(text, {_quoted(r.pattern)})"
        for no, r in enumerate(RULES)
    )
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    counts = ", ".join(f"CAST(count(s.kind) FILTER (s.kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rn FROM documents),
m AS (SELECT *, row_number() OVER () AS seq FROM ({each})),
p AS (SELECT *, sum(length(gap) + length(own)) OVER (PARTITION BY rn, no ORDER BY seq ROWS UNBOUNDED PRECEDING) AS "end" FROM m),
s AS (SELECT rn, no, kind, CAST("end" - length(own) AS BIGINT) AS start, kind || ':' || CAST("end" - length(own) AS BIGINT) || ':' || CAST("end" AS BIGINT) AS span
  FROM p WHERE length(counted) >= least)
SELECT t.doc_id, {counts},
  sha256(coalesce(string_agg(s.span, ',' ORDER BY s.start, s.no) FILTER (s.kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg(s.span, ',' ORDER BY s.start, s.no), '') AS spans
FROM t LEFT JOIN s ON s.rn = t.rn GROUP BY t.rn, t.doc_id"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
