"""Token-set similarity of names, and the pairs of names that reach the threshold.

With A, B the word sets, I their intersection and a, b the sorted rests joined by
spaces: the score is 100 when I is not empty and a or b is, else the best of three
ratios of edit distance (insertions and deletions) to length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope import fixed_values as fixed
from shelfscope.functions.numbers import let
from shelfscope.functions.text import computed_once
from shelfscope.session import cut_lineage

HOT_GRAM_NAMES = 4096


WORD_BITS = 60  # of a number that holds one bit per character: a sum of two such numbers stays positive


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts, by bits.

    ``a`` is cut into pieces of 60 characters, each with a row of bits that starts as all ones. Every character of
    ``b`` adds to each row the bits where the piece has that character, with the carry of the piece before; in the end
    the zeros count the common characters.
    """
    one = F.lit(1).cast("long")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(a) - 1) / WORD_BITS).cast("int")), lambda i: F.substring(a, i * WORD_BITS + 1, F.lit(WORD_BITS)))
    full = lambda piece: F.call_function("shiftleft", one, F.length(piece)) - 1

    def bits(piece: Column, letter: Column) -> Column:
        """Bits of the positions of a letter, the first position lowest."""
        letters = F.reverse(F.split(piece, ""))
        return F.aggregate(letters, F.lit(0).cast("long"), lambda m, x: m * 2 + F.when(x == letter, one).otherwise(F.lit(0).cast("long")))

    def over(p: Column) -> Column:
        letters = F.split(b, "")
        known = F.array_distinct(letters)
        masks = F.map_from_arrays(known, F.transform(known, lambda c: F.transform(p, lambda piece: bits(piece, c))))
        return let(masks, lambda m: F.aggregate(letters, F.transform(p, full), lambda rows, c: step(p, rows, m[c]), lambda rows: found(p, rows)))

    def step(p: Column, rows: Column, mask: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("rows"), F.lit(0).cast("long").alias("carry"))

        def add(state: Column, i: Column) -> Column:
            row, hit = rows[i], rows[i].bitwiseAND(mask[i])
            total = row + hit + state["carry"]
            kept = total.bitwiseOR(row - hit).bitwiseAND(full(p[i]))
            carry = F.shiftright(total, WORD_BITS)
            return F.struct(F.concat(state["rows"], F.array(kept)).alias("rows"), carry.alias("carry"))

        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), start, add, lambda state: state["rows"])

    def found(p: Column, rows: Column) -> Column:
        zeros = F.transform(rows, lambda row, i: F.length(p[i]) - F.bit_count(row))
        return F.aggregate(zeros, F.lit(0), lambda n, x: n + x)

    return F.when((a == "") | (b == ""), F.lit(0)).otherwise(let(pieces, over))


def word_set(normal: Column) -> Column:
    """Sorted distinct words of normalised text, as one text."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(normal, " "))), " ")


def _parts(left: Column, right: Column) -> Column:
    a, b = F.split(left, " "), F.split(right, " ")
    return F.struct(
        F.length(F.array_join(F.array_intersect(a, b), " ")).alias("shared"),
        F.array_join(F.array_except(a, b), " ").alias("a"),
        F.array_join(F.array_except(b, a), " ").alias("b"),
    )


def score_pairs(pairs: DataFrame, left: str, right: str, threshold: int | None = None) -> DataFrame:
    """Add ``score`` to pairs of word sets; with a threshold keep only pairs reaching it.

    The common subsequence is computed only where lengths alone leave the score open.
    """
    p = F.col("_p")
    gap = F.when(p["shared"] > 0, 1).otherwise(0)
    len_a, len_b = F.length(p["a"]), F.length(p["b"])
    whole_a, whole_b = p["shared"] + gap + len_a, p["shared"] + gap + len_b
    empty = (F.col(left) == "") | (F.col(right) == "")
    contained = (p["shared"] > 0) & ((len_a == 0) | (len_b == 0))

    def ratio(distance: Column, total: Column) -> Column:
        return F.lit(100.0) - F.lit(100.0) * distance / total

    side_a = ratio(gap + len_a, p["shared"] + whole_a)
    side_b = ratio(gap + len_b, p["shared"] + whole_b)
    sides = F.when(p["shared"] > 0, F.greatest(side_a, side_b)).otherwise(F.lit(0.0))
    ceiling = ratio(F.abs(len_a - len_b), whole_a + whole_b)
    open_score = ~empty & ~contained
    if threshold is not None:
        open_score = open_score & (sides < threshold) & (ceiling >= threshold)
    else:
        open_score = open_score & (ceiling > sides)
    marked = computed_once(pairs, {"_p": _parts(F.col(left), F.col(right))}).withColumn("_open", open_score)
    if threshold is not None:
        marked = marked.filter(~empty & (contained | (sides >= threshold) | F.col("_open")))
    lcs = F.when(F.col("_open"), common_subsequence(p["a"], p["b"])).otherwise(F.lit(0))
    distance = len_a + len_b - 2 * F.col("_lcs")
    score = (
        F.when(empty, F.lit(0.0))
        .when(contained, F.lit(100.0))
        .when(F.col("_open"), F.greatest(sides, ratio(distance, whole_a + whole_b)))
        .otherwise(sides)
    )
    scored = computed_once(marked, {"_lcs": lcs}).withColumn("score", score).drop("_p", "_open", "_lcs")
    return scored if threshold is None else scored.filter(F.col("score") >= threshold)


def _with_grams(names: DataFrame) -> DataFrame:
    """One row per two-letter gram of the padded text with its occurrence number.

    A text of n characters has n + 1 of them, whatever the order of its words.
    """
    padded = F.concat(F.lit(" "), F.col("words"), F.lit(" "))
    codes = F.array_sort(
        F.transform(
            F.sequence(F.lit(1), F.length("words") + 1),
            lambda i: F.ascii(F.substring(padded, i, 1)) * 128 + F.ascii(F.substring(padded, i + 1, 1)),
        )
    )
    numbered = F.transform(
        "_codes", lambda c, i: (c * 65536 + (i + 1 - F.array_position("_codes", c))).cast("int")
    )
    return computed_once(names, {"_codes": codes}).select("*", F.explode(numbered).alias("gram")).drop("_codes")


def similar_names(names: DataFrame) -> DataFrame:
    """Pairs of word sets of one block that reach the threshold, shorter name first.

    ``names``: block, words, is_open (one row per block and words). Pairs without an
    open side are left out. Nothing is paired block-wide: a pair of score 90 or more
    misses at most a third of the shorter name's grams, so its (third + 1) rarest grams
    must hit the other name. Only those are joined, the rarest common one emits the
    pair, and grams of many names are spread over salted buckets.

    Why a third: with edit distance d over total length l, d <= l / 10 and the longer
    side is at most 11/9 of the shorter. One deletion costs two grams, one insertion one,
    and the shorter side has no more deletions than insertions, so at most 1.5 d grams
    are lost, which is a third of the shorter length. The one-sided ratios lose less.
    """
    grams = _with_grams(names.filter("words <> ''"))
    counts = grams.groupBy("block", "gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = cut_lineage(
        grams.join(counts, ["block", "gram"])
        .groupBy("block", "words", "is_open")
        .agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("grams"))
        .withColumn("allowed", F.floor(F.length("words") / F.lit(3.0) + F.lit(1e-6)).cast("int"))
        .withColumn("codes", F.col("grams.gram"))
    )
    buckets = F.ceil(F.col("g.n") / F.lit(float(HOT_GRAM_NAMES))).cast("int")
    probe = (
        ranked.select(
            "block",
            F.col("words").alias("words_a"),
            F.col("is_open").alias("open_a"),
            F.col("codes").alias("codes_a"),
            "allowed",
            F.posexplode(F.slice("grams", F.lit(1), F.col("allowed") + 1)).alias("pos", "g"),
        )
        .withColumn("salt", F.explode(F.sequence(F.lit(0), buckets - 1)))
        .withColumn("gram", F.col("g.gram"))
        .drop("g")
    )
    index = (
        ranked.select(
            "block",
            F.col("words").alias("words_b"),
            F.col("is_open").alias("open_b"),
            F.col("codes").alias("codes_b"),
            F.explode("grams").alias("g"),
        )
        .withColumn("salt", F.pmod(F.hash("words_b"), buckets))
        .withColumn("gram", F.col("g.gram"))
        .drop("g")
    )
    shorter = (F.length("words_a") < F.length("words_b")) | (
        (F.length("words_a") == F.length("words_b")) & (F.col("words_a") < F.col("words_b"))
    )
    candidates = probe.join(index, ["block", "gram", "salt"]).filter(
        shorter
        & (F.col("open_a") | F.col("open_b"))
        & (F.size(F.array_intersect(F.slice("codes_a", F.lit(1), F.col("pos")), "codes_b")) == 0)
        & (F.size(F.array_intersect("codes_a", "codes_b")) >= F.size("codes_a") - F.col("allowed"))
    )
    return score_pairs(
        candidates.select("block", "words_a", "words_b"), "words_a", "words_b", fixed.FUZZY_THRESHOLD
    )
