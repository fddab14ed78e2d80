"""Which offers are the same product.

Product code first, then the structural key, then similar names within a block of
brand, volume and pack. Two different product codes are never joined.

``offer_ord`` must be a unique number giving the order of the offers; it decides all ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope import fixed_values as fixed
from shelfscope.functions.labels import canonical_key, display_name
from shelfscope.operators.forest import join_free_labels
from shelfscope.operators.similarity import similar_names, word_set
from shelfscope.session import cut_lineage

POSITIONS_PER_BUCKET = 1 << 20
OFFERS_PER_BUCKET = 1 << 16  # where nearly every number is taken


def code_owner_of_keys(offers: DataFrame) -> DataFrame:
    """First product code, in offer order, among the offers of each structural key."""
    return (
        offers.filter("structural_key IS NOT NULL AND gtin_norm <> ''")
        .groupBy("structural_key")
        .agg(F.min_by("gtin_norm", "offer_ord").alias("owner_gtin"))
    )


def label_exact(offers: DataFrame) -> DataFrame:
    """Label by product code and structural key, without iteration: adds label, rooted.

    An offer without code takes the code that owns its key; all others are not looked up and stay where they are.
    """
    own = F.concat(F.lit("o:"), F.col("offer_ord").cast("string"))
    needs = (F.col("gtin_norm") == "") & F.col("structural_key").isNotNull()
    needs = F.coalesce(needs, F.lit(False))
    owners = cut_lineage(code_owner_of_keys(offers))  # its real size decides how it is joined
    code = F.coalesce(F.nullif("gtin_norm", F.lit("")), F.col("owner_gtin"))
    looked_up = offers.filter(needs).join(owners, "structural_key", "left")
    return (
        offers.filter(~needs)
        .withColumn("owner_gtin", F.lit(None).cast("string"))
        .unionByName(looked_up)
        .withColumn("rooted", code.isNotNull())
        .withColumn(
            "label",
            F.coalesce(
                F.concat(F.lit("g:"), code), F.concat(F.lit("k:"), F.col("structural_key")), own
            ),
        )
        .drop("owner_gtin")
    )


def block_key() -> Column:
    """Brand, volume and pack; offers without volume share a block."""
    return F.concat_ws(
        "|",
        "brand_slug",
        F.coalesce(F.col("volume_ml_canon").cast("string"), F.lit("")),
        F.col("pack_qty").cast("string"),
    )


GROUP = ["block", "words", "platform", "is_zero", "variant_slug"]


def name_groups(rows: DataFrame) -> DataFrame:
    """Offers that no gate can tell apart: first offer, first rooted offer, any free one."""
    return (
        rows.groupBy(*GROUP)
        .agg(
            F.min("offer_ord").alias("first"),
            F.min_by(F.struct("label", "rooted"), "offer_ord").alias("first_of"),
            F.min(F.when(F.col("rooted"), F.col("offer_ord"))).alias("first_rooted"),
            F.min_by("label", F.when(F.col("rooted"), F.col("offer_ord"))).alias("rooted_label"),
            F.bool_or(~F.col("rooted")).alias("is_open"),
        )
    )


def matching_groups(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ordered pairs of name groups passing all gates: shop, zero flag, variant, similarity."""
    same = groups.filter("words <> ''").select("block", F.col("words").alias("words_a"), F.col("words").alias("words_b")).distinct()
    both = (
        pairs.select("block", "words_a", "words_b")
        .unionByName(pairs.select("block", F.col("words_b").alias("words_a"), F.col("words_a").alias("words_b")))
        .unionByName(same)
    )

    def side(tag: str) -> DataFrame:
        return groups.select("block", *[F.col(c).alias(f"{c}_{tag}") for c in groups.columns if c != "block"])

    unknown = fixed.UNKNOWN_VARIANT
    compatible = (
        (F.col("variant_slug_a") == F.col("variant_slug_b"))
        | (F.col("variant_slug_a") == unknown)
        | (F.col("variant_slug_b") == unknown)
    )
    return (
        both.join(side("a"), ["block", "words_a"])
        .join(side("b"), ["block", "words_b"])
        .filter("platform_a <> platform_b AND is_zero_a = is_zero_b AND (is_open_a OR is_open_b)")
        .filter(compatible)
    )


def fuzzy_edges(labelled: DataFrame) -> DataFrame:
    """The edges between labels that can matter, in the order of the greedy join.

    Within a pair of matching groups all offers match all others, so a spanning forest
    needs only: first offer to first offer per pair of groups, and for every other free
    offer (and the first rooted one) its smallest edge, to the first offer among all
    matching groups. Linear in the offers, never pairs of rows.
    """
    rows = cut_lineage(labelled.select(
        block_key().alias("block"),
        word_set(F.col("nombre_norm")).alias("words"),
        "platform",
        "is_zero",
        "variant_slug",
        "label",
        "rooted",
        "offer_ord",
    ))
    groups = cut_lineage(name_groups(rows))
    names = groups.groupBy("block", "words").agg(F.bool_or("is_open").alias("is_open"))
    starts = groups.groupBy("block").agg(F.min("first").alias("block_start"))
    matches = cut_lineage(matching_groups(groups, similar_names(names)).join(starts, "block"))

    firsts = matches.filter("first_a < first_b").select(
        "block_start",
        F.col("first_a").alias("x"),
        F.col("first_of_a.label").alias("x_label"),
        F.col("first_of_a.rooted").alias("x_rooted"),
        F.col("first_b").alias("y"),
        F.col("first_of_b.label").alias("y_label"),
        F.col("first_of_b.rooted").alias("y_rooted"),
    )
    best = (
        matches.groupBy(
            "block", "block_start", "first_rooted_a", "rooted_label_a", *[f"{c}_a" for c in GROUP[1:]]
        )
        .agg(F.min(F.struct("first_b", "first_of_b")).alias("m"))
        .select(
            "block",
            "block_start",
            "first_rooted_a",
            "rooted_label_a",
            *[F.col(f"{c}_a").alias(c) for c in GROUP[1:]],
            F.col("m.first_b").alias("y"),
            F.col("m.first_of_b.label").alias("y_label"),
            F.col("m.first_of_b.rooted").alias("y_rooted"),
        )
    )
    free = (
        rows.filter(~F.col("rooted"))
        .groupBy(*GROUP, "label")
        .agg(F.min("offer_ord").alias("x"))
        .join(best, GROUP)
        .select(
            "block_start", "x", F.col("label").alias("x_label"), F.lit(False).alias("x_rooted"), "y", "y_label", "y_rooted"
        )
    )
    anchors = best.filter("first_rooted_a IS NOT NULL").select(
        "block_start",
        F.col("first_rooted_a").alias("x"),
        F.col("rooted_label_a").alias("x_label"),
        F.lit(True).alias("x_rooted"),
        "y",
        "y_label",
        "y_rooted",
    )
    return (
        firsts.unionByName(free)
        .unionByName(anchors)
        .filter("x_label <> y_label AND NOT (x_rooted AND y_rooted)")
        .select(
            F.when(F.col("x_rooted"), F.col("y_label")).otherwise(F.col("x_label")).alias("a"),
            F.when(F.col("x_rooted"), F.col("x_label")).otherwise(F.col("y_label")).alias("b"),
            (F.col("x_rooted") | F.col("y_rooted")).alias("b_rooted"),
            F.struct(
                "block_start", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")
            ).alias("rank"),
        )
    )


def label_fuzzy(labelled: DataFrame) -> DataFrame:
    """Replace the label of free offers by that of the component they join; rooted offers keep theirs and stay where they are."""
    joined = join_free_labels(fuzzy_edges(labelled)).hint("shuffle_hash")
    free = labelled.filter(~F.col("rooted")).join(joined, "label", "left")
    moved = free.withColumn("label", F.coalesce("component", "label")).drop("component", "rooted")
    return labelled.filter("rooted").drop("rooted").unionByName(moved)


def dense_rank_at_scale(df: DataFrame, order: str, rank: str, span: int = POSITIONS_PER_BUCKET) -> DataFrame:
    """Zero-based dense rank over a whole number that is unique per row.

    Numbers are cut into ranges of ``span``; each range is ranked in its own task and shifted
    by the count of all earlier ranges, so no task sees everything.
    """
    bucket = F.floor(F.col(order) / F.lit(span)).cast("long")
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    running = F.expr("sum(_n) OVER (ORDER BY _bucket) - _n")
    shifts = sizes.withColumn("_shift", running).drop("_n")
    place = F.expr(f"row_number() OVER (PARTITION BY _bucket ORDER BY {order}) - 1")
    return (
        rows.withColumn("_place", place)
        .join(shifts, "_bucket")
        .withColumn(rank, (F.col("_place") + F.col("_shift")).cast("long"))
        .drop("_bucket", "_place", "_shift")
    )


def platform_priority(platform: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(0))
    for name, priority in fixed.PLATFORM_PRIORITY.items():
        chain = chain.when(platform == name, F.lit(priority))
    return chain.otherwise(F.lit(fixed.OTHER_PLATFORM_PRIORITY))


def representative_order() -> Column:
    return F.struct(
        F.when(F.col("gtin_norm") != "", 0).otherwise(1).alias("no_code"),
        platform_priority(F.col("platform")).alias("priority"),
        F.length("nombre").alias("name_length"),
        F.col("offer_ord").alias("ord"),
    )


def representatives(labelled: DataFrame) -> DataFrame:
    """Per product the offer with a code, a preferred shop, the shortest name, the first."""
    fields = ["brand_slug", "brand_display", "volume_ml_canon", "pack_qty", "nombre", "platform", "offer_ord"]
    return labelled.groupBy("label").agg(
        F.min_by(F.struct(*fields), representative_order()).alias("rep")
    )


def majorities(labelled: DataFrame) -> DataFrame:
    """Most frequent variant, container, zero flag and sub brand; the smallest on a tie."""
    known = F.when(F.col("variant_slug") != fixed.UNKNOWN_VARIANT, F.col("variant_slug"))
    votes = {
        "variant_slug": F.nullif(known, F.lit("")),
        "container": F.nullif("container", F.lit("")),
        "is_zero": F.col("is_zero"),
        "sub_brand": F.nullif("sub_brand", F.lit("")),
    }
    return labelled.groupBy("label").agg(
        *[F.mode(vote, True).alias(name) for name, vote in votes.items()]
    ).select(
        "label",
        F.coalesce("variant_slug", F.lit(fixed.UNKNOWN_VARIANT)).alias("variant_slug"),
        "container",
        F.coalesce("is_zero", F.lit(False)).alias("is_zero"),
        F.coalesce("sub_brand", F.lit("")).alias("sub_brand"),
    )


def link_methods(labelled: DataFrame) -> DataFrame:
    """How offers of different shops were joined, the shops counted, and what needs review."""
    shops = (
        labelled.groupBy("label", "platform", "gtin_norm", "structural_key")
        .agg(F.lit(1).alias("_one"))
        .drop("_one")
    )

    def shared(column: str) -> DataFrame:
        return (
            shops.filter(F.col(column).isNotNull() & (F.col(column) != ""))
            .groupBy("label", column)
            .agg((F.min("platform") != F.max("platform")).alias("many"))
            .groupBy("label")
            .agg(F.bool_or("many").alias(f"by_{column}"))
        )

    counted = shops.groupBy("label").agg(F.count_distinct("platform").alias("n_platforms"))
    method = (
        F.when(F.col("n_platforms") < 2, "single")
        .when(F.col("by_gtin_norm"), "gtin")
        .when(F.col("by_structural_key"), "structural")
        .otherwise("fuzzy")
    )
    return (
        counted.join(shared("gtin_norm"), "label", "left")
        .join(shared("structural_key"), "label", "left")
        .select("label", "n_platforms", method.alias("match_method"))
        .withColumn("review_needed", F.col("match_method") == "fuzzy")
    )


def build_canonicals(labelled: DataFrame) -> DataFrame:
    """One row per product, with label (for joining back) and canonical_id."""
    heads = labelled.groupBy("label").agg(
        F.min("offer_ord").alias("first_ord"), F.coalesce(F.max(F.nullif("gtin_norm", F.lit(""))), F.lit("")).alias("gtin")
    ).filter("label IS NOT NULL")
    heads = dense_rank_at_scale(cut_lineage(heads), "first_ord", "canonical_id", OFFERS_PER_BUCKET)
    votes, reps, methods = majorities(labelled), representatives(labelled), link_methods(labelled)
    return (
        heads.join(votes, "label")
        .join(reps, "label")
        .join(methods, "label")
        .select(
            "label",
            "canonical_id",
            canonical_key(
                F.col("rep.brand_slug"),
                F.col("sub_brand"),
                F.col("variant_slug"),
                F.col("rep.volume_ml_canon"),
                F.col("container"),
                F.col("rep.pack_qty"),
                F.col("is_zero"),
            ).alias("canonical_key"),
            "rep.brand_slug",
            "rep.brand_display",
            "sub_brand",
            "variant_slug",
            F.col("rep.volume_ml_canon").alias("volume_ml"),
            "container",
            "rep.pack_qty",
            "gtin",
            display_name(
                F.col("rep.brand_display"),
                F.col("sub_brand"),
                F.col("variant_slug"),
                F.col("rep.volume_ml_canon"),
                F.col("container"),
                F.col("rep.pack_qty"),
            ).alias("display_name"),
            "n_platforms",
            "match_method",
            "review_needed",
        )
    )


def assign_canonicals(offers: DataFrame, fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """Whole resolver: offers with canonical_id and canonical_key, and the products.

    ``offers`` are gone through several times: they should come from files. The joins hash their small side, so that the
    offers, which are wide, are never sorted.
    """
    exact = label_exact(offers)
    labelled = cut_lineage(label_fuzzy(exact) if fuzzy else exact.drop("rooted"))
    canonicals = cut_lineage(build_canonicals(labelled))
    ids = canonicals.select("label", "canonical_id", "canonical_key").hint("shuffle_hash")
    return labelled.join(ids, "label").drop("label"), canonicals.drop("label")
