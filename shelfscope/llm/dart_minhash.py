"""Near-duplicates by DartMinHash over word shingles.

Darts are thrown at the area over each shingle: as wide as its weight, as high as the rank goes.
Number and places of the darts in a cell of that area come from hashes of the shingle and the
cell, so equal shingles get equal darts in all texts. Every dart has one of k coordinates, and
the earliest dart (lowest rank) of each coordinate is the text's signature: two texts agree in a
coordinate with the probability of their weighted Jaccard similarity. Bands of coordinates that
agree make candidates; these are verified on the shingles themselves.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import BROADCAST_ROWS, if_small, join_by_key, join_to_owner, keyed, map_batches, map_partition, packed, texts_of, unpacked
from shelfscope.session import cut_lineage

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: 36 bands of 6 coordinates: a pair of similarity 0.8 shares no band once in 60,000 times.
BANDS, ROWS = 36, 6
FIRST_CELL = 0.25  # height of the lowest cell; the next are twice as high each, up to LAST_CELL
LAST_CELL = 64.0
#: Coordinates (of 216) whose two sketch bits must agree before a pair is verified: 4.5 standard deviations below what similarity 0.8 gives.
AGREEING = 160
#: Rows of a bucket, and pairs of a centre, that one task gets together.
ROWS_TOGETHER = 512

_BASE = 0x100000001B3 | 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64, n of each at least."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, factor in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            step = np.full(size, np.uint64(factor), np.uint64)
            step[0] = 1
            _POWERS[name] = np.multiply.accumulate(step)
    return _POWERS["up"], _POWERS["down"]


def normal_words(text: str) -> bytes:
    """Small letters, one blank between words: what is compared."""
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


def shingle_hashes(normal: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all runs of ``size`` words, repeats included; a text of fewer words is one run, an empty one has none."""
    if not normal:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(normal, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    if len(starts) > size:
        starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    up, down = _powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def _cells(most: float):
    """The cells above one unit of weight from the bottom up to ``most``."""
    low, height = 0.0, FIRST_CELL
    while low < most:
        yield low, height
        low, height = low + height, min(height * 2 if low else height, LAST_CELL)


_CHANCES: dict[float, np.ndarray] = {}


def _chances(mean: float) -> np.ndarray:
    """Distribution function of the Poisson number of darts in a cell of this area."""
    if mean not in _CHANCES:
        most = int(mean + 12 * math.sqrt(mean) + 20)
        _CHANCES[mean] = np.cumsum([math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(most)])
    return _CHANCES[mean]


def signatures(elements: np.ndarray, weights: np.ndarray | None, doc: np.ndarray, docs: int, k: int) -> np.ndarray:
    """k signature values per document; documents without elements have zeros.

    ``elements`` are hashes, ``doc`` the document of each; a weight of None is one each. Ranks are searched up
    to where a document has some k ln k + 2k darts, and twice as far for those with an empty coordinate.
    """
    found = np.zeros((docs, k), np.uint64)
    if weights is None:
        cell_of, share = elements, None
    else:  # a weight is cut into units; the last may be part of one
        units = np.ceil(weights).astype(np.int64)
        at = np.repeat(np.arange(len(elements)), units)
        unit = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
        cell_of, doc, share = _mix(elements[at] + unit.astype(np.uint64) * _ODD), doc[at], np.minimum(weights[at] - unit, 1.0)
    total = np.bincount(doc, share, docs) if len(doc) else np.zeros(docs)
    most = np.where(total > 0, k * (math.log(k) + 2) / np.maximum(total, 1e-300), 0)
    open_docs = total > 0
    while open_docs.any():
        mine = open_docs[doc]
        done = _throw(cell_of[mine], share[mine] if share is not None else None, doc[mine], most, docs, k, found)
        open_docs &= ~done
        most = most * 2
    return found


def _throw(cells: np.ndarray, share: np.ndarray | None, doc: np.ndarray, most: np.ndarray, docs: int, k: int, found: np.ndarray) -> np.ndarray:
    """Fill the signatures of documents whose every coordinate has a dart of rank below ``most``; tells which."""
    ranks, names, places = [], [], []
    limit = most[doc]
    for c, (low, height) in enumerate(_cells(limit.max())):
        reach = limit > low
        base = _mix(cells[reach] ^ np.uint64((c + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        n = np.searchsorted(_chances(height), _unit(base), side="right")
        of = np.repeat(np.arange(len(base)), n)
        j = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        dart = _mix(base[of] + (j + 1).astype(np.uint64) * _ODD)
        rank = low + height * _unit(dart)
        keep = rank < limit[reach][of]
        if share is not None:
            keep &= _unit(_mix(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5))) < share[reach][of]
        dart = dart[keep]
        ranks.append(rank[keep])
        names.append(dart)
        places.append(doc[reach][of[keep]] * k + (_mix(dart + _ODD) % np.uint64(k)).astype(np.int64))
    rank, name, place = np.concatenate(ranks), np.concatenate(names), np.concatenate(places)
    first = np.full(docs * k, np.inf)
    np.minimum.at(first, place, rank)
    earliest = rank == first[place]
    value = np.zeros(docs * k, np.uint64)
    value[place[earliest]] = name[earliest]
    whole = np.isfinite(first.reshape(docs, k)).all(axis=1)
    found[whole] = value.reshape(docs, k)[whole]
    return whole


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash per document and band over the band's coordinates."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _ODD, parts.shape[:2]).copy()
    for r in range(rows):
        key = _mix(key ^ parts[:, :, r]) + _ODD
    return key


def sketch_bits(signature: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, 32 coordinates to a number."""
    two = _mix(signature) & np.uint64(3)
    pad = -two.shape[1] % 32
    two = np.hstack([two, np.zeros((len(two), pad), np.uint64)]).reshape(len(two), -1, 32)
    return np.bitwise_or.reduce(two << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=2)


def sign(docs: DataFrame, counted: bool = False, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of keyed documents: doc_id, text_hash, content (hash of its words), n_words > 0 as has_words, bands, sketch.

    Weights are one per distinct shingle, or its number of occurrences if ``counted``.
    """
    k = bands * rows

    def run(batch):
        normal = [normal_words(x) for x in texts_of(batch)]
        hashes = [shingle_hashes(x) for x in normal]
        weights = None
        if counted:
            found = [np.unique(h, return_counts=True) for h in hashes]
            hashes, weights = [f[0] for f in found], np.concatenate([f[1] for f in found]).astype(float)
        else:
            hashes = [np.unique(h) for h in hashes]
        doc = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        signature = signatures(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), weights, doc, len(hashes), k)
        return {
            "doc_id": batch.column("doc_id"),
            "text_hash": batch.column("text_hash"),
            "content": [hashlib.blake2b(x, digest_size=16).digest() for x in normal],
            "has_words": [bool(x) for x in normal],
            "bands": list(band_keys(signature, bands, rows).view(np.int64)),
            "sketch": list(sketch_bits(signature).view(np.int64)),
        }

    return map_batches(docs.select("doc_id", "text_hash", "text"), run, "doc_id long, text_hash long, content binary, has_words boolean, bands array<long>, sketch array<long>")


def elements(text: str, counted: bool = False) -> np.ndarray:
    """Distinct shingle hashes of a text; ``counted`` tells the occurrences of a shingle apart, so that sets behave as weights do."""
    hashes, n = np.unique(shingle_hashes(normal_words(text)), return_counts=True)
    if not counted or not len(hashes):
        return hashes
    which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.unique(_mix(np.repeat(hashes, n) + which.astype(np.uint64) * _ODD))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of elements."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def agreement(a: Column, b: Column, words: int) -> Column:
    """Coordinates whose two sketch bits agree; coordinates that fill up the last number always do."""
    total = F.lit(0)
    for i in range(words):
        differ = a[i].bitwiseXOR(b[i])
        either = differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(0x5555555555555555))
        total = total + (32 - F.bit_count(either))
    return total


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, counted: bool = False) -> DataFrame:
    """Per row: doc_id, text_hash, class_id, is_first.

    Rows are in one class if a chain of links joins them: equal words, or shingle similarity of ``least`` or
    more. class_id is the smallest id in the class; is_first marks the rows of the smallest (id, text), which
    stand for it. Null, empty and wordless texts are classes of their own. Rows without an id take part like
    others and come first. Further columns are ignored.

    Texts of equal words are one node from here on. A bucket (texts that share a band) isn't paired up:
    each of its texts is compared with its centre, the one that shares most buckets with others. Only texts
    that are then still in several components of one bucket are looked at in pairs, and a pair is compared
    only if it may be similar: by its sketches, and by what both texts share with the centre and besides.
    """
    docs = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    signed = cut_lineage(sign(docs, counted))
    nodes = cut_lineage(
        signed.filter("has_words").groupBy("content").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("doc_id").alias("least_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    buckets = nodes.select("content", F.explode("bands").alias("bucket"))
    shared = cut_lineage(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("_rows", F.col("n")))
    members = cut_lineage(join_to_owner(buckets, shared, "bucket"))
    ties = members.groupBy("content").agg(F.sum("n").alias("ties"))
    centre = cut_lineage(members.join(ties, "content").groupBy("bucket").agg(F.max(F.struct("ties", "content")).alias("c"), F.first("n").alias("_rows")).select("bucket", F.col("c.content").alias("a"), "_rows"))
    star = join_to_owner(members, centre, "bucket").filter("a <> content").select("a", F.col("content").alias("b")).distinct()
    sketches = nodes.select("content", "sketch")
    words = -(-BANDS * ROWS // 32)
    spare = 32 * words - BANDS * ROWS

    def alike(a: Column, b: Column) -> Column:
        return agreement(a, b, words) >= AGREEING + spare

    sketched = star.join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb"), "b")
    linked = _verified(docs, nodes, cut_lineage(sketched.filter(alike(F.col("sa"), F.col("sb"))).select("a", "b")), least, counted)
    parts = components(linked)

    labelled = cut_lineage(members.select("bucket", "content").join(parts, "content", "left").withColumn("part", F.coalesce("part", "content")))
    mixed = labelled.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("bucket")
    apart = cut_lineage(join_to_owner(labelled, cut_lineage(centre.join(mixed, "bucket")), "bucket").filter("content <> a"))
    measured = _measured(docs, nodes, cut_lineage(apart.select("a", F.col("content").alias("b")).distinct()), counted)
    open_rows = cut_lineage(apart.join(measured.withColumnRenamed("b", "content"), ["a", "content"]).join(sketches, "content").select("bucket", "content", "part", "sketch", "size", "shared", "rest"))
    left, right = (dealt.toDF("bucket", "chunk", f"{x}", f"part_{x}", f"sketch_{x}", f"size_{x}", f"shared_{x}", f"rest_{x}") for dealt, x in zip(_dealt(open_rows), "ab"))
    # two texts share at most what both share with the centre, and what they share of their rests
    at_most = F.least("shared_a", "shared_b") + F.size(F.array_intersect("rest_a", "rest_b"))
    enough = at_most * (1 + least) >= least * (F.col("size_a") + F.col("size_b")) - 1e-6
    may = (F.col("a") < F.col("b")) & (F.col("part_a") != F.col("part_b")) & alike(F.col("sketch_a"), F.col("sketch_b")) & enough
    rest = left.join(right, (left.bucket == right.bucket) & (left.chunk == right.chunk) & may).select("a", "b").distinct()
    more = _verified(docs, nodes, cut_lineage(rest), least, counted)
    parts = components(linked.unionByName(more))

    named = nodes.select("content", "first", "least_id").join(parts, "content", "left").withColumn("part", F.coalesce("part", "content"))
    named = cut_lineage(named)
    heads = cut_lineage(named.groupBy("part").agg(F.min("first").alias("head"), F.min("least_id").alias("class_id"), F.count(F.lit(1)).alias("_rows")))
    classes = cut_lineage(join_to_owner(named.select("content", "part"), heads, "part").select("content", "head", "class_id"))
    rows = signed.select("doc_id", "text_hash", "content", "has_words").join(if_small(classes), "content", "left")
    alone = ~F.col("has_words")
    own = F.struct("doc_id", "text_hash").eqNullSafe(F.col("head"))
    return rows.select("doc_id", "text_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (alone | own).alias("is_first"))


def _dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a bucket, twice, with a column ``chunk`` after it: each in one chunk of its bucket, and each in all chunks of it.

    A chunk has some ROWS_TOGETHER rows of the first kind, so that a large bucket is many tasks' work.
    """
    chunks = cut_lineage(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_rows")).withColumn("chunks", F.ceil(F.col("_rows") / ROWS_TOGETHER)))
    counted, rest = join_to_owner(rows, chunks, "bucket"), [c for c in rows.columns if c != "bucket"]
    one = F.pmod(F.xxhash64("content"), F.col("chunks"))
    return counted.select("bucket", one.alias("chunk"), *rest), counted.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), *rest)


def _with_texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of contents (a written table) with their texts: a, b, ta, tb.

    A text is sent once per some ROWS_TOGETHER pairs in which it is a, so that those of one centre are many tasks' work.
    """
    involved = pairs.select(F.col("a").alias("content")).union(pairs.select("b")).distinct()
    wanted = cut_lineage(nodes.join(involved, "content", "left_semi").select("first.doc_id", "first.text_hash", "content"))
    texts = cut_lineage(join_by_key(docs, wanted, "inner").select("content", "text").dropDuplicates(["content"]))
    chunks = cut_lineage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_rows")).withColumn("chunks", F.ceil(F.col("_rows") / ROWS_TOGETHER)))
    dealt = join_to_owner(pairs, chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    centres = texts.toDF("a", "ta").join(chunks, "a").select("a", "ta", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    return dealt.join(texts.toDF("b", "tb"), "b").join(centres, ["a", "chunk"]).select("a", "b", "ta", "tb")


def _element_pairs(batches, counted: bool):
    """Per batch the pairs and the elements of both texts; those of a are kept while a stays the same."""
    last, of_last = None, None
    for batch in batches:
        found = []
        for a, b, ta, tb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), texts_of(batch, "ta"), texts_of(batch, "tb")):
            if a != last:
                last, of_last = a, elements(ta, counted)
            found.append((a, b, of_last, elements(tb, counted)))
        yield found


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, least: float, counted: bool) -> DataFrame:
    """Those of the pairs (a, b) of contents whose texts have at least the similarity."""

    def compare(batches):
        for found in _element_pairs(batches, counted):
            good = [(a, b) for a, b, ea, eb in found if similarity(ea, eb) >= least]
            yield {"a": [x[0] for x in good], "b": [x[1] for x in good]}

    return cut_lineage(map_partition(_with_texts(docs, nodes, pairs), compare, "a binary, b binary"))


def _measured(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, counted: bool) -> DataFrame:
    """For pairs (a, b) of contents: a, b, size of b, what b shares with a, and the rest of its elements."""

    def measure(batches):
        for found in _element_pairs(batches, counted):
            rest = [np.setdiff1d(eb, ea, assume_unique=True).view(np.int64) for _, _, ea, eb in found]
            size = [len(x[3]) for x in found]
            yield {"a": [x[0] for x in found], "b": [x[1] for x in found], "size": size, "shared": [n - len(r) for n, r in zip(size, rest)], "rest": rest}

    return cut_lineage(map_partition(_with_texts(docs, nodes, pairs), measure, "a binary, b binary, size long, shared long, rest array<long>"))


def components(links: DataFrame) -> DataFrame:
    """content, part: each linked node and the smallest node it is connected with.

    Large and small stars in turn: neighbours are linked to the smallest node around until every component is
    one star. Each step is written to the shared folder; a hub's links stay where they are (``join_to_owner``).
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    before = edges.agg(*state).first()
    while True:
        small = 2 * before[0] <= BROADCAST_ROWS  # so are both tables of least neighbours

        def meet(rows: DataFrame, least: DataFrame) -> DataFrame:
            return rows.join(F.broadcast(least.drop("_rows")), "u") if small else join_to_owner(rows, cut_lineage(least), "u")

        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_rows")).select("u", F.least("u", "m").alias("m"), "_rows")
        large = cut_lineage(meet(both, low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        star = meet(large, large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_rows")))
        edges = cut_lineage(star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(star.select("u", F.col("m"))).filter("u <> v").distinct())
        now = edges.agg(*state).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("content"), F.col("v").alias("part")).union(edges.select("v", "v").distinct())


def first_of_each_class(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one of each class; of wordless texts every row stays."""
    found = near_duplicates(docs, least).filter("is_first")
    counted = cut_lineage(found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")))
    kept = join_by_key(packed(docs), counted.select("doc_id", "text_hash"), "left_semi")
    if not counted.filter("n > 1").isEmpty():  # rows repeated in id and text
        worded = F.coalesce(F.col("row.text").rlike(r"(?U)\S"), F.lit(False))
        kept = kept.filter(worded).dropDuplicates(["doc_id", "text_hash"]).unionByName(kept.filter(~worded))
    return unpacked(kept)
