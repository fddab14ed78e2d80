"""Language identification by Bloom filters that hold languages as bit slices.

A filter position holds one bit per language. Inserting an n-gram sets its language's bit at
its hash positions; looking it up ands the masks there, which gives all languages that may
contain it in one step. A text's n-grams are counted per language, the counts are corrected
for each language's false-positive rate, and the largest corrected count decides.

A language's n-grams are those that two of its texts hold, unless another language has them far more
often: quotations and names then don't fill every language's filter as the data grow.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import id_remainder, map_partition, texts_of
from shelfscope.session import cut_lineage

ORDERS = (2, 3)  # characters in an n-gram
HASHES = 3
BITS_PER_GRAM = 12
MAX_LANGUAGES = 64  # bits of a mask
MIN_TEXTS = 2  # of a language that must hold an n-gram, whatever its size
MIN_RATE = 0.1  # least share of a language's texts that hold an n-gram, against the largest such share of any language
POSITIONS = 1 << 22  # at most, 32 MB; more n-grams than fit well make more false positives, which the counts are corrected for
FLUSH = 1 << 20  # distinct n-grams that a task counts before it hands them on
UNKNOWN = "und"


def gram_hashes(text: str) -> np.ndarray:
    """Hashes of all character n-grams of the lower-case text, repeats included."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    found = []
    for n in ORDERS:
        if len(points) >= n:
            h = points[: len(points) - n + 1] + np.uint64(n << 40)
            for k in range(1, n):
                h = h * np.uint64(0x100000001B3) + points[k : len(points) - n + 1 + k]
            found.append(_mix(h))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass
class LanguageFilter:
    """Masks by position, the languages by bit, and each language's false-positive rate."""

    languages: list[str]
    masks: np.ndarray
    wrong: np.ndarray

    @staticmethod
    def build(grams: dict[str, np.ndarray]) -> LanguageFilter:
        """Filter over the n-gram hashes of each language."""
        languages = sorted(grams)
        masks = np.zeros(filter_size(max((len(x) for x in grams.values()), default=0)), np.uint64)
        for bit, language in enumerate(languages):
            for at in _positions(grams[language], len(masks)):
                masks[at] |= np.uint64(1 << bit)  # one language at a time: a repeated position gets the same bit
        return LanguageFilter.of(languages, masks)

    @staticmethod
    def of(languages: list[str], masks: np.ndarray) -> LanguageFilter:
        full = np.array([float(((masks >> np.uint64(b)) & np.uint64(1)).mean()) for b in range(len(languages))])
        return LanguageFilter(languages, masks, full**HASHES)

    def predict(self, text: str) -> tuple[str, float]:
        """Language and its share of the corrected counts; ties go to the first language by name."""
        if not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        grams = gram_hashes(text)
        if not len(grams):  # a single character
            grams = gram_hashes(f" {text} ")
        hit = None
        for at in _positions(grams, len(self.masks)):
            hit = self.masks[at] if hit is None else hit & self.masks[at]
        count = np.array([np.count_nonzero(hit & np.uint64(1 << b)) for b in range(len(self.languages))], float)
        true = np.maximum(count - len(grams) * self.wrong, 0) / np.maximum(1 - self.wrong, 1e-9)
        best = int(np.argmax(true))
        return self.languages[best], float(true[best] / true.sum()) if true.any() else 0.0


def filter_size(most: int) -> int:
    """Positions for ``most`` n-grams in one language: a power of two."""
    return min(POSITIONS, 1 << max(10, int(np.ceil(np.log2(max(1, most * BITS_PER_GRAM))))))


def _positions(h: np.ndarray, size: int):
    step = (h >> np.uint64(40)) | np.uint64(1)
    for k in range(HASHES):
        yield ((h + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)


def learn_languages(known: DataFrame, min_texts: int = MIN_TEXTS, min_rate: float = MIN_RATE) -> LanguageFilter:
    """Filter over each language's n-grams: see ``language_grams``.

    The filter's words are put together on executors; the driver gets POSITIONS of them at most, whatever the data.
    More than MAX_LANGUAGES languages are an error.
    """
    texts = texts_by_language(known)
    languages = sorted(texts)
    grams = cut_lineage(language_grams(known, texts, min_texts, min_rate))
    size = filter_size(max((r.n for r in grams.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()), default=0))

    def set_bits(batches):
        for batch in batches:
            at = np.concatenate(list(_positions(batch.column("gram").to_numpy().view(np.uint64), size)))
            bits = np.array([1 << languages.index(x) for x in batch.column("lang").to_pylist()], np.uint64)
            yield {"at": at, "mask": np.tile(bits, HASHES).view(np.int64)}

    masks = np.zeros(size, np.uint64)
    words = map_partition(grams.select("lang", "gram"), set_bits, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks[words.column("at").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return LanguageFilter.of(languages, masks)


def texts_by_language(known: DataFrame) -> dict[str, int]:
    texts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(texts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return texts


def language_grams(known: DataFrame, texts: dict[str, int], min_texts: int = MIN_TEXTS, min_rate: float = MIN_RATE) -> DataFrame:
    """lang, gram: n-grams that ``min_texts`` texts of the language hold, and at least ``min_rate`` times the share of its
    texts that holds them in the language where that share is largest.

    ``known`` has lang and text without nulls; ``texts`` are its languages' numbers of texts. Texts per n-gram are
    counted on executors, over all rows.
    """

    def count(batches):
        held, size = {}, 0

        def flush():
            for lang, parts in held.items():
                gram, n = _summed(parts)
                yield {"lang": [lang] * len(gram), "gram": gram.view(np.int64), "n": n}

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
                own = np.unique(gram_hashes(text))
                held.setdefault(lang, []).append((own, np.ones(len(own), np.int64)))
                size += len(own)
            if size > FLUSH:
                held = {k: [_summed(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > FLUSH // 2:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    counted = map_partition(known.select("lang", "text"), count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = F.lit(None)
    for lang, n in texts.items():
        total = F.when(F.col("lang") == F.lit(lang), F.lit(n)).otherwise(total)
    each = counted.groupBy("gram").agg(F.collect_list(F.struct("lang", "n", (F.col("n") / total).alias("rate"))).alias("held"))  # as long as the languages
    usual = F.filter("held", lambda x: (x.n >= min_texts) & (x.rate >= min_rate * F.array_max("held.rate")))
    return each.select("gram", F.explode(usual).alias("x")).select("x.lang", "gram")


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return gram, np.bincount(back, np.concatenate([p[1] for p in parts]), len(gram)).astype(np.int64)


def identify_languages(docs: DataFrame, held_out_of: int = 3, held_out: int = 1) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    Learns from rows with an id, a text and a language whose id's checksum isn't in the held-out class.
    Every row is predicted from its whole text alone; null and letterless texts, and all if nothing was
    learned, are UNKNOWN with score 0. Ties go to the first language by name. Repeated rows get equal results;
    further columns are ignored.
    """
    rest = id_remainder(F.col("doc_id"), held_out_of)
    learned = learn_languages(docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (rest != held_out)))
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # at most POSITIONS words

    def predict(batches):
        model = shared.value
        for batch in batches:
            found = [model.predict(x) for x in texts_of(batch)]
            yield {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(rest == held_out, F.lit(False)).alias("held_out"))
    return map_partition(rows, predict, "doc_id long, held_out boolean, lang_pred string, score double")
