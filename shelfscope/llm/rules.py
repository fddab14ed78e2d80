"""Quality rules: exact rule statistics per text, then isolation forests over all of them.

An isolation forest cuts a small sample by random splits; rows that are separated after few
splits are anomalous. One forest sees what a text is made of, another how it repeats itself: in one
forest, what hardly tells good from bad hides what does. They are fitted on a bounded sample of rows
labelled good; the verdict's thresholds are calibrated on all labelled rows of both kinds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import keyed, label_scores, labelled_sample, map_batches, one_label, one_per_id, sums_by_score, texts_of
from shelfscope.session import cut_lineage

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = [*COUNTS, "n_capitals", "n_lines"]
_COLUMNS = ", ".join(f"{c} long" for c in STATISTICS)

FIT_ROWS = 20_000  # labelled rows that the forests are grown on, at most; thresholds take all
TREES, SUBSAMPLE = 100, 256
GOOD_COST = 10.0  # of losing a share of the rows labelled good, where keeping that share of the bad ones costs 1


def rule_counts(text: str) -> tuple[int, ...]:
    """The counts of STATISTICS, in that order.

    Words are runs without the six blanks; a line with a word equal to an earlier one is a
    duplicate; a word repeats if some window of eight words over it occurs twice in the text.
    """
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six blanks
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    symbols = sum(map(text.count, SYMBOLS))
    letters = np.frombuffer(raw, np.uint8)
    capitals = int(np.count_nonzero((letters >= 65) & (letters <= 90)))  # A-Z
    return n, len(text) - sum(map(text.count, BLANKS)), symbols, len(lines) - len(set(lines)), _repeated(words), capitals, len(lines)


def _repeated(words: list[bytes]) -> int:
    n = len(words)
    if n <= WINDOW:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
    odd = 0x9E3779B97F4A7C15
    for step in (1, 2, 4):  # hash of 2, 4, then 8 words in order
        h = h[:-step] + h[step:] * np.uint64(pow(odd, step, 1 << 64))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    ends = np.zeros(n + 1, np.int64)
    starts = np.union1d(order[1:][same], order[:-1][same])
    ends[starts] += 1
    ends[starts + WINDOW] -= 1
    return int((np.cumsum(ends) > 0).sum())


def _counted(batch) -> np.ndarray:
    return np.array([rule_counts(x) for x in texts_of(batch)], np.int64).reshape(-1, len(STATISTICS))


def rule_vectors(counts: np.ndarray) -> np.ndarray:
    """What the first forest sees of rows of STATISTICS: symbols and letters per word, capitals per letter.

    Logarithms spread the rare values; the constants keep short texts from looking odd by chance.
    """
    n, chars, symbols, _, _, capitals, _ = counts.astype(float).T
    return np.column_stack([np.log((symbols + 1) / (n + 20)), np.log((chars + 100) / (n + 20)), np.log((capitals + 2) / (chars + 100))])


def repetition_vectors(counts: np.ndarray) -> np.ndarray:
    """What the second forest sees: duplicate lines per line with a word, repeated words per word, words."""
    n, _, _, dups, repeats, _, lines = counts.astype(float).T
    return np.column_stack([dups / (lines + 3), repeats / (n + 20), np.log(n + 20)])


@dataclass
class IsolationForest:
    """Trees as arrays: split feature (-1 in a leaf), split value, path length in leaves; children of i are 2i+1, 2i+2."""

    feature: np.ndarray
    value: np.ndarray
    depth: np.ndarray
    usual: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly between 0 and 1; higher is rarer. Ties of a split go right."""
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[trees, at]
            if (f < 0).all():
                return 2.0 ** (-self.depth[trees, at].mean(axis=1) / self.usual)
            right = x[rows, np.maximum(f, 0)] >= self.value[trees, at]
            at = np.where(f < 0, at, 2 * at + 1 + right)


def _expected(n: int) -> float:
    """Mean path length of a failed search among n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def fit_forest(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7) -> IsolationForest:
    rng = np.random.default_rng(seed)
    size = min(subsample, len(x))
    height = max(1, int(np.ceil(np.log2(max(size, 2)))))
    shape = (trees, 2 ** (height + 1) - 1)
    feature, value, depth = np.full(shape, -1, np.int64), np.zeros(shape), np.zeros(shape)
    for t in range(trees):
        todo = [(0, 0, x[rng.choice(len(x), size, replace=False)])]
        while todo:
            node, level, rows = todo.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            splits = np.flatnonzero(high > low)
            if level == height or len(rows) < 2 or not len(splits):
                depth[t, node] = level + _expected(len(rows))
                continue
            f = int(rng.choice(splits))
            cut = rng.uniform(low[f], high[f])
            cut = cut if cut > low[f] else high[f]
            feature[t, node], value[t, node] = f, cut
            right = rows[:, f] >= cut
            todo += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
    return IsolationForest(feature, value, depth, max(_expected(size), 1.0))


def base_failed(counts: np.ndarray) -> np.ndarray:
    """The plain rules on rows of STATISTICS: too few words, or too much of the text repeated."""
    n, repeats = counts[:, 0], counts[:, 4]
    return (n < 20) | (100 * repeats > 30 * n)


Forests = tuple[IsolationForest, IsolationForest]  # over rule_vectors, and over repetition_vectors


def fit_forests(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Forests | None:
    """Forests over the good ones of at most ``fit_rows`` labelled documents that pass the base rules; None if there are none."""

    def statistics(batch):
        found = _counted(batch)
        return {c: batch.column(c) for c in ("doc_id", "text_hash", "label")} | {c: found[:, i] for i, c in enumerate(STATISTICS)}

    sampled = one_per_id(map_batches(labelled_sample(docs, labels, fit_rows), statistics, f"doc_id long, text_hash long, label int, {_COLUMNS}"))
    sample = np.array([[r[c] for c in [*STATISTICS, "label"]] for r in sampled]).reshape(-1, len(STATISTICS) + 1)
    good = sample[~base_failed(sample) & (sample[:, -1] == 1), :-1]
    if not len(good):
        return None
    vectors = rule_vectors(good), repetition_vectors(good)
    return tuple(fit_forest(x[np.lexsort(x.T)]) for x in vectors)  # in an order that doesn't hang on the partitions


def rule_scores(docs: DataFrame, forests: Forests | None) -> DataFrame:
    """Per row: doc_id, text_hash, the statistics of the whole text, base_failed, and the forests' scores one and two (0 without forests), as a written table."""

    def score(batch):
        counts = _counted(batch)
        one, two = np.zeros(len(counts)), np.zeros(len(counts))
        if forests is not None and len(counts):
            one, two = forests[0].scores(rule_vectors(counts)), forests[1].scores(repetition_vectors(counts))
        return (
            {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "base_failed": base_failed(counts), "one": one, "two": two}
            | {c: counts[:, i] for i, c in enumerate(STATISTICS)}
        )

    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return cut_lineage(map_batches(rows, score, f"doc_id long, text_hash long, {_COLUMNS}, base_failed boolean, one double, two double"))


def score_limit(labelled: DataFrame, score: str, good_cost: float) -> float | None:
    """The good row's score that loses the least as the most a kept row may have; of equally good ones the highest. None without good rows.

    A share of the good ones lost counts ``good_cost`` times as much as the same share of the bad ones kept.
    """
    sums = sums_by_score(labelled, score)
    good, bad = sums.agg(F.max("good"), F.max("bad")).first()
    if not good:
        return None
    loss = F.lit(float(good_cost)) * (1 - F.col("good") / F.lit(float(good))) + F.col("bad") / F.lit(float(max(bad, 1)))
    of_good = sums.join(labelled.filter("label = 1").select(F.col(score).alias("score")).distinct(), "score", "left_semi")
    return of_good.agg(F.min_by("score", F.struct(loss, -F.col("score")))).first()[0]


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, good_cost: float = GOOD_COST) -> DataFrame:
    """Per document: doc_id, the statistics, base_failed, anomaly (the higher score of the forests), kept.

    The second forest's limit is that of the labelled rows which the first one keeps; its scores are moved to the
    first one's limit. Every row gets one result, repeated ids and empty or null texts too (those fail the base
    rules). Further columns of either table are ignored; label rows with nulls are too. Without rows labelled good
    that pass the base rules there are no forests: anomaly is 0 and the base rules decide alone.
    """
    known = one_label(labels, "quality")
    forests = fit_forests(docs, known, fit_rows)
    scored = rule_scores(docs, forests)
    anomaly, usual = F.lit(0.0), F.lit(True)
    if forests is not None:
        labelled = cut_lineage(label_scores(scored.select("doc_id", "text_hash", "base_failed", "one", "two"), known).filter(~F.col("base_failed")))
        first = score_limit(labelled, "one", good_cost)
        second = score_limit(labelled.filter(F.col("one") <= first), "two", good_cost)
        anomaly = F.greatest("one", F.col("two") + F.lit(first - second))
        usual = (F.col("one") <= first) & (F.col("two") <= second)
    return scored.select("doc_id", *STATISTICS, "base_failed", anomaly.alias("anomaly"), (~F.col("base_failed") & usual).alias("kept"))
