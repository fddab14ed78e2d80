"""Quality classifier: Bradley-Terry ranking of texts.

Every labelled good text is preferred to every labelled bad one. The model gives a text the
score w.x of its features and the preference the probability sigmoid(w.(x_good - x_bad)); w
minimises the logistic loss over a bounded set of such pairs. A quantile of the scores of all
labelled rows is the threshold between accepted and rejected texts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import id_remainder, keyed, label_scores, labelled_sample, map_batches, one_label, one_per_id, sums_by_score, texts_of
from shelfscope.session import cut_lineage

FIT_ROWS = 20_000  # labelled rows that pairs are drawn from, at most
FIT_PAIRS = 40_000  # preference pairs, at most
ACCEPTED = 0.7  # score that the threshold is moved to
HELD_OUT_OF, HELD_OUT = 4, 2  # ids with this checksum remainder teach nothing
SYMBOL_BYTES = np.frombuffer(b"#*$%&|<>~^_={}[]@\\+", np.uint8)


def text_features(text: str) -> list[float]:
    """Shares and means over the whole text; an empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    have = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    long = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    upper, lower = have[65:91].sum(), have[97:123].sum()
    return [
        np.log1p(len(words)),
        long.sum() / n / 10,
        float((long <= 3).sum()) / n,
        float((long >= 12).sum()) / n,
        upper / max(upper + lower, 1),
        have[SYMBOL_BYTES].sum() / n,
        have[48:58].sum() / size,
        have[33] / n,
        have[46] / n,
        have[44] / n,
        have[124] / n,
        have[10] / n,
        len(set(words)) / n,
        len(set(zip(words, words[1:]))) / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1),
    ]


N_FEATURES = len(text_features(""))


@dataclass
class Ranking:
    """Weights of standardised features and their squares; the threshold on w.x; the scale of scores."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _expand(x, self.mean, self.spread) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, at least ACCEPTED for accepted texts."""
        return self.scores_of_raw(self.raw(x))

    def scores_of_raw(self, raw: np.ndarray) -> np.ndarray:
        if not self.weights.any():  # nothing to prefer
            return np.full(len(raw), ACCEPTED)
        z = np.clip((raw - self.threshold) / self.scale, -30, 30) + np.log(ACCEPTED / (1 - ACCEPTED))
        found = 1 / (1 + np.exp(-z))
        return np.where(z >= np.log(ACCEPTED / (1 - ACCEPTED)), np.maximum(found, ACCEPTED), np.minimum(found, np.nextafter(ACCEPTED, 0)))


def _expand(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / spread, -6, 6)
    return np.hstack([z, z * z])


def fit_ranking(x: np.ndarray, label: np.ndarray, pairs: int = FIT_PAIRS, ridge: float = 1.0, seed: int = 5) -> Ranking:
    """Newton steps on the pairwise logistic loss; without both labels all weights are zero."""
    order = np.lexsort((label, *x.T))  # the pairs drawn don't hang on the order of the rows
    x, label = x[order], label[order]
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    mean = x.mean(axis=0) if len(x) else np.zeros(N_FEATURES)
    spread = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(N_FEATURES)
    if not len(good) or not len(bad):
        return Ranking(mean, spread, np.zeros(2 * N_FEATURES), 0.0, 1.0)
    rng = np.random.default_rng(seed)
    z = _expand(x, mean, spread)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), d.T @ (1 - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    return Ranking(mean, spread, w, _threshold(raw, label), max(float(raw.std()) / 4, 1e-6))


def _threshold(raw: np.ndarray, label: np.ndarray) -> float:
    """The score at the quantile that splits the labelled rows with the fewest errors, halfway to the next lower score."""
    order = np.argsort(raw, kind="stable")
    lost = np.concatenate([[0], np.cumsum(label[order] == 1)])  # good rows among the q lowest
    let = (label == 0).sum() - np.concatenate([[0], np.cumsum(label[order] == 0)])
    q = int(np.argmin(lost + let))
    ranked = raw[order]
    return float(ranked[0] - 1 if q == 0 else ranked[-1] + 1 if q == len(ranked) else (ranked[q - 1] + ranked[q]) / 2)


def learn_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Ranking:
    """Ranking learnt from at most ``fit_rows`` of the labelled documents; ``labels`` has doc_id and label.

    Its threshold is that of the sample.
    """

    def features(batch):
        return {c: batch.column(c) for c in ("doc_id", "text_hash", "label")} | {"x": [text_features(t) for t in texts_of(batch)]}

    sample = one_per_id(map_batches(labelled_sample(docs, labels, fit_rows), features, "doc_id long, text_hash long, x array<double>, label int"))
    return fit_ranking(np.array([r.x for r in sample]).reshape(-1, N_FEATURES), np.array([r.label for r in sample], dtype=int))


def rank_documents(docs: DataFrame, model: Ranking) -> DataFrame:
    """Per row: doc_id, text_hash, raw (the score w.x of its whole text), as a written table."""

    def rank(batch):
        return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "raw": model.raw(_features(batch))}

    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return cut_lineage(map_batches(rows, rank, "doc_id long, text_hash long, raw double"))


def with_threshold(model: Ranking, ranked: DataFrame, labels: DataFrame) -> Ranking:
    """The model with the threshold that splits all labelled ones of the ranked rows with the fewest errors, halfway to the next lower score.

    Rows of equal scores stay together; of equally good splits it is the lowest.
    """
    sums = sums_by_score(label_scores(ranked, labels), "raw")
    # the split that rejects all up to a score loses the good ones and lets the bad ones above it pass
    best = sums.agg(F.max("score").alias("top"), F.min("score").alias("bottom"), F.min_by("score", F.struct(F.col("good") - F.col("bad"), "score")).alias("score"), F.min(F.col("good") - F.col("bad")).alias("errors")).first()
    if best.top is None:
        return model
    if best.errors >= 0:  # to reject none is as good
        return replace(model, threshold=best.bottom - 1)
    above = sums.filter(F.col("score") > best.score).agg(F.min("score")).first()[0]
    return replace(model, threshold=best.top + 1 if above is None else (best.score + above) / 2)


def known_quality(labels: DataFrame, held_out_of: int = HELD_OUT_OF, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id and label of the rows that may teach: those whose id's checksum isn't in the held-out class."""
    return one_label(labels, "quality").filter(id_remainder(F.col("doc_id"), held_out_of) != held_out)


def _features(batch) -> np.ndarray:
    return np.array([text_features(t) for t in texts_of(batch)]).reshape(-1, N_FEATURES)


def classify_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, held_out_of: int = HELD_OUT_OF, held_out: int = HELD_OUT) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Rows whose id's checksum falls into the held-out class teach nothing, nor do rows without an id.
    Repeated ids are scored row by row; label rows with nulls are ignored, conflicting ones count as 0.
    Null texts are empty. Without labels of both kinds every score is ACCEPTED. Further columns are ignored.
    """
    known = known_quality(labels, held_out_of, held_out)
    model = learn_quality(docs, known, fit_rows)
    ranked = rank_documents(docs, model)
    model = with_threshold(model, ranked, known)

    def score(batch):
        found = model.scores_of_raw(batch.column("raw").to_numpy(zero_copy_only=False))
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": found, "predicted": (found >= ACCEPTED).astype(np.int32)}

    aside = F.coalesce(id_remainder(F.col("doc_id"), held_out_of) == held_out, F.lit(False))
    return map_batches(ranked.select("doc_id", "raw", aside.alias("held_out")), score, "doc_id long, held_out boolean, score double, predicted int")


def accepted_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that reach the threshold; they are neither joined nor shuffled, but ranked twice."""
    known = known_quality(labels)
    model = learn_quality(docs, known, fit_rows)
    model = with_threshold(model, rank_documents(docs, model), known)

    def keep(batch):
        kept = batch.filter(pa.array(model.scores(_features(batch)) >= ACCEPTED))
        return {name: kept.column(name) for name in kept.schema.names}

    return map_batches(docs, keep, docs.schema)
