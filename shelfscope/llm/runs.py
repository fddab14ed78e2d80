"""Periodic runs of words: online square catching over dyadic blocks.

Words come one after another. Every completed block of 2^k words is watched by a catcher: if the same words come
again, a period's distance later, what precedes and what follows both copies is compared. That gives the longest stretch of the
period around them, which is followed further as words are appended. The block of a period is so short that each run holds a whole
block and its copy, and so long that texts without runs hardly wake a catcher.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import map_batches, texts_of

EXPONENT, SHORTEST = 4, 6  # a run is at least so many periods, and so many words
PIECE = 1 << 17  # words appended at once

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


def agreement(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal entries at the start of both; read in pieces of growing size."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = a[at : min(at + step, n)] != b[at : min(at + step, n)]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = at + step, step * 4
    return n


@dataclass
class Stretch:
    """Words start..end-1 repeat with this period."""

    period: int
    start: int
    end: int


class Level:
    """Catchers over blocks of ``size`` words, for the periods from ``least`` to ``most``."""

    def __init__(self, size: int, exponent: int):
        self.size = size
        # an interval of (exponent - 1) * period words, where copies may start, holds a whole block
        self.least, self.most = -(-(2 * size - 1) // (exponent - 1)), -(-(4 * size - 1) // (exponent - 1)) - 1
        self.blocks = np.zeros(0, np.uint64)  # hash of each completed block
        self.recent = np.zeros(0, np.uint64)  # hashes of the last windows of this size: the next level needs them


class SquareCatcher:
    """All runs of at least ``exponent`` periods and ``shortest`` words in a sequence that grows by ``append``.

    ``longest`` bounds the periods, if it is known that there are no longer ones.
    """

    def __init__(self, exponent: int = EXPONENT, shortest: int = SHORTEST, longest: int | None = None):
        if exponent < 2:
            raise ValueError("a run has two periods at least")
        self.exponent, self.shortest, self.longest = exponent, shortest, longest
        self.words, self.n = np.zeros(1024, np.int64), 0
        self.levels: list[Level] = []
        self.open: list[Stretch] = []  # reach the last word
        self.closed: dict[tuple[int, int], int] = {}  # (start, end) of finished runs to their period

    def append(self, new: np.ndarray) -> None:
        """Take further words (numbers; equal words have equal ones)."""
        if not len(new):
            return
        old, self.n = self.n, self.n + len(new)
        if self.n > len(self.words):
            grown = np.zeros(max(self.n, 2 * len(self.words)), np.int64)
            grown[:old] = self.words[:old]
            self.words = grown
        self.words[old : self.n] = new
        for s in self.open:
            s.end += agreement(self.words[old : self.n], self.words[old - s.period : self.n - s.period])
        known = self.open  # stretches that may cover a new window: those open until now, and new ones
        hashes = new.astype(np.uint64) * _A
        hashes ^= hashes >> _C
        size, k = 1, 0
        while True:
            if k == len(self.levels):
                self.levels.append(Level(size, self.exponent))
            level = self.levels[k]
            if self.longest is not None and level.least > self.longest:
                self.levels.pop()
                break
            first = self.n - size + 1 - len(hashes)  # start of the first new window of this size
            self._catch(level, hashes, first, known)
            # windows of twice the size: of two neighbouring ones
            windows = np.concatenate([level.recent, hashes])
            level.recent = windows[-size:]
            if len(windows) <= size:
                break
            hashes = windows[:-size] * _B + windows[size:]
            hashes ^= hashes >> _C
            hashes *= _A
            size, k = 2 * size, k + 1
        self.open = [s for s in known if s.end == self.n]
        for s in known:
            if s.end < self.n:
                self._keep(self.closed, s)

    def _catch(self, level: Level, hashes: np.ndarray, first: int, known: list[Stretch]) -> None:
        size = level.size
        level.blocks = np.concatenate([level.blocks, hashes[-first % size :: size]])
        if level.least > level.most or first + len(hashes) <= level.least:
            return
        starts = np.arange(max(first, level.least), first + len(hashes))
        nearest = (starts - level.least) // size
        hits = []
        for back in range(-(-(level.most - level.least + 1) // size)):
            block = nearest - back
            period = starts - block * size
            same = (block >= 0) & (period <= level.most)
            same[same] = level.blocks[block[same]] == hashes[starts[same] - first]
            hits.append((starts[same], period[same]))
        start, period = (np.concatenate(x) for x in zip(*hits))
        if not len(start):
            return
        order = np.lexsort((period, start))
        start, period = start[order], period[order]
        waiting = np.ones(len(start), bool)
        for s in known:
            self._cover(s, size, start, period, waiting)
        at = 0
        while True:
            left = np.flatnonzero(waiting[at:])
            if not len(left):
                return
            at += int(left[0])
            waiting[at] = False
            found = self._around(int(start[at]), int(period[at]), size)
            if found:
                known.append(found)
                self._cover(found, size, start, period, waiting)

    @staticmethod
    def _cover(s: Stretch, size: int, start: np.ndarray, period: np.ndarray, waiting: np.ndarray) -> None:
        """Hits within a known stretch tell nothing new: one of a multiple of its period is the same stretch."""
        a, b = np.searchsorted(start, [s.start + s.period, s.end - size + 1])
        if a < b:
            waiting[a:b] &= (period[a:b] % s.period != 0) | (start[a:b] - period[a:b] < s.start)

    def _around(self, start: int, period: int, size: int) -> Stretch | None:
        """The longest stretch of this period around a window at ``start`` and its copy a period before."""
        t, copy = self.words, start - period
        right = agreement(t[start : self.n], t[copy : self.n - period])
        if right < size:
            return None  # equal hashes of unequal words
        left = agreement(t[:copy][::-1], t[:start][::-1])
        return Stretch(period, copy - left, start + right)

    def _keep(self, runs: dict[tuple[int, int], int], s: Stretch) -> None:
        length = s.end - s.start
        if length >= max(self.shortest, self.exponent * s.period):
            place = (s.start, s.end)
            runs[place] = min(runs.get(place, s.period), s.period)

    def runs(self) -> list[tuple[int, int, int]]:
        """start, length, period of all runs so far, those that may still grow too, by start and period."""
        found = dict(self.closed)
        for s in self.open:
            self._keep(found, s)
        return sorted((a, b - a, p) for (a, b), p in found.items())


def runs_of_batch(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each document's words. All go through one catcher, kept apart by numbers that occur once."""
    number: dict[bytes, int] = defaultdict(lambda: len(number))
    longest = max(map(len, documents), default=0)
    catcher = SquareCatcher(longest=longest // EXPONENT)
    starts, at = [], 0
    flat = []
    for no, words in enumerate(documents):
        starts.append(at)
        flat += [np.fromiter(map(number.__getitem__, words), np.int64, len(words)), np.array([-1 - no])]
        at += len(words) + 1
    sequence = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    for first in range(0, len(sequence), PIECE):
        catcher.append(sequence[first : first + PIECE])
    found = [[] for _ in documents]
    for start, length, period in catcher.runs():
        no = int(np.searchsorted(starts, start, side="right")) - 1
        found[no].append((start - starts[no], length, period))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by one space, without those of runs after the first period."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept)]
    return b" ".join(words).decode()


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period), and the text without the runs' repeats, per row.

    Words are what the six ASCII blanks part. Null and empty texts have no words, no runs and an empty text. Repeated
    rows and null ids keep their rows; further columns are ignored; an empty table gives no rows. Texts are taken whole; a
    worker holds one batch of texts and a few numbers per word of it.
    """

    def find(batch):
        documents = [t.encode().split() for t in texts_of(batch)]  # bytes split at exactly the six blanks
        found = runs_of_batch(documents)
        return {
            "doc_id": batch.column("doc_id"),
            "n_words": [len(words) for words in documents],
            "runs": [[{"start": a, "length": n, "period": p} for a, n, p in runs] for runs in found],
            "collapsed": [collapsed(words, runs) for words, runs in zip(documents, found)],
        }

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), find, schema)


def run_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (smallest start, then period, of equal ones) and hashes of the runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    written = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return (
        found.withColumn("_longest", longest)
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            (-F.col("_longest.start")).alias("start"),
            F.col("_longest.length").alias("length"),
            (-F.col("_longest.period")).alias("period"),
            F.sha2(written, 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
        .withColumn("exponent_milli", F.floor(F.col("length") * 1000 / F.col("period")).cast("long"))
    )
