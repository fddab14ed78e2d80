"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a seeded random order, are a stream that is cut into blocks of equal
size. Block j of a source of weight w is released at slot floor(j / w) and due at slot
ceil((j + 1) / w); each slot takes the released block that is due first. As the weights add up
to one, no block is late, and at any time a source is less than one block away from its share.
Weights are exact fractions, so no rounding adds up however many blocks there are. When a source
has no blocks left, the others start anew with their weights scaled up. Sources of weight zero
follow all others.

Weights over a common denominator make the order repeat after so many slots. So the driver schedules one period
between two ends of sources, and executors place any block from it by arithmetic: neither work nor what is sent to them
grows with the blocks.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import join_by_key, keyed, map_partition, packed, running_position, unpacked
from shelfscope.session import cut_lineage

BLOCK_CHARS = 50_000
PERIOD = 1_000  # slots that a source's part is told of
MOST_SOURCES = 256  # the schedule is sent to all executors
NO_SOURCE = ""
DENOMINATOR = 10_000  # default weights are whole parts of this
LONGEST_PERIOD = 1_000_000  # slots; weights without a common denominator up to here are scheduled block by block


def whole_parts(weights: dict[str, float], period: int = PERIOD) -> dict[str, Fraction]:
    """Weights as exact parts of a period; the parts add up to the whole period."""
    if not all(map(math.isfinite, weights.values())) or min(weights.values()) < 0 or not any(weights.values()):
        raise ValueError("weights must be finite, not negative and not all zero")
    exact = {s: Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    return {s: w * period / total for s, w in exact.items()}


def dealt(blocks: dict[str, int], weights: dict[str, float | Fraction]) -> Iterator[tuple[str, int]]:
    """Source and block of each slot: of the released blocks the one that is due first, ties by name.

    Slots are told from the last one in which a source ended. A source that had no slot since then waits in the
    order of weights, which is that of first due times, so that a source's end costs nothing for those.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    if not left:
        return
    parts = whole_parts({s: weights[s] for s in left})
    scale = math.lcm(*(x.denominator for x in parts.values()))
    whole = {s: int(x * scale) for s, x in parts.items()}
    last = {s: n for s, n in left.items() if not whole[s]}
    order = sorted(left.keys() - last.keys(), key=lambda s: (-whole[s], s))
    place = {s: i for i, s in enumerate(order)}
    after = list(range(len(order) + 1))  # the first place from here on whose source has blocks left, by way of others
    done, total = dict.fromkeys(order, 0), sum(whole.values())

    def living(i: int) -> int:
        while after[i] != i:
            after[i] = after[after[i]]
            i = after[i]
        return i

    while total:
        waiting: list[tuple[int, str, int]] = []  # release, source, block since the start
        ready: list[tuple[int, str, int]] = []  # due, source, block since the start
        fresh, t, ended = living(0), 0, False
        while not ended:
            while waiting and waiting[0][0] <= t:
                _, s, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(j + 1) * total // whole[s]), s, j))
            while fresh < len(order) and (not ready or -(-total // whole[order[fresh]]) <= ready[0][0]):
                s = order[fresh]
                heapq.heappush(ready, (-(-total // whole[s]), s, 0))
                fresh = living(fresh + 1)
            _, s, j = heapq.heappop(ready)  # there is one, as the weights fill the slots
            yield s, done[s]
            done[s], left[s], t = done[s] + 1, left[s] - 1, t + 1
            ended = not left[s]
            heapq.heappush(waiting, ((j + 1) * total // whole[s], s, j + 1))
        after[place[s]] += 1
        total -= whole[s]
    yield from dealt(last, dict.fromkeys(last, 1))


def edf_period(parts: dict[str, Fraction]) -> dict[str, list[int]]:
    """Slots of each source's blocks within one period, in which no source ends."""
    period = int(sum(parts.values()))
    slots: dict[str, list[int]] = {s: [] for s in parts}
    for t, (s, _) in enumerate(islice(dealt(dict.fromkeys(parts, period + 1), parts), period)):
        slots[s].append(t)
    return slots


@dataclass
class Schedule:
    """The slots of each source's blocks, in order."""

    taken: dict[str, np.ndarray]

    def slots(self, source: str, blocks: np.ndarray) -> np.ndarray:
        """Slots of a source's blocks, given by number."""
        return self.taken[source][blocks]


def make_schedule(blocks: dict[str, int], weights: dict[str, float]) -> Schedule:
    """Slots for all blocks of all sources."""
    taken = {s: np.zeros(n, np.int64) for s, n in blocks.items()}
    for t, (s, j) in enumerate(dealt(blocks, weights)):
        taken[s][j] = t
    return Schedule(taken)


@dataclass
class Phase:
    """Slots between two ends of sources: from ``start``, repeating after ``period`` slots."""

    start: int
    period: int
    first: dict[str, int]  # each source's first block here
    taken: dict[str, np.ndarray]  # each source's slots in a period, or in the whole phase if that is shorter


@dataclass
class PeriodicSchedule:
    """The same as a ``Schedule``, from one period per phase."""

    phases: list[Phase]

    def slots(self, source: str, blocks: np.ndarray) -> np.ndarray:
        """Slots of a source's blocks, given by number."""
        mine = [p for p in self.phases if len(p.taken.get(source, ()))]
        which = np.searchsorted([p.first[source] for p in mine], blocks, side="right") - 1
        found = np.zeros(len(blocks), np.int64)
        for i in np.unique(which):
            phase, here = mine[i], which == i
            taken = phase.taken[source]
            k = blocks[here] - phase.first[source]
            found[here] = phase.start + k // len(taken) * phase.period + taken[k % len(taken)]
        return found


def common_parts(weights: dict[str, float | Fraction]) -> dict[str, int] | None:
    """Weights as whole parts of their sum: of the fractions that they stand for, None if those have no short period.

    A float stands for the fraction of a denominator up to LONGEST_PERIOD that it is the closest float of.
    """
    exact = {s: Fraction(w).limit_denominator(LONGEST_PERIOD) for s, w in weights.items()}
    if any(float(f) != float(weights[s]) for s, f in exact.items()):
        return None
    scale = math.lcm(*(f.denominator for f in exact.values()))
    whole = {s: int(f * scale) for s, f in exact.items()}
    shared = math.gcd(*whole.values())
    return None if sum(whole.values()) > LONGEST_PERIOD * shared else {s: w // shared for s, w in whole.items()}


def make_periodic_schedule(blocks: dict[str, int], parts: dict[str, int]) -> PeriodicSchedule:
    """Slots for all blocks, given whole parts; at most a period is gone through per phase, of which there are as many as sources."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done, start, phases = dict.fromkeys(left, 0), 0, []
    while left:
        weighty = {s: parts[s] for s in left if parts[s]} or dict.fromkeys(left, 1)  # those of weight zero come last, alike
        shared = math.gcd(*weighty.values())
        size = {s: w // shared for s, w in weighty.items()}
        period, taken, length = sum(size.values()), {s: [] for s in weighty}, None
        for t, (s, _) in enumerate(islice(dealt(dict.fromkeys(size, period + 1), size), period)):
            taken[s].append(t)
            if len(taken[s]) == left[s]:
                length = t + 1
                break
        if length is None:  # all go on after the first period: the first end is where a last block's slot is earliest
            length = 1 + min((left[s] - 1) // size[s] * period + taken[s][(left[s] - 1) % size[s]] for s in size)
        phases.append(Phase(start, period, {s: done[s] for s in size}, {s: np.array(x, np.int64) for s, x in taken.items()}))
        for s in size:
            n = length // period * size[s] + bisect_left(taken[s], length % period)
            done[s], left[s] = done[s] + n, left[s] - n
        left, start = {s: n for s, n in left.items() if n}, start + length
    return PeriodicSchedule(phases)


def schedule_of(blocks: dict[str, int], weights: dict[str, float | Fraction]) -> Schedule | PeriodicSchedule:
    """Slots for all blocks of all sources, by exactly these weights."""
    if not blocks:
        return PeriodicSchedule([])
    whole_parts({s: weights[s] for s in blocks})  # raises what is no weight
    parts = common_parts({s: weights[s] for s in blocks})
    return make_schedule(blocks, weights) if parts is None else make_periodic_schedule(blocks, parts)


def tempered_weights(sizes: dict[str, int], power: float = 0.5) -> dict[str, Fraction]:
    """Weights that grow slower than the sources: size to the given power, in whole parts of DENOMINATOR, one at least."""
    grown = {s: float(n) ** power for s, n in sizes.items()}
    total = math.fsum(grown.values())
    return {s: Fraction(max(round(x / total * DENOMINATOR), 1), DENOMINATOR) for s, x in grown.items()}


def mix_sources(docs: DataFrame, weights: dict[str, float | Fraction] | None = None, block_chars: int = BLOCK_CHARS, seed: int = 1) -> DataFrame:
    """Per document: doc_id, text_hash, source, block, slot, start (characters of its source before it).

    A document belongs to the block in which it starts, and counts one character at least. Every document
    gets a place: nothing is repeated or left out. A null source is the source ''. Sources missing in
    ``weights`` are an error, as are more than MOST_SOURCES; without weights they are the roots of the sizes, in parts of 10,000.
    Rows of equal id and text follow one another. An empty table gives no rows.
    """
    spark = docs.sparkSession
    size = F.greatest(F.char_length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("long")
    rows = keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text_hash", F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source"), size.alias("size"))
    rows = rows.withColumn("turn", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
    placed = cut_lineage(running_position(rows, ["turn", "doc_id", "text_hash"], weight="size", within="source"))
    totals = {r.source: r.n for r in placed.groupBy("source").agg(F.max(F.col("position") + F.col("size")).alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    starts = {r.source: r.n for r in placed.groupBy("source").agg(F.max("position").alias("n")).collect()}
    targets = tempered_weights(totals) if weights is None else weights
    if missing := sorted(totals.keys() - targets.keys()):
        raise ValueError(f"no weight for {missing}")
    schedule = schedule_of({s: n // block_chars + 1 for s, n in starts.items()}, targets)
    shared = spark.sparkContext.broadcast(schedule)  # a period per phase; eight bytes per block where there is no short period

    def place(batches):
        for batch in batches:
            names = np.array(batch.column("source").to_pylist(), dtype=object)
            start = batch.column("position").to_numpy()
            block = start // block_chars
            slot = np.zeros(len(names), np.int64)
            for s in set(names):
                slot[names == s] = shared.value.slots(s, block[names == s])
            yield {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "source": batch.column("source"), "block": block, "slot": slot, "start": start}

    return map_partition(placed, place, "doc_id long, text_hash long, source string, block long, slot long, start long")


def mixed_documents(docs: DataFrame, weights: dict[str, float | Fraction] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, in mixed order: ranges of slots, sorted within."""
    found = mix_sources(docs, weights, block_chars).select("doc_id", "text_hash", "slot", F.col("start").alias("_start")).withColumnRenamed("slot", "_slot")
    first = found.groupBy("doc_id", "text_hash").agg(F.min(F.struct("_slot", "_start")).alias("at")).select("doc_id", "text_hash", "at._slot", "at._start")
    placed = join_by_key(packed(docs), cut_lineage(first), "left")
    order = ["_slot", "_start"]
    return unpacked(placed.repartitionByRange(*order).sortWithinPartitions(*order))
