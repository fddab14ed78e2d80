"""Byte-level BPE: ids of texts by replaying the merges over the words of many texts at once, and texts from ids.

A text is cut into words by the vocabulary's pattern; a word's ids depend on nothing but the word. So the corpus is
taken in blocks of texts. The distinct words of a block that are new to the worker are laid out one after another as
bytes, with an index from every pair of neighbouring tokens that can be merged to its positions. The merges are then
applied in rank order, each at all its positions; a merge looks at nothing but the two tokens that now adjoin the new one.
Blocks need no shuffle and no common dictionary: words never influence each other, so any division gives the same ids.
"""

from __future__ import annotations

import base64
import heapq
import sys
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import map_batches, map_partition, texts_of

BLOCK_CHARS = 4 << 20  # characters of texts whose new words are replayed together; one longer text is a block of its own
KNOWN_WORDS = 1_000_000  # words a worker remembers; beyond that it keeps those of the last block
OTHER = "\ue000"  # a character that is neither letter, number nor white space
RIGHT = 1 << 24  # a pair of tokens as one number: left * RIGHT + right


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: per line the token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _newer_letters() -> dict[int, str]:
    """Code points that the regex module takes as letters or numbers, but not the Unicode version that tiktoken has."""
    import tiktoken

    newer = {}
    for kind in (r"\p{L}", r"\p{N}"):
        single = tiktoken.Encoding("single bytes", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        for first in range(0, sys.maxunicode + 1, 4096):
            some = "".join(chr(c) for c in range(first, first + 4096) if not 0xD800 <= c < 0xE000)
            mine = regex.findall(kind, some)
            older = set(bytes(single.encode_ordinary(some)).decode()) if mine else ()
            newer |= {ord(c): OTHER for c in mine if c not in older}
    return newer


class Cutter:
    """Words of a text by a pattern of tiktoken's, with its idea of letters and numbers."""

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.newer = _newer_letters()

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # all these characters are old
            return self.find(text)
        except UnicodeEncodeError:
            seen = text.translate(self.newer)
        words = self.find(seen)
        if seen == text:
            return words
        ends = np.cumsum([len(w) for w in words]).tolist()
        return [text[a:b] for a, b in zip([0, *ends], ends)]


class Vocabulary:
    """Tokens by id, and which pairs of them merge."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        size = max(self.ranks.values(), default=-1) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.merged: dict[int, int] = {}  # pair to the rank of its merge, -1 if there is none; grows with the pairs met

    def merge(self, pair: int) -> int:
        left, right = divmod(pair, RIGHT)
        found = self.merged[pair] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens one after another."""
        return gather(self.bytes, self.starts, self.lengths, ids).tobytes()


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """The stretches ``picked`` of ``values``, one after another."""
    each = lengths[picked]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts[picked] - ends + each, each) + np.arange(total)]


def replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and the number of ids of each.

    ``index`` has the positions of the pairs that wait for a merge, by its rank; pairs that make the same token wait
    together, from left to right, so that ties go as they go within a single word. A merge can enable one of a lower
    rank, which then comes first. ``due`` is the rank for which a position's present pair waits: a position that
    waits for another one by its turn is passed over.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    flat = vocabulary.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    n = len(flat)
    word = np.repeat(np.arange(len(words)), lengths)
    inside = np.flatnonzero(word[1:] == word[:-1])
    after = np.full(n, -1, np.int64)
    before = np.full(n, -1, np.int64)
    after[inside], before[inside + 1] = inside + 1, inside

    pairs = flat[inside] * RIGHT + flat[inside + 1]
    kinds, which = np.unique(pairs, return_inverse=True)
    ranks = np.array([vocabulary.merge(p) for p in kinds.tolist()], np.int64)[which]
    due = np.full(n, -1, np.int64)
    due[inside] = ranks
    order = np.argsort(ranks, kind="stable")  # positions rise within a rank
    waiting, first = np.unique(ranks[order], return_index=True)
    index = {rank: spots[::-1].tolist() for rank, spots in zip(waiting.tolist(), np.split(inside[order], first[1:])) if rank >= 0}

    token, after, before, due = flat.tolist(), after.tolist(), before.tolist(), due.tolist()
    known, merge = vocabulary.merged, vocabulary.merge
    turns, mixed = list(index), set()  # ranks that wait; those whose positions are out of order
    heapq.heapify(turns)
    while turns:
        rank = heapq.heappop(turns)
        spots = index.pop(rank)  # taken from its end
        if rank in mixed:
            mixed.discard(rank)
            spots.sort(reverse=True)
        while spots:
            at = spots.pop()
            if due[at] != rank:
                continue
            mate = after[at]
            token[at], token[mate], due[mate] = rank, -1, -1
            right, left = after[mate], before[at]
            after[at] = right
            earliest = rank
            due[at] = -1
            if right >= 0:
                before[right] = at
            for spot, mate in ((at, right), (left, at)):
                if spot < 0 or mate < 0:
                    continue
                pair = token[spot] * RIGHT + token[mate]
                turn = known.get(pair)
                if turn is None:
                    turn = merge(pair)
                due[spot] = turn
                if turn in index:
                    index[turn].append(spot)
                    mixed.add(turn)
                elif turn >= 0:
                    index[turn] = [spot]
                    heapq.heappush(turns, turn)
                    earliest = min(earliest, turn)
            if earliest < rank and spots:
                index[rank] = spots
                heapq.heappush(turns, rank)
                break
    left_over = np.array(token, np.int64)
    alive = left_over >= 0
    return left_over[alive], np.bincount(word[alive], minlength=len(words))


class _Places(dict):
    """Places of words, in the order in which they were first met."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


class BlockEncoder:
    """Ids of blocks of texts; remembers the words of earlier blocks."""

    def __init__(self, path: str, pattern: str, known: int = KNOWN_WORDS):
        self.vocabulary, self.cut, self.limit = Vocabulary(path), Cutter(pattern), known
        self.places, self.ids, self.lengths = _Places(), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def keep(self, places: np.ndarray):
        """Forget all words but those at these places."""
        words = np.array(list(self.places), object)[places].tolist()
        starts = np.cumsum(self.lengths) - self.lengths
        self.places = _Places(zip(words, range(len(words))))
        self.ids, self.lengths = gather(self.ids, starts, self.lengths, places), self.lengths[places]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        known, cut, place = len(self.places), self.cut, self.places.__getitem__
        places = [np.fromiter(map(place, cut(t)), np.int32) for t in texts]
        new = [w.encode() for w in islice(self.places, known, None)]
        if new:
            ids, lengths = replay(new, self.vocabulary)
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.lengths = np.concatenate([self.lengths, lengths.astype(np.int32)])
        starts = np.cumsum(self.lengths) - self.lengths
        found = [gather(self.ids, starts, self.lengths, words) for words in places]
        if len(self.places) > self.limit:
            self.keep(np.unique(np.concatenate(places)))
        return found


@cache
def block_encoder(path: str, pattern: str) -> BlockEncoder:
    """One per worker process and vocabulary."""
    return BlockEncoder(path, pattern)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def blocks_of(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[list[tuple[pa.RecordBatch, list[str]]]]:
    """Consecutive batches with their texts, together until they hold so many characters."""
    block, size = [], 0
    for batch in batches:
        texts = texts_of(batch)
        block.append((batch, texts))
        size += sum(map(len, texts))
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode_texts(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id and ids (array) of every whole text, without special tokens; one row per row, null and empty texts have no ids.

    ``ranks`` is the path of a rank file on every machine. Special tokens' strings are ordinary text. Repeated rows
    and null ids keep their rows; further columns are ignored; an empty table gives no rows.
    """

    def encode(batches):
        encoder = block_encoder(ranks, pattern)
        for block in blocks_of(batches, block_chars):
            found = iter(encoder([t for _, texts in block for t in texts]))
            for batch, texts in block:
                yield {"doc_id": batch.column("doc_id"), "ids": [next(found) for _ in texts]}

    return map_partition(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids and ``decoded``: the bytes of the ids' tokens. No ids, or null, give no bytes; an unknown id is an error."""

    def decode(batch):
        words = vocabulary(ranks)
        ids = [np.asarray(x or [], np.int64) for x in batch.column("ids").to_pylist()]
        if any(len(x) and (x.min() < 0 or x.max() >= len(words.tokens)) for x in ids):
            raise ValueError("an id is not in the vocabulary")
        return {"doc_id": batch.column("doc_id"), "ids": batch.column("ids"), "decoded": [words.decode(x) for x in ids]}

    return map_batches(encoded.select("doc_id", "ids"), decode, "doc_id long, ids array<int>, decoded binary")


def encoding_digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids written out and of the decoded bytes."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
