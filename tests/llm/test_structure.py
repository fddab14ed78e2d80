"""Whitening, byte-level BPE and periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfscope.llm import byte_bpe, runs, whitening
from shelfscope.llm.common import table
from shelfscope.llm.queries import QUERIES, RANKS

# ---- whitening


def plain_whitening(rows, k=16):
    """vec_id -> (deviation, whitened up to sign), explained; by dense linear algebra over the distinct vectors."""
    grid = [(i, [int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in grid}), np.int64)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - fit[0]
    centred = centred - centred.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    out = []
    for i, x in grid:
        away = np.array([(n * v - s) / n for v, s in zip(x, sums)])
        out.append((i, sum((n * v - s) ** 2 for v, s in zip(x, sums)), np.abs(away @ axes / np.sqrt(values))))
    return n, out, values / np.trace(centred.T @ centred / n)


def test_whitening_equals_dense_algebra(spark, data):
    given_rows = [(r.vec_id, list(r.embedding)) for r in table(spark, data, "embeddings").collect()]
    odd = [(None, given_rows[0][1]), (1, given_rows[1][1]), (1, given_rows[1][1]), (7, None), (8, [None] + [0.0] * 63), (9, [float("nan")] * 64), (10, [float("inf")] + [0.0] * 63)]
    rows = given_rows + odd
    frame = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, x string, n int")
    n, wanted, explained = plain_whitening(rows)
    found = whitening.whiten(frame).collect()
    assert len(found) == 16 * len(wanted) and {r.n for r in found} == {n}
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    for r in found:
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    key = lambda i, d: (-1 if i is None else i, d)
    mine = {}
    for r in found:
        mine.setdefault(key(r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    for i, deviation, whitened in wanted:
        assert np.allclose([abs(mine[key(i, deviation)][c][0]) for c in range(1, 17)], whitened, atol=1e-8)
        assert all(max(v) == min(v) for v in mine[key(i, deviation)].values())


@pytest.mark.parametrize("vectors, components", [([], 0), ([[1.0, 2.0]] * 3, 0), ([[]], 0), ([[1.0, 2.0], [1.0, 3.0], [5.0]], 1), ([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]], 2)])
def test_whitening_of_few_vectors(spark, vectors, components):
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    found = whitening.whiten(frame).collect()
    assert {r.component for r in found} == set(range(1, components + 1))
    assert all(r.identity_error < 1e-12 for r in found)


def test_whitening_far_from_zero_and_large_deviations(spark):
    rng = np.random.default_rng(1)
    x = np.rint(rng.normal(size=(50, 3)) * 1e7) + 1e12
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = whitening.whiten(frame).collect()
    assert len(found) == 150 and found[0].identity_error < 1e-9
    n, wanted, _ = plain_whitening(list(enumerate(x.tolist())))
    exact = {i: d if d < 1 << 63 else None for i, d, _ in wanted}
    assert all(r.deviation == exact[r.vec_id] for r in found) and None in exact.values()


@pytest.mark.parametrize("size, rank", [(1, 1), (5, 5), (20, 7), (33, 33)])
def test_principal_axes(size, rank):
    rng = np.random.default_rng(size)
    b = rng.normal(size=(size, rank)) * 10.0 ** rng.uniform(-3, 3, rank)
    a = b @ b.T
    values, axes = whitening.principal_axes(a)
    assert len(values) <= size and np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-12)
    assert np.allclose(a, axes * values @ axes.T, atol=1e-12 * np.abs(a).max())
    assert np.allclose(values[:rank], np.linalg.eigvalsh(a)[::-1][: len(values)][:rank], rtol=1e-9, atol=1e-13 * values[0])
    assert (np.diff(values) <= 0).all()


# ---- byte-level BPE

SOME = "a b  c\tdon't I'LL they're  \n\n x12345 ... !?# naïve café ΑΣ ß 日本語 текст עברית \U0001f600\U0001f601 \x1c\x85\xa0  ՘࢏\U00011de0 ʼn <|endoftext|>"
HARD = ["", " ", "   ", "a", "aaaa" * 300, "ab" * 501, " " * 700 + "x", SOME, "é" * 99, "'s't're've'm'll'd", "՘x࢏1\U00011de0 z", "퟿￿\U0010ffff", "xyzzy" * 2000]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.BlockEncoder(RANKS, public_tokenizers.PATTERN, known=50)


def test_bpe_query_equals_the_library(spark, data, library):
    texts = [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()]
    found = {r.doc_id: r for r in QUERIES["op12_byte_level_bpe"](spark, data).collect()}
    assert len(found) == len(texts)
    for i, text in texts:
        ids = library.encode_ordinary(text)
        wanted = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == wanted


def test_bpe_of_odd_rows(spark, library):
    rows = [*enumerate(HARD), (None, None), (3, None), (None, "no id"), (5, HARD[5])]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").repartition(2)
    found = byte_bpe.decode_ids(byte_bpe.encode_texts(frame, RANKS, block_chars=50), RANKS).collect()
    key = lambda r: str(r)
    wanted = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in found), key=key) == sorted(wanted, key=key)
    assert byte_bpe.encode_texts(frame.limit(0), RANKS).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("ab c'st1é\n", max_size=60), max_size=4))
def test_bpe_of_random_texts(library, encoder, texts):
    assert [x.tolist() for x in encoder(texts)] == [library.encode_ordinary(t) for t in texts]


def test_letters_as_in_the_library(library, encoder):
    every = "".join(chr(c) + " x" for c in range(0x30000) if not 0xD800 <= c < 0xE000)
    assert encoder([every])[0].tolist() == library.encode_ordinary(every)


def test_replay_with_merges_that_enable_earlier_ones():
    rng = random.Random(5)
    for _ in range(200):  # random ranks: tokens of any length, ties between different pairs of one token
        tokens = {bytes([b]): b for b in range(256)}
        while len(tokens) < 300:
            tokens.setdefault(bytes(rng.choices(b"ab", k=rng.randint(2, 5))), len(tokens))
        ranked = dict(zip(tokens, [*range(256), *rng.sample(range(256, 300), 44)]))
        vocabulary = byte_bpe.Vocabulary.__new__(byte_bpe.Vocabulary)
        vocabulary.ranks, vocabulary.tokens, vocabulary.merged = ranked, sorted(ranked, key=ranked.get), {}
        vocabulary.of_byte = np.arange(256)
        words = [bytes(rng.choices(b"abc", k=rng.randint(1, 30))) for _ in range(8)]
        plain = tiktoken.Encoding("random", pat_str=r"[abc]+", mergeable_ranks=ranked, special_tokens={})
        ids, lengths = byte_bpe.replay(words, vocabulary)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [plain.encode_ordinary(w.decode()) for w in words]


# ---- periodic runs


def plain_runs(words, exponent=4, shortest=6):
    n, found = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(shortest, exponent * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, b - a, p) for (a, b), p in found.items())


def plain_digest(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for a, k, p in found for i in range(a + p, a + k)}
    best = min(((-k, a, p) for a, k, p in found), default=None)
    longest = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    listed = "".join(f"{a},{k},{p}\n" for a, k, p in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def caught(words, sizes, exponent=4, shortest=6):
    catcher, at = runs.SquareCatcher(exponent, shortest), 0
    for size in sizes:
        catcher.append(np.array(words[at : at + size], np.int64))
        at += size
    return catcher.runs()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 1) | st.integers(0, 3), max_size=70), st.integers(1, 40), st.integers(2, 5), st.integers(1, 9))
def test_runs_however_words_are_appended(words, size, exponent, shortest):
    wanted = plain_runs(words, exponent, shortest)
    assert caught(words, [size] * 70, exponent, shortest) == wanted
    assert caught(words, [1] * 70, exponent, shortest) == wanted


def test_runs_of_repeated_pieces():
    rng = random.Random(3)
    for _ in range(300):
        words = []
        while len(words) < 250:
            piece = [rng.randint(0, 2) for _ in range(rng.randint(1, 25))]
            words += (piece * rng.randint(1, 7))[: rng.randint(1, 120)]
        assert caught(words, [rng.randint(1, 60) for _ in range(250)]) == plain_runs(words)


def test_a_run_is_known_as_soon_as_it_is_complete():
    words = [9, 8, *[1, 2, 3] * 5, 7]
    catcher, seen = runs.SquareCatcher(), []
    for w in words:
        catcher.append(np.array([w]))
        seen.append(catcher.runs())
    assert seen[12] == [] and seen[13] == [(2, 12, 3)] and seen[-1] == [(2, 15, 3)]


def test_one_word_over_and_over_stays_cheap():
    assert caught([1] * 400_000, [100_000] * 4) == [(0, 400_000, 1)]
    assert caught([1, 2] * 200_000 + [3], [400_001]) == [(0, 400_000, 2)]


def test_run_query_equals_brute_force(spark, data):
    given_rows = [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()]
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = QUERIES["op13_periodic_runs"](spark, data).select(*columns).collect()
    short = {i: t for i, t in given_rows if len(t) < 9_000}
    assert len(found) == len(given_rows) and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in short) > 5
    assert {tuple(r) for r in found if r.doc_id in short} == {plain_digest(i, t) for i, t in short.items()}


def test_runs_of_odd_rows(spark):
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "a\x0b a a\x0c a a a"), (4, "a\x0b a a\x0c a a a"), (None, "x\x85 x\xa0x x x x x x"), (6, "é ñ " * 9 + "end"), (7, "b " * 30_000)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, runs string, n_words int")
    found = runs.find_runs(frame).collect()
    wanted = sorted((str(i), len((t or "").encode().split()), str(plain_runs((t or "").encode().split()[:500]))) for i, t in rows if i != 7)
    assert sorted((str(r.doc_id), r.n_words, str([tuple(x) for x in r.runs])) for r in found if r.doc_id != 7) == wanted
    long = next(r for r in found if r.doc_id == 7)
    assert (long.n_words, [tuple(x) for x in long.runs], long.collapsed) == (30_000, [(0, 30_000, 1)], "b")
    assert runs.find_runs(frame.limit(0)).count() == 0
    assert runs.run_digest(runs.find_runs(frame.filter(F.col("doc_id") == 3))).first().start is None
