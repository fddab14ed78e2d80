"""Tokens, mixing, near-duplicates and the pipeline against brute force."""

import heapq
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from shelfscope.llm import dart_minhash as darts
from shelfscope.llm import common, mixing, token_scan, token_store
from shelfscope.llm.common import join_to_owner, running_position, table
from shelfscope.llm.queries import END_ID, QUERIES, TOKENIZER
from shelfscope.llm.tokens import encoder, width_for, write_id_files
from shelfscope.session import cut_lineage, scratch_path

HARD = [
    "", " ", "Don't they're 'S 'tis I'LL", "<|endoftext|> and <|startoftext|>", "a  b\tc d e\x1cf", "ΑΣ ΟΔΟΣ", "J̌ ǰ é É İ ß ẞ",
    "x_y 12.5% #tag ##&&", "THE!! the. (the) \"the\" the's the'", "日本語 текст עברית", "\U0001f600\U0001f601 ok", "ÀÉÎõü÷×ª", "퟿", "naïve*** café###",
]


def whole(text):
    return Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def rows(spark, data):
    docs = [(r.doc_id, r.text) for r in table(spark, data, "documents").limit(60).collect()]
    return docs + [(10_000 + i, t) for i, t in enumerate(HARD)] + [(None, None), (None, "no id"), (3, "again"), (10_001, HARD[1]), (10_001, HARD[1])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, n_tokens string")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoding_equals_the_library(spark, data, name):
    path = public_tokenizers.path(name)
    plain, mine = Tokenizer.from_file(path), encoder(path)
    for text in HARD + [r.text for r in table(spark, data, "documents").limit(80).collect()]:
        assert np.frombuffer(mine(text), f"<u{mine.width}").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_width_has_room_for_the_end_id():
    assert [token_scan.flat_width(n) for n in (49_408, (1 << 16) - 1, 1 << 16, (1 << 16) + 1)] == [2, 2, 4, 4]
    assert [width_for(n) for n in (1 << 16, (1 << 16) + 1)] == [2, 4]


def test_store_round_trip(rows, docs):
    found = token_store.store_digest(token_store.write_store(docs, TOKENIZER, END_ID), token_store.document_keys(docs)).collect()
    ids = [(i, whole(t) + [END_ID]) for i, t in rows]
    wanted = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == wanted
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1]]
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in ordered[:2]] == [None, None]


def test_store_answers_for_its_keys_only(spark, docs):
    store = token_store.write_store(docs, TOKENIZER, END_ID)
    asked = spark.createDataFrame([(3, 0), (3, 1), (3, 2), (99_999, 0), (None, 1)], "doc_id long, copy long")
    assert {(r.doc_id, r.copy) for r in store.find(asked).collect()} == {(3, 0), (3, 1), (None, 1)}
    empty = token_store.write_store(docs.limit(0), TOKENIZER, END_ID)
    assert empty.read(asked).count() == 0


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 2000, 5000):
        a, b = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
        pilots = token_store.perfect_hash(a, b)
        assert sorted(token_store.find_slots(a, b, pilots, n)) == list(range(n))
    with pytest.raises(ValueError):
        token_store.perfect_hash(np.array([7, 7], np.uint64), np.array([7, 7], np.uint64))


def test_token_counts(rows, docs):
    found = token_scan.count_tokens(docs, TOKENIZER).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in found) == Counter((i, len(whole(t))) for i, t in rows)
    assert token_scan.count_tokens(docs.limit(0), TOKENIZER).count() == 0


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_scan_of_files_with_open_ends(spark, block):
    parts = [[5, 6, 0, 7], [8], [0, 0, 9], [4, 4, 4, 4], [1, 0, 2, 2]]  # the files' ids, with no end at their ends
    folder = scratch_path(spark, "flat")
    lines = [(i, np.array(p, "<u2").tobytes()) for i, p in enumerate(parts)]
    frame = spark.createDataFrame(lines, "no int, ids binary").repartitionByRange(5, "no").sortWithinPartitions("no")
    write_id_files(frame.select("ids"), folder, 3, 2)  # each file ends with id 3, which is a plain id here
    flat = [x for p in parts for x in [*p, 3]]
    wanted, start = [], 0
    for at, x in enumerate([*flat, 0]):
        if x == 0:
            wanted.append((len(wanted), start, at - start, at < len(flat)))
            start = at + 1
    found = token_scan.scan_ends(spark, folder, 0, 2, block).collect()
    assert sorted((r.doc_no, r.start, r.n_tokens, r.closed) for r in found) == wanted


def test_running_position(spark):
    frame = spark.range(500).select((F.col("id") % 7).cast("string").alias("g"), (F.col("id") % 5).alias("o"), "id", (F.col("id") % 3).alias("w"))
    found = running_position(frame, ["o", "id"], "w", "g").collect()
    sums = defaultdict(int)
    for r in sorted(found, key=lambda r: (r.g, r.o, r.id)):
        assert r.position == sums[r.g]
        sums[r.g] += r.w


def brute_order(blocks, weights):
    """Slot by slot: released blocks by due time, with the parts of the sources that still have blocks."""
    left, done, order = dict(blocks), dict.fromkeys(blocks, 0), []
    while left:
        parts = mixing.whole_parts({s: weights[s] for s in left}, max(mixing.PERIOD, len(left)))
        size, j, ended, t = sum(parts.values()), dict.fromkeys(left, 0), False, 0
        while not ended:
            ready = [(-(-(j[s] + 1) * size // parts[s]), s) for s in left if j[s] * size // parts[s] <= t]
            s = heapq.nsmallest(1, ready)[0][1]
            order.append((s, done[s]))
            j[s], done[s], left[s], t = j[s] + 1, done[s] + 1, left[s] - 1, t + 1
            ended = left[s] == 0
        left = {s: n for s, n in left.items() if n}
    return order


def test_schedule_is_earliest_deadline_first():
    blocks, weights = {"a": 1300, "b": 700, "c": 90, "d": 1, "e": 0}, {"a": 0.5, "b": 0.31, "c": 0.1, "d": 0.05, "e": 0.04}
    schedule = mixing.make_schedule(blocks, weights)
    found = {}
    for s, n in blocks.items():
        for j, slot in enumerate(schedule.slots(s, np.arange(n))):
            found[int(slot)] = (s, j)
    wanted = brute_order({s: n for s, n in blocks.items() if n}, weights)
    assert [found[t] for t in range(len(wanted))] == wanted and len(found) == len(wanted)


@pytest.mark.parametrize(
    "blocks, weights",
    [
        ({"a": 1300, "b": 700, "c": 90, "d": 1, "e": 0}, {"a": "1/2", "b": "31/100", "c": "1/10", "d": "1/20", "e": "1/25"}),
        ({"a": 40, "b": 7, "c": 90, "d": 33}, {"a": "1/3", "b": "1/7", "c": "1/100", "d": "2/9"}),
        ({"a": 500, "b": 501, "c": 3}, {"a": "1/2", "b": "1/2", "c": "1/1000"}),
        ({"a": 5000, "b": 1}, {"a": "1", "b": "1/99999"}),
    ],
)
def test_a_period_places_blocks_as_slot_by_slot(blocks, weights):
    exact = {s: Fraction(w) for s, w in weights.items()}
    wanted = brute_order({s: n for s, n in blocks.items() if n}, exact)
    schedule = mixing.schedule_of(blocks, exact)
    assert isinstance(schedule, mixing.PeriodicSchedule)
    found = {int(t): (s, j) for s, n in blocks.items() for j, t in enumerate(schedule.slots(s, np.arange(n)))}
    assert [found[t] for t in range(len(wanted))] == wanted and len(found) == len(wanted)


def test_work_for_a_schedule_does_not_grow_with_the_blocks():
    weights = {"a": 0.5, "b": 0.31, "c": 0.1, "d": 0.05, "e": 0.04}
    schedule = mixing.schedule_of({s: 10**12 + i for i, s in enumerate(weights)}, weights)
    assert sum(len(x) for p in schedule.phases for x in p.taken.values()) < 500
    for s, w in weights.items():
        at = np.array([0, 1, 10**9, 10**9 + 1, 10**10])
        assert (np.abs(at + 1 - (schedule.slots(s, at) + 1) * w) < 1 + 1e-3).all()  # in the first phase
    last = sorted((int(schedule.slots(s, np.array([10**12 + i - 1]))[0]), s) for i, s in enumerate(weights))
    assert last[-1][0] == 5 * 10**12 + 10 - 1  # no slot is empty or taken twice
    assert isinstance(mixing.schedule_of({"a": 3, "b": 3}, {"a": 0.123456789, "b": 1.0}), mixing.Schedule)


def test_shares_deviate_by_less_than_a_block():
    parts = mixing.whole_parts({f"s{i}": (i + 1) ** 2 for i in range(20)})
    seen = Counter()
    order = sorted((t, s) for s, slots in mixing.edf_period(parts).items() for t in slots)
    for t, s in order:
        seen[s] += 1
        assert all(abs(seen[x] - (t + 1) * parts[x] / mixing.PERIOD) < 1 for x in parts)


@pytest.mark.parametrize(
    "weights",
    [
        {"a": 0.9, "b": 0.025, "c": 0.025, "d": 0.025, "e": 0.025},
        {"a": 0.5, "b": 0.31, "c": 0.1, "d": 0.05, "e": 0.04},
        {"a": 0.5} | {f"s{i:03}": 0.5 / 255 for i in range(255)},
        {"a": 1.0, "b": 1e-5},
    ],
)
@pytest.mark.parametrize("schedule", [mixing.make_schedule, mixing.schedule_of])
def test_given_weights_hold_over_many_periods(weights, schedule):
    slots, total = 30 * mixing.PERIOD, sum(weights.values())
    schedule = schedule({s: int(slots * w / total) + 2 for s, w in weights.items()}, weights)
    for s, w in weights.items():
        taken = schedule.slots(s, np.arange(int(slots * w / total) + 2))
        taken = taken[taken < slots]  # no source ends before
        share, seen = w / total, np.arange(len(taken))
        assert (np.abs(seen + 1 - (taken + 1) * share) < 1 + 1e-6).all() and (np.abs(seen - taken * share) < 1 + 1e-6).all()
        assert abs(len(taken) - slots * share) < 1 + 1e-6


def test_sources_of_weight_zero_follow_all_others():
    schedule = mixing.make_schedule({"a": 3, "b": 2, "c": 2}, {"a": 1.0, "b": 0.0, "c": 0.0})
    assert [schedule.slots(s, np.arange(n)).tolist() for s, n in (("a", 3), ("b", 2), ("c", 2))] == [[0, 1, 2], [3, 5], [4, 6]]
    with pytest.raises(ValueError):
        mixing.make_schedule({"a": 3}, {"a": 0.0})


def test_mixing_places_every_row(spark, data):
    docs = table(spark, data, "documents").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(None, None, None), (1, "", "src0"), (1, "", "src0"), (2, "x" * 300_000, "new")], docs.schema)
    both = docs.unionByName(odd).withColumn("slot", F.lit("mine"))
    found = mixing.mix_sources(both, block_chars=5_000).collect()
    assert len(found) == both.count()
    slot_of = defaultdict(set)
    for r in found:
        slot_of[r.slot].add((r.source, r.block))
        assert r.block == r.start // 5_000
    assert all(len(v) == 1 for v in slot_of.values())
    mixed = mixing.mixed_documents(both, block_chars=5_000)
    assert mixed.columns == both.columns and Counter(map(tuple, mixed.collect())) == Counter(map(tuple, both.collect()))
    assert mixing.mix_sources(both.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(both, {"src0": 1.0}).count()


def brute_classes(rows, least=0.8):
    sets = [set(darts.elements(t or "").tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= least * len(a | sets[j]):
                parent[top(i)] = top(j)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[top(i)].append(doc_id)
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [smallest[top(i)] for i in range(len(rows))]


def near_rows(spark, data):
    rows = [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()]
    rng = np.random.default_rng(3)
    origin = [f"w{i}" for i in range(120)]
    for i in range(40):  # chains around one text: some near it, some near each other only
        words = list(origin)
        for at in rng.choice(120, rng.integers(0, 6), replace=False):
            words[at] = f"e{i}x{at}"
        rows.append((5_000 + i, " ".join(words)))
    return rows + [(6_000, None), (6_001, ""), (6_002, " \n"), (6_003, "two words"), (6_004, "Two  WORDS"), (None, "two words"), (6_003, "two words"), (6_005, "q " * 50_000), (6_006, "q " * 60_000)]


def test_near_duplicates_against_brute_force(spark, data):
    rows = near_rows(spark, data)
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, content string")
    found = darts.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.class_id) for r in found) == Counter((i, c) for (i, _), c in zip(rows, brute_classes(rows)))
    kept = darts.first_of_each_class(docs)
    wordless = sum(not (t or "").split() for _, t in rows)
    worded = [(i, c) for (i, t), c in zip(rows, brute_classes(rows)) if (t or "").split()]
    assert kept.columns == docs.columns and kept.count() == wordless + len({c for _, c in worded})
    assert darts.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 4, 1_000])
def test_rows_of_hot_keys_join_their_owner(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_KEYS", most)
    rows = [("hub", i) for i in range(300)] + [(f"k{i % 70}", i) for i in range(200)] + [(None, 1), ("alone", 1)]
    owners = [("hub", 7.0), *((f"k{i}", float(i)) for i in range(60)), ("unused", 1.0), (None, 3.0)]
    held = Counter(k for k, _ in rows)
    owned = spark.createDataFrame([(k, w, held[k]) for k, w in owners], "k string, w double, _rows long")
    found = join_to_owner(spark.createDataFrame(rows, "k string, v long"), owned, "k")
    of = dict(owners[:-1])
    assert found.columns == ["k", "v", "w"]
    assert Counter(map(tuple, found.collect())) == Counter((k, v, of[k]) for k, v in rows if k in of)


def test_hubs_and_large_buckets_in_parts(spark, data, monkeypatch):
    rows = near_rows(spark, data)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for module in (common, darts):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    monkeypatch.setattr(darts, "ROWS_TOGETHER", 2)
    found = darts.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.class_id) for r in found) == Counter((i, c) for (i, _), c in zip(rows, brute_classes(rows)))


def test_signatures_agree_as_weighted_jaccard_says():
    rng = np.random.default_rng(1)
    names, w = rng.integers(0, 2**63, 400).astype(np.uint64), rng.uniform(0.2, 3, 400)
    v = w * rng.uniform(0.5, 1.5, 400)
    s = darts.signatures(np.concatenate([names, names]), np.concatenate([w, v]), np.repeat([0, 1], 400), 3, 4000)
    assert abs((s[0] == s[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.04
    assert not s[2].any() and (s[:2] != 0).all()


def test_pipeline_stages(spark, data):
    docs = table(spark, data, "documents")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut_lineage(stage(spark, docs, data))
        assert after.columns == corpus_pipeline.COLUMNS and after.exceptAll(docs.select(*after.columns)).isEmpty()
        sizes.append(after.count())
        if name.startswith("MinHash"):
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            classes = brute_classes(rows)
            wanted = {i for (i, t), c in zip(rows, classes) if not (t or "").split() or i == c}
            assert {r.doc_id for r in after.collect()} == wanted
        docs = after
    assert sizes == sorted(sizes, reverse=True) and sizes[2] == sizes[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    place = {r.doc_id: (r.f, r.n) for r in docs.select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("n")).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    start = 0
    for r in sorted(last, key=lambda r: r.start):
        ids = np.array(whole(texts[r.doc_id]) + [END_ID], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert [r.doc_id for r in sorted(last, key=lambda r: r.start)] == sorted(texts, key=place.get)
    empty = table(spark, data, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0


def test_queries_are_thirteen():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_pipeline_stages_on_odd_rows(spark, data):
    usual = table(spark, data, "documents").withColumn("text_hash", F.lit("mine")).withColumn("file", F.lit(1))
    good = usual.filter("length(text) between 400 and 900").orderBy("doc_id").first()
    rows = [
        (None, None, None, None, None, None, None), (None, good.text, "en", "a", 5, "x", 2), (900_001, "", None, "a", 0, None, None), (900_002, None, "en", None, 0, "x", 2),
        (900_003, " \n\t", "en", "a", 3, "x", 2), (900_004, good.text, "en", "a", 5, "x", 2), (900_004, good.text, "en", "a", 5, "x", 2), (900_005, good.text.upper(), "en", "b", 5, "x", 2),
        (900_006, good.text + " and more " * 30_000, "en", "b", 5, "x", 2),
    ]
    odd = spark.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType) for f in usual.schema]))
    docs = cut_lineage(usual.unionByName(odd))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut_lineage(stage(spark, docs, data))
        assert after.columns == corpus_pipeline.COLUMNS and after.exceptAll(docs.select(*after.columns)).isEmpty()
        ids = Counter(r.doc_id for r in after.select("doc_id").collect())
        if name.startswith("MinHash"):  # equal words are one document, that without an id; wordless ones all stay
            assert not {900_004, 900_005, good.doc_id} & set(ids)
        if name.startswith("mixing"):
            assert ids == Counter(r.doc_id for r in docs.select("doc_id").collect())
        # each stage is tried on all odd rows too, whatever the stages before let pass
        alone = cut_lineage(stage(spark, cut_lineage(odd), data))
        assert alone.columns == corpus_pipeline.COLUMNS and alone.exceptAll(odd.select(*alone.columns)).isEmpty()
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, cut_lineage(odd), data).collect()
    wanted = Counter((r[0], len(whole(r[1])) + 1) for r in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in last) == wanted
