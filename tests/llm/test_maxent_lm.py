from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallybook.llm import maxent_lm

from .conftest import words


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def brute_force(rows):
    lists = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    counts = Counter(w for i, own in lists if not held_out(i) for w in own)
    total = sum(counts.values())
    outcomes = total + len(counts) + 1
    return sorted(
        (
            (i is not None, i, len(own), sum(counts[w] > 0 for w in own), total,
             round(sum(math.log10((counts[w] + 1) / outcomes) for w in own), 4))
            for i, own in lists
        ),
    )


def found_in(frame):
    rows = maxent_lm.scored(frame).collect()
    assert all(r.held_out == held_out(r.doc_id) and r.score < 0 for r in rows)
    return rows, sorted(
        (r.doc_id is not None, r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows
    )


@pytest.mark.parametrize("frequent", [65_536, 20])
def test_counts_and_base_are_exact(documents, nasty, frequent, monkeypatch):
    """With words known to every task, and with most of them met by the join."""
    monkeypatch.setattr(maxent_lm, "FREQUENT", frequent)
    assert found_in(documents)[1] == brute_force(nasty)


def test_held_out_text_is_likelier_than_by_single_words(spark):
    draw = random.Random(6)
    follows = {n: [draw.randrange(40) for _ in range(3)] for n in range(40)}
    rows = []
    for number in range(300):
        at, own = draw.randrange(40), []
        for _ in range(60):
            own.append(f"w{at}")
            at = draw.choice(follows[at])
        rows.append((number, " ".join(own)))
    found, _ = found_in(spark.createDataFrame(rows, "doc_id bigint, text string"))
    own = [r for r in found if r.held_out]
    assert sum(r.score for r in own) > 0.7 * sum(r.base_score for r in own)


def test_outcomes_sum_to_one(spark):
    draw = random.Random(4)
    rows = [(n, words(draw, 30)) for n in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    table, model = maxent_lm.train(frame)
    rare = model.words.rare
    for history in ([], [3], [3, 5], [rare, 2]):
        numbers = np.array([[0, *history, outcome] for outcome in range(rare + 1)], np.int32)
        total = sum(10.0 ** model.log10(row)[-1] for row in numbers)
        assert abs(total - 1) < 1e-3


@pytest.mark.parametrize("part_tokens, heaps", [(500_000, 1024), (3000, 1024), (3000, 4)])
def test_rare_words_before_and_pairs_of_them_tell_what_follows(spark, part_tokens, heaps, monkeypatch):
    """All words lie beyond the clustered ones, so only hashed buckets tell the histories apart."""
    monkeypatch.setattr(maxent_lm, "CLASSED", 60)
    monkeypatch.setattr(maxent_lm, "PART_TOKENS", part_tokens)
    monkeypatch.setattr(maxent_lm, "HEAPS", heaps)
    draw = random.Random(8)
    rows = []
    for number in range(400):
        own = []
        for _ in range(40):
            a, b = draw.randrange(90), draw.randrange(2)
            own += [f"{'xy'[b]}{a}", f"m{a % 5}", f"t{(a * 7 + a % 5 * b) % 50}"]
        rows.append((number, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    texts = frame.withColumn("row_id", frame["doc_id"])
    found = {r.row_id: r.hashed for r in maxent_lm.hashed_scores(texts, texts, maxent_lm.train(frame)[1]).collect()}
    _, model = maxent_lm.train(frame)
    fixed = 0.0
    for _, text in rows:
        numbers = model.words.numbered(maxent_lm.tokens(text.encode()))
        fixed += float((model.log10(numbers) - model.tables.inside[numbers]).sum())
    assert found.keys() == dict(rows).keys()
    assert sum(found.values()) > 0.95 * fixed


def test_buckets_grow_and_hashed_outcomes_sum_to_one():
    counts = np.array([4_000_000, 3_000_000, 100], np.int64)
    words_ = maxent_lm.Words({b"": 0, b"a": 1, b"b": 2}, counts, 8_000_000, 4, 999_900, 1)
    layout = maxent_lm.Layout.of(words_)
    assert layout.buckets == 8_000_000 // maxent_lm.PER_BUCKET
    assert layout.tasks.max() == 4_000_000 // maxent_lm.PART_TOKENS
    assert set(layout.part(np.arange(layout.buckets), 3)) <= set(range(len(layout.homes())))
    draw = np.random.default_rng(3)
    for kind, outcomes in (("class", 64), ("leaf", 64)):
        keys = np.unique(draw.integers(0, 3 * maxent_lm._CELL[kind], 500))
        weights = maxent_lm.Weights.zero().short()
        found = maxent_lm.fit(weights, kind, keys, draw.integers(1, 9, len(keys)))
        row = keys[7] // outcomes * outcomes + np.arange(outcomes)
        value = maxent_lm.hashed_log10(weights, found, kind, row)
        assert abs((10.0**value).sum() - 1) < 1e-5 and value.max() > value.min()


def test_words_beyond_65536_are_known_to_every_task(spark):
    rows = [(n, " ".join(f"w{w}" for w in range(n % 70 * 1000, n % 70 * 1000 + 1000))) for n in range(210)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    _, found = maxent_lm.count_words(frame)
    assert found.rare == 70_001 and found.rare_total == 0


def test_nothing_to_learn_from(spark, empty, clashing):
    assert maxent_lm.scored(empty).count() == 0
    alone = next(n for n in range(100) if held_out(n))
    [row] = maxent_lm.scored(spark.createDataFrame([(alone, "a b")], "doc_id bigint, text string")).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert maxent_lm.scored(clashing).count() == 6


@pytest.mark.parametrize("kind", ["class", "leaf"])
def test_slices_give_the_weights_of_the_whole(kind, monkeypatch):
    """Buckets far larger than a slice, and many small ones."""
    draw = np.random.default_rng(5)
    size = maxent_lm._CELL[kind]
    keys = np.unique(np.concatenate((draw.integers(0, 2 * size, 3000), draw.integers(0, 60 * size, 1000))))
    counts = draw.integers(1, 9, len(keys))
    weights = maxent_lm.Weights.zero().short()
    whole = maxent_lm.fit(weights, kind, keys, counts)
    monkeypatch.setattr(maxent_lm, "SLICE", 100)
    cut = maxent_lm.fit(weights, kind, keys, counts)
    assert whole.keys() == cut.keys()
    for name, (of, values) in whole.items():
        assert (of == cut[name][0]).all() and np.allclose(values, cut[name][1], atol=2e-3)


def test_rows_that_are_not_read_from_files(spark, monkeypatch):
    """A shuffled input may come in another order each time it is computed."""
    draw = random.Random(12)
    rows = [(n, " ".join(f"w{min(int(draw.expovariate(0.1)), 200)}" for _ in range(draw.randint(1, 30)))) for n in range(600)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        shuffled = frame.repartition(13).join(frame.select("doc_id", "doc_id").toDF("doc_id", "other").hint("merge"), "doc_id")
        found = {r.doc_id: (r.n_tokens, r.score) for r in maxent_lm.scored(shuffled).collect()}
        plain = {r.doc_id: (r.n_tokens, r.score) for r in maxent_lm.scored(frame.repartition(3)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert found.keys() == plain.keys()
    for doc_id, (n_tokens, score) in plain.items():
        assert found[doc_id][0] == n_tokens and abs(found[doc_id][1] - score) < 1e-2 * abs(score)


@pytest.mark.parametrize("heaps", [1024, 3])
def test_sums_of_a_text_travel_packed_and_come_out_once(spark, heaps, monkeypatch):
    """A text has tokens in many parts. Their sums are added up in a task, and rows there are as many as texts."""
    monkeypatch.setattr(maxent_lm, "PART_TOKENS", 1000)
    monkeypatch.setattr(maxent_lm, "HEAPS", heaps)
    draw = random.Random(21)
    texts = [" ".join(f"w{draw.randrange(3000)}" for _ in range(draw.randint(0, 80))) for _ in range(500)]
    frame = spark.createDataFrame([(n, text) for n, text in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    _, words_ = maxent_lm.count_words(frame)
    shared = spark.sparkContext.broadcast(words_)
    rows = maxent_lm.numbered(maxent_lm.as_training(frame), shared)
    assert maxent_lm.Layout.of(words_).parts > 10
    found = maxent_lm.hashed_sums(rows, rows, maxent_lm.learn(rows, words_)).collect()
    assert len(found) == len({row.row_id for row in found}) == 500
    assert all(math.isfinite(row.value) and row.value < 0 for row in found)


def test_sums_of_runs():
    draw = np.random.default_rng(2)
    for sizes in ([1], [1, 1, 1], [7], [1, 300, 2, 1, 64, 5], draw.integers(1, 40, 200)):
        rows = draw.random((int(np.sum(sizes)), 3)).astype(np.float32)
        begins = np.cumsum(sizes) - sizes
        assert np.allclose(np.add.reduceat(rows, begins), maxent_lm._run_sums(rows.copy(), begins), rtol=1e-5)


def test_sums_of_parts_are_added_up_before_they_are_dealt():
    ids = np.array([3, 9, 1 << 33, (1 << 33) + 1], np.int64)
    packed = [maxent_lm._row_sums([(0, ids[own], np.full(len(ids[own]), 0.5))]) for own in (slice(0, 3), slice(1, 4), slice(0, 0))]
    [dealt] = maxent_lm._deal_sums(2)(iter(packed))
    assert dealt.num_rows <= 2
    found = maxent_lm._sum_slot(pa.Table.from_batches([dealt])).to_pylist()
    assert {row["row_id"]: row["value"] for row in found} == {3: 0.5, 9: 1.0, 1 << 33: 1.0, (1 << 33) + 1: 0.5}


def test_counts_of_common_words_are_gathered_and_copied(spark, monkeypatch):
    """However the buckets are dealt to parts, the weights are the same, and so the sums."""
    draw = random.Random(22)
    texts = [" ".join(draw.choice(["of", f"w{draw.randrange(300)}"]) for _ in range(40)) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    _, words_ = maxent_lm.count_words(frame)
    rows = maxent_lm.numbered(maxent_lm.as_training(frame), spark.sparkContext.broadcast(words_))
    model = maxent_lm.learn(rows, words_)
    found = []
    for part_tokens in (1_000_000, 1500):
        monkeypatch.setattr(maxent_lm, "PART_TOKENS", part_tokens)
        layout = maxent_lm.Layout.of(words_)
        assert bool(len(layout.hot)) == (part_tokens == 1500)
        found.append({row.row_id: row.value for row in maxent_lm.hashed_sums(rows, rows, model).collect()})
    assert found[0].keys() == found[1].keys() and len(found[0]) == 200
    assert all(abs(found[1][row] - value) < 1e-3 * abs(value) for row, value in found[0].items())
