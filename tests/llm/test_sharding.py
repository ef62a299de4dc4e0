from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

from tallybook.llm import sharding


def test_every_row_once_with_slots_without_gaps(documents, nasty):
    rows = sharding.shard(documents, 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in nasty
    )
    for number in range(4):
        slots = sorted(r.slot for r in rows if r.shard == number)
        assert slots == list(range(len(slots)))


def test_sizes_are_even_and_equal_texts_stay_together(spark):
    draw = np.random.default_rng(2)
    texts = [f"{n} " * int(size) for n, size in enumerate(draw.lognormal(3, 1, 3000))]
    rows = [(n, text) for n, text in enumerate(texts)] + [(10_000 + n, texts[n // 2]) for n in range(200)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).collect()
    sizes = np.zeros(8)
    where = {}
    for r in found:
        sizes[r.shard] += r.size
        where[r.doc_id] = r.shard
    assert sizes.max() / sizes.mean() < 1.01 and sizes.min() / sizes.mean() > 0.99
    assert all(where[10_000 + n] == where[n // 2] for n in range(200))


def test_a_group_of_a_third_of_all_rows_is_split(spark):
    rows = [(n, "the same text " * 5 if n % 3 == 0 else f"text {n} " * 8) for n in range(6000)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), 40).collect()
    sizes = np.bincount([r.shard for r in found], weights=[r.size for r in found])
    assert len(sizes) == 40 and sizes.max() / sizes.mean() < 1.03


def spread(found, of):
    sums = np.zeros(max(r.shard for r in found) + 1)
    for r in found:
        sums[r.shard] += of(r)
    return max(sums.max() / sums.mean() - 1, 1 - sums.min() / sums.mean())


def test_a_third_of_rows_equal_in_every_column_is_spread(spark):
    rows = [(None, None)] * 3000 + [(n, f"text {n} " * 8) for n in range(6000)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), 40).collect()
    assert spread(found, lambda r: r.size) < 0.03 and spread(found, lambda r: 1) < 0.15
    for number in range(40):
        slots = sorted(r.slot for r in found if r.shard == number)
        assert slots == list(range(len(slots)))


def test_bytes_tokens_and_rows_are_even(spark):
    """Sources that differ in bytes per token and tokens per row."""
    draw = np.random.default_rng(4)
    rows = []
    for n, size in enumerate(draw.integers(5, 120, 6000)):
        rows.append((n, " ".join(["x" if n % 3 else f"longerword{n}"] * (int(size) if n % 2 else 3)) + str(n)))
    found = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).collect()
    for of in (lambda r: r.size, lambda r: r.tokens, lambda r: 1):
        assert spread(found, of) < 0.02


def test_only_groups_above_a_shard_are_split(spark):
    """A pair of texts of 0.7 of a shard stays together, one of 1.4 does not."""
    small = [(n, f"text {n} " * 5) for n in range(2000)]
    bytes_ = sum(len(t) + 16 for _, t in small)
    for part, together in ((0.7, True), (1.4, False)):
        long = "y" * int(part / (8 - part) * bytes_ / 2)
        rows = small + [(10_000, long), (10_001, long)]
        found = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).collect()
        assert (len({r.shard for r in found if r.doc_id >= 10_000}) == 1) == together


def test_groups_that_leave_no_room_are_split_too(spark):
    rows = [(n, f"group {n % 12} " * 40) for n in range(12 * 30)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).collect()
    assert spread(found, lambda r: r.size) < 0.25  # whole groups would give 1 or 2 a shard


def test_the_rule_of_the_dot_product():
    items = np.array([[0.5, 0.1, 0.1], [0.1, 0.4, 0.2], [0.4, 0.5, 0.7]])
    assert sorted(np.bincount(sharding.pack(items, 2), minlength=2)) == [1, 2]


def test_empty_and_clashing(empty, clashing):
    assert sharding.shard(empty).count() == 0
    assert sharding.shard(clashing).count() == 6
