from __future__ import annotations

import numpy as np
import pytest

from tallybook.llm import near_dedup

from .conftest import frame_of, words


def shingle_set(text):
    found = (text or "").encode().lower().split()
    return {b" ".join(found[at : at + 5]) for at in range(max(1, len(found) - 4))} if found else set()


def brute_force(rows):
    """Component of each row, by comparing all pairs."""
    sets = [shingle_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
    ids = {}
    for n, (doc_id, _) in enumerate(rows):
        ids.setdefault(find(n), []).append(doc_id)
    return [
        (doc_id, len(sets[n]), min((i for i in ids[find(n)] if i is not None), default=None))
        for n, (doc_id, _) in enumerate(rows)
    ]


def by_null(row):
    return tuple((value is not None, value) for value in row)


def check(frame, rows):
    found = [tuple(r) for r in near_dedup.near_duplicates(frame).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(found, key=by_null) == sorted(brute_force(rows), key=by_null)


def test_components_are_those_of_all_pairs(documents, nasty):
    check(documents, nasty)


def test_a_group_of_edited_copies_with_no_common_centre(spark):
    """Each copy is close to its neighbours only: links form a chain."""
    import random

    draw = random.Random(3)
    text = words(draw, 80).split(" ")
    rows = [(500, "nothing like the others at all here")]
    for number in range(30):
        text[(number * 7) % 80] = f"new{number}"
        rows.append((100 - number, " ".join(text)))
    check(frame_of(spark, rows), rows)


@pytest.mark.parametrize("small", [True, False])
def test_broadcast_or_shuffle_gives_the_same(documents, nasty, small, monkeypatch):
    monkeypatch.setattr("tallybook.llm.common.BROADCAST_ROWS", 10**6 if small else 0)
    left = near_dedup.drop_near_duplicates(documents)
    assert left.columns == documents.columns
    expected = [row for row in brute_force(nasty) if row[0] == row[2]]
    assert sorted((r.doc_id for r in left.collect()), key=lambda i: (i is not None, i)) == sorted(
        (row[0] for row in expected), key=lambda i: (i is not None, i)
    )


def test_empty_and_clashing(empty, clashing):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert sorted(r.component_id for r in near_dedup.near_duplicates(clashing).collect()) == [0, 0, 0, 1, 1, 1]


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(1)
    everything = draw.integers(1, 2**63, 3000).astype(np.uint64)
    one, other = np.sort(everything[:2000]), np.sort(everything[500:2500])
    same = near_dedup.signature(one) == near_dedup.signature(other)
    assert abs(same.mean() - 0.6) < 0.15


def edited(seed, count, size, edits):
    """Texts that differ from one text, which is not among them, in so many words each."""
    import random

    draw = random.Random(seed)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(size)]
    rows = []
    for number in range(count):
        text = list(base)
        for place in draw.sample(range(size), edits):
            text[place] = f"e{number}x{place}"
        rows.append((number, " ".join(text)))
    return rows


def counted_pairs(monkeypatch):
    """The number of pairs that each step compares."""
    counts, confirmed = [], near_dedup._confirmed

    def counting(documents, nodes, pairs):
        counts.append(pairs.count())
        return confirmed(documents, nodes, pairs)

    monkeypatch.setattr(near_dedup, "_confirmed", counting)
    return counts


def test_a_member_of_a_group_of_copies_costs_about_one_pair(spark, monkeypatch):
    counts = counted_pairs(monkeypatch)
    rows = edited(1, 400, 300, 1)
    check(frame_of(spark, rows), rows)
    assert counts[0] < 400 and sum(counts) < 1.2 * 400


def test_texts_that_resemble_without_linking(spark, monkeypatch):
    """A bucket is cut into cells, a hub's set into copies; the rows stay those of all pairs."""
    monkeypatch.setattr(near_dedup, "PAIRS", 500)
    monkeypatch.setattr(near_dedup, "HUB_PAIRS", 3)
    counts = counted_pairs(monkeypatch)
    rows = edited(2, 200, 100, 2) + [(1000 + i, t) for i, t in edited(3, 200, 60, 1)]
    check(frame_of(spark, rows), rows)
    assert sum(counts[:3]) <= 3 * 400


def test_no_link_between_tiny_sets_is_missed(spark):
    """Sets of up to 12 shingles share a key whenever they are linked."""
    draw = np.random.default_rng(5)
    for _ in range(80_000):
        shared = int(draw.integers(3, 13))
        union = int(draw.integers(shared, 4 * shared // 3 + 1))
        everything = draw.integers(0, 2**64, union, np.uint64)
        cut = int(draw.integers(shared, union + 1))
        one, other = np.sort(everything[:cut]), np.sort(np.concatenate((everything[:shared], everything[cut:])))
        if min(len(one), len(other)) <= 12:
            assert np.isin(near_dedup.tiny_keys(one), near_dedup.tiny_keys(other)).any()


def test_tiny_texts(spark):
    """Texts of 7 and 8 words that share 3 of 4 shingles, and many that share one only."""
    rows = []
    for number in range(60):
        text = [f"t{number}x{place}" for place in range(8)]
        rows += [(2 * number, " ".join(text)), (2 * number + 1, " ".join(text[:7]))]
    rows += [(1000 + n, f"five words that all share {n}") for n in range(60)]
    rows += [(2000 + n, f"{n} b c d") for n in range(20)]
    check(frame_of(spark, rows), rows)
