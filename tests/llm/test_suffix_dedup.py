from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tallybook.llm import suffix_dedup

from .conftest import frame_of, words


def brute_force(rows):
    """doc_id to (bytes, removed, spans, sha) for distinct ids, window by window."""
    seen, found = set(), {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for start in range(len(data) - 99):
            window = data[start : start + 100]
            if window in seen:
                gone[start : start + 100] = True
            seen.add(window)
        left = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        found[doc_id] = (len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return found


def result(frame):
    return {
        r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
        for r in suffix_dedup.remove_repeats(frame).collect()
    }


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats_are_those_of_every_window(spark, distinct, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1 if hot == 1 else 64)
    assert result(frame_of(spark, distinct)) == brute_force(distinct)


def test_passages_at_random_places(spark):
    draw = random.Random(9)
    passages = [words(draw, n) for n in (12, 15, 40, 90)] + ["=" * 250, "abc" * 70, "é" * 120]
    rows = []
    for number in range(60):
        parts = []
        for _ in range(draw.randint(1, 5)):
            parts.append(words(draw, draw.randint(0, 9)))
            passage = draw.choice(passages)
            start = draw.randrange(len(passage) // 2)
            parts.append(passage[start : start + draw.randint(10, 300)])
        rows.append((number * 3, "".join(parts)))
    frame = frame_of(spark, rows)
    assert result(frame) == brute_force(rows)
    left = {r.doc_id: r for r in suffix_dedup.drop_repeats(frame).collect()}
    for doc_id, (size, removed, _, digest) in brute_force(rows).items():
        if removed == size and size:
            assert doc_id not in left
        elif removed and left[doc_id].text.isascii():
            assert hashlib.sha256(left[doc_id].text.encode()).hexdigest() == digest
            assert left[doc_id].n_chars == len(left[doc_id].text)


def test_null_and_repeated_ids(documents, nasty):
    found = suffix_dedup.remove_repeats(documents).collect()
    assert len(found) == len(nasty)
    # Missing ids come last: the copy of the base text without one goes.
    assert sorted(r.n_removed == r.n_bytes for r in found if r.doc_id is None) == [False, True]
    left = suffix_dedup.drop_repeats(documents)
    assert left.columns == documents.columns
    assert {r.doc_id for r in left.collect()} >= {3, 50, 51, 52, 62}


def test_empty_and_clashing(empty, clashing):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.drop_repeats(clashing).columns == clashing.columns
    assert suffix_dedup.drop_repeats(clashing).count() <= 6


def test_deep_shallow_orders_like_sorting():
    draw = np.random.default_rng(4)
    for size in (1, 2, 50, 400):
        groups = draw.integers(0, 5, size)
        rows = draw.integers(0, 2, (size, 72)).astype(np.uint8)
        rows[draw.random(size) < 0.6, :60] = 1
        rows[draw.random(size) < 0.3] = 0
        order, common = suffix_dedup.deep_shallow(groups, rows)
        keys = [(int(groups[r]), rows[r].tobytes()) for r in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(size))
        for place in range(1, size):
            (g, a), (h, b) = keys[place - 1], keys[place]
            shared = next((n for n in range(72) if a[n] != b[n]), 72) if g == h else -1
            assert common[place] == shared


def test_runs_of_a_common_anchor_are_dealt_out(spark, monkeypatch):
    """A passage in all texts: at its edge all runs differ, and no piece of the window takes them all."""
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
    draw = random.Random(6)
    passage = words(draw, 20)
    rows = [(n, f"{words(draw, 15)} {passage} {words(draw, 15)}") for n in range(200)]
    frame = frame_of(spark, rows)
    texts = frame.select("doc_id", "text").toDF("ord", "text")
    assert suffix_dedup.common_anchors(texts).count() > 0
    assert result(frame) == brute_force(rows)
