from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallybook.llm import exact_dedup


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("share", [1 / 4096, 0.2, 2.0])
def test_groups_are_those_of_equal_texts(documents, nasty, share, monkeypatch):
    """With all, some and no groups treated as frequent."""
    monkeypatch.setattr(exact_dedup, "SHARE", share)
    groups = {}
    for doc_id, text in nasty:
        groups.setdefault(lowered(text), []).append(doc_id)
    found = exact_dedup.exact_duplicates(documents).withColumn("hex", F.lower(F.hex("digest"))).collect()
    expected = Counter(
        (i, max((d for d in same if d is not None), default=None), len(same), hashlib.sha256(t.encode()).hexdigest())
        for t, same in groups.items()
        for i in same
    )
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.hex) for r in found) == expected
    kept = Counter(r.hex for r in found if r.kept)
    assert len(kept) == len(groups) and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_one_row_of_each_group_is_left_with_its_columns(documents, nasty, clashing, empty):
    left = exact_dedup.drop_exact_duplicates(documents)
    assert left.columns == documents.columns
    texts = [lowered(row.text) for row in left.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {lowered(t) for _, t in nasty}
    assert exact_dedup.drop_exact_duplicates(clashing).count() == 2
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_null_and_empty_of_one_id_are_the_same_text(spark):
    rows = [(1, None), (1, ""), (1, None), (2, "a"), (2, "A"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert exact_dedup.exact_duplicates(frame).where("kept").count() == 2
    left = exact_dedup.drop_exact_duplicates(frame).collect()
    assert sorted((row.doc_id, lowered(row.text)) for row in left) == [(1, ""), (2, "a")]


def test_a_summary_misses_no_frequent_digest():
    counts = {bytes([n]): 1 for n in range(50)} | {b"often": 40}
    left, cut = exact_dedup.shrink(counts, 5)
    assert len(left) <= 5 and left[b"often"] + cut == 40
    assert cut <= sum(counts.values()) / 6
