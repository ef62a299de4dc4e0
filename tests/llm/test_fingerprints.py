from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from tallybook.llm import fingerprints


def shingle_set(text):
    found = text.split()
    return {" ".join(found[at : at + 5]) for at in range(max(1, len(found) - 4))} if found else set()


def test_edited_texts_and_likeness(spark, distinct):
    rows = sorted(((i, t or "") for i, t in distinct), reverse=True)
    frame = spark.createDataFrame(distinct, "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: r for r in fingerprints.fingerprints(frame).collect()}
    assert found.keys() == dict(rows).keys()
    for place, (doc_id, text) in enumerate(rows):
        following = rows[(place + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = found[doc_id]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(row.sketch) <= len(shingle_set(text)) and row.sketch == sorted(set(row.sketch))
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert found[62].near_edited > 0.3 and found[62].near_next < 0.05
    long = shingle_set(dict(distinct)[62])
    assert abs(len(found[62].sketch) * fingerprints.SCALE / len(long) - 1) < 0.15
    assert found[50].sketch == found[51].sketch == found[52].sketch == []


def test_sketches_merge(spark):
    rows = [("a b c d e f g h", "x y z"), ("", "a b"), ("p q", "p q"), ("", "")]
    frame = spark.createDataFrame(rows, "one string, other string")
    hashes = lambda text: fingerprints.sketch(F.col(text))
    merged = fingerprints.merged(hashes("one"), hashes("other"))
    for row in frame.select(hashes("one").alias("a"), hashes("other").alias("b"), merged.alias("m")).collect():
        both = sorted(set(row.a) | set(row.b))
        assert row.m == both and all(h < fingerprints.THRESHOLD for h in both)


def contained(one, other):
    a, b = shingle_set(one), shingle_set(other)
    return len(a & b) / min(len(a), len(b)) if a and b else float(not a and not b)


def recomputed(one, other):
    """Likeness of two sets of retained hashes."""
    return len(set(one) & set(other)) / min(len(one), len(other)) if one and other else float(not one and not other)


def unequal_rows():
    """Notes wholly or partly contained in the long text that follows them."""
    draw = random.Random(9)
    rows = []
    for number in range(96):
        long = [f"w{draw.randrange(10**6)}" for _ in range(3000)]
        size = (1, 3, 5, 8, 14, 24, 44, 150)[number % 8]
        at = draw.randrange(2000)
        note = long[at : at + size]
        if number % 3 == 0:
            note = note[: size // 2] + [f"x{draw.randrange(10**6)}" for _ in range(size - size // 2)]
        rows += [(2 * number + 1, " ".join(note)), (2 * number, " ".join(long))]
    return rows


def test_likeness_is_that_of_the_returned_fingerprints(spark):
    rows = unequal_rows()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: r for r in fingerprints.fingerprints(frame).collect()}
    for doc_id, _ in rows:
        row = found[doc_id]
        following = found[(doc_id - 1) % len(rows)]
        assert abs(row.near_edited - recomputed(row.sketch, row.edited_sketch)) < 1e-12
        assert abs(row.near_next - recomputed(row.sketch, following.sketch)) < 1e-12


def test_containment_lies_within_its_bounds(spark):
    rows = unequal_rows()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: r for r in fingerprints.fingerprints(frame).collect()}
    texts, missed = dict(rows), 0
    for doc_id, text in rows:
        following = texts[(doc_id - 1) % len(rows)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = found[doc_id]
        for bounds, near, other in ((row.edited_bounds, row.near_edited, edited), (row.next_bounds, row.near_next, following)):
            assert 0 <= bounds.low <= bounds.high <= 1
            missed += not bounds.low - 1e-9 <= contained(text, other) <= bounds.high + 1e-9
            if row.sketch and contained(text, other) == 1 and doc_id % 2:
                assert near == 1  # whatever stands in a text is found in it
        if len(text.split()) > 1000:
            assert abs(row.near_edited - contained(text, edited)) < 0.06
            assert row.edited_bounds.high - row.edited_bounds.low < 0.12
    assert missed <= 0.08 * 2 * len(rows)


def test_null_and_repeated_ids_and_empty_tables(documents, nasty, clashing, empty):
    found = fingerprints.fingerprints(documents)
    assert found.count() == len(nasty)
    same = found.where("doc_id = 70").groupBy("n_chars").agg(F.countDistinct("edited_sha256").alias("n"))
    assert [row.n for row in same.collect()] == [1, 1]
    assert fingerprints.fingerprints(empty).count() == 0
    assert fingerprints.fingerprints(clashing).count() == 6


def test_no_python_in_the_plan(documents):
    plan = fingerprints.fingerprints(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
