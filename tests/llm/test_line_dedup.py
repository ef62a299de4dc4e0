"""Line dedup against plain counting, and the perfect hash by itself."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tallybook.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def expected(rows, least_chars=1, least_documents=10):
    def key(line):
        found = lowered(line.strip(BLANK))
        return found if len(found) >= least_chars else None

    split = [(i, (t or "").split("\n")) for i, t in rows]
    counts = Counter(k for _, lines in split for k in {key(line) for line in lines} if k is not None)
    result = []
    for i, lines in split:
        kept = [line for line in lines if key(line) is None or counts[key(line)] < least_documents]
        result.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(result, key=lambda row: tuple((v is not None, v) for v in row))


def lined_rows():
    draw = random.Random(3)
    common = ["Subscribe now", "© 2024 Élan", "x", "a b\tc", "İ"]
    rows = []
    for number in range(60):
        lines = [f"line {number} {place}" for place in range(draw.randint(0, 5))]
        for line in common:
            if draw.random() < 0.3:
                lines.insert(draw.randint(0, len(lines)), draw.choice([line, f"  {line.upper()}\r", f"\t{line}"]))
        rows.append((number, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n \n"), (103, "Subscribe now\n" * 3000), (104, "Élan x\nx")]
    rows += [(105, "twice\nSubscribe now")] * 3 + [(None, "x\nSubscribe now\nx"), (None, None), (105, "other\nx")]
    return rows


@pytest.mark.parametrize("least_chars, least_documents", [(1, 10), (1, 1), (3, 5), (0, 3), (1, 300)])
def test_matches_plain_counting(spark, rows_of, least_chars, least_documents):
    rows = lined_rows()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = line_dedup.line_counts(frame, least_chars, least_documents)
    assert rows_of(found) == expected(rows, least_chars, least_documents)


def test_nasty_rows(documents, nasty, rows_of):
    assert rows_of(line_dedup.line_counts(documents, 1, 2)) == expected(nasty, 1, 2)


def test_many_shards_and_blocks(spark, rows_of, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 5)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    rows = lined_rows() * 2
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(16)
    assert rows_of(line_dedup.line_counts(frame)) == expected(rows)


def test_drop_keeps_rows_and_columns(spark, clashing, rows_of):
    out = line_dedup.drop_lines(clashing, 1, 2)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    assert {row["text"] for row in out.collect()} == {""}
    rows = lined_rows()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = rows_of(line_dedup.drop_lines(frame))
    assert kept == sorted(((i, t) for i, _, _, t in expected(rows)), key=lambda row: tuple((v is not None, v) for v in row))


def test_empty(empty):
    assert line_dedup.line_counts(empty).collect() == []
    assert line_dedup.drop_lines(empty).collect() == []


@pytest.mark.parametrize("count", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal(count):
    draw = np.random.default_rng(count)
    high = draw.integers(0, 2**64, count, np.uint64)
    low = draw.integers(0, 2**64, count, np.uint64)
    high[: count // 2] = 7  # half of a digest may be shared
    levels, index = line_dedup.build(high, low)
    assert sorted(index.tolist()) == list(range(count))
    assert (line_dedup.index_of(levels, high, low) == index).all()
    assert sum(len(level) for level in levels) * 8 <= 6 * count + 64 * len(levels)
