"""Collocations against plain counting, and the walk over cut streams."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from tallybook.llm import collocations as c

SCHEMA = "doc_id bigint, text string, lang string, n string, home string"


def lowered(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)


def expected(rows, least, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text or "")):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for size in range(1, 5):
                for place in range(len(words) - size + 1):
                    counts[lang][tuple(words[place : place + size])] += 1
    result = []
    for lang, own in counts.items():
        found = []
        often = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        covered = set()
        for longer, f in often.items():
            for size in range(2, len(longer)):
                for place in range(len(longer) - size + 1):
                    part = longer[place : place + size]
                    if 100 * f >= 80 * own[part]:
                        covered.add(part)
        for phrase, a in often.items():
            if phrase not in covered:
                score, _, l, r = min(
                    (2000000 * a // (own[phrase[:k]] + own[phrase[k:]]), k, own[phrase[:k]], own[phrase[k:]])
                    for k in range(1, len(phrase))
                )
                found.append((-score, -a, " ".join(phrase).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(result)


def prose(count=300, seed=1):
    draw = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "\x01x", "é", "los", "Ångström", "a"]
    rows = []
    for _ in range(count):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b", "\x1c"]) for _ in range(draw.randint(0, 40)))
        if draw.random() < 0.5:
            text += " new york city hall " * draw.randint(1, 3)
        rows.append((draw.choice(["en", "en", "en", "de", None, "und"]), text))
    return rows + [("fr", None), ("fr", ""), ("xx", " . , \t")]


def frame(spark, rows, parts=5):
    full = [(n, text, lang, "?", "?") for n, (lang, text) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


@pytest.mark.parametrize("least, top", [(1, 2000), (5, 2000), (5, 7), (30, 2000)])
def test_matches_plain_counting(spark, rows_of, least, top):
    rows = prose()
    assert rows_of(c.collocations(frame(spark, rows), least, top)) == expected(rows, least, top)


def test_small_chunks_and_filter(spark, rows_of, monkeypatch):
    """Texts in sections, a bitmap that is full, streams cut within the phrases of one word."""
    monkeypatch.setattr(c, "CHUNK_BYTES", 40)
    monkeypatch.setattr(c, "FILTER_BITS", c.BUCKET_BITS)
    monkeypatch.setattr(c, "BITS_EACH", 1)
    monkeypatch.setattr(c, "PART_ROWS", 10)
    rows = prose(150, 2) + [("en", "the new york of " * 300), ("en", "x" * 500 + " the the the")]
    assert rows_of(c.collocations(frame(spark, rows), 2)) == expected(rows, 2)


def test_nasty_rows(documents, nasty, rows_of):
    assert rows_of(c.collocations(documents, 3)) == expected([("en", t) for _, t in nasty], 3)


def test_clashing_columns_and_empty(spark, clashing, empty, rows_of):
    from pyspark.sql import functions as F

    found = c.collocations(clashing.withColumn("lang", F.lit("a b")).withColumn("phrase", F.lit("?")), 2)
    texts = [(f"some text number {n % 2} " * 8) for n in range(6)]
    assert rows_of(found) == expected([("a b", t) for t in texts], 2)
    assert c.collocations(empty).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_walk_over_cuts_equals_the_whole(size):
    draw = random.Random(size)
    counts = Counter()
    for _ in range(2000):
        words = [draw.choice([b"a", b"a", b"b", b"c"]) for _ in range(4)]
        for end in range(1, 5):
            counts[draw.choice([b"x", b"y"]), tuple(words[:end])] += 1
    for (lang, words), n in list(counts.items()):
        for end in range(1, len(words)):
            counts[lang, words[:end]] += n
    rows = sorted((lang, list(words), n, 0) for (lang, words), n in counts.items())
    parts = [rows[first : first + size] for first in range(0, len(rows), size)]
    summaries = []
    for number, part in enumerate(parts):
        _, _, before, opened = c.walk(part, [])
        summaries.append({"part": number, "first_lang": part[0][0], "first": part[0][1], "last_lang": part[-1][0],
                          "last": part[-1][1], "open": opened, "before": before})
    handed = c.hand_over(summaries)
    sides, extended = [], []
    for number, part in enumerate(parts):
        own, most, _, _ = c.walk(part, handed[number][0])
        for depth, later in enumerate(handed[number][1]):
            if later:
                place = [row[:2] for row in part].index((part[-1][0], part[-1][1][: depth + 1]))
                most[place] = max(most[place], later)
        sides += own
        extended += most
    for row, own, most in zip(rows, sides, extended):
        lang, words = row[0], tuple(row[1])
        assert own == [counts[lang, words[:end]] for end in range(1, len(words))]
        longer = [n for (other, more), n in counts.items() if other == lang and more[:-1] == words]
        assert most == max(longer, default=0)
