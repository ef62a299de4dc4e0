"""Small tables with everything that may go wrong in them."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns with names the operators use themselves.
CLASHING = (
    "doc_id bigint, text string, digest string, row_id string, text_hash string, ord string, "
    "band string, node string, rank string, key string, part string, place string, word string"
)


@pytest.fixture(autouse=True)
def importable(spark):
    """Python workers find the package wherever the tests were started."""
    root = str(Path(__file__).resolve().parents[2])
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def words(draw: random.Random, count: int) -> str:
    return " ".join(draw.choice(["alpha", "Beta", "gamma", "delta,", "épée", "x", "zeta\n"]) + str(draw.randint(0, 99)) for _ in range(count))


def nasty_rows(seed: int = 5) -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, nulls, blanks, repeats, one long text."""
    draw = random.Random(seed)
    base = words(draw, 60)
    passage = words(draw, 30)
    rows: list[tuple[int | None, str | None]] = [(10, base), (3, base), (7, base.upper())]
    for number in range(20, 32):
        edited = base.split(" ")
        edited[draw.randrange(60)] = f"edit{number}"
        rows.append((number, " ".join(edited)))
    for number in range(40, 48):
        rows.append((number, f"{words(draw, 20)} {passage} {words(draw, 20)}"))
    rows += [(50, None), (51, ""), (52, "   \n\t "), (53, "one two"), (54, "one  two"), (55, "a b c d e")]
    rows += [(60, "ab" * 300), (61, "same " * 80), (62, words(draw, 4000))]
    rows += [(70, base), (70, base), (70, "other text of the same id, long enough to count " * 3)]
    rows += [(None, base), (None, "text without an id " * 9), (-5, "naïve ▁ œuvre 中文 \U0001f600 <|endoftext|> </s> \x00 end")]
    draw.shuffle(rows)
    return rows


def frame_of(spark, rows):
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nasty():
    return nasty_rows()


@pytest.fixture(scope="session")
def documents(spark, nasty):
    return frame_of(spark, nasty).cache()


@pytest.fixture(scope="session")
def distinct(nasty):
    """Rows with ids of their own."""
    rows, seen = [], set()
    for doc_id, text in nasty:
        if doc_id is not None and doc_id not in seen:
            seen.add(doc_id)
            rows.append((doc_id, text))
    return rows


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(spark):
    rows = [(n, f"some text number {n % 2} " * 8, *["?"] * 11) for n in range(6)]
    return spark.createDataFrame(rows, CLASHING)
