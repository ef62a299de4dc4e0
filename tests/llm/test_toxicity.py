from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tallybook.llm import toxicity

from .conftest import words


@pytest.fixture(scope="module")
def taught(spark):
    """Toxic texts hold a made-up insult; some labels are missing, null or doubled."""
    draw = random.Random(1)
    rows, labels = [], []
    for number in range(400):
        toxic = number % 4 == 0
        text = words(draw, 40).split(" ")
        for _ in range(3 if toxic else 0):
            text.insert(draw.randrange(40), "grobiann" + draw.choice(["a", "o", "es", "chen"]))
        rows.append((number, " ".join(text)))
        if number % 10:
            labels.append((number, 1, int(toxic)))
    labels += [(None, 1, 1), (1, 1, None), (4, 1, 1), (10**9, 0, 1)]
    rows += [(None, "no id"), (500, None), (501, "")]
    return (
        spark.createDataFrame(rows, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
        dict(rows),
    )


def test_held_out_rows_are_told_apart(taught):
    frame, labels, texts = taught
    found = toxicity.toxicity(frame, labels).collect()
    assert len(found) == len(texts)
    for row in found:
        name = "" if row.doc_id is None else str(row.doc_id)
        assert row.held_out == (zlib.crc32(name.encode()) % 5 == 0)
        assert 0 <= row.score <= 1 and row.predicted == (row.score >= 0.5)
    wrong = [r for r in found if r.doc_id is not None and r.doc_id < 400 and r.predicted != (r.doc_id % 4 == 0)]
    assert len(wrong) <= 4


def test_without_labels_the_grammar_speaks(spark, taught, empty):
    frame, labels, _ = taught
    none = labels.limit(0)
    found = toxicity.toxicity(spark.createDataFrame([(1, "You are a stupid idiot."), (2, "A fine day.")], "doc_id bigint, text string"), none)
    assert {r.doc_id: r.predicted for r in found.collect()} == {1: 1, 2: 0}
    assert toxicity.toxicity(empty, none).count() == 0


def test_clauses_not_words():
    grammar = toxicity.Grammar()

    def weight(text):
        return toxicity.logit(text, grammar)

    plain, nothing = weight("that idiot came"), weight("")
    assert weight("you idiot came") > plain and weight("that idiot and you came") > plain
    assert weight("he is not an idiot") < weight("he is an idiot")
    assert weight("she said idiot") < weight("she thinks idiot")
    assert weight("never again. that idiot came") == plain  # negation ends with its clause
    assert weight("I will hurt you") > weight("it may hurt you") > nothing == weight("you said no")


def test_the_composition_reads_as_its_parts_in_turn():
    """What the tables of the composed machine put out, against the transducers run one after another."""
    draw = random.Random(7)
    _, _, put = toxicity.machine()
    assert put == toxicity.PUT
    chain = [toxicity.insults()]
    for following in (toxicity.threats, toxicity.negations, toxicity.reports, toxicity.targets):
        chain.append(following(chain[-1].outputs()))
    for _ in range(300):
        clause = [draw.choice(toxicity.SYMBOLS) for _ in range(draw.randint(0, 25))]
        found = list(clause)
        for transducer in chain:
            state, read = transducer.start, []
            for symbol in found:
                state, out = transducer.arcs[state, symbol]
                read += out
            found = read
        total = np.zeros(len(put))
        toxicity.read([(symbol, 2.0) for symbol in clause], total)
        weights = [found.count(name) * (2.0 if 0 < n <= 9 else 1.0) for n, name in enumerate(put)]
        assert total.tolist() == weights and set(found) <= set(put)


def test_aims_are_found_on_both_sides_within_reach():
    def aims(*symbols):
        total = np.zeros(len(toxicity.PUT))
        toxicity.read([(symbol, 1.0) for symbol in symbols], total)
        return {name: n for name, n in zip(toxicity.PUT, total) if n}

    far = ["other"] * toxicity.REACH
    assert aims("target", *far[1:], "insult") == {"insult": 1, "aim at insult": 1}
    assert aims("insult", *far[1:], "target") == {"insult": 1, "aim at insult": 1}
    assert aims("target", *far, "insult") == aims("insult", *far, "target") == {"insult": 1}
    assert aims("negation", "insult", "target", "insult") == {
        "insult negated": 2, "aim at insult negated": 2, "pile": 1
    }
    assert aims("report", *far, *far, "intent", "verb") == {"threat reported": 1}


def planted(seed, count):
    """Insults in all texts, as often in either half; only how they stand in their clause differs."""
    draw = random.Random(seed)
    rows = []
    for number in range(count):
        toxic = number % 2
        insult = draw.choice(["idiot", "moron", "fool", "clown"])
        if toxic:
            clause = draw.choice(["you are an absolute {}", "what a {} you are", "these people are {} types", "i think the {} knows"])
        else:
            clause = draw.choice(
                ["you are not an absolute {}", "she said you are a {}", "hardly any {} came", "allegedly the man on the old bridge over there was a {}"]
            )
        text = [words(draw, draw.randint(5, 30)), clause.format(insult), words(draw, draw.randint(5, 30))]
        rows.append((number, ". ".join(text), toxic))
    return rows


def area(pairs):
    """Probability that a toxic text scores higher than another one."""
    ones, zeros = [s for s, t in pairs if t], [s for s, t in pairs if not t]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_planted_clauses_that_a_word_count_cannot_tell_apart(spark):
    """Hardly and allegedly are in no list: they are learned to negate and to report."""
    rows = planted(3, 2000)
    documents = spark.createDataFrame([row[:2] for row in rows], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(row[0], row[2]) for row in rows], "doc_id bigint, toxic int")
    grammar = toxicity.learn(documents, labels)
    assert grammar.classes["hardly"] == "negation" and grammar.classes["allegedly"] == "report"
    found = [(r.score, rows[r.doc_id][2]) for r in toxicity.toxicity(documents, labels).collect() if r.held_out]
    counted = [(sum(text.count(w) for w in toxicity.INSULTS), toxic) for _, text, toxic in rows]
    assert area(found) > 0.97 and 0.4 < area(counted) < 0.6
    assert sum((score >= 0.5) == toxic for score, toxic in found) > 0.95 * len(found)


def test_clashing_repeated_and_long_rows(spark, clashing):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, None)], "doc_id bigint, toxic int")
    assert toxicity.toxicity(clashing, labels).count() == 6
    long = "a fine day. " * 20_000
    rows = [(1, long), (1, long), (1, long + "you idiot"), (2, long), (2, "you idiot")]
    found = toxicity.toxicity(spark.createDataFrame(rows, "doc_id bigint, text string"), labels.limit(0)).collect()
    assert len(found) == 5 and [r.predicted for r in found if r.doc_id == 2].count(1) == 1
    assert len({r.score for r in found if r.doc_id == 1}) == 2


def test_rejected_rows_go_with_all_columns_kept(clashing, spark):
    rows = [(1, "stupid idiot, you moron", "x"), (2, None, "y"), (3, "good day", "z")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    left = toxicity.drop_toxic(frame, toxicity.Grammar())
    assert left.columns == frame.columns and [r.doc_id for r in left.collect()] == [2, 3]
    assert toxicity.drop_toxic(clashing, toxicity.Grammar()).count() == 6
