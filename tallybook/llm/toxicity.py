"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into clauses, and the words of a clause are symbols: insult, threat verb, target,
negation, report, intent, other. Sequential transducers read them; each has states and, in every
state, one arc for each symbol of its input, with the next state and the symbols put out:

* ``insults`` puts out a pile after each insult that follows another;
* ``threats`` turns a threat verb within REACH words of an intent into a threat;
* ``negations`` marks insults, verbs and threats within REACH words after a negation as negated;
* ``reports`` marks those after a verb of reporting as reported, up to the end of the clause;
* ``targets`` puts out an aim for each of them that has a target within REACH words, whichever
  comes first, with the marks of what is aimed.

They are composed, the output of one being the input of the next, into one machine, whose states
are the reachable tuples of states. A weight is a vector with a place for each symbol that the
composition can put out. An arc weighs one at the place of each symbol it puts out, times the
lexical weight of the word where that is an insult or verb; weights along a path are added. The machine is
sequential, so a clause has one path. A clause without an insult or verb is not read.

The weights of a document's clauses are added up, and a logistic regression weighs each symbol:
how much less a negated or reported insult counts, or how much more an aimed one, is learned.

What the words mean is learned as well, beginning with short lists. Insults are words, and stems of 4 to 6
characters, that occur mostly in toxic documents. Words that stand within REACH words before insults
mostly in documents that are not toxic become negations; those further ahead in the clause, reports;
words around insults mostly in toxic documents become targets. The rows to learn from are split by a hash of the id:
three quarters teach the classes, the rest the regression, so the
regression sees the classes as it does on new texts. Both are fitted on at most SAMPLE
labelled rows, chosen by a hash of the id, which bounds what they can hold. Labels, language, source and id are not inputs
of a score.

A missing text is empty and scored like one. Rows without a label are scored and not
learned from; a document labelled twice is toxic if any label says so; labels other than 0
and 1 are left out. Without labels the grammar's own weights are used. Repeated rows are
scored each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallybook.llm.common import identified, remainder, small, written

#: Labelled rows learned from, at most.
SAMPLE = 40_000
#: Texts a learned word must occur in, and how many times likelier than in others.
LEAST_TEXTS = 6
LEAST_RATIO = 8.0
#: Least log likelihood ratio of a learned class against chance, twice (four standard errors).
LEAST_EVIDENCE = 16.0
STEMS = (4, 5, 6)
#: A stem is left to the word that makes up at least this share of its toxic texts.
ONE_WORD = 0.8
#: Words within which negations, intents and targets reach.
REACH = 4

INSULTS = {
    "idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash",
    "pathetic", "worthless", "disgusting", "clown", "dumb", "imbecile", "fool", "vermin",
    "idiota", "imbécil", "basura", "estúpido", "crétin", "imbécile", "ordure", "dummkopf",
    "abschaum", "trottel", "schwachkopf",
}
THREATS = {"kill", "hurt", "destroy", "attack", "burn", "töten", "tuer", "matar"}
TARGETS = {
    "you", "your", "they", "them", "he", "she", "him", "her", "these", "those", "people",
    "du", "dich", "ihr", "sie", "tu", "vous", "ils", "vosotros", "usted", "ellos",
}
NEGATIONS = {"not", "no", "never", "nor", "isn't", "aren't", "nicht", "kein", "nie", "ne", "pas", "jamais", "nunca"}
REPORTS = {"said", "says", "called", "wrote", "claimed", "quoted", "sagte", "nannte", "dit", "appelé", "dijo", "llamó"}
INTENTS = {"will", "gonna", "going", "i'll", "we'll", "shall", "werde", "werden", "vais", "allons", "voy", "vamos"}

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")

# ---- transducers -----------------------------------------------------------------------

#: Input symbols.
SYMBOLS = ("other", "insult", "verb", "target", "negation", "report", "intent")
#: Symbols with a lexical weight, once all marks are there: what it is, and how it is softened.
HEAVY = ("insult", "verb", "threat")
MARKS = ("", " negated", " reported")
Arcs = dict[tuple[Hashable, str], tuple[Hashable, tuple[str, ...]]]


@dataclass
class Transducer:
    """A sequential transducer; an arc leads from a state and a symbol to a state and symbols."""

    start: Hashable
    arcs: Arcs

    @classmethod
    def of(cls, start: Hashable, symbols: Iterable[str], step: Callable) -> Transducer:
        """All states that ``step``, from a state and a symbol, reaches."""
        arcs: Arcs = {}
        states, waiting = {start}, [start]
        symbols = list(symbols)
        while waiting:
            state = waiting.pop()
            for symbol in symbols:
                arc = arcs[state, symbol] = step(state, symbol)
                if arc[0] not in states:
                    states.add(arc[0])
                    waiting.append(arc[0])
        return cls(start, arcs)

    def outputs(self) -> set[str]:
        return {symbol for _, put in self.arcs.values() for symbol in put}

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one puts out."""

        def step(state, symbol):
            one, two = state
            one, put = self.arcs[one, symbol]
            out: tuple[str, ...] = ()
            for between in put:
                two, more = other.arcs[two, between]
                out += more
            return (one, two), out

        return Transducer.of((self.start, other.start), {symbol for _, symbol in self.arcs}, step)


def insults() -> Transducer:
    def step(seen, symbol):
        if symbol != "insult":
            return seen, (symbol,)
        return True, ("insult", "pile") if seen else ("insult",)

    return Transducer.of(False, SYMBOLS, step)


def threats(symbols: set[str]) -> Transducer:
    def step(left, symbol):
        if symbol == "pile":  # stands beside a word
            return left, (symbol,)
        if symbol == "intent":
            return REACH, ("other",)
        return max(0, left - 1), ("threat" if symbol == "verb" and left else symbol,)

    return Transducer.of(0, symbols, step)


def negations(symbols: set[str]) -> Transducer:
    def step(left, symbol):
        if symbol == "pile":
            return left, (symbol,)
        if symbol == "negation":
            return REACH, ("other",)
        return max(0, left - 1), (symbol + MARKS[1] if symbol in HEAVY and left else symbol,)

    return Transducer.of(0, symbols, step)


def reports(symbols: set[str]) -> Transducer:
    def step(reported, symbol):
        if symbol == "report":
            return True, ("other",)
        heavy = symbol.split()[0]
        return reported, (heavy + MARKS[2] if heavy in HEAVY and reported else symbol,)

    return Transducer.of(False, symbols, step)


def targets(symbols: set[str]) -> Transducer:
    """A state: words since a target, what waits for one, and for how many words."""

    def step(state, symbol):
        since, waiting, age = state
        if symbol == "pile":
            return state, (symbol,)
        since = 0 if symbol == "target" else min(since + 1, REACH + 1)
        age += 1
        if waiting is None or age > REACH:
            waiting, age = None, 0
        if symbol == "target":
            return (since, None, 0), () if waiting is None else (f"aim at {waiting}",)
        if symbol.split()[0] in HEAVY:
            if since <= REACH:
                return (since, None, 0), (symbol, f"aim at {symbol}")
            return (since, symbol, 0), (symbol,)
        return (since, waiting, age), ()

    return Transducer.of((REACH + 1, None, 0), symbols, step)


@cache
def machine() -> tuple[list[int], list[tuple[int, ...]], list[str]]:
    """The composition as tables: by state and symbol the next state and what is put out; what can be put out.

    States are numbered, a state's row begins at its number times the number of symbols.
    """
    whole = insults()
    for following in (threats, negations, reports, targets):
        whole = whole.then(following(whole.outputs()))
    kinds = [heavy + mark for heavy in HEAVY for mark in MARKS]
    put = ["pile", *kinds, *(f"aim at {kind}" for kind in kinds)]
    numbers = {whole.start: 0}
    for state, _ in whole.arcs:
        numbers.setdefault(state, len(numbers))
    follow, out = [0] * (len(numbers) * len(SYMBOLS)), [()] * (len(numbers) * len(SYMBOLS))
    for (state, symbol), (after, found) in whole.arcs.items():
        place = numbers[state] * len(SYMBOLS) + SYMBOLS.index(symbol)
        follow[place] = numbers[after] * len(SYMBOLS)
        out[place] = tuple(put.index(name) for name in found)
    return follow, out, put


# ---- grammar ---------------------------------------------------------------------------

PUT = ["pile"] + [
    before + heavy + mark for before in ("", "aim at ") for heavy in HEAVY for mark in MARKS
]
FEATURES = ("bias", "share", *PUT)
#: Weights of the features before anything is learned: plain ones, negated and reported ones.
_FIRST = {"bias": -3.0, "share": 1.0, "pile": 0.5, "insult": 2.5, "verb": 0.5, "threat": 2.5}
PRIOR = np.array(
    [_FIRST.get(name, 0.5 if name.startswith("aim at ") and name.split()[-1] in HEAVY else 0.2) for name in FEATURES]
)


@dataclass
class Grammar:
    """Symbols of words, lexical weights, and the weights of the features.

    ``lexicon`` holds words, ``stems`` beginnings of words; ``classes`` all symbols but insults and verbs.
    """

    lexicon: dict[str, float] = field(default_factory=lambda: {word: 2.0 for word in INSULTS})
    stems: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=lambda: {word: 0.5 for word in THREATS})
    classes: dict[str, str] = field(
        default_factory=lambda: {
            word: symbol
            for symbol, words in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("intent", INTENTS))
            for word in words
        }
    )
    weights: np.ndarray = field(default_factory=PRIOR.copy)

    def insult(self, word: str) -> float:
        if (weight := self.lexicon.get(word)) is not None:
            return weight
        for length in STEMS:
            if len(word) >= length and (weight := self.stems.get(word[:length])) is not None:
                return weight
        return 0.0

    def heavy_words(self, words: set[str]) -> dict[str, tuple[str, float]]:
        """The insults and threat verbs among a document's different words."""
        found = {word: ("insult", weight) for word in words if (weight := self.insult(word))}
        found |= {w: ("verb", self.threats[w]) for w in words & self.threats.keys() if w not in found}
        return found


def read(symbols: list[tuple[str, float]], total: np.ndarray) -> None:
    """Add the weight of a clause's path through the machine to ``total``."""
    follow, out, _ = machine()
    state = 0
    for symbol, weight in symbols:
        place = state + SYMBOLS.index(symbol)
        for number in out[place]:
            total[number] += weight if 0 < number <= len(HEAVY) * len(MARKS) else 1.0
        state = follow[place]


def features(text: str, grammar: Grammar) -> np.ndarray:
    """The description of a document by its matched clauses."""
    lowered = text.lower()
    words = _WORD.findall(lowered)
    heavy = grammar.heavy_words(set(words))
    total = np.zeros(len(PUT))
    if not heavy:
        return np.array([1.0, 0.0, *total])
    matched = 0
    for clause in _CLAUSE.split(lowered):
        found = _WORD.findall(clause)
        if not heavy.keys().isdisjoint(found):
            read([heavy.get(word) or (grammar.classes.get(word, "other"), 0.0) for word in found], total)
            matched += sum(word in heavy for word in found)
    return np.array([1.0, min(1.0, 10 * matched / len(words)), *np.log1p(total)])


def logit(text: str, grammar: Grammar) -> float:
    return float(features(text, grammar) @ grammar.weights)


def sigmoid(values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(values, -30, 30)))


def fit(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards PRIOR."""
    weights = PRIOR.copy()
    pull = np.eye(len(PRIOR))
    pull[0, 0] = 1e-3
    for _ in range(25):
        found = sigmoid(rows @ weights)
        slope = rows.T @ (found - labels) + pull @ (weights - PRIOR)
        bend = (rows * (found * (1 - found))[:, None]).T @ rows + pull
        step = np.linalg.solve(bend, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and stems of each text, once per text, with how many toxic and other texts."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(_WORD.findall(text.lower()))
            terms = {f"{word} " for word in words}
            for length in STEMS:
                terms.update(word[:length] for word in words if len(word) >= length)
            for term in terms:
                counts.setdefault(term, [0, 0])[toxic] += 1
        if len(counts) > 500_000:
            yield _counted(counts)
            counts = {}
    yield _counted(counts)


def _counted(counts: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(counts), pa.string()),
            pa.array([n[1] for n in counts.values()], pa.int64()),
            pa.array([n[0] for n in counts.values()], pa.int64()),
        ],
        names=["term", "toxic", "other"],
    )


def _contexts(grammar: Grammar):
    """Words before, far before and after insults and verbs, once per text, with its label; the
    empty word stands for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lowered = text.lower()
                heavy = grammar.heavy_words(set(_WORD.findall(lowered)))
                met = {"text "} if heavy else set()
                for clause in _CLAUSE.split(lowered) if heavy else ():
                    found = _WORD.findall(clause)
                    for place in (n for n, word in enumerate(found) if word in heavy):
                        near = max(0, place - REACH)
                        met.update(f"near {word}" for word in found[near:place] if word not in heavy)
                        met.update(f"far {word}" for word in found[:near] if word not in heavy)
                        met.update(f"after {word}" for word in found[place + 1 : place + 1 + REACH] if word not in heavy)
                for term in met:
                    counts.setdefault(term, [0, 0])[toxic] += 1
            if len(counts) > 500_000:
                yield _counted(counts)
                counts = {}
        yield _counted(counts)

    return run


def learned_classes(teaching: DataFrame, grammar: Grammar) -> dict[str, str]:
    """Symbols of words that soften or aim, from text and toxic."""
    found = written(
        teaching.select("text", "toxic")
        .mapInArrow(_contexts(grammar), "term string, toxic bigint, other bigint")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")),
        "contexts",
    )
    whole = found.where("term = 'text '").first()
    if whole is None or not whole["toxic"] or not whole["other"]:
        return {}
    ratio = (F.col("toxic") + 0.5) / (whole["toxic"] + 1) / ((F.col("other") + 0.5) / (whole["other"] + 1))
    both = (F.col("toxic") + F.col("other")) / (whole["toxic"] + whole["other"])

    def surprise(label: str) -> Column:
        """n log(n / expected)"""
        n = F.col(label)
        return F.when(n > 0, n * F.log(n / (both * whole[label]))).otherwise(0.0)

    told = found.withColumn("ratio", ratio).where(
        2 * (surprise("toxic") + surprise("other")) >= LEAST_EVIDENCE
    )
    told = told.where(
        ((F.col("other") >= LEAST_TEXTS) & (F.col("ratio") <= 1 / LEAST_RATIO))
        | ((F.col("toxic") >= LEAST_TEXTS) & (F.col("ratio") >= LEAST_RATIO))
    )
    symbols: dict[str, str] = {}
    # What also softens from far ahead reports; what softens from nearby alone negates.
    for row in sorted(told.collect(), key=lambda row: row["term"].startswith("far "), reverse=True):
        place, word = row["term"].split(" ", 1)
        if row["ratio"] > 1:
            symbol = "target"
        elif place == "after":
            continue
        else:
            symbol = "report" if place == "far" else "negation"
        symbols.setdefault(word, symbol)
    return symbols


def labelled(documents: DataFrame, labels: DataFrame, rest: int, divisor: int) -> DataFrame:
    """At most SAMPLE labelled documents to learn from: doc_id, text, toxic; each text once."""
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)")
        .where(remainder(divisor) != rest)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE)
    )
    rows = identified(documents).join(F.broadcast(chosen), "doc_id")
    rows = written(rows.select("doc_id", "text", "text_hash", "toxic"), "labelled")
    first = rows.groupBy("text_hash", "toxic").agg(F.min("doc_id").alias("doc_id"))
    return rows.join(F.broadcast(first), ["text_hash", "toxic", "doc_id"]).select(
        "doc_id", "text", "toxic"
    )


def learn(documents: DataFrame, labels: DataFrame, rest: int = 0, divisor: int = 5) -> Grammar:
    """A grammar from the labelled rows whose id has another remainder than ``rest``."""
    rows = labelled(documents, labels, rest, divisor).withColumn(
        "quarter", F.pmod(F.xxhash64("doc_id"), F.lit(4))
    )
    grammar = Grammar()
    teaching = rows.where("quarter > 0")
    sizes = {row["toxic"]: row["count"] for row in teaching.groupBy("toxic").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if toxic and other:
        ratio = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("other") + 0.5) / (other + 1))
        terms = (
            teaching.select("text", "toxic")
            .mapInArrow(_terms, "term string, toxic bigint, other bigint")
            .groupBy("term")
            .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
            .where(F.col("toxic") >= LEAST_TEXTS)
            .withColumn("ratio", ratio)
            .where(F.col("ratio") >= LEAST_RATIO)
            .collect()
        )
        most = {}
        for row in terms:
            if row["term"].endswith(" "):
                for length in STEMS:
                    stem = row["term"][:-1][:length]
                    most[stem] = max(most.get(stem, 0), row["toxic"])
        for row in terms:
            term, weight = row["term"], min(3.0, math.log(row["ratio"]) / 2)
            if term.endswith(" "):
                grammar.lexicon[term[:-1]] = weight
            elif most.get(term, 0) < ONE_WORD * row["toxic"]:
                grammar.stems[term] = weight
        # A word of the lists keeps its symbol.
        grammar.classes = learned_classes(teaching, grammar) | grammar.classes
    described = rows.where("quarter = 0").select("text", "toxic").mapInArrow(
        _describe(grammar), "features array<double>, toxic bigint"
    )
    # Equal descriptions are counted, which keeps what is fetched short.
    found = described.groupBy("features", "toxic").count().collect()
    if len({row["toxic"] for row in found}) == 2:
        x = np.repeat([row["features"] for row in found], [row["count"] for row in found], axis=0)
        y = np.repeat([float(row["toxic"]) for row in found], [row["count"] for row in found])
        grammar.weights = fit(x, y)
    return grammar


def _describe(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(features(text, grammar)) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.float64())), batch.column(1).cast(pa.int64())],
                names=["features", "toxic"],
            )

    return run


def scored(documents: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, text_hash, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [features(text, grammar) @ grammar.weights for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sigmoid(np.array(found, float)))],
                names=["doc_id", "text_hash", "score"],
            )

    return identified(documents).mapInArrow(run, "doc_id bigint, text_hash bigint, score double")


def toxicity(documents: DataFrame, labels: DataFrame, rest: int = 0, divisor: int = 5) -> DataFrame:
    """doc_id, text_hash, held_out, score, predicted of every row."""
    grammar = learn(documents, labels, rest, divisor)
    return scored(documents, grammar).select(
        "doc_id",
        "text_hash",
        (remainder(divisor) == rest).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(documents: DataFrame, grammar: Grammar) -> DataFrame:
    """All columns of the rows that are not predicted toxic."""
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column(place).to_pylist()
            found = sigmoid(np.array([features(t or "", grammar) @ grammar.weights for t in texts]))
            yield batch.filter(pa.array(found < 0.5, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
