"""A hashed maximum-entropy language model with a class-factored softmax.

The probability of a word given the words before it is

    P(class | history) * P(leaf | class, history) * P(word | leaf).

The first two are softmaxes over sums of weights, one weight row per active feature, looked
up by a hashed bucket of the history: the word before (n-gram), the class of the word
before that (skip), both hashed together, and a bias. These are a model of fixed size, which the
driver holds. To its sums are added weights of the hashed word before and of the hashed pair of
words before, in buckets whose number grows with the training tokens; they are tables. A leaf
is one word for the frequent words of a class; a leaf of several words shares its
probability out by their counts.

1. Words are counted over all training texts. The FREQUENT commonest are known to every
   task; all others form one rare leaf, whose counts are met by a join. The texts' tokens are written
   once as numbers, with the hashes of rare ones and a number for each row; all further steps read these.
2. Words get classes by clustering what stands next to them, counted over all training texts.
3. The counts of (history bucket, outcome) over all training texts are all that the
   gradient of the log-likelihood needs. They are written in blocks of a bounded size.
   Each gradient update is a Spark job over the blocks: a task returns observed minus expected
   counts of its features, the driver adds them up and moves the weights, which are of
   fixed size too.
4. Counts of (hashed history, outcome) are dealt by bucket, a part of the buckets to a task, which
   makes HASHED_UPDATES gradient updates of its buckets' weights, with the model of fixed size as
   the start and the prior, SLICE histories at a time. Of a bucket, distinct cells are merged first in several
   tasks where its word has more tokens than a part. The counts of all parts are written as a table.
5. Texts are scored in numpy batches: their tokens are dealt to the parts of their buckets, fitted there,
   and summed by text, first over a part and a task, packed, then over all. Tokens after a common word go to several tasks, each with a
   copy of that bucket's counts, from which it finds the same weights.

A token is a word or the end of a text. Among the rare words an unknown one is one outcome,
with the share of words met once (Good-Turing). All outcomes sum to one.

A missing text is empty: its end alone. Repeated rows are rows of their own. A missing id has
the remainder of the empty text. Without training rows every token is unknown and the
score is that of the base. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import copy
import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F

from tallybook.llm.common import identified, in_batches, remainder, texts_as_bytes, written

#: Words every task knows; of these, those that get a class by what stands next to them.
FREQUENT, CLASSED = 131_072, 4096
#: Neighbours told apart when words are clustered: the commonest words, the last for all others.
NEIGHBOURS = 128
CLASSES = LEAVES = 64
#: Buckets: of the word before, of the class before that, of both, and of the word before
#: within a class.
NEAR, SKIP, JOINT, INNER = 2048, 32, 8, 256
UPDATES = 12
#: Counts that pull a row of weights to the shares of all rows, at first and in training.
PRIOR, PULL = 2.0, 2.0
#: Training tokens to a bucket of the word before; fewest buckets; buckets of the word before
#: that within each.
PER_BUCKET, LEAST_BUCKETS, FAR = 2048, 2048, 64
HASHED_UPDATES = 4
#: Tokens whose buckets form a part; a word with more has several parts.
PART_TOKENS = 250_000
#: Histories that are worked on at a time.
SLICE = 16_384
#: Tokens a task deals out at a time, and most heaps it deals them to; parts beyond that are dealt in two steps.
DEALT, HEAPS = 500_000, 1024
#: Tokens of one numpy batch.
CHUNK = 150_000
END = b""
#: Words longer than this are told apart by a digest.
LONG = 40


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words of a text and its end."""
    found = text.lower().split()
    if max(map(len, found), default=0) > LONG:
        found = [w if len(w) <= LONG else b"\n" + hashlib.blake2b(w, digest_size=16).digest() for w in found]
    found.append(END)
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()
    for batch in batches:
        for text in texts_as_bytes(batch.column(0)):
            counts.update(tokens(text))
            if len(counts) > 400_000:
                yield _pairs(counts)
                counts = Counter()
    yield _pairs(counts)


def _pairs(counts: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
        names=["word", "n"],
    )


@dataclass
class Words:
    """The frequent words, by number, and what is known of each; the last number is rare."""

    numbers: dict[bytes, int]
    counts: np.ndarray  # of each frequent word
    total: int  # tokens
    distinct: int
    rare_total: int  # tokens of rare words
    rare_once: int  # rare words met once

    @property
    def rare(self) -> int:
        return len(self.counts)

    def numbered(self, found: list[bytes]) -> np.ndarray:
        get, rare = self.numbers.get, self.rare
        return np.fromiter(map(get, found, repeat(rare)), np.int32, len(found))


def count_words(training: DataFrame) -> tuple[DataFrame, Words]:
    """All words with their counts, as a table, and what tasks need of them."""
    table = written(
        training.select("text")
        .mapInArrow(_counted, "word binary, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n")),
        "words",
    )
    # A word met once stays rare: it tells how likely words not met are.
    often = table.where((F.col("n") > 1) | (F.col("word") == F.lit(END)))
    top = often.orderBy(F.desc(F.col("word") == F.lit(END)), F.desc("n"), "word").limit(FREQUENT).toArrow()
    sums = table.agg(
        F.sum("n").alias("n"), F.count("*").alias("distinct"), F.count_if(F.col("n") == 1).alias("once")
    ).first()
    counts = top.column("n").to_numpy().astype(np.int64)
    total = sums["n"] or 0
    return table, Words(
        {word: number for number, word in enumerate(top.column("word").to_pylist())},
        counts,
        total,
        sums["distinct"],
        total - int(counts.sum()),
        (sums["once"] or 0) - int((counts == 1).sum()),  # the end may be
    )


# ---- classes ---------------------------------------------------------------------------


TOKENS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("training", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("known", pa.int64()),
        ("base", pa.float64()),
        ("rare", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))),
        ("numbers", pa.binary()),
        ("hashes", pa.binary()),
    ]
)
TOKENS_SQL = (
    "doc_id bigint, training boolean, n_tokens bigint, known bigint, base double, "
    "rare array<struct<word: binary, n: bigint>>, numbers binary, hashes binary"
)


def _numbered(words: Broadcast):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: Words = words.value
        base = np.log10(np.append(known.counts, 0) + 1.0) - math.log10(known.total + known.distinct + 1)
        base[known.rare] = 0.0
        rows, counts = [], []
        for text in texts_as_bytes(batch.column("text")):
            found = tokens(text)
            numbers = known.numbered(found)
            rare = [found[place] for place in np.flatnonzero(numbers == known.rare).tolist()]
            counts.append(Counter(rare))
            rows.append(
                (
                    len(found), len(found) - len(rare), float(base[numbers].sum()), numbers.tobytes(),
                    np.fromiter(map(zlib.crc32, rare), np.uint32, len(rare)).tobytes(),
                )
            )
        n_tokens, n_known, sums, numbers, hashes = list(zip(*rows)) or [()] * 5
        words_of = pa.StructArray.from_arrays(
            [
                pa.array(list(chain.from_iterable(counts)), pa.binary()),
                pa.array(list(chain.from_iterable(own.values() for own in counts)), pa.int64()),
            ],
            names=["word", "n"],
        )
        ends = pa.array(np.cumsum([0, *map(len, counts)]), pa.int32())
        values = [n_tokens, n_known, sums, None, numbers, hashes]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("training")]
            + [
                pa.ListArray.from_arrays(ends, words_of) if own is None else pa.array(own, field.type)
                for own, field in zip(values, list(TOKENS)[2:])
            ],
            schema=TOKENS,
        )

    return run


def numbered(rows: DataFrame, words: Broadcast) -> DataFrame:
    """A written row per row of doc_id, training, text: its tokens' numbers and what single words tell.

    ``row_id`` is given here, once, whatever the rows come from.
    """
    found = rows.select("doc_id", "training", "text").mapInArrow(in_batches(_numbered(words)), TOKENS_SQL)
    return written(found.withColumn("row_id", F.monotonically_increasing_id()), "tokens", "zstd")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of about CHUNK tokens at a time, ``numbers`` and ``hashes`` as arrays."""
    held, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            row["numbers"] = np.frombuffer(row["numbers"], np.int32)
            if "hashes" in row:
                row["hashes"] = np.frombuffer(row["hashes"], np.uint32)
            held.append(row)
            size += len(row["numbers"])
            if size > CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Numbers of the tokens of many texts at once; each text ends with the end."""
    for rows in _texts(batches):
        yield np.concatenate([row["numbers"] for row in rows])


def _before(numbers: np.ndarray, end: int, steps: int, of: np.ndarray | None = None) -> np.ndarray:
    """The token so many steps before, or its value in ``of``; at the start of a text, and beyond it, the end."""
    of, edge = (numbers, end) if of is None else (of, of[np.argmax(numbers == end)])
    found = np.concatenate((np.full(steps, edge, of.dtype), of[:-steps]))[: len(numbers)]
    # What stands just before a text is the end of the one before it; what stands beyond that is not the text's.
    for nearer in range(1, steps):
        found[nearer:][numbers[:-nearer] == end] = edge
    return found


def _sparse(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for kind, values in sums.items():
        found = np.flatnonzero(values)
        for first in range(0, len(found), CHUNK):
            cells = found[first : first + CHUNK]
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(kind, len(cells)), pa.array(cells), pa.array(values[cells], pa.int64())],
                names=["kind", "cell", "n"],
            )


def _add(sums: np.ndarray, cells: np.ndarray) -> None:
    found, counts = np.unique(cells, return_counts=True)
    sums[found] += counts


def _neighbours(rows: int):
    """Counts of what stands before and after each of the commonest words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {"near": np.zeros(rows * NEIGHBOURS * 2, np.int64)}
        for numbers in _chunks(batches):
            before = np.minimum(_before(numbers, 0, 1), NEIGHBOURS - 1)
            after = np.minimum(np.append(numbers[1:], 0), NEIGHBOURS - 1)
            own = numbers < rows
            base = numbers[own].astype(np.int64) * (2 * NEIGHBOURS)
            _add(sums["near"], base + before[own])
            _add(sums["near"], base + NEIGHBOURS + after[own])
        yield from _sparse(sums)

    return run


CELLS = "kind string, cell bigint, n bigint"


def cluster(near: np.ndarray, classes: int) -> np.ndarray:
    """A class for each row by k-means on the roots of its shares, seeded by its first rows."""
    points = np.sqrt(near / np.maximum(near.sum(axis=1, keepdims=True), 1))
    classes = min(classes, len(points))
    centres = points[:classes].copy()
    chosen = np.zeros(len(points), np.int64)
    for _ in range(20):
        chosen = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, chosen, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    return chosen


@dataclass
class Tables:
    """Arrays over word numbers, the rare one last."""

    classes: np.ndarray
    leaves: np.ndarray
    inside: np.ndarray  # log10 P(word | leaf); of the rare leaf nothing yet
    near: np.ndarray  # bucket as the word before
    inner: np.ndarray  # bucket as the word before, within a class
    skip: np.ndarray  # bucket as the word before that

    @classmethod
    def of(cls, words: Words, chosen: np.ndarray) -> Tables:
        count = words.rare
        classes = np.full(count + 1, CLASSES - 1)
        classes[: len(chosen)] = chosen
        leaves = np.zeros(count + 1, np.int64)
        for number in range(CLASSES - 1):
            own = np.flatnonzero(classes == number)
            leaves[own] = np.minimum(np.arange(len(own)), LEAVES - 1)
        # Frequent words without a class of their own share leaves with their like in rank.
        ranks = np.arange(len(chosen), count)
        if len(ranks):
            leaves[ranks] = np.minimum(
                8 * np.log2((ranks + 1) / (len(chosen) + 1)), LEAVES - 2
            ).astype(np.int64)
        leaves[count] = LEAVES - 1
        leaf = classes * LEAVES + leaves
        sums = np.bincount(leaf[:count], weights=words.counts, minlength=CLASSES * LEAVES)
        inside = np.zeros(count + 1, np.float32)
        inside[:count] = np.log10(words.counts / sums[leaf[:count]])
        numbers = np.arange(count + 1)
        own_near, own_inner = NEAR - CLASSES, INNER - CLASSES
        near = np.where(numbers < min(own_near, count), numbers, own_near + classes)
        inner = np.where(numbers < min(own_inner, count), numbers, own_inner + classes)
        numbers = (classes, leaves, near, inner, classes % SKIP)
        classes, leaves, near, inner, skip = (values.astype(np.int32) for values in numbers)
        return cls(classes, leaves, inside, near, inner, skip)

    def joint(self, near: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Both histories hashed into the buckets of the nearer one."""
        return near * JOINT + (skip * np.int64(2654435761) >> 7) % JOINT


# ---- training --------------------------------------------------------------------------


def _histories(tables: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tables = tables.value
        sums = {
            "class": np.zeros(NEAR * SKIP * CLASSES, np.int64),
            "leaf": np.zeros(CLASSES * INNER * LEAVES, np.int64),
        }
        for numbers in _chunks(batches):
            one, two = _before(numbers, 0, 1), _before(numbers, 0, 2)
            outcome = t.classes[numbers].astype(np.int64)
            _add(sums["class"], (t.near[one] * SKIP + t.skip[two]) * CLASSES + outcome)
            _add(sums["leaf"], (outcome * INNER + t.inner[one]) * LEAVES + t.leaves[numbers])
        yield from _sparse(sums)

    return run


#: Histories of the word before in one block of counts.
BLOCK = 32
_SIZES = {"class": BLOCK * SKIP * CLASSES, "leaf": INNER * LEAVES}


def _block(table):
    """One block of counts as a dense array of fixed size."""
    kind = table.column("kind")[0].as_py()
    size = _SIZES[kind]
    counts = np.zeros(size, np.float32)
    counts[table.column("cell").to_numpy() % size] = table.column("n").to_numpy()
    block = int(table.column("cell")[0].as_py()) // size
    return pa.table({"kind": [kind], "block": [block], "counts": pa.array([counts.tobytes()], pa.binary())})


def softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities and log of the sum over the last axis."""
    top = logits.max(axis=-1, keepdims=True)
    powers = np.exp(logits - top)
    sums = powers.sum(axis=-1, keepdims=True)
    return powers / sums, (top + np.log(sums))[..., 0]


@dataclass
class Weights:
    bias: np.ndarray  # classes
    near: np.ndarray  # NEAR x classes
    skip: np.ndarray  # SKIP x classes
    joint: np.ndarray  # NEAR * JOINT x classes
    leaf_bias: np.ndarray  # classes x leaves
    leaf_near: np.ndarray  # classes x INNER x leaves

    def short(self) -> Weights:
        """As sent to tasks, in single precision."""
        return Weights(*(values.astype(np.float32) for values in vars(self).values()))

    @classmethod
    def zero(cls) -> Weights:
        return cls(
            np.zeros(CLASSES), np.zeros((NEAR, CLASSES)), np.zeros((SKIP, CLASSES)),
            np.zeros((NEAR * JOINT, CLASSES)), np.zeros((CLASSES, LEAVES)),
            np.zeros((CLASSES, INNER, LEAVES)),
        )


def class_logits(weights: Weights, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all histories of a block, BLOCK x SKIP x classes, and their joint buckets."""
    near = np.arange(block * BLOCK, (block + 1) * BLOCK)
    skip = np.arange(SKIP)
    joint = Tables.joint(None, near[:, None], skip[None, :])
    logits = weights.bias + weights.near[near][:, None] + weights.skip[None] + weights.joint[joint]
    return logits, joint


def _gradients(weights: Broadcast):
    """Observed and expected counts of every feature of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Weights = weights.value
        for batch in batches:
            for row in batch.to_pylist():
                counts, block = np.frombuffer(row["counts"], np.float32), row["block"]
                if row["kind"] == "class":
                    counts = counts.reshape(BLOCK, SKIP, CLASSES).astype(float)
                    logits, joint = class_logits(w, block)
                    expected = softmax(logits)[0] * counts.sum(axis=2, keepdims=True)
                    parts = []
                    for values in (counts, expected):
                        both = np.zeros((BLOCK * JOINT, CLASSES))
                        np.add.at(both, joint - block * BLOCK * JOINT, values)
                        parts += [values.sum(axis=1), values.sum(axis=0), both]
                else:
                    counts = counts.reshape(INNER, LEAVES).astype(float)
                    logits = w.leaf_bias[block] + w.leaf_near[block]
                    expected = softmax(logits)[0] * counts.sum(axis=1, keepdims=True)
                    parts = [counts, expected]
                packed = np.concatenate([part.ravel() for part in parts]).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["kind"]]), pa.array([block], pa.int64()), pa.array([packed], pa.binary())],
                    names=["kind", "block", "sums"],
                )

    return run


def _step(
    weights: np.ndarray, origin: np.ndarray, observed: np.ndarray, expected: np.ndarray, active: int
) -> None:
    """Move weights along the gradient, scaled by its curvature and by how many move together.

    The gradient is that of the likelihood less PULL / 2 times the squared way from the origin.
    """
    observed, expected = observed.reshape(weights.shape), expected.reshape(weights.shape)
    slope, scale = observed - expected, np.maximum(observed, expected)
    slope -= PULL * (weights - origin)
    scale += PULL
    slope /= scale
    slope /= active
    weights += slope


def update(weights: Weights, origin: Weights, rows: list) -> None:
    """One gradient update from the blocks' sums."""
    skip = np.zeros((2, SKIP, CLASSES))
    for row in rows:
        sums, block = np.frombuffer(row["sums"], np.float32).astype(float), row["block"]
        if row["kind"] == "class":
            cuts = np.cumsum([BLOCK * CLASSES, SKIP * CLASSES, BLOCK * JOINT * CLASSES] * 2)[:-1]
            near, far, joint, near_e, far_e, joint_e = np.split(sums, cuts)
            skip += np.array([far, far_e]).reshape(2, SKIP, CLASSES)
            own = slice(block * BLOCK, (block + 1) * BLOCK)
            _step(weights.near[own], origin.near[own], near, near_e, 4)
            own = slice(block * BLOCK * JOINT, (block + 1) * BLOCK * JOINT)
            _step(weights.joint[own], origin.joint[own], joint, joint_e, 4)
        else:
            observed, expected = sums.reshape(2, INNER, LEAVES)
            _step(weights.leaf_near[block], origin.leaf_near[block], observed, expected, 2)
            _step(
                weights.leaf_bias[block], origin.leaf_bias[block],
                observed.sum(axis=0), expected.sum(axis=0), 2,
            )
    _step(weights.skip, origin.skip, *skip, 4)
    _step(weights.bias, origin.bias, *skip.sum(axis=1), 4)


#: Weight of an outcome that cannot be.
NEVER = -100.0


def first_weights(rows: list, tables: Tables) -> Weights:
    """Start from what the word before alone tells; ``rows`` are the sums under zero weights."""
    weights = Weights.zero()
    exists = np.zeros((CLASSES, LEAVES), bool)
    exists[tables.classes, tables.leaves] = True
    near, total = np.zeros((NEAR, CLASSES)), np.zeros(CLASSES)
    for row in rows:
        sums, block = np.frombuffer(row["sums"], np.float32).astype(float), row["block"]
        if row["kind"] == "class":
            own = sums[: BLOCK * CLASSES].reshape(BLOCK, CLASSES)
            near[block * BLOCK : (block + 1) * BLOCK] = own
            total += own.sum(axis=0)
        else:
            observed = sums.reshape(2, INNER, LEAVES)[0]
            whole = observed.sum(axis=0) + 0.01
            share = whole / whole.sum()
            weights.leaf_bias[block] = np.where(exists[block], np.log(share), NEVER)
            mixed = (observed + PRIOR * share) / (observed.sum(axis=1, keepdims=True) + PRIOR)
            weights.leaf_near[block] = np.log(mixed / share)
    share = (total + 0.01) / (total + 0.01).sum()
    weights.bias = np.where(exists.any(axis=1), np.log(share), NEVER)
    mixed = (near + PRIOR * share) / (near.sum(axis=1, keepdims=True) + PRIOR)
    weights.near = np.log(mixed / share)
    return weights


@dataclass
class Model:
    words: Words
    tables: Tables
    weights: Weights
    class_sums: np.ndarray  # log of the softmax' sum for each history
    leaf_sums: np.ndarray

    def log10(self, numbers: np.ndarray) -> np.ndarray:
        """log10 P of each token up to its leaf, and within it except for rare words."""
        t, w = self.tables, self.weights
        one, two = _before(numbers, 0, 1), _before(numbers, 0, 2)
        near, skip, inner = t.near[one], t.skip[two], t.inner[one]
        outcome, leaf = t.classes[numbers], t.leaves[numbers]
        value = (
            w.bias[outcome] + w.near[near, outcome] + w.skip[skip, outcome]
            + w.joint[t.joint(near, skip), outcome] - self.class_sums[near, skip]
            + w.leaf_bias[outcome, leaf] + w.leaf_near[outcome, inner, leaf]
            - self.leaf_sums[outcome, inner]
        )
        return value / math.log(10) + t.inside[numbers]


def as_training(texts: DataFrame) -> DataFrame:
    """``text`` alone, as rows to learn from."""
    return texts.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(True).alias("training"), "text")


def train(training: DataFrame) -> tuple[DataFrame, Model]:
    """The table of word counts and the model, from ``text`` of all training rows."""
    table, words = count_words(training)
    shared = training.sparkSession.sparkContext.broadcast(words)
    return table, learn(numbered(as_training(training), shared), words)


def learn(training: DataFrame, words: Words) -> Model:
    """The model from ``numbers`` of all training rows."""
    context = training.sparkSession.sparkContext
    cells = (
        training.select("numbers").mapInArrow(_neighbours(CLASSED), CELLS)
        .groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    )
    near = np.zeros(CLASSED * NEIGHBOURS * 2)
    near[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    classed = min(CLASSED, words.rare)
    chosen = cluster(near.reshape(CLASSED, -1)[:classed], CLASSES - 1) if classed else np.zeros(0, int)
    tables = Tables.of(words, chosen)
    placed = context.broadcast(tables)
    histories = training.select("numbers").mapInArrow(_histories(placed), CELLS)
    size = F.when(F.col("kind") == "class", F.lit(_SIZES["class"])).otherwise(F.lit(_SIZES["leaf"]))
    blocks = written(
        histories.groupBy("kind", "cell")
        .agg(F.sum("n").alias("n"))
        .withColumn("block", F.floor(F.col("cell") / size))
        .groupBy("kind", "block")
        .applyInArrow(_block, "kind string, block bigint, counts binary"),
        "blocks",
    )
    placed.destroy()

    def sums(weights: Weights) -> list:
        sent = context.broadcast(weights.short())
        found = blocks.mapInArrow(_gradients(sent), "kind string, block bigint, sums binary").toArrow()
        sent.destroy()  # or each update would leave its weights on every executor's disk
        return found.to_pylist()

    weights = first_weights(sums(Weights.zero()), tables)
    origin = copy.deepcopy(weights)
    for _ in range(UPDATES):
        update(weights, origin, sums(weights))
    weights = weights.short()
    class_sums = np.concatenate([softmax(class_logits(weights, b)[0])[1] for b in range(NEAR // BLOCK)])
    leaf_sums = softmax(weights.leaf_bias[:, None] + weights.leaf_near)[1]
    return Model(words, tables, weights, class_sums, leaf_sums)


# ---- hashed n-grams --------------------------------------------------------------------


@dataclass
class Layout:
    """Where the buckets of the word before lie."""

    buckets: int
    parts: int
    hashes: np.ndarray  # of each frequent word, the rare one last
    hot: np.ndarray  # buckets of common words, ascending
    first: np.ndarray  # first part of each
    tasks: np.ndarray  # how many parts it has
    heaps: int  # most rows that a batch is dealt into

    @classmethod
    def of(cls, words: Words) -> Layout:
        buckets = max(LEAST_BUCKETS, words.total // PER_BUCKET)
        parts = -(-words.total // PART_TOKENS)
        hashes = np.array([zlib.crc32(word) for word in words.numbers] + [0], np.int64)
        common = words.counts > PART_TOKENS  # no more words than there are parts
        hot, at = np.unique(hashes[:-1][common] % buckets, return_inverse=True)
        tasks = -(-np.bincount(at, weights=words.counts[common]).astype(np.int64) // PART_TOKENS)
        return cls(buckets, parts, hashes, hot, parts + np.cumsum(tasks) - tasks, tasks, HEAPS)

    def _hot(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hot):
            return np.zeros(len(buckets), bool), np.zeros(len(buckets), np.int64)
        at = np.minimum(np.searchsorted(self.hot, buckets), len(self.hot) - 1)
        return self.hot[at] == buckets, at

    def part(self, buckets: np.ndarray, task: int) -> np.ndarray:
        common, at = self._hot(buckets)
        part = buckets % self.parts
        part[common] = self.first[at[common]] + task % self.tasks[at[common]]
        return part

    def heap(self, buckets: np.ndarray, task: int) -> np.ndarray:
        """Where a part's rows are dealt to at first: the part, or if there are too many, a heap of them."""
        part = self.part(buckets, task)
        return part % self.heaps if self.in_two_steps() else part

    def in_two_steps(self) -> bool:
        return self.parts + int(self.tasks.sum()) > self.heaps

    def slots(self) -> int:
        """Groups of rows whose sums are added up together."""
        return max(1, min(self.parts, self.heaps))

    def homes(self) -> np.ndarray:
        """The part where the weights of each part are found."""
        return np.concatenate((np.arange(self.parts), np.repeat(self.first, self.tasks)))


def _hashed(rows: list[dict], numbers: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The hash of each token of the rows, rare ones by their own."""
    values = hashes[numbers]
    values[numbers == len(hashes) - 1] = np.concatenate([row["hashes"] for row in rows])
    return values


def cells(t: Tables, layout: Layout, numbers: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the cell of its class and that of its leaf, as one number each.

    class: bucket, far bucket, near, skip, class. leaf: bucket, class, inner, leaf.
    """
    one, two = _before(numbers, 0, 1), _before(numbers, 0, 2)
    bucket = _before(numbers, 0, 1, hashes) % layout.buckets
    far = (_before(numbers, 0, 2, hashes) * 2654435761 >> 13) & (FAR - 1)
    outcome = t.classes[numbers].astype(np.int64)
    history = ((bucket * FAR + far) * NEAR + t.near[one]) * SKIP + t.skip[two]
    leaf = ((bucket * CLASSES + outcome) * INNER + t.inner[one]) * LEAVES + t.leaves[numbers]
    return history * CLASSES + outcome, leaf


#: What the buckets are multiplied by in either cell, and in the rows of weights of each.
_CELL = {"class": FAR * NEAR * SKIP * CLASSES, "leaf": CLASSES * INNER * LEAVES}
PACKED = "part int, kind string, one binary, two binary"


def _out(values: np.ndarray) -> bytes:
    """Numbers as bytes, the first byte of each, then the second and so on, which shuffles compress better."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()


def _in(data: bytes, of: type) -> np.ndarray:
    width = np.dtype(of).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(of).ravel()


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    part, kind, one, two = zip(*rows) if rows else [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(kind, pa.string()), pa.array(one, pa.binary()), pa.array(two, pa.binary())],
        names=["part", "kind", "one", "two"],
    )


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, int)


def _by_part(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if len(parts) and parts.max() < 1 << 15:
        parts = parts.astype(np.int16)  # sorted by digits
    order = np.argsort(parts, kind="stable")
    starts = _runs(parts[order])
    for own in np.split(order, starts[1:]) if len(starts) else []:
        yield int(parts[own[0]]), own


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = _runs(keys)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _deal_counts(tables: Broadcast, layout: Broadcast):
    """Counts of cells, packed by part, or by heap of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, where = tables.value, layout.value
        task = TaskContext.get().partitionId()
        held: list[tuple] = []

        def dealt() -> pa.RecordBatch:
            rows = []
            for kind, found in zip(_CELL, zip(*held)):
                keys, counts = np.unique(np.concatenate(found), return_counts=True)
                for part, own in _by_part(where.heap(keys // _CELL[kind], task)):
                    rows.append((part, kind, _out(keys[own]), _out(counts[own].astype(np.int64))))
            held.clear()
            return _packed(rows)

        for rows in _texts(batches):
            numbers = np.concatenate([row["numbers"] for row in rows])
            held.append(cells(t, where, numbers, _hashed(rows, numbers, where.hashes)))
            if sum(len(own[0]) for own in held) > DEALT:
                yield dealt()
        yield dealt()

    return run


def _deal_on(layout: Broadcast):
    """From heaps to parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = layout.value
        task = TaskContext.get().partitionId()
        held: dict[str, list[tuple[bytes, bytes]]] = {}

        def dealt(kind: str) -> pa.RecordBatch:
            keys = np.concatenate([_in(one, np.int64) for one, _ in held[kind]])
            ids = np.concatenate([_in(two[: len(one)], np.int64) for one, two in held[kind]])
            inside, size = None, _CELL.get(kind, _CELL["class"])
            if kind == "tokens":
                inside = np.concatenate([_in(two[len(one) :], np.int16) for one, two in held[kind]])
            rows = []
            for part, own in _by_part(where.part(keys // size, task)):
                two = _out(ids[own]) + (b"" if inside is None else _out(inside[own]))
                rows.append((part, kind, _out(keys[own]), two))
            del held[kind]
            return _packed(rows)

        for batch in batches:
            for row in batch.to_pylist():
                kind = row["kind"]
                held.setdefault(kind, []).append((row["one"], row["two"]))
                if sum(len(one) for one, _ in held[kind]) > 8 * DEALT:
                    yield dealt(kind)
        for kind in list(held):
            yield dealt(kind)

    return run


def _by_parts(dealt: DataFrame, layout: Broadcast) -> DataFrame:
    """Rows by part, also where tasks have dealt them to heaps."""
    if not layout.value.in_two_steps():
        return dealt
    return dealt.repartition(layout.value.heaps, "part").mapInArrow(_deal_on(layout), PACKED)


def _unpacked(table: pa.Table, kind: str, types: tuple = (np.int64, np.int64)) -> list[np.ndarray]:
    rows = [(r["one"], r["two"]) for r in table.to_pylist() if r["kind"] == kind]
    columns = zip(*rows) if rows else ((), ())
    return [np.concatenate([np.zeros(0, of), *(_in(data, of) for data in own)]) for own, of in zip(columns, types)]


def _merge_counts(layout: Broadcast):
    def run(keys, table):
        home = int(layout.value.homes()[keys[0].as_py()])
        rows = []
        for kind in _CELL:
            found, counts = _summed(*_unpacked(table, kind))
            rows.append((home, kind, _out(found), _out(counts)))
        return pa.Table.from_batches([_packed(rows)])

    return run


def _base(w: Weights, kind: str, histories: np.ndarray) -> np.ndarray:
    """The sums of the model of fixed size for each history."""
    if kind == "leaf":
        inner, outcome = histories % INNER, histories // INNER % CLASSES
        return w.leaf_bias[outcome] + w.leaf_near[outcome, inner]
    skip, near = histories % SKIP, histories // SKIP % NEAR
    return w.bias + w.near[near] + w.skip[skip] + w.joint[Tables.joint(None, near, skip)]


def _features(kind: str, histories: np.ndarray) -> dict[str, np.ndarray]:
    """The rows of weights each history has; those of a feature's row share that of the feature before it."""
    if kind == "leaf":
        return {"leaf": histories // INNER}
    pair = histories // (NEAR * SKIP)
    return {"near": pair // FAR, "pair": pair}


def _scaled_softmax(logits: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Probabilities times the row's total, in place."""
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits *= (total / logits.sum(axis=1))[:, None]
    return logits


def _run_sums(rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the rows from each beginning to the next. Changes ``rows``.

    Neighbours in a run are added up, then neighbours of what is left; ``reduceat`` takes several times as long.
    """
    sizes = np.diff(np.append(begins, len(rows)))
    while len(sizes) < len(rows):
        place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        odd = np.flatnonzero(place & 1)
        rows[odd - 1] += rows[odd]
        rows = rows[place & 1 == 0]
        sizes = (sizes + 1) // 2
    return rows


def _slices(buckets: np.ndarray) -> Iterator[slice]:
    """Whole buckets of at least SLICE rows together, or what is left."""
    begins = np.append(_runs(buckets), len(buckets))
    first = 0
    while first < len(buckets):
        last = int(begins[min(np.searchsorted(begins, first + SLICE), len(begins) - 1)])
        yield slice(first, last)
        first = last


def fit(w: Weights, kind: str, keys: np.ndarray, counts: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Weights of all buckets in ``keys``, ascending: for each feature its rows' numbers and the rows.

    No weight belongs to two buckets, so buckets are fitted a slice after the other.
    """
    outcomes = CLASSES if kind == "class" else LEAVES
    starts = _runs(keys // outcomes)
    ends = np.append(starts, len(keys))
    found: dict[str, list] = {}
    for own in _slices(keys[starts] // _CELL[kind]):
        inside = slice(ends[own.start], ends[own.stop])
        fitted = _fit_slice(w, kind, keys[inside], counts[inside], starts[own] - ends[own.start], outcomes)
        for name, of, weights in fitted:
            found.setdefault(name, []).append((of, weights.astype(np.float16)))
    return {name: tuple(np.concatenate(parts) for parts in zip(*own)) for name, own in found.items()}


def _fit_slice(w: Weights, kind: str, keys: np.ndarray, counts: np.ndarray, starts: np.ndarray, outcomes: int):
    """Name, numbers and weights of the rows of each feature. A bucket larger than a slice is gone
    through in pieces in each update."""
    histories = keys[starts] // outcomes
    total = np.add.reduceat(counts, starts).astype(np.float32)
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
    features = []
    for name, of in _features(kind, histories).items():
        begins = _runs(of)
        at = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(of))))
        cells = at[row] * outcomes + keys % outcomes
        seen = np.bincount(cells, weights=counts, minlength=len(begins) * outcomes).astype(np.float32)
        weights = np.zeros((len(begins), outcomes), np.float32)
        features.append((name, of[begins], at, weights, seen.reshape(-1, outcomes)))
    pieces = [slice(first, first + SLICE) for first in range(0, len(histories), SLICE)]
    base = [_base(w, kind, histories[piece]).astype(np.float32) for piece in pieces[:1]]
    for turn in range(HASHED_UPDATES):
        expected = [np.zeros_like(weights) for _, _, _, weights, _ in features]
        for number, piece in enumerate(pieces):
            logits = base[0].copy() if not number else _base(w, kind, histories[piece]).astype(np.float32)
            for _, _, at, weights, _ in features if turn else ():  # all are zero at first
                logits += weights[at[piece]]
            _scaled_softmax(logits, total[piece])
            rows, places = logits, np.arange(len(logits))
            for sums, (_, _, at, _, _) in zip(expected[::-1], features[::-1]):
                own = at[piece][places]
                begins = _runs(own)
                rows, places = _run_sums(rows, begins), places[begins]
                sums[own[begins]] += rows
        for sums, (_, _, _, weights, seen) in zip(expected, features):
            _step(weights, np.float32(0), seen, sums, len(features))
    return [(name, of, weights) for name, of, _, weights, _ in features]


def _copy_counts(layout: Broadcast):
    """The counts of a home, added up, for every part that needs its weights."""

    def run(keys, table):
        copies = np.flatnonzero(layout.value.homes() == keys[0].as_py()).tolist()
        rows = []
        for kind in _CELL:
            found, counts = _summed(*_unpacked(table, kind))
            rows += [(part, kind, _out(found), _out(counts)) for part in copies]
        return pa.Table.from_batches([_packed(rows)])

    return run


def _deal_tokens(tables: Broadcast, layout: Broadcast):
    """Cells of the tokens of each row, packed by part, or by heap of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, where = tables.value, layout.value
        task = TaskContext.get().partitionId()
        for rows in _texts(batches):
            numbers = np.concatenate([row["numbers"] for row in rows])
            outcome, leaf = cells(t, where, numbers, _hashed(rows, numbers, where.hashes))
            ids = np.array([row["row_id"] for row in rows], np.int64)
            of = np.repeat(ids, [len(row["numbers"]) for row in rows])
            # Leaves go without the bucket and class, which the other cell tells.
            inside = (leaf % (INNER * LEAVES)).astype(np.int16)
            yield _packed([
                (part, "tokens", _out(outcome[own]), _out(of[own]) + _out(inside[own]))
                for part, own in _by_part(where.heap(outcome // _CELL["class"], task))
            ])

    return run


def hashed_log10(w: Weights, found: dict[str, tuple[np.ndarray, np.ndarray]], kind: str, keys: np.ndarray) -> np.ndarray:
    """log10 of the probability of each cell's outcome; weights never trained are zero."""
    outcomes = CLASSES if kind == "class" else LEAVES
    cells, at = np.unique(keys, return_inverse=True)
    value = np.zeros(len(cells))
    starts = _runs(cells // outcomes)
    ends = np.append(starts, len(cells))
    for first in range(0, len(starts), SLICE):
        own = slice(first, min(first + SLICE, len(starts)))
        histories = cells[starts[own]] // outcomes
        logits = _base(w, kind, histories).astype(np.float32)
        for name, of in _features(kind, histories).items():
            rows, weights = found[name]
            if len(rows):
                place = np.minimum(np.searchsorted(rows, of), len(rows) - 1)
                known = np.flatnonzero(rows[place] == of)
                logits[known] += weights[place[known]]
        top = logits.max(axis=1)
        sums = np.log(np.exp(logits - top[:, None]).sum(axis=1)) + top
        inside = slice(ends[own.start], ends[own.stop])
        row = np.repeat(np.arange(len(histories)), np.diff(ends[own.start : own.stop + 1]))
        value[inside] = logits[row, cells[inside] % outcomes] - sums[row]
    return value[at] / math.log(10)


def _score_part(weights: Broadcast):
    def run(table):
        w = weights.value
        ids, sums = [], []
        for row in table.to_pylist():
            if row["kind"] == "tokens":
                outcome, size = _in(row["one"], np.int64), len(row["one"])
                ids.append(_in(row["two"][:size], np.int64))
                inside = _in(row["two"][size:], np.int16).astype(np.int64)
                leaf = (outcome // _CELL["class"] * CLASSES + outcome % CLASSES) * (INNER * LEAVES) + inside
                sums.append((outcome, leaf))
        if not ids:
            return _ROW_SUMS.empty_table()
        outcome, leaf = (np.concatenate(own) for own in zip(*sums))
        nothing = np.zeros(0, np.int64), np.zeros((0, CLASSES), np.float16)
        found = dict.fromkeys(("near", "pair", "leaf"), nothing)
        for kind in _CELL:
            cells, counts = _unpacked(table, kind)
            found |= fit(w, kind, cells, counts) if len(cells) else {}
        value = hashed_log10(w, found, "class", outcome) + hashed_log10(w, found, "leaf", leaf)
        return pa.Table.from_batches([_row_sums([(0, *_summed(np.concatenate(ids), value))])])

    return run


#: Sums of many rows' tokens: the rows' numbers, ascending, and a sum for each.
_ROW_SUMS = pa.schema([("slot", pa.int32()), ("ids", pa.binary()), ("sums", pa.binary())])
_ROW_SUMS_SQL = "slot int, ids binary, sums binary"


def _row_sums(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    slots, ids, sums = zip(*found) if found else [()] * 3
    columns = [slots, [_out(own) for own in ids], [_out(own) for own in sums]]
    return pa.RecordBatch.from_arrays([pa.array(own, f.type) for own, f in zip(columns, _ROW_SUMS)], schema=_ROW_SUMS)


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ids, sums = zip(*found)
    return _summed(np.concatenate(ids), np.concatenate(sums))


def _deal_sums(slots: int):
    """The sums of a task's parts, added up and dealt by row; a row has tokens in many parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def dealt() -> pa.RecordBatch:
            ids, sums = _added(held)
            held.clear()
            slot = (ids * 2654435761 >> 16 & (1 << 31) - 1) % slots
            return _row_sums([(number, ids[own], sums[own]) for number, own in _by_part(slot)])

        for batch in batches:
            for row in batch.to_pylist():
                held.append((_in(row["ids"], np.int64), _in(row["sums"], np.float64)))
                if sum(len(own) for own, _ in held) > 4 * DEALT:
                    yield dealt()
        if held:
            yield dealt()

    return run


def _sum_slot(table: pa.Table) -> pa.Table:
    ids, sums = _added([(_in(r["ids"], np.int64), _in(r["sums"], np.float64)) for r in table.to_pylist()])
    return pa.table({"row_id": ids, "value": sums})


def hashed_scores(training: DataFrame, rows: DataFrame, model: Model) -> DataFrame:
    """row_id and the sum of log10 of the probabilities of its tokens up to their leaves, of row_id, text."""
    shared = training.sparkSession.sparkContext.broadcast(model.words)
    ids = rows.select(F.col("row_id").alias("doc_id"), F.lit(False).alias("training"), "text")
    found = numbered(ids, shared).drop("row_id").withColumnRenamed("doc_id", "row_id")
    sums = hashed_sums(numbered(as_training(training), shared), found, model)
    return sums.groupBy("row_id").agg(F.sum("value").alias("hashed"))


def hashed_sums(training: DataFrame, rows: DataFrame, model: Model) -> DataFrame:
    """row_id and value: the sum of log10 of the probabilities of its tokens up to their leaves."""
    context = training.sparkSession.sparkContext
    layout = context.broadcast(Layout.of(model.words))
    tables, weights = context.broadcast(model.tables), context.broadcast(model.weights)
    counted = training.select("numbers", "hashes").mapInArrow(_deal_counts(tables, layout), PACKED)
    merged = written(
        _by_parts(counted, layout).groupBy("part").applyInArrow(_merge_counts(layout), PACKED), "counts", "zstd"
    )
    # Only parts of common words have a home that gathers several, and copies.
    common = F.col("part") >= layout.value.parts
    copies = merged.where(common).groupBy("part").applyInArrow(_copy_counts(layout), PACKED)
    counts = merged.where(~common).unionByName(copies)
    dealt = rows.select("row_id", "numbers", "hashes").mapInArrow(_deal_tokens(tables, layout), PACKED)
    return (
        _by_parts(dealt, layout)
        .unionByName(counts)
        .groupBy("part")
        .applyInArrow(_score_part(weights), _ROW_SUMS_SQL)
        .mapInArrow(_deal_sums(layout.value.slots()), _ROW_SUMS_SQL)
        .groupBy("slot")
        .applyInArrow(_sum_slot, "row_id bigint, value double")
    )


# ---- scoring ---------------------------------------------------------------------------


def _inside(tables: Broadcast):
    """log10 of the words' probabilities within their leaves, by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = tables.value.inside
        for batch in batches:
            found = (np.frombuffer(own, np.int32) for own in batch.column("numbers").to_pylist())
            sums = [float(inside[numbers].sum(dtype=float)) for numbers in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), pa.array(sums, pa.float64())], names=["row_id", "value"]
            )

    return run


def scored(documents: DataFrame, rest: int = 2, divisor: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    The model learns from rows whose remainder is another than ``rest``.
    """
    context = documents.sparkSession.sparkContext
    rows = identified(documents).select("doc_id", (remainder(divisor) != rest).alias("training"), "text")
    table, words = count_words(rows.where("training"))
    shared = context.broadcast(words)
    first = numbered(rows, shared)
    shared.destroy()
    texts = first.select("row_id", "doc_id", "n_tokens", "known", "base")
    if words.total:
        training = first.where("training")
        model = learn(training, words)
        inside = first.select("row_id", "numbers").mapInArrow(
            _inside(context.broadcast(model.tables)), "row_id bigint, value double"
        )
        values = hashed_sums(training, first, model).unionByName(inside)
        sums = written(values.groupBy("row_id").agg(F.sum("value").alias("model")), "hashed")
        texts = texts.join(sums, "row_id", "left")
    count = F.coalesce(F.col("c"), F.lit(0))
    outcomes = float(words.total + words.distinct + 1)
    # Among the rare words, an unknown one has the share of those met once.
    unknown = max(words.rare_once, 1) / max(words.rare_total + words.rare_once, 1)
    share = F.when(count > 0, (1 - unknown) * count / max(words.rare_total, 1)).otherwise(unknown)
    if not words.total:
        share = F.lit(1.0)
    met = (
        first.select("row_id", F.explode("rare").alias("r"))
        .select("row_id", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
        .join(table.withColumnRenamed("n", "c"), "word", "left")
        .groupBy("row_id")
        .agg(
            F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("n") * F.log10((count + 1) / F.lit(outcomes))).alias("rare_base"),
            F.sum(F.col("n") * F.log10(share)).alias("rare_model"),
        )
    )

    def total(own: str, rare: str):
        return F.col(own) + F.coalesce(rare, F.lit(0))

    base = total("base", "rare_base")
    return texts.join(met, "row_id", "left").select(
        "doc_id",
        (remainder(divisor) == rest).alias("held_out"),
        "n_tokens",
        total("known", "rare_known").alias("n_known"),
        F.lit(words.total).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        (total("model", "rare_model") if words.total else base).alias("score"),
    )
