"""Codes of vectors by parts, found exactly in integers by a Walsh-Hadamard transform.

Rows whose vector is missing or holds missing or non-finite components are dropped. A component x
becomes floor(SCALE * x). Vectors are cut into equal consecutive parts; each part position has a
codebook, which starts as that part of the first rows by vec_id. A round assigns every part to
its codebook's nearest entry (squared Euclidean distance, ties to the lower index) and replaces
each entry by its parts' componentwise floor(sum / count); an entry without parts stays.

Nearest entries: parts and entries are filled up with zeros to a power of two, P, and transformed by
the Hadamard matrix, rows in order of sequency (sign changes). That multiplies every
squared distance by P. An entry is guessed from the first coefficients and measured in full;
then squared differences are added up coefficient by coefficient over all other entries,
and an entry is gone as soon as its sum exceeds that of the guess. What is left is compared in full.

All arithmetic is in integers: in 64 bits where the largest component of rows and codebooks rules out
an overflow, else in Python's integers, which the same numpy code works on. Sums over rows leave
a task in limbs of 32 bits, so they are exact for any number of rows. The driver holds the codebooks
and their sums, whose size is parts x entries x part length.

Vectors are packed and written once, each round reads them. Vectors shorter than the longest, or of a length
that the parts do not divide, are filled up with zeros at the end. Missing ids come after
all others, equal ids are ordered by their vectors. With fewer rows than entries the codebooks
have that many. An error beyond 64 bits is null, and the sum of its label too. Repeated rows count
and are returned as often as they stand there. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallybook.llm.common import if_small, in_batches, small, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Coefficients that the guess is made from; coefficients added up between two looks at the sums.
GUESSED, STEP = 3, 1
#: Rows of one numpy batch.
CHUNK = 8192
LIMB = 32

# ---- packed vectors --------------------------------------------------------------------

PACKED = "vec_id bigint, bytes int, vector binary"
_KINDS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}


def _scaled(value: float, scale: int) -> int:
    """floor(scale * value), also where the product is beyond a double."""
    return math.floor(value) * scale if abs(value) >= 2**53 else math.floor(value * scale)


def _pack(width: int, scale: int):
    """Integers in as few bytes as the batch needs, beyond 64 bits as text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("vector")
        sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        grid = np.zeros((len(sizes), width))
        row = np.repeat(np.arange(len(sizes)), sizes)
        grid[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
        large = np.abs(grid).max(axis=1, initial=0) >= 2**62 / scale
        floors = np.floor(np.where(large[:, None], 0, grid) * scale).astype(np.int64)
        most = max(int(floors.max(initial=0)), -int(floors.min(initial=0)) - 1)
        size = next(size for size in _KINDS if most < 1 << (8 * size - 1))
        vectors = [own.tobytes() for own in floors.astype(_KINDS[size])]
        for place in np.flatnonzero(large).tolist():
            vectors[place] = ",".join(str(_scaled(x, scale)) for x in grid[place].tolist()).encode()
        rest = batch.drop_columns(["vector"])
        return pa.RecordBatch.from_arrays(
            [*rest.columns, pa.array(np.where(large, 0, size), pa.int32()), pa.array(vectors, pa.binary())],
            names=[*rest.schema.names, "bytes", "vector"],
        )

    return run


def _chunks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the batch and their vectors, of 64 bits or as Python's integers."""
    kinds = batch.column("bytes").to_numpy()
    vectors = batch.column("vector").to_pylist()
    for size in np.unique(kinds).tolist():
        places = np.flatnonzero(kinds == size)
        for first in range(0, len(places), CHUNK):
            own = places[first : first + CHUNK]
            held = [vectors[place] for place in own.tolist()]
            if size:
                rows = np.frombuffer(b"".join(held), _KINDS[size]).reshape(len(own), width).astype(np.int64)
            else:
                rows = np.array([[int(x) for x in vector.split(b",")] for vector in held], object)
            yield own, rows


# ---- nearest entries -------------------------------------------------------------------


def walsh(rows: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row, zeros added up to a power of two, by sequency."""
    size = 1 << max(rows.shape[1] - 1, 0).bit_length()
    out = np.zeros((len(rows), size), rows.dtype)
    out[:, : rows.shape[1]] = rows
    half = 1
    while half < size:
        pairs = out.reshape(len(rows), -1, 2, half)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2)
        out = out.reshape(len(rows), size)
        half *= 2
    return out[:, _by_sequency(size)]


def _by_sequency(size: int) -> np.ndarray:
    """The rows of the Hadamard matrix by their number of sign changes."""
    number = np.arange(size)
    signs = np.bitwise_count(number[:, None] & number[None, :]) & 1
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


def _exact(rows: np.ndarray, entries: np.ndarray) -> bool:
    """Whether P times a squared distance stays within 64 bits."""
    if rows.dtype == object or entries.dtype == object:
        return False
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max(initial=0)))
    size = 1 << max(rows.shape[1] - 1, 0).bit_length()
    return (2 * size * most) ** 2 < 2**63


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest entry, ties to the lower index, and its squared distance."""
    if not _exact(rows, entries):
        rows, entries = rows.astype(object), entries.astype(object)
    a, b = walsh(rows), walsh(entries)
    size = a.shape[1]
    seen = min(GUESSED, size)
    sums = np.zeros((len(a), len(b)), a.dtype)
    for place in range(seen):
        sums += (a[:, place, None] - b[None, :, place]) ** 2
    guess = sums.argmin(axis=1)
    bound = ((a - b[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= bound[:, None])
    sums = sums[row, entry]
    for first in range(seen, size, STEP):
        sums = sums + ((a[row, first : first + STEP] - b[entry, first : first + STEP]) ** 2).sum(axis=1)
        left = sums <= bound[row]
        row, entry, sums = row[left], entry[left], sums[left]
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else row
    least = np.minimum.reduceat(sums, starts) if len(row) else sums
    hits = np.flatnonzero(sums == least[row])  # rows are 0, 1, 2 and so on: the guess is always left
    first = hits[np.flatnonzero(np.concatenate(([True], row[hits][1:] != row[hits][:-1])))] if len(hits) else hits
    return entry[first], least // size


# ---- rounds ----------------------------------------------------------------------------

SUMS = "part int, entry int, place int, limb int, value bigint"


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """A number in limbs of LIMB bits, the last with the sign."""
    limb = 0
    while not -(1 << LIMB) < value < 1 << LIMB:
        yield limb, value & ((1 << LIMB) - 1)
        value >>= LIMB
        limb += 1
    yield limb, value


def _array(entries: list[list[int]]) -> np.ndarray:
    big = any(not -(2**62) < x < 2**62 for entry in entries for x in entry)
    return np.array(entries, object if big else np.int64)


def _sums(codebooks: list[np.ndarray], width: int):
    """Sums and counts of the parts of each entry; place -1 is the count."""
    length = width // len(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int, int], int] = {}
        for batch in small(batches):
            for _, rows in _chunks(batch, width):
                for part, entries in enumerate(codebooks):
                    own = rows[:, part * length : (part + 1) * length]
                    chosen, _ = nearest(own, entries)
                    if rows.dtype != object and int(np.abs(own).max(initial=0)) >= 2**62 // CHUNK:
                        own = own.astype(object)
                    order = np.argsort(chosen, kind="stable")
                    starts = np.flatnonzero(np.concatenate(([True], np.diff(chosen[order]) != 0)))
                    added = np.add.reduceat(own[order], starts, axis=0).tolist()
                    counts = np.diff(np.append(starts, len(order))).tolist()
                    for entry, count, sums in zip(chosen[order][starts].tolist(), counts, added):
                        for place, value in enumerate([count, *sums], -1):
                            key = part, entry, place
                            totals[key] = totals.get(key, 0) + value
        rows = [(*key, *limb) for key, value in totals.items() for limb in _limbs(value)]
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(values, kind) for values, kind in zip(columns, [pa.int32()] * 4 + [pa.int64()])],
            names=["part", "entry", "place", "limb", "value"],
        )

    return run


def train(packed: DataFrame, codebooks: list[np.ndarray], width: int, rounds: int) -> list[np.ndarray]:
    """The codebooks after so many rounds over all rows."""
    for _ in range(rounds):
        found = (
            packed.select("bytes", "vector")
            .mapInArrow(_sums(codebooks, width), SUMS)
            .groupBy("part", "entry", "place", "limb")
            .agg(F.sum("value").alias("value"))
            .collect()
        )
        totals: dict[tuple[int, int, int], int] = {}
        for part, entry, place, limb, value in found:
            key = part, entry, place
            totals[key] = totals.get(key, 0) + (value << (LIMB * limb))
        books = [entries.tolist() for entries in codebooks]
        for (part, entry, place), value in totals.items():
            if place >= 0:
                books[part][entry][place] = value // totals[part, entry, -1]
        codebooks = [_array(entries) for entries in books]
    return codebooks


CODED = "vec_id bigint, code string, error bigint"


def _code(codebooks: list[np.ndarray], width: int):
    length = width // len(codebooks)
    digits = np.array([f"{entry:02x}" for entry in range(max(256, len(codebooks[0])))], object)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = np.full(batch.num_rows, "", object)
        errors = np.zeros(batch.num_rows, object)
        for places, rows in _chunks(batch, width):
            for part, entries in enumerate(codebooks):
                chosen, distances = nearest(rows[:, part * length : (part + 1) * length], entries)
                codes[places] += digits[chosen]
                errors[places] += distances
        rest = batch.drop_columns(["bytes", "vector"])
        whole = [error if error < 2**63 else None for error in map(int, errors)]
        return pa.RecordBatch.from_arrays(
            [*rest.columns, pa.array(codes.tolist(), pa.string()), pa.array(whole, pa.int64())],
            names=[*rest.schema.names, "code", "error"],
        )

    return run


def codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error, label_error of every kept row; the codebooks, an array per part."""
    label = vectors.schema["label"].dataType.simpleString()
    kept = vectors.select(
        vectors["vec_id"].cast("bigint").alias("vec_id"), "label", F.col("embedding").alias("vector")
    ).where(
        F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    length = width // parts
    packed = written(
        kept.mapInArrow(in_batches(_pack(width, scale)), PACKED.replace("bytes", f"label {label}, bytes", 1)),
        "vectors",
    )
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = [[_scaled(x, scale) for x in row["vector"]] + [0] * (width - len(row["vector"])) for row in first]
    books = [_array([row[part * length : (part + 1) * length] for row in start]) for part in range(parts)]
    if first:
        books = train(packed, books, width, rounds)
    found = written(
        packed.mapInArrow(in_batches(_code(books, width)), CODED.replace("code", f"label {label}, code", 1)),
        "codes",
    )
    totals = found.groupBy("label").agg(
        F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count_if(F.isnull("error")).alias("beyond")
    )
    totals = totals.select(
        F.col("label").alias("_label"),
        F.when(F.col("beyond") == 0, F.expr("try_cast(sum AS bigint)")).alias("label_error"),
    )
    return found.join(if_small(totals), F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), books


def digest(codebooks: list[np.ndarray]) -> str:
    """sha256 of all components by part, entry and place in the part, as decimal text."""
    whole = [str(x) for entries in codebooks for entry in entries.tolist() for x in entry]
    return hashlib.sha256(",".join(whole).encode()).hexdigest()
