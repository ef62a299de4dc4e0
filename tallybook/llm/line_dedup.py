"""Lines found in many documents, dropped by probing a sharded minimal perfect hash.

A text is split at each ``\\n``. A line's key is the line without the characters
``[\\x20\\x09-\\x0D]`` at both ends, A-Z as a-z. Keys of at least ``least_chars`` code points
found in at least ``least_documents`` rows lose all their lines; the other lines stay, joined by
``\\n``.

1. A block is what a task reads at a time. Its distinct keys, as 128-bit digests with the number of
   the block's documents that hold each, are written with the block's lines as numbers into them. A
   key counts once per block from here on, however common it is.
2. Digests are dealt to shards, packed by block, so that a shard holds about SHARD_KEYS of
   them. A shard adds up its distinct digests and builds a minimal perfect hash over them: a
   cascade of bit arrays, in each of which the keys that meet no other key set their bit, and the
   rank of a key's bit is its index. The index leads into two compact arrays, one of
   16-bit fingerprints and one of counts, which end at ``least_documents``. Bits and arrays are a row
   of a table per shard.
3. Blocks probe the arrays: their digests go, packed by shard once more, to the shard's row. What
   comes back is the numbers of the keys to drop.
4. From these and the block's lines each document's dropped lines are listed, and cut out of its text.

A missing text is empty: one empty line, which no key of a code point or more can match. Rows that
repeat doc_id and text are documents of their own. An empty table gives an empty
result. Other columns are kept by ``drop_lines`` and ignored by ``line_counts``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallybook.llm.common import (
    id_key,
    identified,
    if_small,
    in_batches,
    small,
    text_of,
    texts_as_bytes,
    written,
)
from tallybook.llm.hashing import mixed

#: Digests of a shard, copies in other blocks counted.
SHARD_KEYS = 500_000
#: Most bytes of dropped lines' numbers that are broadcast.
BROADCAST_BYTES = 16 << 20
BLANK = b" \t\n\x0b\x0c\r"
_STEP = 0xD6E8FEB86659FD93
DIGEST = np.dtype([("high", "<u8"), ("low", "<u8")])

BLOCKS = (
    "doc_ids array<bigint>, text_hashes array<bigint>, sizes binary, lines binary, "
    "digests binary, documents binary"
)


def _key(line: bytes, least_chars: int) -> bytes | None:
    key = line.strip(BLANK)
    if len(key) < least_chars or (len(key) < 4 * least_chars and len(key.decode()) < least_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _blocks(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            numbers: dict[bytes, int] = {}
            documents: list[int] = []
            sizes, lines = [], []
            for text in texts_as_bytes(batch.column(1)):
                own = []
                for line in text.lower().split(b"\n"):
                    key = _key(line, least_chars)
                    own.append(-1 if key is None else numbers.setdefault(key, len(numbers)))
                documents += [0] * (len(numbers) - len(documents))
                for number in set(own):
                    if number >= 0:
                        documents[number] += 1
                sizes.append(len(own))
                lines += own
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([batch.column(2).to_pylist()], pa.list_(pa.int64())),
                    pa.array([np.array(sizes, np.int32).tobytes()], pa.binary()),
                    pa.array([np.array(lines, np.int32).tobytes()], pa.binary()),
                    pa.array([b"".join(numbers)], pa.binary()),
                    pa.array([np.array(documents, np.int32).tobytes()], pa.binary()),
                ],
                names=["doc_ids", "text_hashes", "sizes", "lines", "digests", "documents"],
            )

    return run


def blocks(documents: DataFrame, least_chars: int = 1) -> DataFrame:
    """A written row per block: its documents, their lines as numbers, the distinct keys' digests."""
    rows = identified(documents).mapInArrow(_blocks(least_chars), BLOCKS)
    return written(rows.withColumn("block", F.monotonically_increasing_id()), "blocks")


# ---- shards ----------------------------------------------------------------------------

DEALT = "shard bigint, block bigint, numbers binary, digests binary, documents binary"


def _dealt(shards: int):
    """A block's digests and their numbers, packed by shard."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for row in batch.to_pylist():
            digests = np.frombuffer(row["digests"], DIGEST)
            documents = np.frombuffer(row["documents"], np.int32)
            of = digests["high"] % np.uint64(shards)
            order = np.argsort(of, kind="stable").astype(np.int32)
            ends = np.flatnonzero(np.diff(of[order])) + 1
            for own in np.split(order, ends) if len(order) else []:
                rows.append(
                    (int(of[own[0]]), row["block"], own.tobytes(), digests[own].tobytes(), documents[own].tobytes())
                )
        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(values, kind) for values, kind in zip(columns, [pa.int64()] * 2 + [pa.binary()] * 3)],
            names=["shard", "block", "numbers", "digests", "documents"],
        )

    return run


def _place(high: np.ndarray, low: np.ndarray, level: int, bits: int) -> np.ndarray:
    seed = np.uint64((level + 1) * _STEP % 2**64)
    return mixed(high + mixed(low + seed)) % np.uint64(bits)


def _fingerprints(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (mixed(high ^ mixed(low)) >> np.uint64(48)).astype(np.uint16)


def build(high: np.ndarray, low: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of a minimal perfect hash over distinct digests, and each digest's index."""
    levels: list[np.ndarray] = []
    index = np.zeros(len(high), np.int64)
    left, before = np.arange(len(high)), 0
    while len(left):
        bits = -(-2 * len(left) // 64) * 64
        places = _place(high[left], low[left], len(levels), bits)
        alone = np.bincount(places.astype(np.int64), minlength=bits) == 1
        settled = alone[places]
        index[left[settled]] = before + np.cumsum(alone)[places[settled]] - 1
        levels.append(np.packbits(alone))
        before += int(alone.sum())
        left = left[~settled]
    return levels, index


def index_of(levels: list[np.ndarray], high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The index of each digest; -1 for one whose bit is nowhere set."""
    index = np.full(len(high), -1, np.int64)
    left, before = np.arange(len(high)), 0
    for level, packed in enumerate(levels):
        alone = np.unpackbits(packed).astype(bool)
        places = _place(high[left], low[left], level, len(alone))
        settled = alone[places]
        ranks = np.cumsum(alone)
        index[left[settled]] = before + ranks[places[settled]] - 1
        before += int(ranks[-1])
        left = left[~settled]
    return index


SHARDS = "shard bigint, bits array<binary>, fingerprints binary, counts binary"


def _build_shard(least_documents: int):
    def run(keys, table):
        digests = np.frombuffer(b"".join(table.column("digests").to_pylist()), DIGEST)
        documents = np.frombuffer(b"".join(table.column("documents").to_pylist()), np.int32)
        order = np.lexsort((digests["low"], digests["high"]))
        digests, documents = digests[order], documents[order].astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], digests[1:] != digests[:-1])))
        digests, counts = digests[starts], np.add.reduceat(documents, starts)
        high, low = digests["high"].copy(), digests["low"].copy()
        levels, index = build(high, low)
        fingerprints = np.zeros(len(index), np.uint16)
        fingerprints[index] = _fingerprints(high, low)
        kept = np.zeros(len(index), np.min_scalar_type(max(least_documents, 1)))
        kept[index] = np.minimum(counts, least_documents)
        return pa.table(
            {
                "shard": [keys[0].as_py()],
                "bits": pa.array([[packed.tobytes() for packed in levels]], pa.list_(pa.binary())),
                "fingerprints": pa.array([fingerprints.tobytes()], pa.binary()),
                "counts": pa.array([kept.tobytes()], pa.binary()),
            }
        )

    return run


def _probe(least_documents: int):
    def run(probes, shard):
        if not shard.num_rows or not probes.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "found": pa.array([], pa.binary())})
        levels = [np.frombuffer(packed, np.uint8) for packed in shard.column("bits")[0].as_py()]
        fingerprints = np.frombuffer(shard.column("fingerprints")[0].as_py(), np.uint16)
        kind = np.min_scalar_type(max(least_documents, 1))
        counts = np.frombuffer(shard.column("counts")[0].as_py(), kind)
        packed = probes.column("digests").to_pylist()
        digests = np.frombuffer(b"".join(packed), DIGEST)
        high, low = digests["high"].copy(), digests["low"].copy()
        index = index_of(levels, high, low)
        common = (index >= 0) & (fingerprints[index] == _fingerprints(high, low))
        common &= counts[index] >= least_documents
        blocks, found, first = [], [], 0
        for block, own, numbers in zip(
            probes.column("block").to_pylist(), packed, probes.column("numbers").to_pylist()
        ):
            last = first + len(own) // DIGEST.itemsize
            hits = np.frombuffer(numbers, np.int32)[common[first:last]]
            if len(hits):
                blocks.append(block)
                found.append(hits.tobytes())
            first = last
        return pa.table({"block": pa.array(blocks, pa.int64()), "found": pa.array(found, pa.binary())})

    return run


def shards(dealt: DataFrame, least_documents: int) -> DataFrame:
    """A written row per shard: the hash's bit arrays, the fingerprints and the counts."""
    return written(
        dealt.select("shard", "digests", "documents")
        .groupBy("shard")
        .applyInArrow(_build_shard(least_documents), SHARDS),
        "shards",
    )


# ---- documents -------------------------------------------------------------------------

DROPS = "doc_id bigint, text_hash bigint, drops binary"


def _listed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The numbers of the dropped lines of each document that has any."""
    rows = []
    for row in batch.to_pylist():
        lines = np.frombuffer(row["lines"], np.int32)
        common = np.unique(np.frombuffer(b"".join(row["found"]), np.int32))
        dropped = np.isin(lines, common)
        ends = np.cumsum(np.frombuffer(row["sizes"], np.int32), dtype=np.int64)
        first = 0
        for doc_id, text_hash, last in zip(row["doc_ids"], row["text_hashes"], ends.tolist()):
            own = np.flatnonzero(dropped[first:last]).astype(np.int32)
            if len(own):
                rows.append((doc_id, text_hash, own.tobytes()))
            first = last
    columns = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(columns, [pa.int64()] * 2 + [pa.binary()])],
        names=["doc_id", "text_hash", "drops"],
    )


def dropped_lines(documents: DataFrame, least_chars: int = 1, least_documents: int = 10) -> DataFrame:
    """doc_id, text_hash and the packed numbers of the dropped lines, of documents that have any."""
    spark = documents.sparkSession
    held = blocks(documents, least_chars)
    keys = held.agg(F.sum(F.octet_length("digests"))).first()[0] or 0
    count = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // (DIGEST.itemsize * SHARD_KEYS))
    )
    dealt = held.select("block", "digests", "documents").mapInArrow(in_batches(_dealt(count)), DEALT)
    arrays = shards(dealt, least_documents)
    answers = (
        dealt.select("shard", "block", "numbers", "digests")
        .groupBy("shard")
        .cogroup(arrays.groupBy("shard"))
        .applyInArrow(_probe(least_documents), "block bigint, found binary")
        .groupBy("block")
        .agg(F.collect_list("found").alias("found"))
    )
    listed = held.select("block", "doc_ids", "text_hashes", "sizes", "lines").join(answers, "block")
    return written(listed.mapInArrow(in_batches(_listed), DROPS), "drops")


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, sizes, counts = [], [], []
    for text, drops in zip(texts_as_bytes(batch.column("_text")), batch.column("_drops").to_pylist()):
        gone = [] if drops is None else np.frombuffer(drops, np.int32).tolist()
        sizes.append(text.count(b"\n") + 1)
        counts.append(len(gone))
        if gone:
            lines: list[bytes | None] = text.split(b"\n")
            for place in gone:
                lines[place] = None
            text = b"\n".join(line for line in lines if line is not None)
        texts.append(text)
    kept = batch.drop_columns(["_text", "_drops"])
    return pa.RecordBatch.from_arrays(
        [*kept.columns, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
        names=[*kept.schema.names, "n_lines", "n_dropped", "kept_text"],
    )


def _with_drops(rows: DataFrame, drops: DataFrame) -> DataFrame:
    """``rows``, which have ``_key_id``, ``_key_hash`` and ``_text``, with what to drop of each."""
    keys = drops.select(
        id_key().alias("_key_id"), F.col("text_hash").alias("_key_hash"), F.col("drops").alias("_drops")
    ).dropDuplicates(["_key_id", "_key_hash"])
    size = drops.agg(F.sum(F.octet_length("drops"))).first()[0] or 0
    keys = if_small(keys) if size <= BROADCAST_BYTES else keys
    return rows.join(keys, ["_key_id", "_key_hash"], "left").drop("_key_id", "_key_hash")


def line_counts(documents: DataFrame, least_chars: int = 1, least_documents: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text; a row per row of ``documents``."""
    drops = dropped_lines(documents, least_chars, least_documents)
    rows = identified(documents).select(
        "doc_id", id_key().alias("_key_id"), F.col("text_hash").alias("_key_hash"), F.col("text").alias("_text")
    )
    return _with_drops(rows, drops).select("doc_id", "_text", "_drops").mapInArrow(
        in_batches(_cut), "doc_id bigint, n_lines bigint, n_dropped bigint, kept_text string"
    )


def drop_lines(documents: DataFrame, least_chars: int = 1, least_documents: int = 10) -> DataFrame:
    """All rows and columns, their texts without the lines of common keys."""
    drops = dropped_lines(documents, least_chars, least_documents)
    text = text_of(documents)
    rows = documents.select(
        F.struct(*(documents[f"`{name}`"] for name in documents.columns)).alias("_row"),
        F.coalesce(documents["doc_id"].cast("bigint"), F.lit(-(2**63))).alias("_key_id"),
        F.xxhash64(text).alias("_key_hash"),
        text.alias("_text"),
    )
    kind = documents.schema.simpleString()
    cut = _with_drops(rows, drops).select("_row", "_text", "_drops").mapInArrow(
        in_batches(_cut), f"_row {kind}, n_lines bigint, n_dropped bigint, kept_text string"
    )
    return cut.select(
        *(
            F.coalesce("kept_text", F.lit("")).alias("text") if name == "text" else F.col(f"_row.`{name}`").alias(name)
            for name in documents.columns
        )
    )
