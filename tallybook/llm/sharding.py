"""Shards that are even in bytes, tokens and rows, by vector bin packing.

An item is a vector (bytes, tokens, rows), each as a share of the whole table. Items are
taken from the largest down; each goes to the shard where the dot product of the item with
the shard's residual capacity is highest.

Documents of equal text form a group and stay together. Groups of at least one
``CELLS``-th of the table in any measure are items of their own; there are at most
3 * CELLS of those. All smaller groups are bundled by a hash of the text into CELLS items.
So the driver packs a bounded list whatever the size of the table, and the answer goes
back as a map of the same bounded size.

A group above a shard cannot stay together; it is split by its rows' numbers into parts of
PART of a shard. Only if the shards still differ by more than UNEVEN in bytes, because groups of nearly a
shard leave no room, the groups above half a shard are split as well, then those above a quarter.

Rows are numbered once, when their measures are written, and dealt by that number, so rows
that repeat in every column are spread like any other.
A missing text has size 16, the overhead alone, and is grouped with empty texts.
Repeated or missing ids are rows like any other. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallybook.llm.common import identified, in_batches, texts_as_bytes, written

#: Bytes a row costs besides its text.
OVERHEAD = 16
#: Bundles of small groups.
CELLS = 32_768
#: A part of a split group, as a part of a shard.
PART = 0.25
#: Groups above so much of a shard are split, the next only if shards stay uneven; the bound for that.
LIMITS = (1.0, 0.5, PART)
UNEVEN = 0.02
#: How much each measure counts in the dot product: bytes most, their law is the promise.
WEIGHTS = np.array([1.0, 0.5, 0.5])
#: Rows numbered by one task at a time.
RUN = 8192
MEASURES = ("size", "tokens", "n")


def _sums() -> list[Column]:
    return [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = texts_as_bytes(batch.column(1))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array([len(text) + OVERHEAD for text in texts], pa.int64()),
            pa.array([zlib.crc32(text) for text in texts], pa.int64()),
            pa.array([len(text.split()) for text in texts], pa.int64()),
            pa.array([hashlib.blake2b(text, digest_size=16).digest() for text in texts]),
        ],
        names=["doc_id", "size", "text_crc32", "tokens", "digest"],
    )


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; ``items`` has a row per item, a share of the whole per column."""
    order = np.argsort(-items.max(axis=1), kind="stable")
    free = np.full((shards, items.shape[1]), 1.0 / shards)
    chosen = np.zeros(len(items), dtype=np.int64)
    for item in order:
        best = int(np.argmax(free @ (items[item] * WEIGHTS)))
        chosen[item] = best
        free[best] -= items[item]
    return chosen


def _parts(share: Column, shards: int, limit: float) -> Column:
    """Into how many parts a group with this share of the table is split."""
    return F.when(share * shards > limit, F.ceil(share * shards / PART)).otherwise(1)


def _placed(rows: DataFrame, whole: list[int], shards: int) -> DataFrame:
    """``rows`` with their shard."""
    share = F.greatest(*(F.col(name) / F.lit(float(of)) for name, of in zip(MEASURES, whole)))
    large = written(
        rows.groupBy("digest")
        .agg(*_sums())
        .withColumn("share", share)
        .where(F.col("share") >= 1.0 / CELLS)
        .select("digest", "share"),
        "large",
    )
    cell = F.concat(F.lit("cell "), F.pmod(F.xxhash64("digest"), F.lit(CELLS)))
    for limit in LIMITS:
        parts = _parts(F.col("share"), shards, limit)
        part = F.concat(F.hex("digest"), F.lit(" "), F.pmod(F.xxhash64("row_id"), parts))
        items = rows.join(F.broadcast(large), "digest", "left").withColumn(
            "item", F.when(F.col("share").isNull(), cell).otherwise(part)
        )
        bundles = items.groupBy("item").agg(*_sums()).orderBy("item").collect()
        vectors = np.array([[b[name] for name in MEASURES] for b in bundles], float).reshape(-1, 3)
        chosen = pack(vectors / whole, shards)
        sizes = np.bincount(chosen, weights=vectors[:, 0], minlength=shards)
        if sizes.max() <= (1 + UNEVEN) * sizes.mean():
            break
    where = rows.sparkSession.createDataFrame(
        [(b["item"], int(at)) for b, at in zip(bundles, chosen)], "item string, shard int"
    )
    return items.join(F.broadcast(where), "item")


def shard(documents: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard, slot of every row."""
    rows = written(
        identified(documents)
        .select("doc_id", "text")
        .mapInArrow(
            in_batches(_measure),
            "doc_id bigint, size bigint, text_crc32 bigint, tokens bigint, digest binary",
        )
        .withColumn("row_id", F.monotonically_increasing_id()),
        "measures",
    )
    total = rows.agg(*_sums()).first()
    rows = _placed(rows, [max(1, total[name] or 0) for name in MEASURES], shards)
    runs = max(1, -(-int(total["n"]) // (shards * RUN)))
    rows = rows.withColumn("run", F.pmod(F.xxhash64("row_id", F.lit(1)), F.lit(runs)))
    before = (
        rows.groupBy("shard", "run")
        .agg(F.count("*").alias("n"))
        .select(
            "shard",
            "run",
            (
                F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")
            ).alias("before"),
        )
    )
    in_run = Window.partitionBy("shard", "run").orderBy("doc_id", "digest", "row_id")
    return (
        rows.withColumn("place", F.row_number().over(in_run) - 1)
        .join(before, ["shard", "run"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "tokens",
            "shard",
            (F.col("before") + F.col("place")).alias("slot"),
        )
    )
