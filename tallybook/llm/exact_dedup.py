"""Exact duplicates by a heavy-hitter split.

Misra-Gries summaries, one per task, name every digest that can be frequent. An exact
count verifies them; the verified ones (fewer than ``1 / share``) are broadcast and their
rows get their answer where they are read, without a shuffle. All other digests are
grouped and joined by an ordinary shuffle, in which no digest is frequent.

Texts are equal when identical after lower-casing A-Z. A missing text is empty, and empty
texts are equal. Of equal texts the largest doc_id stays; a missing doc_id counts as
smallest; of rows that repeat that doc_id exactly one stays. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tallybook.llm.common import identified, in_batches, texts_as_bytes, with_keys, written

#: A digest of at least this share of the rows is frequent.
SHARE = 1 / 4096
#: Counters of one summary; its error is below rows / (COUNTERS + 1), well under SHARE.
COUNTERS = 16384


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    digests = [hashlib.sha256(text.lower()).digest() for text in texts_as_bytes(batch.column(1))]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(2), pa.array(digests, pa.binary())],
        names=["doc_id", "text_hash", "digest"],
    )


def digests(documents: DataFrame) -> DataFrame:
    """A row per document: row_id, doc_id, text_hash, SHA-256 of the lower-cased text."""
    rows = (
        identified(documents)
        .select("doc_id", "text", "text_hash")
        .mapInArrow(in_batches(_digest), "doc_id bigint, text_hash bigint, digest binary")
    )
    return written(rows.withColumn("row_id", F.monotonically_increasing_id()), "digests")


def shrink(counts: dict[bytes, int], size: int) -> tuple[dict[bytes, int], int]:
    """The Misra-Gries step: no more than ``size`` counters, and what was taken off each."""
    if len(counts) <= size:
        return counts, 0
    cut = sorted(counts.values(), reverse=True)[size]
    return {value: count - cut for value, count in counts.items() if count > cut}, cut


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}
    error = seen = 0
    for batch in batches:
        seen += batch.num_rows
        for entry in pc.value_counts(batch.column(0)).to_pylist():
            counts[entry["values"]] = counts.get(entry["values"], 0) + entry["counts"]
        counts, cut = shrink(counts, COUNTERS)
        error += cut
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([*counts, None], pa.binary()),
            pa.array([*counts.values(), error], pa.int64()),
            pa.array([0] * len(counts) + [seen], pa.int64()),
        ],
        names=["digest", "counted", "seen"],
    )


def heavy_hitters(rows: DataFrame) -> DataFrame:
    """Each frequent digest with its true count and the row that stays; under 1 / SHARE rows."""
    summaries = written(
        rows.select("digest").mapInArrow(_summary, "digest binary, counted bigint, seen bigint"),
        "summaries",
    )
    totals = (
        summaries.where("digest is null")
        .agg(F.sum("seen").alias("seen"), F.sum("counted").alias("error"))
        .first()
    )
    seen, error = totals["seen"] or 0, totals["error"] or 0
    least = max(2.0, SHARE * seen)
    candidates = (
        summaries.where("digest is not null")
        .groupBy("digest")
        .agg(F.sum("counted").alias("counted"))
        .where(F.col("counted") + error >= least)
        .select("digest")
    )
    # Counters sum to at most the rows, so fewer than 1 / (SHARE - 1 / COUNTERS) pass.
    return (
        rows.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(*_answers())
        .where(F.col("group_size") >= least)
    )


def _answers():
    return (
        F.max(F.struct("doc_id", "row_id")).alias("stays"),
        F.count(F.lit(1)).alias("group_size"),
    )


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, digest, keep_id, group_size, kept; one row per row of ``documents``."""
    rows = digests(documents)
    winners = written(heavy_hitters(rows), "winners")
    frequent = rows.join(F.broadcast(winners), "digest")
    ordinary = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    grouped = ordinary.groupBy("digest").agg(*_answers())
    return frequent.unionByName(ordinary.join(grouped, "digest")).select(
        "doc_id",
        "text_hash",
        "digest",
        F.col("stays.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("stays.row_id")).alias("kept"),
    )


def drop_exact_duplicates(documents: DataFrame) -> DataFrame:
    """All columns of one row per group of equal texts."""
    keys = written(
        exact_duplicates(documents)
        .groupBy("doc_id", "text_hash")
        .agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("times")),
        "exact",
    )
    left = with_keys(documents, keys.where("not kept"), "left_anti")
    repeated = keys.where("kept and times > 1")
    if repeated.isEmpty():
        return left
    # Rows that repeat doc_id and text: one of them, the first that each task meets.
    row = F.struct(*(F.col(name) for name in documents.columns))
    single = (
        with_keys(left, repeated, "left_semi")
        .groupBy("doc_id", F.coalesce("text", F.lit("")))
        .agg(F.first(row).alias("row"))
        .select("row.*")
    )
    return with_keys(left, repeated, "left_anti").unionByName(single)
