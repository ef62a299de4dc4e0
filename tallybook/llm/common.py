"""What the operators of this folder share: the documents, their identity, written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallybook.sources.workspace import run_folder

#: The characters that separate words, as a character class.
SPACE = r"[\x20\x09-\x0D]"
#: Spark's setting for removing the shuffle files of a finished execution.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Most rows of a list of keys that is broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of a batch that Python works on at a time.
BATCH_BYTES = 8 << 20
#: Spark's setting for the bytes of a batch that it hands to Python, and those that keep it below BATCH_BYTES
#: with the row that goes beyond. Either side holds a batch besides its heap, Spark's default is 64 MB of it.
ARROW_SETTING, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 7 << 20
#: Stands for a missing doc_id in join keys.
NO_ID = -(2**63)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def written(frame: DataFrame, purpose: str, compression: str = "snappy") -> DataFrame:
    """``frame`` as a table in the shared folder: computed once, read by later steps.

    It cuts the lineage: losing an executor afterwards costs only a read.
    """
    spark = frame.sparkSession
    folder = run_folder(spark, purpose)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # its shuffles are of no use once the table is there
    try:
        frame.write.parquet(folder, compression=compression)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(folder)


def text_of(frame: DataFrame) -> Column:
    """The text, a missing one as empty."""
    return F.coalesce(frame["text"].cast("string"), F.lit(""))


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python of ARROW_BYTES from now on, unless the session names its own bound.

    It stays set: results that are handed back are computed only when they are read.
    """
    if spark.conf.get(ARROW_SETTING, None) is None:
        spark.conf.set(ARROW_SETTING, str(ARROW_BYTES))


def identified(frame: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (never null) and ``text_hash``.

    ``doc_id`` and ``text_hash`` together name a document; rows that repeat both are the
    same document more than once.
    """
    bounded_batches(frame.sparkSession)
    text = text_of(frame)
    return frame.select(
        frame["doc_id"].cast("bigint").alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text).alias("text_hash"),
    )


def id_key(column: str = "doc_id") -> Column:
    """``doc_id`` as a join key that is never null."""
    return F.coalesce(F.col(column), F.lit(NO_ID))


def remainder(divisor: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``divisor``; of a missing id, that of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(divisor))


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that what Python makes of one stays small; long texts count by their bytes."""
    for batch in batches:
        parts = max(1, -(-batch.nbytes // BATCH_BYTES))
        rows = max(1, -(-batch.num_rows // parts))
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def in_batches(
    work: Callable[[pa.RecordBatch], pa.RecordBatch],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of one batch for ``mapInArrow``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield work(batch)

    return run


def if_small(keys: DataFrame) -> DataFrame:
    """Marked for broadcasting if counted and short, else left to a shuffle."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def with_keys(frame: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """All columns of the rows whose document is (``left_semi``) or is not (``left_anti``) in keys.

    ``keys`` holds ``doc_id`` and ``text_hash``.
    """
    keys = keys.select(
        id_key().alias("_key_id"), F.col("text_hash").alias("_key_hash")
    ).distinct()
    keys = if_small(written(keys, "keys"))
    own_id = F.coalesce(frame["doc_id"].cast("bigint"), F.lit(NO_ID))
    return frame.join(
        keys,
        (own_id == keys["_key_id"]) & (F.xxhash64(text_of(frame)) == keys["_key_hash"]),
        how,
    )
