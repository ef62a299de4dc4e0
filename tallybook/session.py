"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

MIB = 1024 * 1024


def shuffle_partitions(shuffled_bytes: int, cores: int, target_bytes: int = 128 * MIB) -> int:
    """Shuffle partitions that keep each one near ``target_bytes``, and no fewer than the cores.

    ``session`` sets it: adaptive execution merges partitions that come out small, but
    never splits a plain aggregate's partition that comes out big.
    """
    return max(cores, -(-shuffled_bytes // target_bytes))


def session(
    master: str | None = None,
    partitions: int | None = None,
    shuffled_bytes: int | None = None,
    cores: int = 1,
    **settings: str,
) -> SparkSession:
    """A session with ANSI arithmetic, UTC and adaptive execution.

    ``master`` is left to ``spark-submit`` unless given. ``partitions`` is the number of
    shuffle partitions; without it, the bytes expected in the largest shuffle and the cluster's
    cores decide. ``settings`` uses ``__`` for dots.
    """
    if partitions is None and shuffled_bytes is not None:
        partitions = shuffle_partitions(shuffled_bytes, cores)
    builder = (
        SparkSession.builder.appName("tallybook")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()
