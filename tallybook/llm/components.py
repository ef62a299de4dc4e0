"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallybook.llm.common import written


def _large(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on its smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (
        down.join(least, "u")
        .where("v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38)))")).first())


def components(edges: DataFrame) -> DataFrame:
    """``u``, ``root`` for every node that has an edge and is not a root itself.

    ``edges`` has two ``bigint`` columns u and v, u <> v. The root is the smallest node.
    Each step is written, so a lost executor costs one step. Steps needed grow with the
    logarithm of the longest path, squared.
    """
    edges = written(edges.select("u", "v").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        edges = written(_small(_large(edges).distinct()), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select("u", F.col("v").alias("root"))
