from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallybook.llm import common
from tallybook.llm.queries import ORACLE_SQL, QUERIES


def test_each_stage_works_on_what_the_one_before_kept(spark, tables):
    docs = common.documents(spark, tables)
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, tables), "test")
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("kind", ["documents", "empty", "clashing"])
def test_stages_on_nulls_repeats_and_other_columns(spark, request, tables, kind):
    docs = given = request.getfixturevalue(kind)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, tables), "test")
        assert docs.columns == given.columns
    left = {row.doc_id for row in docs.collect()}
    assert left <= {row.doc_id for row in given.collect()} and bool(left) == (kind != "empty")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert {row.doc_id for row in packed.collect()} == left
    if kind == "documents":
        assert {50, 51, 52} & left and {53, 55, 62} <= left  # one of the texts without words, short and long ones


def test_batches_for_python_are_bounded_in_bytes(spark):
    """10,000 rows or 64 MB are Spark's bounds otherwise."""

    def measured(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["size"])

    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 5000).alias("text"))
    before = spark.conf.get(common.ARROW_SETTING, None)
    try:
        spark.conf.unset(common.ARROW_SETTING)
        sizes = [row.size for row in common.identified(rows).mapInArrow(measured, "size bigint").collect()]
        assert sum(sizes) > 3000 * 15_000 and max(sizes) <= common.BATCH_BYTES
        spark.conf.set(common.ARROW_SETTING, "100000")  # a session's own bound holds
        common.identified(rows)
        assert spark.conf.get(common.ARROW_SETTING) == "100000"
    finally:
        spark.conf.unset(common.ARROW_SETTING)
        if before is not None:
            spark.conf.set(common.ARROW_SETTING, before)


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op")) == list(range(1, 14))
    assert ORACLE_SQL.keys() < QUERIES.keys()


def test_a_small_list_is_broadcast_a_long_one_is_not(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    rows = spark.range(1000)
    for count, hinted in ((10, True), (11, False)):
        plan = rows.join(common.if_small(spark.range(count)), "id")._jdf.queryExecution().logical().toString()
        assert ("strategy=broadcast" in plan) == hinted


def test_queries_equal_their_sql(spark, tables):
    import duckdb

    database = duckdb.connect()
    for name in ("documents", "embeddings"):
        database.sql(f"CREATE VIEW {name} AS FROM '{tables}/{name}.parquet'")
    for name, text in ORACLE_SQL.items():
        result = QUERIES[name](spark, tables)
        expected = database.sql(text)
        assert sorted(expected.columns) == sorted(result.columns)
        found = sorted(map(tuple, result.select(*expected.columns).collect()))
        assert found == sorted(expected.fetchall()), name
