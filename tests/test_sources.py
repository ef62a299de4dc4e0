"""Table checks and the shared folder."""

from __future__ import annotations

import pytest

from tallybook.sources import SCHEMAS, read_table, run_folder
from tallybook.sources import workspace


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_tables_have_their_columns(spark, tables, name):
    table = read_table(spark, tables, name)
    assert [(f.name, f.dataType) for f in table.schema] == [
        (f.name, f.dataType) for f in SCHEMAS[name]
    ]


def test_missing_and_mistyped_columns_are_named(spark, tmp_path):
    frame = spark.createDataFrame([("1",)], "r_regionkey string")
    frame.write.parquet(f"{tmp_path}/region.parquet")
    with pytest.raises(ValueError, match="r_regionkey: string instead of int; r_name: missing"):
        read_table(spark, str(tmp_path), "region")


def test_more_columns_than_needed_are_fine(spark, tmp_path):
    frame = spark.createDataFrame([(1, "x", 2)], "r_regionkey int, r_name string, extra int")
    frame.write.parquet(f"{tmp_path}/region.parquet")
    assert read_table(spark, str(tmp_path), "region").count() == 1


def test_run_folders_are_new_and_under_the_shared_folder(spark):
    shared = spark.conf.get(workspace.CHECKPOINT_SETTING)
    first, second = run_folder(spark, "x"), run_folder(spark, "x")
    assert first != second
    assert first.startswith(shared + "/x-")


class Session:
    """As much of a session as run_folder asks for."""

    def __init__(self, master: str, shared: str | None):
        self.conf = {workspace.CHECKPOINT_SETTING: shared}
        self.sparkContext = type("Context", (), {"master": master})


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        run_folder(Session("yarn", None), "x")
    assert run_folder(Session("yarn", "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
