"""The Parquet tables the jobs read, with the columns each must have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

def _schema(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


INT, BIGINT, DOUBLE, STRING = IntegerType(), LongType(), DoubleType(), StringType()
MOMENT = TimestampNTZType()

SCHEMAS: dict[str, StructType] = {
    "region": _schema(r_regionkey=INT, r_name=STRING),
    "nation": _schema(n_nationkey=INT, n_name=STRING, n_regionkey=INT),
    "customer": _schema(
        c_custkey=BIGINT, c_name=STRING, c_nationkey=INT, c_acctbal=DOUBLE, c_mktsegment=STRING
    ),
    "supplier": _schema(s_suppkey=BIGINT, s_name=STRING, s_nationkey=INT, s_acctbal=DOUBLE),
    "orders": _schema(
        o_orderkey=BIGINT,
        o_custkey=BIGINT,
        o_orderstatus=STRING,
        o_totalprice=DOUBLE,
        o_orderdate=MOMENT,
        o_orderpriority=STRING,
    ),
    "lineitem": _schema(
        l_orderkey=BIGINT,
        l_partkey=BIGINT,
        l_suppkey=BIGINT,
        l_linenumber=INT,
        l_quantity=DOUBLE,
        l_extendedprice=DOUBLE,
        l_discount=DOUBLE,
        l_tax=DOUBLE,
        l_returnflag=STRING,
        l_linestatus=STRING,
        l_shipdate=MOMENT,
    ),
    "events": _schema(
        event_id=BIGINT, ts=MOMENT, user_id=BIGINT, event_type=STRING, value=DOUBLE, props=STRING
    ),
}


def _name(kind: DataType | None) -> str:
    return kind.simpleString() if kind else "missing"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read ``{root}/{name}.parquet``, one file or a directory of files.

    A schema handed to the reader would turn a missing column into nulls without a
    word, so the columns are checked against the files' own schema instead.
    """
    table = spark.read.parquet(f"{root}/{name}.parquet")
    found = {field.name: field.dataType for field in table.schema}
    wrong = [
        f"{field.name}: {_name(found.get(field.name))} instead of {_name(field.dataType)}"
        for field in SCHEMAS[name]
        if found.get(field.name) != field.dataType
    ]
    if wrong:
        raise ValueError(f"{name} at {root}: " + "; ".join(wrong))
    return table
