"""Cents against Python decimals."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallybook.functions import cents, discounted_cents, ratio, total, units

TWO = Decimal("0.01")
quiet = settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def as_cents(amount: float) -> int:
    """Half away from zero on the shortest text of the double, as a decimal cast does."""
    return int(Decimal(repr(amount)).quantize(TWO, ROUND_HALF_UP) * 100)


AWKWARD = [
    0.0, -0.0, 0.005, -0.005, 0.015, 1.005, -1.005, 2.675, 0.285, 0.125, 1e-9, 104997.88,
    0.1 + 0.2, 4503599627370.49, -4503599627370.5, 5629499534213.125, 99999999999999.98,
    9007199254740993.0, 1234567890123456.8,
]


def test_cents_of_awkward_amounts(spark):
    frame = spark.createDataFrame([(x,) for x in AWKWARD], "amount double")
    found = [tuple(row) for row in frame.select("amount", cents("amount")).collect()]
    assert found == [(x, as_cents(x)) for x in AWKWARD]


@quiet
@given(st.lists(st.floats(-1e13, 1e13, allow_nan=False), min_size=50, max_size=200))
def test_cents_of_any_amount(spark, amounts):
    frame = spark.createDataFrame([(x,) for x in amounts], "amount double")
    assert [row[0] for row in frame.select(cents("amount")).collect()] == [
        as_cents(x) for x in amounts
    ]


@quiet
@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(0, 100)), min_size=50, max_size=200))
def test_discounted_cents(spark, pairs):
    data = [(price / 100, discount / 100) for price, discount in pairs]
    frame = spark.createDataFrame(data, "price double, discount double")
    expected = [
        int((Decimal(p) / 100 * (1 - Decimal(d) / 100)).quantize(TWO, ROUND_HALF_UP) * 100)
        for p, d in pairs
    ]
    assert [row[0] for row in frame.select(discounted_cents("price", "discount")).collect()] == expected


@quiet
@given(
    st.lists(
        st.tuples(st.integers(-10**15, 10**15), st.integers(-10**6, 3 * 10**6)), min_size=50, max_size=200
    )
)
def test_discounts_of_six_decimals(spark, pairs):
    """Small products and ones beyond a bigint alike, prices as the double holds them."""
    data = [(price / 100, discount / 10**6) for price, discount in pairs]
    frame = spark.createDataFrame(data, "price double, discount double")
    expected = [
        int((Decimal(as_cents(p)) * (1 - Decimal(d) / 10**6)).quantize(Decimal(1), ROUND_HALF_UP))
        for (p, _), (_, d) in zip(data, pairs)
    ]
    assert [row[0] for row in frame.select(discounted_cents("price", "discount")).collect()] == expected


def test_an_eighth_off_a_million(spark):
    frame = spark.createDataFrame([(1_000_000.0, 0.125)], "price double, discount double")
    assert frame.select(discounted_cents("price", "discount")).first()[0] == 87_500_000


def test_null_amounts_stay_null(spark):
    frame = spark.createDataFrame([(None,), (1.5,)], "amount double").select(
        cents("amount").alias("amount_cents")
    )
    assert [row[0] for row in frame.collect()] == [None, 150]
    assert frame.agg(total("amount_cents")).first()[0] == Decimal("1.50")
    assert frame.where("amount_cents is null").agg(total("amount_cents")).first()[0] is None


def test_total_goes_beyond_one_bigint(spark):
    values = [9 * 10**18, 9 * 10**18, 9 * 10**18, -7, 123_456_789_012]
    frame = spark.createDataFrame([(v,) for v in values], "amount_cents bigint")
    assert frame.agg(total("amount_cents")).first()[0] == Decimal(sum(values)) / 100


def test_negative_totals(spark):
    frame = spark.createDataFrame([(-1,), (-1048577,), (3,)], "amount_cents bigint")
    assert frame.agg(total("amount_cents")).first()[0] == Decimal("-10485.75")


def test_a_sum_past_its_type_fails_instead_of_wrapping(spark):
    frame = spark.createDataFrame([(9 * 10**18,), (9 * 10**18,)], "amount_cents bigint")
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        frame.agg(F.sum("amount_cents")).collect()


def test_units_and_ratio(spark):
    frame = spark.createDataFrame([(12345, 0), (-5, 3)], "a bigint, b bigint")
    found = [tuple(row) for row in frame.select(units("a"), ratio("a", "b", 4)).collect()]
    assert found == [(Decimal("123.45"), None), (Decimal("-0.05"), -1.6667)]
