"""Rates looked up by the band an amount falls in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from tallybook.functions import total


@dataclass(frozen=True)
class Band:
    """Amounts in ``[low, high)``; no ``high`` means no upper end. The rate is the caller's."""

    name: str
    low: Decimal
    high: Decimal | None
    rate: Decimal


def _check(bands: Sequence[Band]) -> list[Band]:
    if not bands:
        raise ValueError("no bands")
    ordered = sorted(bands, key=lambda band: band.low)
    for band in ordered:
        if band.high is not None and band.high <= band.low:
            raise ValueError(f"band {band.name} is empty")
    for lower, upper in zip(ordered, ordered[1:]):
        if lower.high is None or lower.high > upper.low:
            raise ValueError(f"bands {lower.name} and {upper.name} overlap")
    return ordered


def _to_cents(amount: Decimal) -> int:
    whole = amount * 100
    if whole != int(whole):
        raise ValueError(f"band limit {amount} is not in whole cents")
    return int(whole)


def _number(amount: Column, ordered: Sequence[Band]) -> Column:
    """Position of the band that holds an amount; null where none does.

    A binary search for the last low limit that is not above the amount: a fold over the
    step widths, each of which is taken if it stays in the table and below the amount.
    """
    lows = F.lit([_to_cents(band.low) for band in ordered]).cast("array<bigint>")
    open_end = 2**63 - 1
    highs = F.lit(
        [open_end if band.high is None else _to_cents(band.high) for band in ordered]
    ).cast("array<bigint>")
    widths = [1 << bit for bit in range(len(ordered).bit_length() - 1, -1, -1)]

    def step(found: Column, width: Column) -> Column:
        return F.when(F.get(lows, found + width) <= amount, found + width).otherwise(found)

    found = F.aggregate(F.lit(widths).cast("array<int>"), F.lit(-1), step)
    high = F.get(highs, found)
    return F.when((found >= 0) & ((amount < high) | (high == open_end)), found)


def band_rates(receivables: DataFrame, bands: Sequence[Band]) -> DataFrame:
    """``band, n_receivables, face_value, rate, rated_value`` (sum of face value × rate).

    The parameter table becomes sorted constant arrays and a binary search over them, so no
    row is joined to anything and the expression does not grow with the table. The rate is constant in a band and multiplies the band's exact total.
    Amounts in no band come out as a row with a null band.
    """
    ordered = _check(bands)
    number = _number(F.col("face_cents"), ordered)
    names = F.array(*(F.lit(band.name) for band in ordered))
    rates = F.array(*(F.lit(str(band.rate)).cast("decimal(9,6)") for band in ordered))
    return (
        receivables.groupBy(number.alias("number"))
        .agg(F.count("*").alias("n_receivables"), total("face_cents").alias("face_value"))
        .select(
            F.get(names, F.col("number")).alias("band"),
            "n_receivables",
            "face_value",
            F.get(rates, F.col("number")).alias("rate"),
        )
        .withColumn(
            "rated_value",
            F.round(F.col("face_value").cast("decimal(28,2)") * F.col("rate"), 2),
        )
    )
