"""Money as whole cents.

Inside the jobs an amount is a ``bigint`` count of cents, so that expressions and
aggregation buffers stay primitive. Results leave as decimals. Decimal columns all
the way through give the same values several times slower (README, "Money").
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Doubles up to here times 100 are exact enough to round; see cents().
SAFE_CENTS = 2**49
# One, as a discount of six decimals; prices whose product with twice that fits a bigint.
MICROS = 10**6
SAFE_FACTOR = 2**42
# Low bits split off before summing; see total().
LOW_BITS = 20


def _scaled(amount: str, digits: int) -> str:
    scale = 10**digits
    scaled = f"({amount} * {scale}D)"
    decided = f"abs({scaled}) < {SAFE_CENTS}D AND abs({scaled} - rint({scaled})) < 0.25D"
    by_decimal = f"cast(cast({amount} AS decimal(18,{digits})) * {scale} AS bigint)"
    return f"CASE WHEN {decided} THEN cast(rint({scaled}) AS bigint) ELSE {by_decimal} END"


def _cents(amount: str) -> str:
    return _scaled(amount, 2)


def cents(amount: str) -> Column:
    """Whole cents of a ``double``: what ``cast(amount as decimal(18,2)) * 100`` gives.

    The decimal cast goes through text and is slow, so it only handles what
    multiplying cannot decide: amounts close to half a cent or too big for
    the product to be reliable.
    """
    return F.expr(_cents(amount))


def discounted_cents(price: str, discount: str) -> Column:
    """Cents of ``round(price * (1 - discount), 2)``, half away from zero.

    The price is taken to two decimals first, the discount to six. Where the product could
    pass the limit of a ``bigint`` it is worked out as a decimal, with the same result.
    """
    price, kept = f"({_cents(price)})", f"({MICROS} - ({_scaled(discount, 6)}))"
    half = MICROS // 2
    small = f"({price} * {kept} + if({price} * {kept} < 0, -{half}, {half})) div {MICROS}"
    exact = f"cast({price} AS decimal(18,0)) * cast({kept} AS decimal(12,0))"
    big = f"cast(round(cast({exact} AS decimal(30,0)) * 0.000001BD, 0) AS bigint)"
    fits = f"abs({price}) < {SAFE_FACTOR} AND abs({kept}) <= {2 * MICROS}"
    return F.expr(f"CASE WHEN {fits} THEN {small} ELSE {big} END")


def total(amount_cents: str) -> Column:
    """Aggregate: exact sum of cents, in units, as ``decimal(30,2)``.

    One ``bigint`` sum of cents would pass its limit near 10**17 units, which a
    large book can reach. High and low bits are summed apart, in two ``bigint`` buffers.
    """
    high = f"cast(sum(shiftright({amount_cents}, {LOW_BITS})) AS decimal(20,0))"
    low = f"cast(sum({amount_cents} & {2**LOW_BITS - 1}) AS decimal(20,0))"
    return units(f"{high} * {2**LOW_BITS} + {low}")


def units(amount_cents: str) -> Column:
    """Cents as units, ``decimal(30,2)``."""
    return F.expr(f"cast(cast({amount_cents} AS decimal(29,0)) * 0.01 AS decimal(30,2))")


def ratio(part: str | Column, whole: str | Column, digits: int = 8) -> Column:
    """``part / whole`` as a rounded double; null where ``whole`` is zero."""
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)
