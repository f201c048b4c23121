"""Numeric column helpers. All of them work on doubles: decimal literals would
round reciprocals to a few places and shift the test statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chebyshev coefficients of erfc on [0, inf), c0 first.
_ERFC_COEFFICIENTS = (
    -1.3026537197817094,
    0.6419697923564902,
    0.019476473204185836,
    -0.00956151478680863,
    -0.000946595344482036,
    0.000366839497852761,
    4.2523324806907e-05,
    -2.0278578112534e-05,
    -1.624290004647e-06,
    1.30365583558e-06,
    1.5626441722e-08,
    -8.5238095915e-08,
    6.529054439e-09,
    5.059343495e-09,
    -9.91364156e-10,
    -2.27365122e-10,
    9.6467911e-11,
    2.394038e-12,
    -6.886027e-12,
    8.94487e-13,
    3.13092e-13,
    -1.12708e-13,
    3.81e-16,
    7.106e-15,
    -1.523e-15,
    -9.4e-17,
    1.21e-16,
    -2.8e-17,
)

SQRT_2 = 2.0**0.5


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; NULL instead of an error when the divisor is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def round_half_away(value: Column, digits: int) -> Column:
    """Round to ``digits`` places, halves away from zero, on the double itself.

    Spark's own ``round`` goes through the decimal string of the double, which
    other engines do not. Never returns a negative zero.
    """
    value = value.cast("double")
    scale = F.lit(float(10**digits))
    size = F.floor(F.abs(value) * scale + F.lit(0.5)).cast("double") / scale
    # Adding zero turns -0.0 into 0.0.
    return F.signum(value) * size + F.lit(0.0)


def percent(share: Column, digits: int = 2) -> Column:
    return round_half_away(share * F.lit(100.0), digits)


def erfc(x: Column) -> Column:
    """Complementary error function to about 3e-16.

    Clenshaw's recurrence over a literal array, so the whole thing stays a
    Catalyst expression. Meant for result rows, not for the scan.
    """
    z = F.abs(x)
    t = F.lit(2.0) / (F.lit(2.0) + z)
    y = F.lit(4.0) * t - F.lit(2.0)
    tail = F.expr("array(" + ", ".join(f"{c!r}D" for c in reversed(_ERFC_COEFFICIENTS[1:])) + ")")
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("dd"))

    def step(acc: Column, c: Column) -> Column:
        return F.struct((y * acc["d"] - acc["dd"] + c).alias("d"), acc["d"].alias("dd"))

    def finish(acc: Column) -> Column:
        poly = F.lit(0.5) * (F.lit(_ERFC_COEFFICIENTS[0]) + y * acc["d"]) - acc["dd"]
        return t * F.exp(poly - z * z)

    upper = F.aggregate(tail, zero, step, finish)
    return F.when(x < 0, F.lit(2.0) - upper).otherwise(upper)


def normal_cdf(x: Column) -> Column:
    return F.lit(0.5) * erfc(-x / F.lit(SQRT_2))


def chi_square_tail(x: Column, df: int) -> Column:
    """Probability of a chi-square value above ``x``. For whole degrees of
    freedom the tail is a finite sum: of ``exp(-x/2) (x/2)^k / k!`` from k = 0
    on for even ones, of half-integer steps after an ``erfc`` for odd ones."""
    half = x / F.lit(2.0)
    odd = df % 2
    total = erfc(F.sqrt(half)) if odd else F.lit(0.0)
    for k in range(df // 2):
        power = k + odd / 2
        term = F.exp(-half) * F.pow(half, F.lit(power)) / F.lit(math.gamma(power + 1))
        total = total + term
    return total
