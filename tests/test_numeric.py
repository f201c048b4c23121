from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from splitscope.functions.numeric import erfc, normal_cdf, ratio, round_half_away


def evaluate(spark, values, *expressions):
    rows = spark.createDataFrame([(float(v),) for v in values], "x double")
    return rows.select("x", *[e.alias(f"r{i}") for i, e in enumerate(expressions)]).collect()


def test_erfc_on_a_grid(spark):
    grid = [i / 50 for i in range(-300, 301)]
    for row in evaluate(spark, grid, erfc(F.col("x")), normal_cdf(F.col("x"))):
        assert row.r0 == pytest.approx(math.erfc(row.x), abs=1e-15)
        assert row.r1 == pytest.approx(0.5 * math.erfc(-row.x / math.sqrt(2)), abs=1e-15)


def test_published_tail_values(spark):
    chi, z = evaluate(spark, [math.sqrt(3.84 / 2), 1.96 / math.sqrt(2)], erfc(F.col("x")))
    assert chi.r0 == pytest.approx(0.05004, abs=5e-6)
    assert z.r0 == pytest.approx(0.04999579, abs=5e-9)


def test_rounding_is_half_away_from_zero_on_the_double(spark):
    cases = {0.125: 0.13, -0.125: -0.13, 1.005: 1.0, 2.5: 2.5, -0.001: 0.0, 0.0: 0.0}
    for row in evaluate(spark, cases, round_half_away(F.col("x"), 2)):
        assert row.r0 == cases[row.x]
        assert math.copysign(1, row.r0) == (1 if cases[row.x] >= 0 else -1)


def test_ratio_by_zero_is_null(spark):
    (row,) = evaluate(spark, [0.0], ratio(F.lit(1), F.col("x")))
    assert row.r0 is None


@settings(max_examples=5, deadline=None)
@given(values=st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=50))
def test_rounding_stays_close_and_symmetric(spark, values):
    x = F.col("x")
    for row in evaluate(spark, values, round_half_away(x, 3), round_half_away(-x, 3)):
        assert abs(row.r0 - row.x) <= 0.0005 + 1e-9
        assert row.r0 == -row.r1
