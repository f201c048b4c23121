from __future__ import annotations

import pytest

from splitscope import PowerSettings
from splitscope.operators.planning import measured_baselines, sample_size

GRID = [(f"{m:.0%}", m) for m in (0.10, 0.15, 0.20, 0.30)]


def test_sizes_of_the_two_percent_baseline(spark):
    rows = sample_size(spark.createDataFrame([(0.02,)], "baseline_cr double"), GRID).collect()
    exact = [80590.104, 36651.260, 21084.504, 9786.193]
    assert [r.sample_size_per_variant for r in rows] == [round(n) for n in exact]
    assert [r.total_sample_size for r in rows] == [round(2 * n) for n in exact]
    assert [r.days_at_1k_daily_traffic for r in rows] == [round(2 * n / 1000, 1) for n in exact]
    one = rows[1]
    assert (one.baseline_cr_pct, one.target_cr_pct, one.mde_absolute_pp) == (2.0, 2.3, 0.3)
    assert (one.alpha, one.power, one.z_alpha, one.z_beta) == (0.05, 0.8, 1.96, 0.84)
    assert "daily_traffic" not in one


def test_quantiles_can_follow_from_the_levels(spark):
    settings = PowerSettings.for_levels(0.05, 0.8)
    assert (round(settings.z_alpha, 4), round(settings.z_beta, 4)) == (1.96, 0.8416)
    frame = spark.createDataFrame([(0.02,)], "baseline_cr double")
    stricter = PowerSettings.for_levels(0.01, 0.9)
    sizes = [sample_size(frame, settings=s).first() for s in (settings, stricter)]
    assert sizes[0].sample_size_per_variant < sizes[1].sample_size_per_variant
    assert (sizes[1].alpha, sizes[1].power) == (0.01, 0.9)


@pytest.mark.parametrize("baseline", [0.0, 0.95, None])
def test_nothing_to_size(spark, baseline):
    frame = spark.createDataFrame([(baseline,)], "baseline_cr double")
    assert sample_size(frame, [("x", 0.2)]).first().sample_size_per_variant is None


def test_measured_baseline_and_traffic(spark):
    day = 86_400_000_000
    units = spark.createDataFrame(
        [
            ("a", "Control_A", 0, 1),
            ("b", "Control_A", 1, 0),
            ("a", "Variant_B", 2, 1),
            ("c", "Variant_B", day, 0),
        ],
        "user_pseudo_id string, variant string, session_start bigint, converted int",
    )
    row = measured_baselines(units).first()
    assert (row.baseline_cr, row.daily_traffic) == (0.5, 1.5)
