"""Sample sizes from measured baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitscope.config import LANDING_PAGE, Experiments, PowerSettings, experiment_keys
from splitscope.functions.numeric import percent, ratio, round_half_away
from splitscope.operators.pairing import placed

# The planned effect and the two scenarios around it.
DEFAULT_GRID = (
    ("Sample Size Calculation", 0.15),
    ("Scenario: 10% MDE (smaller effect)", 0.10),
    ("Scenario: 20% MDE (larger effect)", 0.20),
)


def measured_baselines(
    units: DataFrame, experiments: Experiments = LANDING_PAGE, segments: Sequence[str] = ()
) -> DataFrame:
    """``[experiment_id,] segments..., baseline_cr, daily_traffic`` from attributed units.

    The baseline is the control's conversion rate; the daily traffic the mean,
    over days with any, of users newly exposed that day.
    """
    segments = [*experiment_keys(experiments), *segments]
    units = placed(units, experiments)
    in_control = F.col("place") == 0
    day = F.to_date(F.timestamp_micros("session_start"))
    daily = (
        units.withColumn("day", day)
        .groupBy(*segments, "day")
        .agg(
            F.countDistinct("user_pseudo_id").alias("users"),
            F.count_if(in_control).alias("visitors"),
            F.sum(F.when(in_control, F.col("converted"))).alias("converted"),
        )
    )
    return daily.groupBy(*segments).agg(
        ratio(F.sum("converted"), F.sum("visitors")).alias("baseline_cr"),
        ratio(F.sum("users"), F.count("*")).alias("daily_traffic"),
    )


def _users_per_arm(p1: Column, p2: Column, settings: PowerSettings) -> Column:
    """Two-proportion sample size for moving a rate from p1 to p2."""
    one, two = F.lit(1.0), F.lit(2.0)
    middle = (p1 + p2) / two
    under_null = F.sqrt(two * middle * (one - middle))
    under_effect = F.sqrt(p1 * (one - p1) + p2 * (one - p2))
    reach = F.lit(settings.z_alpha) * under_null + F.lit(settings.z_beta) * under_effect
    gap = p2 - p1
    return F.when(p2 <= one, ratio(reach * reach, gap * gap))


def sample_size(
    baselines: DataFrame,
    grid: Sequence[tuple[str, float]] = DEFAULT_GRID,
    settings: PowerSettings = PowerSettings(),
) -> DataFrame:
    """Users needed per arm, for each baseline row and each effect of the grid.

    ``baselines`` has ``baseline_cr``, may have ``daily_traffic``, and any
    segment columns, which are kept. Sizes are NULL where a rate of zero or a
    target above one leaves nothing to compute.
    """
    measured = "daily_traffic" in baselines.columns
    segments = [c for c in baselines.columns if c not in ("baseline_cr", "daily_traffic")]
    choices = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit(float(mde)).alias("mde")) for name, mde in grid]
    )
    rows = baselines.select("*", F.inline(choices))
    p1, mde = F.col("baseline_cr"), F.col("mde")
    rows = rows.withColumn("target", p1 * (F.lit(1.0) + mde))
    rows = rows.withColumn("n", _users_per_arm(p1, F.col("target"), settings))
    total = F.col("n") * F.lit(2.0)

    def days(traffic: float) -> Column:
        return round_half_away(total / F.lit(traffic), 1).alias(
            f"days_at_{int(traffic) // 1000}k_daily_traffic"
        )

    traffic = [
        round_half_away(F.col("daily_traffic"), 2).alias("daily_traffic"),
        round_half_away(ratio(total, F.col("daily_traffic")), 1).alias("days_at_measured_traffic"),
    ]
    return rows.select(
        *segments,
        F.col("name").alias("calculation_type"),
        percent(p1).alias("baseline_cr_pct"),
        percent(F.col("target")).alias("target_cr_pct"),
        percent(mde, 1).alias("mde_relative_pct"),
        percent(p1 * mde, 3).alias("mde_absolute_pp"),
        round_half_away(F.lit(settings.alpha), 2).alias("alpha"),
        round_half_away(F.lit(settings.power), 2).alias("power"),
        round_half_away(F.lit(settings.z_alpha), 2).alias("z_alpha"),
        round_half_away(F.lit(settings.z_beta), 2).alias("z_beta"),
        round_half_away(F.col("n"), 0).alias("sample_size_per_variant"),
        round_half_away(total, 0).alias("total_sample_size"),
        round_half_away(total / F.lit(1000.0), 1).alias("total_sample_size_k"),
        days(1000.0),
        days(5000.0),
        days(10000.0),
        *(traffic if measured else []),
    )
