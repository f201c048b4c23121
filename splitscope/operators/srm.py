"""Sample-ratio mismatch: did the arms get the traffic they should have?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splitscope import labels
from splitscope.config import LANDING_PAGE, Experiment, Experiments, as_registry
from splitscope.functions.numeric import chi_square_tail, percent, ratio, round_half_away
from splitscope.operators.exposure import exposed_views
from splitscope.operators.registry import arms_relation

# Chi-square limits of a two-arm split for 1% and 5%.
CHI2_1PCT, CHI2_5PCT = 6.63, 3.84
# The same levels as probabilities, for splits of more arms.
LEVEL_1PCT, LEVEL_5PCT = 0.01, 0.05


def srm_counts(flat: DataFrame, experiments: Experiments = LANDING_PAGE) -> DataFrame:
    """``experiment_id, variant, users``: exact distinct users per arm.

    The distinct count shuffles on (arm, user), so two arms do not mean two
    busy tasks.
    """
    return (
        exposed_views(flat, experiments)
        .groupBy("experiment_id", "variant")
        .agg(F.countDistinct("user_pseudo_id").alias("users"))
    )


def counts_from_units(
    units: DataFrame, experiments: Experiments = LANDING_PAGE, segments: Sequence[str] = ()
) -> DataFrame:
    """The same counts from attributed units that keep crossovers in both arms:
    there is one unit per user and arm, so no further pass over the events.
    Segments of the units split the counts."""
    if isinstance(experiments, Experiment):
        units = units.withColumn("experiment_id", F.lit(experiments.experiment_id))
    return units.groupBy("experiment_id", *segments, "variant").agg(
        F.count("user_pseudo_id").alias("users")
    )


def completed(
    counts: DataFrame, experiments: Experiments, segments: Sequence[str] = (), carry: Sequence[str] = ()
) -> DataFrame:
    """Counts completed with the arms nobody saw, in each segment that anybody
    was seen in, and their chi-square parts. ``carry`` names further columns to keep."""
    planned = arms_relation(counts.sparkSession, experiments).select("experiment_id", "variant", "place", "share")
    keys = ["experiment_id", *segments]
    complete = _in_segments(counts, planned, keys, carry) if segments else _with_unseen(counts, planned, carry)
    total = F.sum("users").over(W.partitionBy(*keys))
    expected = F.col("total").cast("double") * F.col("share")
    gap = F.col("users").cast("double") - F.col("expected")
    return (
        complete.withColumn("total", total)
        .withColumn("expected", expected)
        .withColumn("component", ratio(gap * gap, F.col("expected")))
    )


def _with_unseen(counts: DataFrame, planned: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Every planned arm with its counts, also of experiments that nobody was seen in."""
    rows = planned.select("*", F.lit(0).cast("bigint").alias("users"))
    return (
        rows.unionByName(counts.select("experiment_id", "variant", "users", *carry), allowMissingColumns=True)
        .groupBy("experiment_id", "variant")
        .agg(*[F.max(c).alias(c) for c in ("place", "share")], F.sum("users").alias("users"), *[F.max(c).alias(c) for c in carry])
    )


def _in_segments(counts: DataFrame, planned: DataFrame, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Every planned arm in each segment of its experiment, from one grouping: the few arms of a segment meet in a row."""
    own = F.struct("variant", "users", *carry)
    seen = counts.groupBy(*keys).agg(F.collect_list(own).alias("_seen")).join(F.broadcast(planned), "experiment_id")
    found = F.get(F.filter("_seen", lambda s: s["variant"] == F.col("variant")), F.lit(0))
    rows = seen.withColumn("_own", found)
    users = F.coalesce(F.col("_own.users"), F.lit(0).cast("bigint")).alias("users")
    return rows.select(*keys, "variant", "place", "share", users, *[F.col(f"_own.{c}").alias(c) for c in carry])


def _ordered_sum(column: str) -> Column:
    """Sum, smallest first, so that the last digit does not depend on row
    order. Gathers one value per arm of an experiment. NULL without values."""
    values = F.array_sort(F.collect_list(column))
    return F.when(F.count(column) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v))


def _drop_id(frame: DataFrame, experiments: Experiments) -> DataFrame:
    return frame.drop("experiment_id") if isinstance(experiments, Experiment) else frame


def srm_split(
    counts: DataFrame, experiments: Experiments = LANDING_PAGE, segments: Sequence[str] = ()
) -> DataFrame:
    """Observed against expected users per arm, from :func:`srm_counts`."""
    return _drop_id(
        completed(counts, experiments, segments).select(
            "experiment_id",
            *segments,
            "variant",
            "users",
            round_half_away(F.col("expected"), 0).alias("expected_users"),
            percent(ratio(F.col("users"), F.col("total")), 1).alias("actual_pct"),
            percent(F.col("share"), 1).alias("expected_pct"),
            round_half_away(F.col("component"), 2).alias("chi_square_component"),
        ),
        experiments,
    )


def _beyond(chi2: Column, df: Column, tail: Column, limit: float, level: float) -> Column:
    return F.when(df == 1, chi2 > limit).otherwise(tail < level)


def split_aggregates() -> list[Column]:
    """The statistic and its degrees of freedom, over the completed arms of an experiment."""
    return [
        _ordered_sum("component").alias("chi_square_statistic"),
        (F.count("*") - 1).cast("int").alias("degrees_of_freedom"),
    ]


def judged(tested: DataFrame, experiments: Experiments) -> DataFrame:
    """Rows with :func:`split_aggregates`, with the unrounded ``tail`` probability and the verdict ``srm_result``."""
    chi2, df = F.col("chi_square_statistic"), F.col("degrees_of_freedom")
    sizes = {len(e.arms) - 1 for e in as_registry(experiments)}
    tested = tested.withColumn("tail", F.coalesce(*[F.when(df == n, chi_square_tail(chi2, n)) for n in sorted(sizes)]))
    tail = F.col("tail")
    verdict = (
        F.when(chi2.isNull(), labels.SRM_NO_DATA)
        .when(_beyond(chi2, df, tail, CHI2_1PCT, LEVEL_1PCT), labels.SRM_DETECTED)
        .when(_beyond(chi2, df, tail, CHI2_5PCT, LEVEL_5PCT), labels.SRM_POSSIBLE)
        .otherwise(labels.SRM_NONE)
    )
    return tested.withColumn("srm_result", verdict)


def srm_test(
    counts: DataFrame, experiments: Experiments = LANDING_PAGE, segments: Sequence[str] = ()
) -> DataFrame:
    """Chi-square test of the split, from :func:`srm_counts`.

    An arm that nobody saw counts with zero users; without any user at all the
    statistic is NULL and the verdict says so. With two arms the verdict follows
    the limits of the statistic, with more the p-value of its degrees of freedom.
    """
    tested = completed(counts, experiments, segments).groupBy("experiment_id", *segments).agg(*split_aggregates())
    return _drop_id(
        judged(tested, experiments).select(
            "experiment_id",
            *segments,
            F.lit(labels.SRM_NAME).alias("test_name"),
            "chi_square_statistic",
            "degrees_of_freedom",
            round_half_away(F.col("tail"), 4).alias("p_value"),
            "srm_result",
        ),
        experiments,
    )
