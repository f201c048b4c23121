"""Putting the control's and a treatment's figures side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitscope.config import Experiment, Experiments, experiment_keys
from splitscope.operators.registry import with_places


def placed(stats: DataFrame, experiments: Experiments) -> DataFrame:
    """Rows per variant with the arm's ``place``, 0 for the control. A registry joins as a relation, whatever its size."""
    if not isinstance(experiments, Experiment):
        return with_places(stats, experiments)
    labels = F.array(*[F.lit(a.variant) for a in experiments.arms])
    place = (F.array_position(labels, F.col("variant")) - 1).cast("int")
    return stats.withColumn("place", place).where("place >= 0")


def side_by_side(payload: Column) -> list[Column]:
    """Aggregates over the arms of an experiment: the control's payload ``a`` and the treatments', ``bs``, in order."""
    treatment = F.when((F.col("place") > 0) & payload.isNotNull(), F.struct("place", payload.alias("b")))
    return [
        F.max(F.when(F.col("place") == 0, payload)).alias("a"),
        F.array_sort(F.collect_list(treatment)).alias("bs"),
    ]


def pair_arms(
    stats: DataFrame, experiments: Experiments, columns: Sequence[str], segments: Sequence[str] = ()
) -> DataFrame:
    """``[experiment_id, segments...,] a, b``: one row per treatment, with the
    named columns of the control in struct ``a`` and of the treatment in ``b``.

    One grouping of the few rows of ``stats`` by experiment and segment; there
    is no row when either arm is missing.
    """
    keys = [*experiment_keys(experiments), *segments]
    wide = placed(stats, experiments).groupBy(*keys).agg(*side_by_side(F.struct("variant", *columns)))
    return wide.where(F.col("a").isNotNull()).select(*keys, "a", F.explode("bs.b").alias("b"))
