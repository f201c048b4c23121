"""Conversion statistics per variant and the tests built on them.

Everything after :func:`variant_stats` works on one row per experiment,
segment and variant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitscope import labels
from splitscope.config import LANDING_PAGE, Experiments, experiment_keys
from splitscope.functions.numeric import (
    SQRT_2,
    erfc,
    normal_cdf,
    percent,
    ratio,
    round_half_away,
)
from splitscope.operators.pairing import pair_arms

# Two-sided 95% normal quantile and the conventional h limits.
Z_95 = 1.96
SMALL_H, MEDIUM_H, LARGE_H = 0.2, 0.5, 0.8


def variant_stats(
    units: DataFrame, experiments: Experiments = LANDING_PAGE, segments: Sequence[str] = ()
) -> DataFrame:
    """Visitors, conversions, rate, standard deviation and Beta(1,1) posterior
    parameters per variant. The sample deviation of a 0/1 column follows from
    its two counts, which makes it exact and independent of row order."""
    counts = units.groupBy(*experiment_keys(experiments), *segments, "variant").agg(
        F.count("*").alias("visitors"), F.sum("converted").alias("conversions")
    )
    return rated(counts)


def _pairs(stats: DataFrame, experiments: Experiments, segments: Sequence[str]):
    keys = [*experiment_keys(experiments), *segments]
    columns = ["visitors", "conversions", "cr", "alpha", "beta"]
    pairs = pair_arms(stats, experiments, columns, segments)
    return pairs, keys, F.col("a"), F.col("b")


def _with(frame: DataFrame, **columns: Column) -> DataFrame:
    return frame.withColumns(columns)


def z_test(
    stats: DataFrame, experiments: Experiments = LANDING_PAGE, segments: Sequence[str] = ()
) -> DataFrame:
    """Two-proportion z-test. The statistic uses the pooled standard error,
    the 95% interval of the difference the unpooled one. Where the pooled
    error is zero the statistic is NULL and the result not significant."""
    pairs, keys, *_ = _pairs(stats, experiments, segments)
    return z_scores(pairs, keys)


def rated(counts: DataFrame) -> DataFrame:
    """Counts per arm, ``visitors`` and ``conversions``, with what follows from them."""
    n, c = F.col("visitors"), F.col("conversions")
    spread = F.sqrt(ratio(c * (n - c), n * (n - 1)))
    return counts.withColumns({"cr": ratio(c, n), "stddev": spread, "alpha": c + 1, "beta": n - c + 1})


def z_scores(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The test of each pair of rated arms ``a`` and ``b``, behind the columns ``keys``."""
    a, b = F.col("a"), F.col("b")
    na, nb = a.visitors.cast("double"), b.visitors.cast("double")
    pooled = ratio(a.conversions + b.conversions, a.visitors + b.visitors)
    one = F.lit(1.0)
    work = _with(
        pairs,
        diff=b.cr - a.cr,
        pooled_se=F.sqrt(pooled * (one - pooled) * (one / na + one / nb)),
        se=F.sqrt(a.cr * (one - a.cr) / na + b.cr * (one - b.cr) / nb),
    ).withColumn("z", ratio(F.col("diff"), F.col("pooled_se")))
    z, diff, margin = F.col("z"), F.col("diff"), F.lit(Z_95) * F.col("se")
    return work.select(
        *keys,
        a.variant.alias("control_name"),
        b.variant.alias("variant_name"),
        a.visitors.alias("control_visitors"),
        b.visitors.alias("variant_visitors"),
        a.conversions.alias("control_conversions"),
        b.conversions.alias("variant_conversions"),
        percent(a.cr).alias("control_cr_pct"),
        percent(b.cr).alias("variant_cr_pct"),
        percent(diff).alias("difference_pct_points"),
        percent(ratio(diff, a.cr)).alias("relative_improvement_pct"),
        round_half_away(z, 2).alias("z_score"),
        round_half_away(erfc(F.abs(z) / F.lit(SQRT_2)), 4).alias("p_value_two_tailed"),
        round_half_away(diff - margin, 4).alias("ci_lower"),
        round_half_away(diff + margin, 4).alias("ci_upper"),
        F.when(F.abs(z) > Z_95, labels.SIGNIFICANT)
        .otherwise(labels.NOT_SIGNIFICANT)
        .alias("significance"),
    )


def _beta_mean(arm: Column) -> Column:
    return ratio(arm.alpha, arm.alpha + arm.beta)


def _beta_variance(arm: Column) -> Column:
    mean, size = _beta_mean(arm), (arm.alpha + arm.beta).cast("double")
    return mean * (F.lit(1.0) - mean) / (size + F.lit(1.0))


def bayes_test(
    stats: DataFrame, experiments: Experiments = LANDING_PAGE, segments: Sequence[str] = ()
) -> DataFrame:
    """P(B > A) from Beta(1,1) priors, by a normal approximation of the
    difference of the posteriors. Verdicts use the probability rounded to four
    places."""
    pairs, keys, a, b = _pairs(stats, experiments, segments)
    spread = F.sqrt(_beta_variance(a) + _beta_variance(b))
    shift = ratio(_beta_mean(b) - _beta_mean(a), spread)
    work = pairs.withColumn("shift", shift).withColumn(
        "p", round_half_away(normal_cdf(F.col("shift")), 4)
    )
    p = F.col("p")
    verdict = (
        F.when(p > 0.95, labels.BAYES_STRONG_B)
        .when(p > 0.90, labels.BAYES_MODERATE_B)
        .when(p < 0.10, labels.BAYES_STRONG_A)
        .when(p.between(0.40, 0.60), labels.BAYES_INCONCLUSIVE)
        .otherwise(labels.BAYES_WEAK)
    )
    return work.select(
        *keys,
        a.variant.alias("control"),
        b.variant.alias("variant"),
        a.visitors.alias("control_visitors"),
        b.visitors.alias("variant_visitors"),
        a.conversions.alias("control_conversions"),
        b.conversions.alias("variant_conversions"),
        percent(a.cr).alias("control_cr_pct"),
        percent(b.cr).alias("variant_cr_pct"),
        percent(b.cr - a.cr).alias("difference_pct_points"),
        p.alias("probability_b_better"),
        percent(p, 1).alias("probability_b_better_pct"),
        verdict.alias("bayesian_decision"),
    )


def effect_size(
    stats: DataFrame, experiments: Experiments = LANDING_PAGE, segments: Sequence[str] = ()
) -> DataFrame:
    """Cohen's h, absolute risk difference and relative lift."""
    pairs, keys, a, b = _pairs(stats, experiments, segments)
    two = F.lit(2.0)
    work = _with(
        pairs,
        h=two * F.asin(F.sqrt(b.cr)) - two * F.asin(F.sqrt(a.cr)),
        diff=b.cr - a.cr,
    )
    h, size, diff = F.col("h"), F.abs(F.col("h")), F.col("diff")
    verdict = (
        F.when(size < SMALL_H, labels.EFFECT_NEGLIGIBLE)
        .when(size < MEDIUM_H, labels.EFFECT_SMALL)
        .when(size < LARGE_H, labels.EFFECT_MEDIUM)
        .otherwise(labels.EFFECT_LARGE)
    )
    return work.select(
        *keys,
        a.variant.alias("control"),
        b.variant.alias("variant"),
        a.visitors.alias("control_visitors"),
        b.visitors.alias("variant_visitors"),
        percent(a.cr).alias("control_cr_pct"),
        percent(b.cr).alias("variant_cr_pct"),
        percent(diff, 3).alias("risk_difference_pp"),
        percent(ratio(diff, a.cr)).alias("relative_lift_pct"),
        round_half_away(h, 4).alias("cohens_h"),
        verdict.alias("effect_size_label"),
    )
