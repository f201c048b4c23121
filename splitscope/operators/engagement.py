"""Reports over :func:`splitscope.operators.sessions.session_metrics`:
guardrails, engagement per variant and the bounce comparison.

Averages are ratios of integer sums (durations in hundredths of a minute), so
they do not depend on partitioning or row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitscope import labels
from splitscope.config import LANDING_PAGE, Experiments, GuardrailLimits, experiment_keys
from splitscope.functions.numeric import percent, ratio, round_half_away
from splitscope.operators.pairing import pair_arms


GUARDRAIL_METRICS = ("sessions", "bounce_rate_pct", "avg_session_duration_min", "cart_abandonment_rate_pct")


def _share(flag: Column) -> Column:
    return ratio(F.count_if(flag), F.count("*"))


def _mean(count: str) -> Column:
    return ratio(F.sum(count), F.count("*"))


def _hundredths() -> Column:
    return F.floor(F.col("session_duration_min") * F.lit(100.0) + F.lit(0.5))


def _mean_duration() -> Column:
    return ratio(F.sum(_hundredths()), F.count("session_duration_min")) / F.lit(100.0)


def _bounced() -> Column:
    return F.col("is_bounce") == 1


def guardrail_sums() -> list[Column]:
    """Aggregates over session metrics that :func:`guardrail_rates` needs; sums of them serve as well."""
    abandoned = (F.col("added_to_cart") == 1) & (F.col("purchased") == 0)
    return [
        F.count("*").alias("session_rows"),
        F.count_if(_bounced()).alias("bounces"),
        F.sum(_hundredths()).alias("hundredths"),
        F.count("session_duration_min").alias("timed"),
        F.sum("pages_per_session").alias("pages"),
        F.sum("added_to_cart").alias("carts"),
        F.count_if(abandoned).alias("abandoned"),
        F.sum("engagement_events").alias("engaged"),
    ]


def guardrail_rates() -> list[Column]:
    """The secondary metrics, from the sums."""
    mean = lambda total: ratio(F.col(total), F.col("session_rows"))
    duration = ratio(F.col("hundredths"), F.col("timed")) / F.lit(100.0)
    return [
        percent(mean("bounces")).alias("bounce_rate_pct"),
        round_half_away(duration, 2).alias("avg_session_duration_min"),
        round_half_away(mean("pages"), 2).alias("avg_pages_per_session"),
        percent(ratio(F.col("abandoned"), F.col("carts"))).alias("cart_abandonment_rate_pct"),
        round_half_away(mean("engaged"), 2).alias("avg_engagement_events"),
    ]


def guardrail_stats(
    metrics: DataFrame, experiments: Experiments = LANDING_PAGE, detail: bool = False, segments: Sequence[str] = ()
) -> DataFrame:
    """Secondary metrics per variant. ``sessions`` counts distinct users;
    ``detail`` adds ``session_rows``, the rows averaged over."""
    keys = [*experiment_keys(experiments), *segments, "variant"]
    sums = metrics.groupBy(*keys).agg(F.countDistinct("user_pseudo_id").alias("sessions"), *guardrail_sums())
    return sums.select(*keys, "sessions", *guardrail_rates(), *(["session_rows"] if detail else []))


def guardrails(
    stats: DataFrame,
    experiments: Experiments = LANDING_PAGE,
    limits: GuardrailLimits = GuardrailLimits(),
    detail: bool = False,
    segments: Sequence[str] = (),
) -> DataFrame:
    """Control against variant on the (rounded) guardrail metrics.

    A metric that is NULL in either arm passes; ``detail`` adds flags that tell
    whether each check had both values.
    """
    pairs = pair_arms(stats, experiments, GUARDRAIL_METRICS, segments)
    return guardrail_checks(pairs, [*experiment_keys(experiments), *segments], limits, detail)


def guardrail_checks(
    pairs: DataFrame, keys: Sequence[str], limits: GuardrailLimits = GuardrailLimits(), detail: bool = False
) -> DataFrame:
    """The checks of each pair of arms ``a`` and ``b``, behind the columns ``keys``."""
    a, b = F.col("a"), F.col("b")

    def check(failed: Column, label: str) -> Column:
        return F.when(failed, label).otherwise(labels.GUARDRAIL_PASS)

    def diff(metric: str) -> Column:
        return round_half_away(b[metric] - a[metric], 2)

    def both(metric: str) -> Column:
        return a[metric].isNotNull() & b[metric].isNotNull()

    bounce, duration, cart = GUARDRAIL_METRICS[1:]
    extra = [
        both(bounce).alias("bounce_evaluable"),
        both(duration).alias("duration_evaluable"),
        both(cart).alias("cart_evaluable"),
    ]
    return pairs.select(
        *keys,
        a.variant.alias("control"),
        b.variant.alias("variant"),
        a.sessions.alias("control_sessions"),
        b.sessions.alias("variant_sessions"),
        a[bounce].alias("control_bounce_pct"),
        b[bounce].alias("variant_bounce_pct"),
        diff(bounce).alias("bounce_rate_diff_pct"),
        check(b[bounce] > a[bounce] + limits.bounce_pp, labels.BOUNCE_FAIL).alias("bounce_check"),
        a[duration].alias("control_duration_min"),
        b[duration].alias("variant_duration_min"),
        diff(duration).alias("duration_diff_min"),
        check(b[duration] < a[duration] * limits.duration_ratio, labels.DURATION_FAIL).alias(
            "duration_check"
        ),
        a[cart].alias("control_cart_abandon_pct"),
        b[cart].alias("variant_cart_abandon_pct"),
        diff(cart).alias("cart_diff_pct"),
        check(b[cart] > a[cart] + limits.cart_abandonment_pp, labels.CART_FAIL).alias("cart_check"),
        *(extra if detail else []),
    )


def engagement_by_variant(
    metrics: DataFrame, experiments: Experiments = LANDING_PAGE, detail: bool = False, segments: Sequence[str] = ()
) -> DataFrame:
    """Engagement per variant. ``sessions`` counts distinct session ids;
    ``detail`` adds ``users`` and ``session_rows``, the rows the rates are
    taken over."""
    keys = [*experiment_keys(experiments), *segments, "variant"]
    users = F.countDistinct("user_pseudo_id").alias("users")
    extra = [users, F.count("*").alias("session_rows")] if detail else []
    return (
        metrics.groupBy(*keys)
        .agg(
            F.countDistinct("session_id").alias("sessions"),
            percent(_share(_bounced())).alias("bounce_rate_pct"),
            round_half_away(_mean("pages_per_session"), 2).alias("avg_pageviews"),
            round_half_away(_mean_duration(), 2).alias("avg_duration_min"),
            percent(F.lit(1.0) - _share(_bounced())).alias("engagement_rate_pct"),
            percent(_share(F.col("clicks") > 0)).alias("click_rate_pct"),
            percent(_share(F.col("purchases") > 0)).alias("conversion_rate_pct"),
            *extra,
        )
        .orderBy(*keys)
    )


def bounce_rates(
    metrics: DataFrame, experiments: Experiments = LANDING_PAGE, segments: Sequence[str] = ()
) -> DataFrame:
    """Share of bounces and page views a session, per variant."""
    keys = [*experiment_keys(experiments), *segments, "variant"]
    return metrics.groupBy(*keys).agg(_share(_bounced()).alias("bounce"), _mean("pages_per_session").alias("views"))


def bounce_comparison(
    metrics: DataFrame, experiments: Experiments = LANDING_PAGE, segments: Sequence[str] = ()
) -> DataFrame:
    """Bounce rate and page views of the variant against the control. A tie
    counts as worse."""
    return compare_bounces(bounce_rates(metrics, experiments, segments), experiments, segments)


def compare_bounces(
    rates: DataFrame, experiments: Experiments = LANDING_PAGE, segments: Sequence[str] = ()
) -> DataFrame:
    """:func:`bounce_comparison` from the rates per variant."""
    keys = [*experiment_keys(experiments), *segments]
    pairs = pair_arms(rates, experiments, ["bounce", "views"], segments)
    a, b = F.col("a"), F.col("b")
    fewer_bounces = F.when(b.bounce < a.bounce, labels.LOWER_IS_BETTER)
    more_views = F.when(b.views > a.views, labels.HIGHER_IS_BETTER)
    return pairs.select(
        *keys,
        percent(a.bounce).alias("control_bounce_pct"),
        percent(b.bounce).alias("variant_bounce_pct"),
        percent(b.bounce - a.bounce).alias("bounce_diff_pct_points"),
        fewer_bounces.otherwise(labels.VARIANT_WORSE).alias("bounce_verdict"),
        round_half_away(a["views"], 2).alias("control_pageviews"),
        round_half_away(b["views"], 2).alias("variant_pageviews"),
        round_half_away(b["views"] - a["views"], 2).alias("pageviews_diff"),
        more_views.otherwise(labels.VARIANT_WORSE).alias("pageviews_verdict"),
    )
