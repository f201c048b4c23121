"""The launch decision: significant, big enough, no guardrail worse, no SRM.

All four conditions come out of one grouping. The totals per session and variant hold a user's exposures and later purchases, so
units, split and session metrics are sums over the same rows: first per user, where users seen in several arms or channels are
settled, then per arm. The arms of an experiment meet in one row, from which the tests are computed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splitscope import labels
from splitscope.config import BOTH, EXCLUDE, Experiment, GuardrailLimits
from splitscope.operators.engagement import GUARDRAIL_METRICS, guardrail_checks, guardrail_rates, guardrail_sums
from splitscope.operators.pairing import side_by_side
from splitscope.operators.sessions import USER, metrics_of
from splitscope.operators.srm import completed, judged, split_aggregates
from splitscope.operators.stats import rated, z_scores

KEY, ARM = "experiment_id", "variant"
MICROS_PER_DAY = 86_400e6


def arm_summary(totals: DataFrame, crossover: str = BOTH, segments: Sequence[str] = ()) -> DataFrame:
    """``experiment_id, segments..., variant`` with all that the decision asks of an arm: ``users`` of the split, ``visitors`` and
    ``conversions``, ``first_exposure`` and ``last_exposure``, ``sessions`` (distinct users) and the sums of the guardrails.

    ``totals`` are session totals over a registry. A user's unit is in the segment of its first exposure, a session in its own.
    Which arm a user seen in several of them counts in is settled by ``crossover``; split and guardrails count all."""
    start = F.col("session_start")
    metrics = metrics_of(totals.withColumn("_first", F.struct(start.isNull().alias("untimed"), start, "session_id")))
    per_user = metrics.groupBy(KEY, USER, ARM, *segments).agg(
        F.min("_first").alias("first"), F.max("purchased").alias("converted"), *guardrail_sums()
    )
    sums = [c for c in per_user.columns if c not in (KEY, USER, ARM, *segments, "first", "converted")]
    of_arm, of_user = W.partitionBy(KEY, USER, ARM), W.partitionBy(KEY, USER)
    if segments:
        per_user = per_user.withColumn("converted", F.max("converted").over(of_arm))
        per_user = per_user.withColumn("is_unit", F.row_number().over(of_arm.orderBy("first", *segments)) == 1)
    else:
        per_user = per_user.withColumn("is_unit", F.lit(True))
    if crossover == BOTH:
        per_user = per_user.withColumn("counts", F.col("is_unit"))
    elif crossover == EXCLUDE:
        per_user = per_user.withColumn("counts", F.col("is_unit") & (F.count_if("is_unit").over(of_user) == 1))
    else:
        # First arm seen; at the same instant, the arm listed first, as labels of designs are places.
        order = [~F.col("is_unit"), "first.untimed", "first.session_start", F.col(ARM).cast("int")]
        nth = F.row_number().over(of_user.orderBy(*order))
        per_user = per_user.withColumn("counts", F.col("is_unit") & (nth == 1))
    exposed_at = F.when(F.col("counts"), F.col("first.session_start"))
    return per_user.groupBy(KEY, *segments, ARM).agg(
        F.count_if(F.col("is_unit") & F.col(USER).isNotNull()).alias("users"),
        F.count_if("counts").alias("visitors"),
        F.coalesce(F.sum(F.when(F.col("counts"), F.col("converted"))), F.lit(0)).alias("conversions"),
        F.min(exposed_at).alias("first_exposure"),
        F.max(exposed_at).alias("last_exposure"),
        F.count(USER).alias("sessions"),
        *[F.sum(c).alias(c) for c in sums],
    )


def _small(frame: DataFrame, **columns: Column) -> DataFrame:
    """Result rows for the join: at most one per experiment and arm of the
    registry, which is what makes the broadcast safe."""
    keys = [c for c in (KEY, ARM) if c in frame.columns]
    return F.broadcast(frame.select(*keys, *[c.alias(n) for n, c in columns.items()]))


def run_lengths(units: DataFrame) -> DataFrame:
    """``experiment_id, days`` from the first to the last first exposure."""
    span = F.max("session_start") - F.min("session_start")
    return units.groupBy(KEY).agg((span / F.lit(MICROS_PER_DAY)).alias("days"))


def launch_decision(
    z_tests: DataFrame,
    guardrail_checks: DataFrame,
    srm_tests: DataFrame,
    min_relative_lift_pct: float = 15.0,
    lengths: DataFrame | None = None,
    min_days: float = 14.0,
) -> DataFrame:
    """One row per experiment and treatment: the four conditions and what
    follows from them. The inputs are results over a registry, so that they
    carry ``experiment_id``.

    The effect is big enough when the relative lift, which the z-test reports as
    well as the effect size does, reaches the minimum. A
    broken split or guardrail makes the test invalid; a significant and big
    enough lift launches the variant, a significant loss keeps the control, and
    anything else asks for a follow-up test. With more than two arms the texts name
    the arm. A missing figure counts as a
    condition not met. With ``lengths`` (see :func:`run_lengths`) a launch also
    needs a test of at least ``min_days``, told by a column ``long_enough``.
    """
    big_enough = F.col("relative_improvement_pct") >= F.lit(float(min_relative_lift_pct))
    tests = _small(
        z_tests.withColumnRenamed("variant_name", ARM),
        significant=F.col("significance") == labels.SIGNIFICANT,
        effect_ok=big_enough,
        z_score=F.col("z_score"),
        control=F.col("control_name"),
    )
    checks = [F.col(c) == labels.GUARDRAIL_PASS for c in ("bounce_check", "duration_check", "cart_check")]
    rails = _small(guardrail_checks, guardrails_ok=reduce(and_, checks))
    sound = F.col("srm_result").isin(labels.SRM_NONE, labels.SRM_POSSIBLE)
    splits = srm_tests.select(KEY, sound.alias("srm_ok"), (F.col("degrees_of_freedom") == 1).alias("two_arms"))
    joined = splits.join(tests, KEY, "left").join(rails, [KEY, ARM], "left")
    flags = ["significant", "effect_ok", "guardrails_ok", "srm_ok"]
    if lengths is not None:
        enough = _small(lengths, long_enough=F.col("days") >= F.lit(float(min_days)))
        joined = joined.join(enough, KEY, "left")
        flags.append("long_enough")
    return _decided(joined, [KEY], flags)


def _decided(joined: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """What follows from the conditions ``flags``; a missing one is not met."""
    joined = joined.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in flags})
    ready = F.col("significant") & F.col("effect_ok")
    if "long_enough" in flags:
        ready = ready & F.col("long_enough")
    valid = F.col("srm_ok") & F.col("guardrails_ok")

    def named(of_two: str, verb: str, arm: str) -> Column:
        return F.when(F.col("two_arms"), of_two).otherwise(F.concat(F.lit(verb), F.col(arm)))

    decision = (
        F.when(~valid, labels.DECISION_INVALID)
        .when(ready, named(labels.DECISION_LAUNCH, labels.LAUNCH_ARM, ARM))
        .when(F.col("significant") & (F.col("z_score") < 0), named(labels.DECISION_KEEP, labels.KEEP_ARM, "control"))
        .otherwise(labels.DECISION_FOLLOW_UP)
    )
    return joined.select(*keys, ARM, *flags, decision.alias("decision"))


def decided(
    summary: DataFrame,
    experiments: Sequence[Experiment],
    limits: GuardrailLimits = GuardrailLimits(),
    min_relative_lift_pct: float = 15.0,
    min_days: float | None = None,
    segments: Sequence[str] = (),
) -> DataFrame:
    """:func:`launch_decision` from an :func:`arm_summary` over the registry: one row per experiment, segment and treatment.
    ``min_days`` asks for so many days from the first to the last first exposure."""
    keys = [KEY, *segments]
    figures = ["visitors", "conversions", "cr", "alpha", "beta", *GUARDRAIL_METRICS]
    # An arm that counts nobody has no figures, as an arm that nobody saw.
    payload = F.when(F.col("visitors") > 0, F.struct(*figures)).alias("payload")
    arms = rated(summary).select(*summary.columns, "cr", "alpha", "beta", *guardrail_rates())
    arms = arms.select(*keys, ARM, "users", "first_exposure", "last_exposure", payload)
    whole = completed(arms, experiments, segments, ["payload", "first_exposure", "last_exposure"])
    span = F.max("last_exposure") - F.min("first_exposure")
    own = F.when(F.col("payload").isNotNull(), F.struct(ARM, "payload.*"))
    tested = whole.groupBy(*keys).agg(
        *split_aggregates(), *side_by_side(own), (span / F.lit(MICROS_PER_DAY)).alias("days")
    )
    pairs = judged(tested, experiments).select(
        *keys, "a", F.explode_outer(F.when(F.col("a").isNotNull(), F.col("bs.b"))).alias("b"),
        "srm_result", (F.col("degrees_of_freedom") == 1).alias("two_arms"), "days",
    )
    kept = [*keys, "srm_result", "two_arms", "days"]
    tests = z_scores(pairs, [*kept, "a", "b"])
    joined = guardrail_checks(tests, [*kept, "significance", "relative_improvement_pct", "z_score"], limits)
    checks = [F.col(c) == labels.GUARDRAIL_PASS for c in ("bounce_check", "duration_check", "cart_check")]
    conditions = {
        "significant": F.col("significance") == labels.SIGNIFICANT,
        "effect_ok": F.col("relative_improvement_pct") >= F.lit(float(min_relative_lift_pct)),
        "guardrails_ok": reduce(and_, checks, F.col(ARM).isNotNull()),
        "srm_ok": F.col("srm_result").isin(labels.SRM_NONE, labels.SRM_POSSIBLE),
    }
    if min_days is not None:
        conditions["long_enough"] = F.col("days") >= F.lit(float(min_days))
    return _decided(joined.withColumns(conditions), keys, list(conditions))
