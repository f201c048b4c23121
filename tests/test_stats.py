from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from splitscope import Arm, Experiment, GuardrailLimits
from splitscope import labels as L
from splitscope.functions.numeric import chi_square_tail
from splitscope.operators import decision, engagement, srm, stats


def units(spark, **arms):
    """Units per variant as (visitors, conversions)."""
    rows = [(v, n, c) for v, (n, c) in arms.items()]
    counts = spark.createDataFrame(rows, "variant string, n int, c int")
    return counts.select("variant", F.explode(F.sequence(F.lit(1), "n")).alias("i"), "c").select(
        "variant", (F.col("i") <= F.col("c")).cast("int").alias("converted")
    )


def table(spark, a, b):
    return stats.variant_stats(units(spark, Control_A=a, Variant_B=b))


def test_variant_stats(spark):
    (row,) = stats.variant_stats(units(spark, Control_A=(5, 2))).collect()
    assert (row.visitors, row.conversions, row.alpha, row.beta) == (5, 2, 3, 4)
    assert row.cr == 0.4
    assert row.stddev == pytest.approx(math.sqrt(0.3), rel=1e-12)
    (one,) = stats.variant_stats(units(spark, Control_A=(1, 1))).collect()
    assert one.stddev is None


def test_z_test_by_hand(spark):
    (row,) = stats.z_test(table(spark, (1000, 100), (1000, 130))).collect()
    p = 0.115
    z = 0.03 / math.sqrt(p * (1 - p) * 2 / 1000)
    se = math.sqrt(0.1 * 0.9 / 1000 + 0.13 * 0.87 / 1000)
    assert row.z_score == round(z, 2)
    assert row.p_value_two_tailed == round(math.erfc(z / math.sqrt(2)), 4)
    assert row.ci_lower == round(0.03 - 1.96 * se, 4)
    assert row.ci_upper == round(0.03 + 1.96 * se, 4)
    assert (row.difference_pct_points, row.relative_improvement_pct) == (3.0, 30.0)
    assert row.significance == L.SIGNIFICANT


@pytest.mark.parametrize("a, b", [((10, 0), (10, 0)), ((10, 10), (10, 10))])
def test_without_variance_there_is_no_statistic(spark, a, b):
    (row,) = stats.z_test(table(spark, a, b)).collect()
    assert (row.z_score, row.p_value_two_tailed) == (None, None)
    assert row.significance == L.NOT_SIGNIFICANT


def test_no_conversions_in_the_control_gives_no_lift(spark):
    both = table(spark, (10, 0), (10, 5))
    assert stats.z_test(both).first().relative_improvement_pct is None
    assert stats.effect_size(both).first().relative_lift_pct is None


@pytest.mark.parametrize("arms", [{}, {"Control_A": (9, 3)}, {"Variant_B": (9, 3)}])
def test_a_missing_arm_gives_no_row(spark, arms):
    if not arms:
        one = stats.variant_stats(units(spark, Control_A=(1, 1)).limit(0))
    else:
        one = stats.variant_stats(units(spark, **arms))
    for test in (stats.z_test, stats.bayes_test, stats.effect_size):
        assert test(one).count() == 0


@settings(max_examples=6, deadline=None)
@given(
    na=st.integers(5, 400), nb=st.integers(5, 400), ca=st.floats(0.1, 0.9), cb=st.floats(0.1, 0.9)
)
def test_swapping_the_arms_mirrors_the_results(spark, na, nb, ca, cb):
    a, b = (na, max(1, int(na * ca))), (nb, max(1, int(nb * cb)))
    one, two = table(spark, a, b), table(spark, b, a)
    z1, z2 = stats.z_test(one).first(), stats.z_test(two).first()
    assert z1.z_score == -z2.z_score
    assert z1.p_value_two_tailed == z2.p_value_two_tailed
    assert z1.difference_pct_points == -z2.difference_pct_points
    p1 = stats.bayes_test(one).first().probability_b_better
    p2 = stats.bayes_test(two).first().probability_b_better
    assert p1 + p2 == pytest.approx(1, abs=1.01e-4)
    assert stats.effect_size(one).first().cohens_h == -stats.effect_size(two).first().cohens_h


@pytest.mark.parametrize(
    "b, label",
    [
        (100, L.BAYES_INCONCLUSIVE),
        (110, L.BAYES_WEAK),
        (120, L.BAYES_MODERATE_B),
        (140, L.BAYES_STRONG_B),
        (70, L.BAYES_STRONG_A),
    ],
)
def test_bayes_verdicts(spark, b, label):
    row = stats.bayes_test(table(spark, (1000, 100), (1000, b))).first()
    assert row.bayesian_decision == label
    ma, mb = 101 / 1002, (b + 1) / 1002
    var = (ma * (1 - ma) + mb * (1 - mb)) / 1003
    p = 0.5 * math.erfc(-(mb - ma) / math.sqrt(var) / math.sqrt(2))
    assert row.probability_b_better == pytest.approx(p, abs=5.1e-5)


@pytest.mark.parametrize(
    "b, label",
    [(55, L.EFFECT_NEGLIGIBLE), (62, L.EFFECT_SMALL), (75, L.EFFECT_MEDIUM), (90, L.EFFECT_LARGE)],
)
def test_effect_labels(spark, b, label):
    row = stats.effect_size(table(spark, (100, 50), (100, b))).first()
    h = 2 * math.asin(math.sqrt(b / 100)) - 2 * math.asin(math.sqrt(0.5))
    assert row.cohens_h == pytest.approx(h, abs=5.1e-5)
    assert row.effect_size_label == label


def counts(spark, rows):
    return spark.createDataFrame(
        [("landing_page", v, n) for v, n in rows],
        "experiment_id string, variant string, users bigint",
    )


@pytest.mark.parametrize(
    "a, b, label",
    [(500, 500, L.SRM_NONE), (530, 470, L.SRM_NONE), (532, 468, L.SRM_POSSIBLE), (541, 459, L.SRM_DETECTED)],
)
def test_srm_verdicts(spark, a, b, label):
    row = srm.srm_test(counts(spark, [("Control_A", a), ("Variant_B", b)])).first()
    assert row.srm_result == label
    chi = (a - 500) ** 2 / 250
    assert row.chi_square_statistic == pytest.approx(chi, abs=1e-12)
    assert row.p_value == pytest.approx(math.erfc(math.sqrt(chi / 2)), abs=5.1e-5)


def test_srm_counts_an_arm_nobody_saw(spark):
    one = counts(spark, [("Control_A", 100)])
    split = {r.variant: (r.users, r.expected_users) for r in srm.srm_split(one).collect()}
    assert split == {"Control_A": (100, 50.0), "Variant_B": (0, 50.0)}
    assert srm.srm_test(one).first().srm_result == L.SRM_DETECTED


def test_srm_without_data_says_so(spark):
    row = srm.srm_test(counts(spark, [("Control_A", 1)]).limit(0)).first()
    assert (row.chi_square_statistic, row.srm_result) == (None, L.SRM_NO_DATA)


def test_srm_uses_the_planned_share_of_each_arm(spark):
    uneven = Experiment("landing_page", (Arm("Control_A", "/a", 0.9), Arm("Variant_B", "/b", 0.1)))
    row = srm.srm_test(counts(spark, [("Control_A", 900), ("Variant_B", 100)]), uneven).first()
    assert (row.chi_square_statistic, row.srm_result) == (0.0, L.SRM_NONE)


def rails(spark, a, b):
    columns = (
        "variant string, sessions bigint, bounce_rate_pct double, "
        "avg_session_duration_min double, cart_abandonment_rate_pct double"
    )
    return spark.createDataFrame([("Control_A", 10, *a), ("Variant_B", 10, *b)], columns)


@pytest.mark.parametrize(
    "b, failed",
    [
        ((45.0, 8.0, 60.0), []),
        ((45.01, 8.0, 60.0), ["bounce_check"]),
        ((45.0, 7.99, 60.0), ["duration_check"]),
        ((45.0, 8.0, 60.01), ["cart_check"]),
        ((45.0, 8.0, None), []),
    ],
)
def test_guardrail_limits_are_strict(spark, b, failed):
    row = engagement.guardrails(rails(spark, (40.0, 10.0, 50.0), b), detail=True).first()
    checks = ["bounce_check", "duration_check", "cart_check"]
    assert [c for c in checks if row[c] != L.GUARDRAIL_PASS] == failed
    assert row.cart_evaluable == (b[2] is not None)


def test_guardrail_limits_are_parameters(spark):
    strict = GuardrailLimits(cart_abandonment_pp=5.0)
    row = engagement.guardrails(rails(spark, (1.0, 1.0, 50.0), (1.0, 1.0, 56.0)), limits=strict)
    assert row.first().cart_check == L.CART_FAIL


@pytest.mark.parametrize(
    "significance, lift, z, check, chi, expected",
    [
        (L.SIGNIFICANT, 20.0, 3.0, L.GUARDRAIL_PASS, 1.0, L.DECISION_LAUNCH),
        (L.SIGNIFICANT, 15.0, 3.0, L.GUARDRAIL_PASS, 6.63, L.DECISION_LAUNCH),
        (L.SIGNIFICANT, 5.0, 3.0, L.GUARDRAIL_PASS, 1.0, L.DECISION_FOLLOW_UP),
        (L.SIGNIFICANT, -20.0, -3.0, L.GUARDRAIL_PASS, 1.0, L.DECISION_KEEP),
        (L.NOT_SIGNIFICANT, 20.0, 1.0, L.GUARDRAIL_PASS, 1.0, L.DECISION_FOLLOW_UP),
        (L.SIGNIFICANT, 20.0, 3.0, L.CART_FAIL, 1.0, L.DECISION_INVALID),
        (L.SIGNIFICANT, 20.0, 3.0, L.GUARDRAIL_PASS, 6.64, L.DECISION_INVALID),
        (L.SIGNIFICANT, 20.0, 3.0, L.GUARDRAIL_PASS, None, L.DECISION_INVALID),
    ],
)
def test_launch_decision(spark, significance, lift, z, check, chi, expected):
    def one(values, schema):
        return spark.createDataFrame([("e", *values)], f"experiment_id string, {schema}")

    row = decision.launch_decision(
        one(
            ("B", significance, z, lift, "A"),
            "variant_name string, significance string, z_score double, "
            "relative_improvement_pct double, control_name string",
        ),
        one(
            ("B", L.GUARDRAIL_PASS, L.GUARDRAIL_PASS, check),
            "variant string, bounce_check string, duration_check string, cart_check string",
        ),
        one((_verdict(chi), 1), "srm_result string, degrees_of_freedom int"),
    ).first()
    assert row.decision == expected


def _verdict(chi):
    return L.SRM_NO_DATA if chi is None else L.SRM_DETECTED if chi > 6.63 else L.SRM_NONE


def test_decisions_among_three_arms_name_the_arm(spark):
    z = spark.createDataFrame(
        [("e", "B", L.SIGNIFICANT, 3.0, 20.0, "A"), ("e", "C", L.SIGNIFICANT, -3.0, -20.0, "A")],
        "experiment_id string, variant_name string, significance string, z_score double, "
        "relative_improvement_pct double, control_name string",
    )
    ok = L.GUARDRAIL_PASS
    rails = spark.createDataFrame(
        [("e", "B", ok, ok, ok), ("e", "C", ok, ok, ok)],
        "experiment_id string, variant string, bounce_check string, duration_check string, cart_check string",
    )
    split = spark.createDataFrame(
        [("e", L.SRM_POSSIBLE, 2)], "experiment_id string, srm_result string, degrees_of_freedom int"
    )
    rows = decision.launch_decision(z, rails, split).collect()
    assert {r.variant: r.decision for r in rows} == {"B": "Launch B", "C": "Keep A"}


@pytest.mark.parametrize("days, expected", [(13.9, L.DECISION_FOLLOW_UP), (14.0, L.DECISION_LAUNCH)])
def test_a_launch_may_need_a_long_enough_test(spark, days, expected):
    units = spark.createDataFrame(
        [("e", 0), ("e", int(days * 86_400_000_000))], "experiment_id string, session_start bigint"
    )
    z = spark.createDataFrame(
        [("e", "B", L.SIGNIFICANT, 3.0, 20.0, "A")],
        "experiment_id string, variant_name string, significance string, z_score double, "
        "relative_improvement_pct double, control_name string",
    )
    ok = L.GUARDRAIL_PASS
    rails = spark.createDataFrame(
        [("e", "B", ok, ok, ok)],
        "experiment_id string, variant string, bounce_check string, duration_check string, "
        "cart_check string",
    )
    split = spark.createDataFrame(
        [("e", L.SRM_NONE, 1)], "experiment_id string, srm_result string, degrees_of_freedom int"
    )
    lengths = decision.run_lengths(units)
    row = decision.launch_decision(z, rails, split, 15.0, lengths, 14.0).first()
    assert (row.long_enough, row.decision) == (days >= 14, expected)


THREE = Experiment("three", (Arm("A", "/a", 0.5), Arm("B", "/b", 0.25), Arm("C", "/c", 0.25)))


@pytest.mark.parametrize("users, label", [((5000, 2595, 2405), L.SRM_POSSIBLE), ((5000, 2650, 2350), L.SRM_DETECTED), ((5000, 2510, 2490), L.SRM_NONE)])
def test_srm_of_three_arms_goes_by_its_degrees_of_freedom(spark, users, label):
    rows = [("three", v, n) for v, n in zip("ABC", users)]
    seen = spark.createDataFrame(rows, "experiment_id string, variant string, users long")
    row = srm.srm_test(seen, THREE).first()
    total = sum(users)
    chi = sum((n - total * s) ** 2 / (total * s) for n, s in zip(users, (0.5, 0.25, 0.25)))
    assert row.degrees_of_freedom == 2 and row.srm_result == label
    assert row.p_value == pytest.approx(math.exp(-chi / 2), abs=5.1e-5)


@pytest.mark.parametrize("df, limit", [(1, 6.6348966), (2, 9.2103404), (3, 11.3448667), (4, 13.2767041), (5, 15.0862725), (7, 18.4753069)])
def test_chi_square_tail_at_the_tabled_limits(spark, df, limit):
    assert spark.range(1).select(chi_square_tail(F.lit(limit), df)).first()[0] == pytest.approx(0.01, abs=1e-8)
