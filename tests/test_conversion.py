from __future__ import annotations

import pytest

from splitscope import LANDING_PAGE, Arm, Experiment, Study
from splitscope.config import BOTH, EXCLUDE, FIRST, SESSION
from splitscope.operators.conversion import attributed_units, conversions
from splitscope.operators.events import ga4_events
from splitscope.operators.exposure import (
    classify_variants,
    experiment_page_views,
    exposed_views,
    exposures,
)
from tests.ga4rows import V1, V2, event, frame


def flat(spark, rows):
    return ga4_events(frame(spark, rows))


def converted(df):
    return {(r.user_pseudo_id, r.variant): r.converted for r in df.collect()}


def test_purchase_before_at_and_after_the_exposure(spark):
    rows = []
    for user, ts in [("before", 99), ("at", 100), ("after", 101)]:
        rows += [event(user, "page_view", 100, V1), event(user, "purchase", ts)]
    assert converted(conversions(flat(spark, rows))) == {
        ("before", "Control_A"): 0,
        ("at", "Control_A"): 1,
        ("after", "Control_A"): 1,
    }


CROSSOVER = [
    event("x", "page_view", 10, V2),
    event("x", "purchase", 15),
    event("x", "page_view", 20, V1),
    event("y", "page_view", 10, V1),
]


def test_crossover_user_counts_in_both_arms_by_default(spark):
    assert converted(conversions(flat(spark, CROSSOVER))) == {
        ("x", "Variant_B"): 1,
        ("x", "Control_A"): 0,
        ("y", "Control_A"): 0,
    }


def test_crossover_user_can_be_excluded_or_given_to_the_first_arm(spark):
    rows = flat(spark, CROSSOVER)
    assert converted(conversions(rows, crossover=EXCLUDE)) == {("y", "Control_A"): 0}
    assert converted(conversions(rows, crossover=FIRST)) == {
        ("x", "Variant_B"): 1,
        ("y", "Control_A"): 0,
    }


def test_first_arm_at_the_same_instant_is_the_one_listed_first(spark):
    rows = [event("x", "page_view", 10, V2), event("x", "page_view", 10, V1)]
    assert converted(conversions(flat(spark, rows), crossover=FIRST)) == {("x", "Control_A"): 0}


def test_session_scope_needs_the_purchase_in_the_session(spark):
    rows = [
        event("u", "page_view", 10, V1, session=1),
        event("u", "purchase", 20, session=2),
        event("w", "page_view", 10, V1, session=1),
        event("w", "page_view", 30, V1, session=2),
        event("w", "purchase", 40, session=2),
        event("n", "page_view", 10, V1, session=None),
        event("n", "purchase", 20, session=None),
    ]
    assert set(converted(conversions(flat(spark, rows))).values()) == {1}
    assert converted(conversions(flat(spark, rows), scope=SESSION)) == {
        ("u", "Control_A"): 0,
        ("w", "Control_A"): 1,
        ("n", "Control_A"): 1,
    }


def test_rows_without_user_form_one_unconverted_unit(spark):
    rows = [
        event(None, "page_view", 10, V1),
        event(None, "page_view", 11, V1),
        event(None, "purchase", 20),
    ]
    assert converted(conversions(flat(spark, rows))) == {(None, "Control_A"): 0}


def test_only_page_views_expose(spark):
    rows = [event("u", "click", 10, V1), event("u", "purchase", 20, V2)]
    assert conversions(flat(spark, rows)).count() == 0


def test_carried_columns_come_from_the_first_exposure(spark):
    rows = [event("u", "page_view", 20, V1, session=2), event("u", "page_view", 10, V1, session=5)]
    (unit,) = attributed_units(flat(spark, rows), carry=["session_id"]).collect()
    assert (unit.session_start, unit.session_id) == (10, 5)


THREE = Experiment("three", (Arm("A", "/landing-v1"), Arm("B", "/landing-v2"), Arm("C", "/home")))


def test_registry_counts_a_view_in_every_experiment_it_fits(spark):
    rows = flat(spark, [*CROSSOVER, event("h", "page_view", 1, "https://x.example/home")])
    got = {
        (r.experiment_id, r.user_pseudo_id, r.variant): r.converted
        for r in conversions(rows, [LANDING_PAGE, THREE]).collect()
    }
    assert got == {
        ("landing_page", "x", "Variant_B"): 1,
        ("landing_page", "x", "Control_A"): 0,
        ("landing_page", "y", "Control_A"): 0,
        ("three", "x", "B"): 1,
        ("three", "x", "A"): 0,
        ("three", "y", "A"): 0,
        ("three", "h", "C"): 0,
    }
    assert exposed_views(rows, [LANDING_PAGE, THREE]).count() == 7


def test_first_pattern_wins_and_longer_paths_match(spark):
    both = "https://x.example/landing-v2/landing-v10"
    (row,) = exposures(flat(spark, [event("u", "page_view", 5, both)])).collect()
    assert row.variant == "Control_A"


def test_page_views_and_classification(spark):
    other = "https://x.example/landing-old"
    rows = flat(
        spark,
        [
            event("u", "page_view", 9, V1),
            event("u", "page_view", 5, V1),
            event("u", "page_view", 6, other),
            event("u", "page_view", 7, "https://x.example/home"),
        ],
    )
    (view,) = experiment_page_views(rows).collect()
    assert (view.page_location, view.session_start) == (V1, 5)
    labels = {r.page_location: r.experiment_variant for r in classify_variants(rows).collect()}
    assert labels == {V1: "Control_A", other: "Unknown"}
    assert classify_variants(rows, limit=1).first().page_location == other
    assert experiment_page_views(rows, limit=0).count() == 0


def test_bad_options_are_rejected(spark):
    rows = flat(spark, CROSSOVER)
    with pytest.raises(ValueError):
        conversions(rows, scope="week")
    with pytest.raises(ValueError):
        conversions(rows, crossover="maybe")
    with pytest.raises(ValueError):
        Experiment("one", (Arm("A", "/a"),))
    with pytest.raises(ValueError):
        Experiment("shares", (Arm("A", "/a", 0.5), Arm("B", "/b", 0.6)))
    with pytest.raises(ValueError):
        conversions(rows, [LANDING_PAGE, LANDING_PAGE])


def test_users_exposed_at_no_known_time_stay_unconverted(spark):
    rows = [
        event("u1", "page_view", None, V1), event("u1", "page_view", 10, V1), event("u1", "purchase", 20),
        event("u4", "page_view", None, V2), event("u4", "purchase", 30),
    ]
    table = frame(spark, rows)
    for registry in (LANDING_PAGE, [LANDING_PAGE]):
        for crossover in (BOTH, EXCLUDE, FIRST):
            study = Study(table, registry, crossover=crossover)
            got = {(r.user_pseudo_id, r.variant): r.converted for r in study.conversions().collect()}
            assert got == {("u1", "Control_A"): 1, ("u4", "Variant_B"): 0}
            by_channel = study.channel_stats.groupBy("variant").sum("visitors", "conversions").collect()
            assert sorted(map(tuple, by_channel)) == [("Control_A", 1, 1), ("Variant_B", 1, 0)]
            assert study.exposures().count() == study.srm_counts.agg({"users": "sum"}).first()[0] == 2
