from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from splitscope import LANDING_PAGE, Arm, Experiment
from splitscope.config import SESSION, USER_FORWARD
from splitscope.operators.engagement import (
    bounce_comparison,
    engagement_by_variant,
    guardrail_stats,
    guardrails,
)
from splitscope.operators.events import ga4_events
from splitscope.operators import sessions
from splitscope.operators.sessions import session_metrics
from tests.ga4rows import V1, V2, event, frame

HOME = Experiment("home", (Arm("H", "/home"), Arm("V", "/landing")))
NAMES = ["page_view"] * 4 + ["scroll", "click", "view_item", "add_to_cart", "purchase", "other", None]


def flat(spark, rows):
    return ga4_events(frame(spark, rows))


def expected(rows, scope):
    """Every exposure against every event of its user, in plain Python."""
    events = [(u, s, t, n, p) for (t, n, u, ps, _) in rows for s, p in [(_value(ps, "ga_session_id", 1), _value(ps, "page_location", 0))]]
    first = {}
    for u, s, t, n, p in events:
        if n == "page_view" and p and ("/landing-v1" in p or "/landing-v2" in p):
            key = (u, s, "Control_A" if "/landing-v1" in p else "Variant_B")
            first[key] = min(t, first.get(key, t))
    result = {}
    for (u, s, v), start in first.items():
        mine = [
            e
            for e in events
            if u is not None and e[0] == u and e[2] >= start and (scope == USER_FORWARD or e[1] == s)
        ]
        names = [e[3] for e in mine]
        seconds = (max(e[2] for e in mine) - start) / 6e7 if mine else None
        result[(v, s, u)] = (
            int(names.count("page_view") == 1),
            seconds,
            names.count("page_view"),
            int("add_to_cart" in names),
            int("purchase" in names),
            sum(n in ("scroll", "click", "view_item") for n in names),
            names.count("scroll"),
            names.count("click"),
            names.count("purchase"),
        )
    return result


def _value(params, key, leaf):
    return next((v[leaf] for k, v in params if k == key), None)


def measured(df):
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in df.collect()}


def random_rows(seed, n=160, span=5_000_000):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        # One user holds about a third of the rows; a few have no id.
        user = rnd.choice(["hot", "hot", "a", "b", "c", None])
        page = rnd.choice([V1, V1, V2, "https://x.example/home", None])
        session = rnd.choice([1, 2, 3, None])
        # Many equal times, and times that share a block.
        ts = rnd.choice([rnd.randrange(span), rnd.randrange(0, span, 500_000)])
        rows.append(event(user, rnd.choice(NAMES), ts, page, session))
    return rows


@pytest.mark.parametrize("block", [sessions.BLOCK_MICROS, 700_000, 1_000])
@pytest.mark.parametrize("scope", [USER_FORWARD, SESSION])
def test_metrics_equal_the_join_for_blocks_of_any_length(spark, scope, block, monkeypatch):
    monkeypatch.setattr(sessions, "BLOCK_MICROS", block)
    rows = random_rows(7)
    got = measured(session_metrics(flat(spark, rows), scope=scope))
    want = expected(rows, scope)
    assert got.keys() == want.keys()
    for key, (bounce, minutes, *rest) in want.items():
        assert got[key][0] == bounce and list(got[key][2:]) == rest, key
        if minutes is None:
            assert got[key][1] is None
        else:
            assert got[key][1] == pytest.approx(minutes, abs=0.0051)


@settings(max_examples=4, deadline=None)
@given(seed=st.integers(0, 10_000))
def test_a_registry_has_the_rows_of_each_experiment(spark, seed):
    rows = flat(spark, random_rows(seed, span=300_000_000)).cache()
    registry = [LANDING_PAGE, HOME]
    got = session_metrics(rows, registry)
    for experiment in registry:
        alone = sorted(map(str, session_metrics(rows, experiment).collect()))
        own = got.where(got.experiment_id == experiment.experiment_id).drop("experiment_id")
        assert sorted(map(str, own.collect())) == alone
    rows.unpersist()


def test_results_do_not_depend_on_partitioning_or_order(spark):
    rows = random_rows(11)
    shuffled = frame(spark, random.Random(1).sample(rows, len(rows))).repartition(7)
    one = session_metrics(ga4_events(frame(spark, rows).coalesce(1)))
    two = session_metrics(ga4_events(shuffled))
    for report in (guardrail_stats, engagement_by_variant, bounce_comparison):
        assert sorted(map(str, report(one).collect())) == sorted(map(str, report(two).collect()))


def test_bounce_needs_exactly_one_page_view(spark):
    rows = []
    for user, further in [("none", 0), ("one", 1), ("two", 2)]:
        rows += [event(user, "page_view", 60_000_000 * i, V1) for i in range(further + 1)]
    got = {k[2]: v for k, v in measured(session_metrics(flat(spark, rows))).items()}
    assert {u: v[0] for u, v in got.items()} == {"none": 1, "one": 0, "two": 0}
    assert {u: v[2] for u, v in got.items()} == {"none": 1, "one": 2, "two": 3}
    assert got["two"][1] == 2.0


def test_reports(spark):
    minute = 60_000_000
    rows = [
        event("a", "page_view", 0, V1),
        event("a", "add_to_cart", minute),
        event("b", "page_view", 0, V1, session=2),
        event("b", "page_view", 2 * minute, V1, session=2),
        event("b", "click", 3 * minute, session=2),
        event("b", "purchase", 4 * minute, session=2),
        event("c", "page_view", 0, V2),
    ]
    metrics = session_metrics(flat(spark, rows))
    control, variant = guardrail_stats(metrics, detail=True).orderBy("variant").collect()
    assert control.asDict() == {
        "variant": "Control_A",
        "sessions": 2,
        "bounce_rate_pct": 50.0,
        "avg_session_duration_min": 2.5,
        "avg_pages_per_session": 1.5,
        "cart_abandonment_rate_pct": 100.0,
        "avg_engagement_events": 0.5,
        "session_rows": 2,
    }
    assert variant.cart_abandonment_rate_pct is None
    row = guardrails(guardrail_stats(metrics)).first()
    assert (row.bounce_rate_diff_pct, row.cart_diff_pct) == (50.0, None)
    assert row.cart_check.endswith("PASS") and "FAIL" in row.bounce_check
    first = engagement_by_variant(metrics, detail=True).first()
    assert (first.engagement_rate_pct, first.click_rate_pct, first.conversion_rate_pct) == (50.0, 50.0, 50.0)
    assert (first.sessions, first.users, first.session_rows) == (2, 2, 2)
    bounce = bounce_comparison(metrics).first()
    assert bounce.bounce_diff_pct_points == 50.0
    assert bounce.bounce_verdict == bounce.pageviews_verdict == "❌ Variant worse"


def test_events_without_a_time_do_not_count(spark):
    rows = [
        event("a", "page_view", 5, V1), event("a", "page_view", None, V1), event("a", "click", 1),
        event("b", "page_view", None, V1), event("b", "click", 9), event(None, "page_view", None, V1),
    ]
    got = measured(session_metrics(flat(spark, rows)))
    assert got[("Control_A", 1, "a")][:3] == (1, 0.0, 1)
    # Exposed at no known time: the user stays, and nothing comes after.
    assert got[("Control_A", 1, "b")] == got[("Control_A", 1, None)] == (0, None, 0, 0, 0, 0, 0, 0, 0)


def test_one_arm_only_gives_no_comparison(spark):
    metrics = session_metrics(flat(spark, [event("a", "page_view", 0, V1)]))
    assert guardrails(guardrail_stats(metrics)).count() == 0
    assert bounce_comparison(metrics).count() == 0
