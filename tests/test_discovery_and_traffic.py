from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from splitscope.functions.traffic import channel_group
from splitscope.operators.attribution import session_channel, session_source
from splitscope.operators.discovery import (
    test_pages,
    test_pages_by_param,
    test_pages_by_url,
)
from splitscope.operators.events import ga4_events
from tests.ga4rows import V1, V2, event, frame, param

for operator in (test_pages, test_pages_by_param, test_pages_by_url):
    operator.__test__ = False


def flat(spark, rows):
    return ga4_events(frame(spark, rows))


def traffic(source=None, medium=None):
    pairs = [("source", source), ("medium", medium)]
    return [param(k, v) for k, v in pairs if v is not None]


def test_pages_are_found_by_url_and_by_param(spark):
    tag = [param("test_id", "t")]
    rows = flat(
        spark,
        [
            event("a", "page_view", 1, V1),
            event("a", "purchase", 2, V1),
            event("b", "page_view", 1, V1),
            event("b", "page_view", 1, "https://x.example/?exp=1"),
            event("b", "click", 1, V2),
            event("c", "page_view", 1, "https://x.example/plain", extra=tag),
            event("c", "purchase", 2, "https://x.example/plain", extra=tag),
            event("d", "page_view", 1, None, extra=tag),
        ],
    )
    got = [tuple(r) for r in test_pages(rows).collect()]
    assert got == [
        ("url_pattern", V1, 2, 3, 1, 50.0),
        ("url_pattern", "https://x.example/?exp=1", 1, 1, 0, 0.0),
        ("event_param", None, 1, 1, 0, 0.0),
        ("event_param", "https://x.example/plain", 1, 1, 0, 0.0),
    ]
    corrected = test_pages_by_param(rows, count_purchases=True).collect()
    assert [r.conversions for r in corrected] == [0, 1]


def test_report_keeps_the_fifty_pages_with_most_users(spark):
    pages = [event(f"u{i}-{j}", "page_view", 1, f"{V1}/{i:03d}") for i in range(60) for j in range(1 + i % 2)]
    report = test_pages_by_url(flat(spark, pages)).collect()
    assert len(report) == 50
    assert [r.unique_users for r in report] == [2] * 30 + [1] * 20
    assert report[30].page_location == f"{V1}/000"
    assert test_pages_by_url(flat(spark, pages), top=None).count() == 60


def resolved(spark, rows):
    r = session_source(flat(spark, rows), with_first_event=True).first()
    return r.source, r.medium, r.session_start.microsecond, r.first_event_at.microsecond


def test_source_priority(spark):
    site = event("u", "page_view", 30, extra=traffic(medium="email"))
    start = event("u", "session_start", 20, extra=traffic("google", "cpc"))
    visit = event("u", "first_visit", 10, extra=traffic("bing"))
    bare = event("u", "page_view", 5)
    assert resolved(spark, [visit, start, site, bare]) == ("(direct)", "email", 30, 5)
    assert resolved(spark, [visit, start, bare]) == ("google", "cpc", 20, 5)
    assert resolved(spark, [visit]) == ("bing", "(none)", 10, 10)
    assert resolved(spark, [visit, bare]) == ("(direct)", "(none)", 5, 5)


def test_ties_are_settled_by_source_and_medium(spark):
    rows = [event("u", "click", 5, extra=traffic(s, m)) for s, m in [("b", "x"), ("a", "y"), ("a", None)]]
    assert resolved(spark, rows)[:2] == ("a", "(none)")


def test_events_without_session_are_left_out(spark):
    rows = [event("u", "click", 5, session=None), event(None, "click", 5, session=2)]
    assert [r.user_pseudo_id for r in session_channel(flat(spark, rows)).collect()] == [None]


@pytest.mark.parametrize(
    "medium, channel",
    [
        ("cpc", "Paid Search"),
        ("ppc", "Paid Search"),
        ("paidsearch", "Paid Search"),
        ("organic", "Organic Search"),
        ("Paid_Social", "Social"),
        ("email", "Email"),
        ("display", "Display"),
        ("banner", "Display"),
        ("referral", "Referral"),
        ("affiliate", "Affiliate"),
        ("(none)", "Direct"),
        ("", "Direct"),
        ("CPC", "src / CPC"),
        ("other", "src / other"),
    ],
)
def test_channels(spark, medium, channel):
    row = spark.range(1).select(channel_group(F.lit("src"), F.lit(medium)).alias("c")).first()
    assert row.c == channel
