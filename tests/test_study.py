from __future__ import annotations

from splitscope import Study
from tests.ga4rows import V1, V2, event, frame

REPORTS = [
    "z_test",
    "bayes_test",
    "effect_size",
    "srm_split",
    "srm_test",
    "guardrails",
    "engagement_by_variant",
    "bounce_comparison",
    "test_pages",
    "session_channel",
    "sample_size",
    "launch_decision",
]


def study(spark):
    rows = []
    for i in range(40):
        rows.append(event(f"u{i}", "page_view", i, V1 if i % 2 else V2, session=i % 3))
        if i % 5 == 0:
            rows.append(event(f"u{i}", "purchase", 100 + i))
    rows.append(event("late", "page_view", 1, V1, date="20240301"))
    return Study(frame(spark, rows), start_date="20240101", end_date="20240131")


def test_reports_are_the_same_over_written_flat_events(spark, tmp_path):
    nested = study(spark)
    flat = nested.flattened(str(tmp_path / "flat"))
    assert nested.flat.count() == flat.flat.count() == 48
    assert nested.flat.dtypes == flat.flat.dtypes
    for report in REPORTS:
        one, two = getattr(nested, report)(), getattr(flat, report)()
        assert one.columns == two.columns
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())), report


def test_no_test_pages_gives_empty_comparisons(spark):
    empty = Study(frame(spark, [event("u", "page_view", 1, "https://x.example/home")]))
    for report in ("z_test", "bayes_test", "effect_size", "guardrails", "bounce_comparison"):
        assert getattr(empty, report)().count() == 0, report
    assert empty.srm_test().first().srm_result == "Insufficient data"
    assert empty.launch_decision().first().decision.startswith("Invalid Test")
