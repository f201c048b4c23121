"""What the plans must look like for the operators to hold at scale."""

from __future__ import annotations

import pytest

from splitscope import Study
from splitscope.sources.ga4 import read_events, write_events
from __spark_entry__ import study as test_study

test_study.__test__ = False


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("table") / "events")
    write_events(test_study(spark, "/root/testdata/sf0.001").events, path)
    return Study(read_events(spark, path), start_date="20240105", end_date="20240120")


def plan(df, final=False):
    if final:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0] if final else text


def test_dates_and_event_names_reach_the_scan(study):
    text = plan(study.conversions())
    assert text.count("FileScan") == 1
    assert "PartitionFilters: [isnotnull(event_date" in text
    assert "PushedFilters: [Or(EqualTo(event_name,page_view),EqualTo(event_name,purchase))" in text


def test_conversions_take_one_shuffle_and_no_join(study):
    text = plan(study.conversions())
    assert text.count("Exchange hashpartitioning(user_pseudo_id") == text.count("Exchange ") == 1
    assert "Join" not in text


def test_lookups_are_not_repeated_by_filters(study):
    for report in (study.conversions(), study.exposures(), study.srm_counts, study.session_source()):
        filters = [line for line in plan(report).splitlines() if "Filter " in line]
        assert not any("array_position" in line for line in filters)


def test_reports_never_cross_join_or_leave_the_engine(study):
    reports = [
        study.z_test(),
        study.bayes_test(),
        study.effect_size(),
        study.srm_test(),
        study.guardrails(),
        study.bounce_comparison(),
        study.sample_size(by_channel=True),
        study.test_pages(),
        study.launch_decision(),
    ]
    for report in reports:
        text = plan(report)
        for word in ("CartesianProduct", "NestedLoop", "Python", "Pandas"):
            assert word not in text


def test_distinct_users_are_spread_before_they_are_counted(study):
    text = plan(study.srm_counts)
    assert "hashpartitioning(experiment_id" in text and "user_pseudo_id" in text.split("hashpartitioning(")[-1]


def scans(df):
    """Rows that the executed file scans read, over all of them; a reused exchange counts once."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    seen, rows, queue = set(), [], [plan]
    while queue:
        node = queue.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            queue.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            queue.append(node.plan())
        elif name == "ReusedExchangeExec":
            continue
        if name == "FileSourceScanExec" and node.id() not in seen:
            seen.add(node.id())
            rows.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        queue += [children.apply(i) for i in range(children.size())]
    return rows


def test_session_metrics_read_the_events_twice(study):
    """Once for the running totals, once, with fewer columns, for the totals of blocks."""
    assert len(scans(study.session_metrics)) <= 2


def test_decision_reads_the_events_four_times(study):
    """Twice for the sessions, once each for the test and the split."""
    assert len(scans(study.launch_decision())) <= 4


def test_reports_over_bucketed_events_do_not_deal_users_out_again(spark, study, tmp_path):
    bucketed = study.bucketed("bucketed_events", str(tmp_path / "events"), 6)
    for report in (bucketed.conversions(), bucketed.z_test()):
        text = plan(report)
        assert "Bucketed: true" in text and "PartitionFilters: [isnotnull(event_date" in text
        assert "hashpartitioning(user_pseudo_id" not in text
    assert sorted(map(str, bucketed.conversions().collect())) == sorted(map(str, study.conversions().collect()))
    assert sorted(map(str, bucketed.session_metrics.collect())) == sorted(map(str, study.session_metrics.collect()))
    spark.sql("DROP TABLE bucketed_events")


def test_partitioned_tables_are_read_by_folder(spark, tmp_path):
    path = str(tmp_path / "events")
    write_events(test_study(spark, "/root/testdata/sf0.001").events, path)
    two_weeks = Study(read_events(spark, path, "20240108", "20240121"), start_date="20240108", end_date="20240121")
    days = test_study(spark, "/root/testdata/sf0.001").flat.where("event_date BETWEEN '20240108' AND '20240121'")
    wanted = days.where("event_name IN ('page_view', 'purchase')").count()
    (read,) = scans(two_weeks.conversions())
    assert wanted <= read <= days.count()
