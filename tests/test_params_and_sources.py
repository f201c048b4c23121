from __future__ import annotations

import pytest

from splitscope.operators.events import ga4_events, landing_page_experiments
from splitscope.sources.ga4 import read_event_shards, read_events, write_events
from tests.ga4rows import V1, V2, event, frame, param


def test_missing_key_is_null_and_first_duplicate_wins(spark):
    rows = [
        event("a", "page_view", 1, page=None, session=None),
        event("b", "page_view", 1, page=V1, session=7, extra=[param("page_location", V2)]),
        event("c", "page_view", 1, page=V1, extra=[param("ab_test", "x"), param("source", "s")]),
        (1, "page_view", "d", None, "20240101"),
    ]
    a, b, c, d = ga4_events(frame(spark, rows)).orderBy("user_pseudo_id").collect()
    assert (a.page_location, a.session_id, a.has_experiment_param) == (None, None, False)
    assert (b.page_location, b.session_id) == (V1, 7)
    assert (c.source, c.medium, c.has_experiment_param) == ("s", None, True)
    assert (d.page_location, d.session_id, d.has_experiment_param) == (None, None, False)


def test_a_key_of_the_other_type_is_null(spark):
    rows = [event("a", "page_view", 1, session=None, extra=[param("ga_session_id", "12")])]
    assert ga4_events(frame(spark, rows)).first().session_id is None


def days(spark):
    dates = ["20240101", "20240102", "20240103"]
    return frame(spark, [event("u", "page_view", i, page=V1, date=d) for i, d in enumerate(dates)])


def test_partitioned_table_round_trip_prunes_dates(spark, tmp_path):
    path = str(tmp_path / "events")
    write_events(days(spark), path)
    events = read_events(spark, path, "20240102", "20240103")
    assert sorted(r.event_date for r in events.collect()) == ["20240102", "20240103"]
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_daily_folders_take_the_date_from_the_name(spark, tmp_path):
    for row in days(spark).collect():
        one_day = frame(spark, [tuple(row)]).drop("event_date")
        one_day.write.parquet(str(tmp_path / f"events_{row.event_date}"))
    # The fourth has no folder; it is skipped.
    events = read_event_shards(spark, str(tmp_path), "20240102", "20240104")
    assert sorted(r.event_date for r in events.collect()) == ["20240102", "20240103"]


def test_unused_params_are_not_read(spark, tmp_path):
    path = str(tmp_path / "events")
    write_events(days(spark), path)
    flat = ga4_events(read_events(spark, path))
    plan = flat.select("page_location")._jdf.queryExecution().executedPlan().toString()
    assert "string_value" in plan and "int_value" not in plan


def test_dates_are_inclusive(spark):
    flat = ga4_events(days(spark), "20240101", "20240102")
    assert flat.count() == 2
    assert ga4_events(days(spark), start_date="20240102").count() == 2


def test_view_is_registered(spark):
    landing_page_experiments(ga4_events(days(spark)), "landing_page_experiments")
    assert spark.sql("SELECT page_location FROM landing_page_experiments").count() == 3


@pytest.mark.parametrize("size", ["0.001"])
def test_flat_filter_reaches_the_file(spark, size):
    from __spark_entry__ import study

    plan = study(spark, f"/root/testdata/sf{size}").flat._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-01T00:00)" in plan.toString()
