"""Results kept by day: states that merge, and bitmaps of users that roll up, against one run over all events."""

from __future__ import annotations

import itertools
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import END, REGISTRY, START
from __spark_entry__ import study as study_of
from splitscope import Study
from splitscope.config import BOTH, EXCLUDE, FIRST, SESSION, USER_FORWARD
from splitscope.operators import dailies, rollup
from splitscope.operators.conversion import attributed_units
from splitscope.operators.events import ga4_events
from tests.ga4rows import V1, V2, event, frame

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize(("scope", "crossover", "days"), [(USER_FORWARD, BOTH, 1), (SESSION, EXCLUDE, 9), (USER_FORWARD, FIRST, 11)])
def test_thirty_days_one_by_one_equal_one_run(spark, tmp_path, scope, crossover, days):
    flat = study_of(spark, SMALL).flat.withColumn("user_pseudo_id", F.split("user_pseudo_id", "[.]")[0]).cache()
    path = str(tmp_path / "states")
    for n in range(0, 31, days):
        first, last = (f"{date(2024, 1, 1) + timedelta(k):%Y%m%d}" for k in (n, min(n + days, 31) - 1))
        dailies.update(flat, path, REGISTRY, first, last, scope)
    got = dailies.units(dailies.read_states(spark, path, START, END), REGISTRY, scope, crossover)
    assert rows(got) == rows(attributed_units(flat, REGISTRY, scope, crossover))
    weeks = dailies.units(dailies.read_states(spark, path, "20240108", "20240121"), REGISTRY, scope, crossover)
    some = flat.where("event_date BETWEEN '20240108' AND '20240121'")
    assert rows(weeks) == rows(attributed_units(some, REGISTRY, scope, crossover))
    flat.unpersist()


def test_a_corrected_day_replaces_its_state_and_no_other(spark, tmp_path):
    path = str(tmp_path / "states")
    first = [event("a", "page_view", 1, V1, date="20240101"), event("b", "page_view", 2, V2, date="20240102")]
    dailies.update(ga4_events(frame(spark, first)), path, REGISTRY, "20240101", "20240102")
    second = [event("c", "page_view", 1, V1, date="20240101"), event("x", "page_view", 2, V2, date="20240103")]
    dailies.update(ga4_events(frame(spark, second)), path, REGISTRY, "20240101", "20240101")
    users = lambda: {r.user_pseudo_id for r in dailies.units(dailies.read_states(spark, path), REGISTRY).collect()}
    assert users() == {"b", "c"}
    dailies.update(ga4_events(frame(spark, second)), path, REGISTRY, "20240102", "20240102")
    assert users() == {"c"}


def test_users_are_numbered_without_gaps(spark):
    users = spark.range(70_000).select(F.when(F.col("id") > 3, F.concat(F.lit("u"), F.col("id") % 69_000)).alias("user_pseudo_id"))
    numbers = rollup.numbered_users(users.repartition(7))
    found = numbers.agg(F.count("*"), F.count_distinct("user_pseudo_id"), F.min("user_number"), F.max("user_number")).first()
    assert tuple(found) == (69_000, 69_000, 1, 69_000)
    bitmaps = rollup.user_bitmaps(users.withColumn("k", F.lit(1)), numbers, ["k"])
    assert bitmaps.count() == 3 and rollup.rolled_up(bitmaps, ["k"]).first()["users"] == 69_000
    assert rollup.numbered_users(users.limit(0)).count() == 0


def test_bitmaps_roll_up_to_what_is_counted_anew(spark):
    flat = study_of(spark, SMALL).flat.withColumn("user_pseudo_id", F.split("user_pseudo_id", "[.]")[0])
    views = flat.where("event_name = 'page_view'").withColumns({"channel": F.col("source"), "day": F.col("event_date")})
    numbers = rollup.numbered_users(flat)
    keys = ["page_location", "day", "channel"]
    bitmaps = rollup.user_bitmaps(views, numbers, keys).cache()
    for size in range(4):
        for some in itertools.combinations(keys, size):
            got = rollup.rolled_up(bitmaps, list(some))
            assert rows(got) == rows(views.groupBy(*some).agg(F.count_distinct("user_pseudo_id").alias("users"))), some
    bitmaps.unpersist()


def test_the_study_counts_from_bitmaps(spark):
    for experiments in (REGISTRY, REGISTRY[0]):
        study = study_of(spark, SMALL, experiments=experiments)
        bitmaps = study.srm_bitmaps(rollup.numbered_users(study.flat))
        assert rows(study.srm_counts_of(bitmaps)) == rows(study.srm_counts)
    empty = Study(frame(spark, []))
    assert empty.srm_counts_of(empty.srm_bitmaps(rollup.numbered_users(empty.flat))).count() == 0
