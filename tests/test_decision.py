"""The decision from one grouping against the decision from the separate reports."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import REGISTRY
from __spark_entry__ import study as study_of
from splitscope.config import BOTH, EXCLUDE, FIRST, SESSION, USER_FORWARD
from splitscope.operators import decision, registry, srm
from splitscope.operators.conversion import attributed_units
from splitscope.operators.events import ga4_events
from splitscope.operators.sessions import session_totals
from tests.ga4rows import V1, V2, event, frame
from tests.test_states import SMALL, rows


def separately(study, min_days=None):
    lengths = [] if min_days is None else [decision.run_lengths(study._named(study._units_of(False))), min_days]
    return decision.launch_decision(study.z_test(), study.guardrails(), srm.srm_test(study.srm_counts, study.experiments), 15.0, *lengths)


@pytest.mark.parametrize(("scope", "crossover"), [(USER_FORWARD, BOTH), (SESSION, BOTH), (USER_FORWARD, EXCLUDE), (SESSION, FIRST)])
def test_one_grouping_decides_as_the_reports_do(spark, scope, crossover):
    study = study_of(spark, SMALL, experiments=REGISTRY)
    # A user for all days: more sessions and crossovers a unit.
    events = study.events.withColumn("user_pseudo_id", F.split("user_pseudo_id", "[.]")[0])
    whole = type(study)(events, REGISTRY, scope=scope, crossover=crossover)
    assert rows(whole.launch_decision(min_days=28)) == rows(separately(whole, 28.0))


@pytest.mark.parametrize("crossover", [BOTH, EXCLUDE, FIRST])
def test_the_summary_holds_what_the_reports_count(spark, crossover):
    made = []
    for i in range(60):
        user = f"u{i % 11}" if i % 7 else None
        made.append(event(user, "page_view", 50 * i if i % 9 else None, V1 if i % 3 else V2, session=i % 4 or None))
        made.append(event(user, "purchase" if i % 2 else "add_to_cart", 50 * i + 10, session=i % 3))
    designs = registry.designs(REGISTRY)
    flat = ga4_events(frame(spark, made))
    summary = decision.arm_summary(session_totals(flat, designs), crossover)
    units = attributed_units(flat, designs, crossover=crossover).groupBy("experiment_id", "variant").agg(
        F.count("*").alias("visitors"), F.sum("converted").alias("conversions"),
        F.min("session_start").alias("first_exposure"), F.max("session_start").alias("last_exposure"),
    )
    assert rows(summary.where("visitors > 0").select(units.columns)) == rows(units)
    users = srm.srm_counts(flat, designs)
    assert rows(summary.select(users.columns)) == rows(users)
