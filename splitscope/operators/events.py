"""Flattening the nested event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitscope.functions.params import has_any_param, int_param, string_param
from splitscope.sources.ga4 import in_dates

# Parameter keys that mark an event as part of a test.
EXPERIMENT_PARAMS = ("experiment_id", "variant", "test_id", "ab_test")


def ga4_events(
    events: DataFrame, start_date: str | None = None, end_date: str | None = None
) -> DataFrame:
    """One row per event, with the parameters in use pulled out once.

    Every other operator starts from this frame and names the columns it
    needs, so unused lookups are pruned and never reach the scan.
    """
    return in_dates(events, start_date, end_date).select(
        "event_date",
        "event_timestamp",
        "event_name",
        "user_pseudo_id",
        int_param("ga_session_id").alias("session_id"),
        string_param("page_location").alias("page_location"),
        string_param("source").alias("source"),
        string_param("medium").alias("medium"),
        has_any_param(*EXPERIMENT_PARAMS).alias("has_experiment_param"),
    )


def landing_page_experiments(flat: DataFrame, view_name: str | None = None) -> DataFrame:
    """The reusable event view of an experiment's date range; registered as a
    temporary view when a name is given."""
    view = flat.select(
        "user_pseudo_id", "session_id", "page_location", "event_timestamp", "event_name"
    )
    if view_name is not None:
        view.createOrReplaceTempView(view_name)
    return view


def pinned(frame: DataFrame, *columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A filter on a projected column moves below the projection and takes a copy
    of the expression with it for every mention; a parameter lookup would then
    run several times per row of the scan. Filters on other columns, such as
    the date and the event name, pass through a generator and still reach the
    scan, while filters on the generated columns stay above it.
    """
    return frame.select("*", F.inline_outer(F.array(F.struct(*columns))))


def pin_column(frame: DataFrame, name: str) -> DataFrame:
    """Keep a column that is about to be filtered on from being recomputed."""
    others = [c for c in frame.columns if c != name]
    return frame.select(*others, F.inline_outer(F.array(F.struct(name))))


def page_views(flat: DataFrame) -> DataFrame:
    return flat.where(F.col("event_name") == "page_view")
