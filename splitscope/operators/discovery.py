"""Finding the pages that take part in tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splitscope.functions.numeric import percent, ratio
from splitscope.functions.urls import contains_any
from splitscope.operators.events import pin_column

# URL fragments that hint at a test page, and the report's size.
TEST_URL_FRAGMENTS = ("/landing", "/v1", "/v2", "?variant=", "?test=", "?exp=")
TOP_PAGES = 50

BY_URL, BY_PARAM = "url_pattern", "event_param"


def _pages(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Users, rows and purchases per page.

    The exact distinct count shuffles on (page, user) before it shuffles on
    the page, so one page with most of the traffic is spread over all tasks.
    """
    bought = F.count_if(F.col("event_name") == "purchase")
    pages = rows.groupBy(*keys, "page_location").agg(
        F.countDistinct("user_pseudo_id").alias("unique_users"),
        F.count("*").alias("pageviews"),
        bought.alias("conversions"),
    )
    return with_rate(pages)


def with_rate(pages: DataFrame) -> DataFrame:
    return pages.withColumn("cr_pct", percent(ratio(F.col("conversions"), F.col("unique_users"))))


def _order() -> list[Column]:
    return [F.desc("unique_users"), F.asc("page_location")]


def _top_pages(rows: DataFrame, top: int | None) -> DataFrame:
    """:func:`_pages`, those with most users first."""
    report = _pages(rows)
    return report if top is None else report.orderBy(*_order()).limit(top)


def _named(*names: str) -> Column:
    return F.col("event_name").isin(*names)


def test_pages_by_url(
    flat: DataFrame,
    fragments: tuple[str, ...] = TEST_URL_FRAGMENTS,
    top: int | None = TOP_PAGES,
) -> DataFrame:
    """Pages whose URL looks like a test page. ``pageviews`` counts page views
    and purchases alike."""
    pages = pin_column(flat.where(_named("page_view", "purchase")), "page_location")
    return _top_pages(pages.where(contains_any(F.col("page_location"), fragments)), top)


def test_pages_by_param(
    flat: DataFrame, count_purchases: bool = False, top: int | None = TOP_PAGES
) -> DataFrame:
    """Pages viewed with an experiment parameter; no page is a group too.

    By default only page views are read and ``conversions`` is therefore 0;
    ``count_purchases`` reads purchases with the parameter as well.
    """
    names = ("page_view", "purchase") if count_purchases else ("page_view",)
    return _top_pages(flat.where(_named(*names) & F.col("has_experiment_param")), top)


def by_method(flat: DataFrame, count_purchases: bool = False) -> DataFrame:
    """Events that tell of a test page, once for each ``method`` they do so by; the events are read once."""
    view, bought = _named("page_view"), _named("purchase")
    counted = view | bought if count_purchases else view
    ways = {
        BY_URL: contains_any(F.col("page_location"), TEST_URL_FRAGMENTS),
        BY_PARAM: counted & F.col("has_experiment_param"),
    }
    found = F.array_compact(F.array(*[F.when(test, F.lit(method)) for method, test in ways.items()]))
    return pin_column(flat.where(view | bought), "page_location").select("*", F.explode(found).alias("method"))


def test_pages(
    flat: DataFrame, count_purchases: bool = False, top: int | None = TOP_PAGES
) -> DataFrame:
    """Both methods in one report, told apart by ``method``."""
    report = _pages(by_method(flat, count_purchases), ["method"])
    report = report.select("method", *[c for c in report.columns if c != "method"])
    if top is None:
        return report
    # Only the first pages of each task meet in the task of their method.
    nth = F.row_number().over(W.partitionBy("method").orderBy(*_order()))
    best = report.withColumn("_nth", nth).where(F.col("_nth") <= top).drop("_nth")
    return best.orderBy(F.desc("method"), *_order())
