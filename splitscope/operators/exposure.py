"""Who saw which variant, and when first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitscope import labels
from splitscope.config import LANDING_PAGE, Experiment, Experiments, experiment_keys
from splitscope.functions.urls import contains_any, variant_label
from splitscope.operators import registry
from splitscope.operators.events import page_views, pin_column, pinned

# Fixed value: any landing page, tested or not.
LANDING_FRAGMENT = "/landing"


def with_arms(flat: DataFrame, experiments: Experiments) -> DataFrame:
    """Every event with ``[experiment_id,] variant``, null where it exposes nobody. A view that exposes to arms of a registry
    is there once for each as well, with a null ``event_name``: these rows count nothing."""
    is_view = F.col("event_name") == "page_view"
    if isinstance(experiments, Experiment):
        return pinned(flat, F.when(is_view, variant_label(F.col("page_location"), experiments)).alias("variant"))
    rows = registry.exposed_rows(pin_column(flat, "page_location"), experiments, is_view, keep=True).drop("place")
    return rows.withColumn("event_name", F.when(F.col("variant").isNull(), F.col("event_name")))


def exposed_views(flat: DataFrame, experiments: Experiments = LANDING_PAGE) -> DataFrame:
    """Page views of tested pages with ``experiment_id, variant``."""
    views = page_views(flat)
    if isinstance(experiments, Experiment):
        name = F.lit(experiments.experiment_id).alias("experiment_id")
        named = pinned(views, name, variant_label(F.col("page_location"), experiments).alias("variant"))
        return named.where(F.col("variant").isNotNull())
    return registry.exposed_rows(pin_column(views, "page_location"), experiments, F.lit(True)).drop("place")


def exposures(
    flat: DataFrame, experiments: Experiments = LANDING_PAGE, by_session: bool = False
) -> DataFrame:
    """First exposure per user and variant, or per user, session and variant."""
    session = ["session_id"] if by_session else []
    keys = [*experiment_keys(experiments), "user_pseudo_id", *session, "variant"]
    return (
        exposed_views(flat, experiments)
        .groupBy(*keys)
        .agg(F.min("event_timestamp").alias("session_start"))
    )


def experiment_page_views(
    flat: DataFrame, experiments: Experiments = LANDING_PAGE, limit: int | None = None
) -> DataFrame:
    """First view per user, session and tested page; over a registry, per
    experiment that tests the page. A ``limit`` keeps the first rows in key order."""
    keys = [*experiment_keys(experiments), "user_pseudo_id", "session_id", "page_location"]
    views = pin_column(page_views(flat), "page_location")
    if isinstance(experiments, Experiment):
        fragments = [a.url_contains for a in experiments.arms]
        tested = views.where(contains_any(F.col("page_location"), fragments))
    else:
        tested = registry.exposed_rows(views, experiments, F.lit(True))
    found = tested.groupBy(*keys).agg(F.min("event_timestamp").alias("session_start"))
    return found if limit is None else found.orderBy(*keys).limit(limit)


def classify_variants(
    flat: DataFrame, experiments: Experiments = LANDING_PAGE, limit: int | None = None
) -> DataFrame:
    """Distinct user, session and landing page, with the page's variant or
    ``Unknown`` for a landing page outside the test; over a registry, one row
    per experiment."""
    keys = ["user_pseudo_id", "session_id", "page_location"]
    unknown = F.lit(labels.UNKNOWN_VARIANT)
    pages = (
        pin_column(page_views(flat), "page_location")
        .where(F.col("page_location").contains(LANDING_FRAGMENT))
        .select(*keys)
        .distinct()
    )
    if isinstance(experiments, Experiment):
        label = variant_label(F.col("page_location"), experiments)
        found = pages.withColumn("experiment_variant", F.coalesce(label, unknown))
    else:
        found = _per_experiment(pages, experiments, unknown)
        keys = ["experiment_id", *keys]
    return found if limit is None else found.orderBy(*keys).limit(limit)


def _per_experiment(pages: DataFrame, experiments: Sequence[Experiment], unknown: Column) -> DataFrame:
    """Every page once per experiment. Labels are found once per URL; only then do the experiments without one come in."""
    urls = pages.select("page_location").distinct()
    found = registry.exposed_rows(urls, experiments, F.lit(True), keep=True)
    label = F.struct("experiment_id", F.col("variant").alias("experiment_variant"))
    by_url = found.groupBy("page_location").agg(F.collect_list(F.when(F.col("variant").isNotNull(), label)).alias("_own"))
    ids = F.array(*[F.lit(e.experiment_id) for e in experiments])
    rest = F.transform(
        F.array_except(ids, F.col("_own.experiment_id")),
        lambda i: F.struct(i.alias("experiment_id"), unknown.alias("experiment_variant")),
    )
    rows = pages.join(by_url, "page_location").select(*pages.columns, F.inline(F.concat("_own", rest)))
    return rows.select("experiment_id", *pages.columns, "experiment_variant")
