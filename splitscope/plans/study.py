"""A study: one event table, a set of experiments and a date range, with every
report as a lazily built DataFrame. The methods follow the order in which the
reports are used: plan, check tracking, check the split, read the result,
size it, check the guardrails, decide."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame

from splitscope.config import (
    BOTH,
    LANDING_PAGE,
    USER_FORWARD,
    Experiment,
    Experiments,
    GuardrailLimits,
    PowerSettings,
    as_registry,
)
from splitscope.operators import (
    attribution,
    conversion,
    decision,
    discovery,
    engagement,
    events,
    exposure,
    planning,
    registry,
    rollup,
    sessions,
    srm,
    stats,
)
from splitscope.sources.ga4 import in_dates, write_events


@dataclass(frozen=True)
class Study:
    events: DataFrame
    experiments: Experiments = LANDING_PAGE
    start_date: str | None = None
    end_date: str | None = None
    scope: str = USER_FORWARD
    crossover: str = BOTH
    limits: GuardrailLimits = field(default_factory=GuardrailLimits)
    power: PowerSettings = field(default_factory=PowerSettings)
    min_relative_lift_pct: float = 15.0
    # The flattened events, where they have been written out before.
    flat_table: DataFrame | None = None

    @cached_property
    def flat(self) -> DataFrame:
        if self.flat_table is not None:
            return in_dates(self.flat_table, self.start_date, self.end_date)
        return events.ga4_events(self.events, self.start_date, self.end_date)

    def flattened(self, path: str) -> Study:
        """The same study over the flattened events, written to ``path`` once.

        Worth it when several reports are made: they then read plain columns,
        not the parameter arrays of every event.
        """
        write_events(self.flat, path)
        # The schema is given: the date folders would be read as numbers.
        reader = self.flat.sparkSession.read.schema(self.flat.schema)
        return replace(self, flat_table=reader.parquet(path).select(*self.flat.columns))

    def bucketed(self, table: str, path: str, buckets: int | None = None) -> Study:
        """As :meth:`flattened`, as a table of the catalog, partitioned by day and bucketed by user.

        Reports per user then aggregate where a bucket is read, without dealing the events out again: of all reports, only what
        follows the first aggregation is shuffled. Every day has up to ``buckets`` files (default: the number of shuffle
        partitions), so that a bucket's share of the date range should fit a task."""
        spark = self.flat.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # One task writes a bucket's files of all days, so that there are no more of them than buckets and days.
        dealt = self.flat.repartition(buckets, "user_pseudo_id").sortWithinPartitions("event_date")
        writer = dealt.write.partitionBy("event_date").bucketBy(buckets, "user_pseudo_id")
        writer.option("path", path).format("parquet").saveAsTable(table)
        return replace(self, flat_table=spark.table(table).select(*self.flat.columns))

    # Units are measured per design of the registry, and named per experiment where results leave the study.

    @cached_property
    def _designs(self) -> Experiments:
        return self.experiments if isinstance(self.experiments, Experiment) else registry.designs(self.experiments)

    def _named(self, frame: DataFrame) -> DataFrame:
        return frame if isinstance(self.experiments, Experiment) else registry.named(frame, self.experiments)

    def _units_of(self, by_channel: bool) -> DataFrame:
        return conversion.attributed_units(
            self.flat, self._designs, self.scope, self.crossover, by_channel=by_channel
        )

    # Planning

    def sample_size(self, by_channel: bool = False, grid=planning.DEFAULT_GRID) -> DataFrame:
        baselines = planning.measured_baselines(self._units_of(by_channel), self._designs, _segments(by_channel))
        return planning.sample_size(self._named(baselines), grid, self.power)

    # Tracking

    def landing_page_experiments(self, view_name: str | None = None) -> DataFrame:
        return events.landing_page_experiments(self.flat, view_name)

    def test_pages(
        self, count_purchases: bool = False, top: int | None = discovery.TOP_PAGES
    ) -> DataFrame:
        return discovery.test_pages(self.flat, count_purchases, top)

    def experiment_page_views(self, limit: int | None = None) -> DataFrame:
        if limit is not None:
            return exposure.experiment_page_views(self.flat, self.experiments, limit)
        return self._named(exposure.experiment_page_views(self.flat, self._designs))

    def classify_variants(self, limit: int | None = None) -> DataFrame:
        return exposure.classify_variants(self.flat, self.experiments, limit)

    def session_source(self) -> DataFrame:
        return attribution.session_source(self.flat)

    def session_channel(self) -> DataFrame:
        return attribution.session_channel(self.flat)

    # Split

    @cached_property
    def srm_counts(self) -> DataFrame:
        counts = srm.srm_counts(self.flat, self._designs)
        return self._named(counts)

    @cached_property
    def channel_srm_counts(self) -> DataFrame:
        """Users per arm and channel of their first exposure to it."""
        study = replace(self, crossover=BOTH)
        return self._named(srm.counts_from_units(study._units_of(True), self._designs, _segments(True)))

    def srm_split(self, by_channel: bool = False) -> DataFrame:
        counts = self.channel_srm_counts if by_channel else self.srm_counts
        return srm.srm_split(counts, self.experiments, _segments(by_channel))

    def srm_test(self, by_channel: bool = False) -> DataFrame:
        counts = self.channel_srm_counts if by_channel else self.srm_counts
        return srm.srm_test(counts, self.experiments, _segments(by_channel))

    # Split and tracking over days, from bitmaps of users

    def srm_bitmaps(self, numbers: DataFrame) -> DataFrame:
        """Users per day, experiment and variant as bitmaps, by :func:`rollup.numbered_users`; see :meth:`srm_counts_of`."""
        views = exposure.exposed_views(self.flat, self._designs)
        return self._named(rollup.user_bitmaps(views, numbers, ["experiment_id", "variant", "event_date"]))

    def srm_counts_of(self, bitmaps: DataFrame, by_day: bool = False) -> DataFrame:
        """Distinct users per arm over the days of the bitmaps, or per day."""
        days = ["event_date"] if by_day else []
        return rollup.rolled_up(bitmaps, ["experiment_id", *days, "variant"])

    def page_bitmaps(self, numbers: DataFrame, count_purchases: bool = False) -> DataFrame:
        """Users per day, method and test page as bitmaps."""
        found = discovery.by_method(self.flat, count_purchases)
        return rollup.user_bitmaps(found, numbers, ["method", "page_location", "event_date"])

    # Result

    def exposures(self, by_session: bool = False) -> DataFrame:
        return self._named(exposure.exposures(self.flat, self._designs, by_session))

    def conversions(self) -> DataFrame:
        return self._named(conversion.without_times(self._units_of(False), self._designs))

    def _stats(self, by_channel: bool) -> DataFrame:
        return self._named(stats.variant_stats(self._units_of(by_channel), self._designs, _segments(by_channel)))

    @cached_property
    def variant_stats(self) -> DataFrame:
        return self._stats(False)

    @cached_property
    def channel_stats(self) -> DataFrame:
        return self._stats(True)

    def z_test(self, by_channel: bool = False) -> DataFrame:
        return self._test(stats.z_test, by_channel)

    def bayes_test(self, by_channel: bool = False) -> DataFrame:
        return self._test(stats.bayes_test, by_channel)

    def effect_size(self, by_channel: bool = False) -> DataFrame:
        return self._test(stats.effect_size, by_channel)

    def _test(self, test, by_channel: bool) -> DataFrame:
        return test(self._stats(by_channel), self.experiments, _segments(by_channel))

    # Guardrails and engagement

    def _metrics(self, by_channel: bool) -> DataFrame:
        return sessions.session_metrics(self.flat, self._designs, self.scope, by_channel)

    @cached_property
    def session_metrics(self) -> DataFrame:
        return self._named(self._metrics(False))

    def _guardrail_stats(self, by_channel: bool) -> DataFrame:
        segments = _segments(by_channel)
        return self._named(engagement.guardrail_stats(self._metrics(by_channel), self._designs, segments=segments))

    @cached_property
    def guardrail_stats(self) -> DataFrame:
        return self._guardrail_stats(False)

    def guardrails(self, detail: bool = False, by_channel: bool = False) -> DataFrame:
        found = self._guardrail_stats(by_channel)
        return engagement.guardrails(found, self.experiments, self.limits, detail, _segments(by_channel))

    def engagement_by_variant(self, by_channel: bool = False) -> DataFrame:
        segments = _segments(by_channel)
        return self._named(engagement.engagement_by_variant(self._metrics(by_channel), self._designs, segments=segments))

    def bounce_comparison(self, by_channel: bool = False) -> DataFrame:
        segments = _segments(by_channel)
        rates = self._named(engagement.bounce_rates(self._metrics(by_channel), self._designs, segments))
        return engagement.compare_bounces(rates, self.experiments, segments)

    # Decision

    def launch_decision(self, min_days: float | None = None, by_channel: bool = False) -> DataFrame:
        """The decision per experiment; ``min_days`` adds a shortest duration."""
        study = replace(self, experiments=as_registry(self.experiments))
        totals = sessions.session_totals(study.flat, study._designs, study.scope, by_channel)
        segments = _segments(by_channel)
        summary = study._named(decision.arm_summary(totals, self.crossover, segments))
        return decision.decided(
            summary, study.experiments, self.limits, self.min_relative_lift_pct, min_days, segments
        )


def _segments(by_channel: bool) -> list[str]:
    return ["channel"] if by_channel else []
