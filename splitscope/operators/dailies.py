"""State per day that merges: what a report needs of the history without reading the events again.

Per user, experiment design and variant a day keeps the first exposure, and per user the last purchase. Both merge by minimum
and maximum, so a result over any days is one aggregation of their states, and a day that is read again replaces its own state
and no other. Sessions may run over midnight: with ``scope='session'`` the state is per session as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitscope.config import BOTH, SESSION, USER_FORWARD, Experiment
from splitscope.operators import conversion, registry
from splitscope.sources.ga4 import in_dates

#: A row that every day has, so that a day without events replaces an earlier state of it too.
MARK = "day"
STATE = (
    "kind string, user_pseudo_id string, session_id bigint, experiment_id string, variant string, place int, "
    "first struct<untimed:boolean,event_timestamp:bigint>, last bigint, event_date string"
)


def day_states(flat: DataFrame, experiments: Sequence[Experiment], scope: str = USER_FORWARD) -> DataFrame:
    """The state of every day of the events, as rows of :data:`STATE`."""
    designs = registry.designs(experiments)
    rows = conversion.arm_states(flat, designs, ["event_date", *([] if scope != SESSION else ["session_id"])])
    session = F.col("session_id") if scope == SESSION else F.lit(None).cast("bigint").alias("session_id")
    return rows.select(
        F.lit("state").alias("kind"), "user_pseudo_id", session, "experiment_id", "variant", "place", "first", "last", "event_date"
    )


def update(
    flat: DataFrame, path: str, experiments: Sequence[Experiment], start_date: str, end_date: str, scope: str = USER_FORWARD
) -> None:
    """Reads the days from ``start_date`` to ``end_date`` and replaces their states in the table at ``path``; the states of
    other days are neither read nor written. A day without any event keeps an empty state."""
    states = day_states(in_dates(flat, start_date, end_date), experiments, scope)
    days = states.sparkSession.sql(
        f"SELECT date_format(d, 'yyyyMMdd') AS event_date FROM (SELECT explode(sequence(to_date('{start_date}', 'yyyyMMdd'), "
        f"to_date('{end_date}', 'yyyyMMdd'))) AS d)"
    )
    marks = days.select(F.lit(MARK).alias("kind"), "event_date")
    whole = states.unionByName(marks, allowMissingColumns=True)
    (
        whole.hint("rebalance", "event_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date")
        .parquet(path)
    )


def read_states(spark: SparkSession, path: str, start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """The states of the days in the range; the dates prune folders."""
    states = spark.read.schema(STATE).parquet(path)
    return in_dates(states, start_date, end_date).where(F.col("kind") != MARK)


def units(
    states: DataFrame, experiments: Sequence[Experiment], scope: str = USER_FORWARD, crossover: str = BOTH
) -> DataFrame:
    """Attributed units (:func:`splitscope.operators.conversion.attributed_units`) over a registry, from the states of days."""
    keys = ["user_pseudo_id", *(["session_id"] if scope == SESSION else [])]
    merged = states.groupBy(*keys, "experiment_id", "variant", "place").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return registry.named(conversion.settled_units(merged, scope, crossover), experiments)
