"""Watching the traffic split while a test runs.

A streaming job keeps each arm's exact number of users up to date; after every
micro-batch the split and its test are written out as two small tables. State
is one entry per user and arm, kept by a state store that spills to disk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from splitscope.config import LANDING_PAGE, Experiments
from splitscope.operators.events import ga4_events
from splitscope.operators.exposure import exposed_views
from splitscope.operators.srm import srm_split, srm_test
from splitscope.sources.ga4 import PARTITIONED_SCHEMA


def read_event_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """New files of a table partitioned by ``event_date``, as a stream."""
    return spark.readStream.schema(PARTITIONED_SCHEMA).options(**options).parquet(path)


def running_counts(events: DataFrame, experiments: Experiments = LANDING_PAGE) -> DataFrame:
    """Streaming ``experiment_id, variant, users``: distinct users so far."""
    first_seen = (
        exposed_views(ga4_events(events), experiments)
        .where(F.col("user_pseudo_id").isNotNull())
        .select("experiment_id", "variant", "user_pseudo_id")
        .dropDuplicates()
    )
    return first_seen.groupBy("experiment_id", "variant").agg(F.count("*").alias("users"))


def checkpoint_dir(spark: SparkSession, name: str) -> str:
    """A folder for the job's state below the one the cluster names."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{name}"


STORE = "spark.sql.streaming.stateStore.providerClass"
SPILLING_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_spilling_store(spark: SparkSession) -> None:
    """Has streams of the session keep state on disk, unless it names a store itself:
    the default one holds every user ever seen on the executor heap."""
    if spark.conf.get(STORE, None) is None:
        spark.conf.set(STORE, SPILLING_STORE)


def monitor_split(
    events: DataFrame,
    write: Callable[[DataFrame, DataFrame, int], None],
    experiments: Experiments = LANDING_PAGE,
    name: str = "split_monitor",
) -> DataStreamWriter:
    """A stream writer that hands the split and its test to ``write`` after
    every batch: ``write(split, test, batch_id)``. Both are whole results, so
    writing them by overwriting makes a repeated batch harmless. The caller
    sets the trigger and starts it.
    """

    def report(counts: DataFrame, batch_id: int) -> None:
        write(srm_split(counts, experiments), srm_test(counts, experiments), batch_id)

    use_spilling_store(events.sparkSession)
    counts = running_counts(events, experiments)
    return (
        counts.writeStream.outputMode("complete")
        .queryName(name)
        .option("checkpointLocation", checkpoint_dir(events.sparkSession, name))
        .foreachBatch(report)
    )
