"""Reading and writing nested web-analytics event tables.

Two layouts are read: one Parquet table partitioned by ``event_date``, and one
folder per day named ``events_YYYYMMDD`` (the wildcard-table export). Both give
the columns of :data:`EVENT_SCHEMA` plus the ``event_date`` string.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Only the leaves that are read: exports carry more value fields, and leaving
# them out of the schema keeps them out of the scan.
PARAM_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField(
            "value",
            T.StructType(
                [
                    T.StructField("string_value", T.StringType()),
                    T.StructField("int_value", T.LongType()),
                ]
            ),
        ),
    ]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_timestamp", T.LongType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("user_pseudo_id", T.StringType()),
        T.StructField("event_params", T.ArrayType(PARAM_SCHEMA)),
    ]
)

PARTITIONED_SCHEMA = T.StructType([*EVENT_SCHEMA.fields, T.StructField("event_date", T.StringType())])


def in_dates(events: DataFrame, start_date: str | None, end_date: str | None) -> DataFrame:
    """Rows with ``start_date <= event_date <= end_date`` (``YYYYMMDD``)."""
    if start_date is not None:
        events = events.where(F.col("event_date") >= start_date)
    if end_date is not None:
        events = events.where(F.col("event_date") <= end_date)
    return events


def read_events(
    spark: SparkSession, path: str, start_date: str | None = None, end_date: str | None = None
) -> DataFrame:
    """Read a table partitioned by ``event_date``; the dates prune folders."""
    return in_dates(spark.read.schema(PARTITIONED_SCHEMA).parquet(path), start_date, end_date)


def _days(start_date: str, end_date: str) -> list[str]:
    first: date = datetime.strptime(start_date, "%Y%m%d").date()
    last: date = datetime.strptime(end_date, "%Y%m%d").date()
    return [f"{first + timedelta(n):%Y%m%d}" for n in range((last - first).days + 1)]


def read_event_shards(
    spark: SparkSession, root: str, start_date: str, end_date: str, prefix: str = "events_"
) -> DataFrame:
    """Read daily folders ``<root>/<prefix>YYYYMMDD``, both dates included.

    Only the folders of the range are listed; days without a folder are
    skipped. ``event_date`` is the folder's suffix.
    """
    days = ",".join(_days(start_date, end_date))
    events = spark.read.schema(EVENT_SCHEMA).parquet(f"{root.rstrip('/')}/{prefix}{{{days}}}")
    suffix = F.regexp_extract(F.col("_metadata.file_path"), re.escape(prefix) + r"(\d{8})/[^/]*$", 1)
    return events.select(*EVENT_SCHEMA.names, suffix.alias("event_date"))


def write_events(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write events as Parquet partitioned by ``event_date``.

    The rebalance hint brings a day's rows together and lets the adaptive
    planner split a day that is too big for one task.
    """
    (
        events.hint("rebalance", "event_date")
        .write.mode(mode)
        .partitionBy("event_date")
        .parquet(path)
    )
