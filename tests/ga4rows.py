"""Tiny nested events for row-level tests."""

from __future__ import annotations

from splitscope.sources.ga4 import EVENT_SCHEMA
from pyspark.sql import types as T

SCHEMA = T.StructType([*EVENT_SCHEMA.fields, T.StructField("event_date", T.StringType())])
V1, V2 = "https://x.example/landing-v1", "https://x.example/landing-v2"


def param(key, value):
    text = value if isinstance(value, str) else None
    number = value if isinstance(value, int) else None
    return (key, (text, number))


def event(user, name, ts, page=None, session=1, date="20240101", extra=()):
    """One event; ``session=None`` and ``page=None`` leave the key out."""
    params = []
    if page is not None:
        params.append(param("page_location", page))
    if session is not None:
        params.append(param("ga_session_id", session))
    return (ts, name, user, [*params, *extra], date)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
