"""Traffic source and channel of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitscope.functions.traffic import DIRECT_SOURCE, NO_MEDIUM, channel_group
from splitscope.operators.events import pin_column

# Events the tracker sends by itself.
AUTO_EVENTS = ("session_start", "first_visit")


def source_candidate() -> Column:
    """What an event says of its session's source; the smallest one of the session settles it."""
    named = F.col("source").isNotNull() | F.col("medium").isNotNull()
    by_site = ~F.col("event_name").isin(*AUTO_EVENTS)
    is_start = F.col("event_name") == "session_start"
    rank = F.when(by_site & named, 0).when(is_start & named, 1).otherwise(2)
    return F.struct(rank.alias("rank"), "event_timestamp", "source", "medium")


def session_source(flat: DataFrame, with_first_event: bool = False) -> DataFrame:
    """Source and medium per user and session.

    Taken from the earliest event that the tracker did not send by itself and
    that names a source or a medium; else from the earliest such
    ``session_start``; else from the earliest event. ``session_start`` is the
    time of that event; ``with_first_event`` adds the time of the session's
    first one. Equal times are settled by source and medium.

    A minimum over (rank, time, source, medium) finds the row: it combines on
    the map side, and no session's events are ever gathered.
    """
    extra = [F.min("event_timestamp").alias("first_event")] if with_first_event else []
    resolved = (
        pin_column(flat, "session_id")
        .where(F.col("session_id").isNotNull())
        .groupBy("user_pseudo_id", "session_id")
        .agg(F.min(source_candidate()).alias("best"), *extra)
    )
    return resolved.select(
        "user_pseudo_id",
        "session_id",
        F.timestamp_micros(F.col("best.event_timestamp")).alias("session_start"),
        F.coalesce("best.source", F.lit(DIRECT_SOURCE)).alias("source"),
        F.coalesce("best.medium", F.lit(NO_MEDIUM)).alias("medium"),
        *([F.timestamp_micros("first_event").alias("first_event_at")] if with_first_event else []),
    )


def session_channel(flat: DataFrame) -> DataFrame:
    """:func:`session_source` with the session's channel."""
    return session_source(flat).withColumn(
        "channel", channel_group(F.col("source"), F.col("medium"))
    )


def resolved_channel(best: Column) -> Column:
    """The channel that a session's smallest :func:`source_candidate` stands for."""
    return channel_group(F.coalesce(best["source"], F.lit(DIRECT_SOURCE)), F.coalesce(best["medium"], F.lit(NO_MEDIUM)))
