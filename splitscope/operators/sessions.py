"""What each exposed session's user did from the exposure on.

The metrics of an exposure are suffix totals: counts over all events of the
user at or after the first exposure. Instead of joining every exposure with
every later event of its user, running totals from the newest event backwards
are attached to the exposing views. Suffix counts never grow with time, so the
value at the first exposure is simply the maximum over the exposure's rows.

Users are handled in blocks of one minute, all of them alike, by a prefix sum in
two levels. Running totals are taken inside each block, where the rows of a
session and variant shrink to one with its own counts; a second running total,
over these rows, adds what all later blocks hold. So no user's events meet in one
task, only those of a minute, and a few rows for each minute in which there are
any. Events are read once, and both levels come out of one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splitscope.config import (
    LANDING_PAGE,
    SCOPES,
    SESSION,
    USER_FORWARD,
    Experiments,
    experiment_keys,
)
from splitscope.functions.numeric import round_half_away
from splitscope.operators.attribution import resolved_channel, source_candidate
from splitscope.operators.exposure import with_arms

# Counters and the events they count. Event names.
COUNTED_EVENTS = {
    "page_views": ("page_view",),
    "scrolls": ("scroll",),
    "clicks": ("click",),
    "engagements": ("scroll", "click", "view_item"),
    "cart_adds": ("add_to_cart",),
    "purchases": ("purchase",),
}
COUNTERS = tuple(COUNTED_EVENTS)
TS, LAST = "event_timestamp", "last_ts"
USER = "user_pseudo_id"
MICROS_PER_MINUTE = 60_000_000
BLOCK_MICROS = MICROS_PER_MINUTE


def _indicators() -> dict[str, Column]:
    """Per-event 0/1 columns behind the counters. Events without a time come
    after no exposure, and those without a user belong to none."""

    def listed(names: Sequence[str]) -> str:
        return ", ".join(f"'{n}'" for n in names)

    return {
        counter: F.expr(f"bigint(coalesce(event_name IN ({listed(names)}), false) AND _counts)")
        for counter, names in COUNTED_EVENTS.items()
    }


def _per_counter(template: str) -> list[Column]:
    return [F.expr(template.format(c)).alias(c) for c in COUNTERS]


def session_totals(
    flat: DataFrame,
    experiments: Experiments = LANDING_PAGE,
    scope: str = USER_FORWARD,
    by_channel: bool = False,
) -> DataFrame:
    """``[experiment_id,] variant, session_id, user_pseudo_id, [channel,] session_start, <counters>, last_ts``: the raw figures
    of :func:`session_metrics` per variant, session and user. ``channel`` is that of the session, null for sessions without an
    id and events without a user."""
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}")
    keys = experiment_keys(experiments)
    # Rows without a user are dealt out by what else they have; nothing is counted for them.
    nobody = F.when(F.col(USER).isNull(), F.xxhash64("session_id", TS))
    counts = F.col(USER).isNotNull() & F.col(TS).isNotNull()
    block = F.floor(F.col(TS) / BLOCK_MICROS)
    events = with_arms(flat, experiments).select(
        USER, "session_id", TS, "event_name", *keys, "variant",
        nobody.alias("_nobody"), counts.alias("_counts"), block.alias("_block"),
        *(["source", "medium"] if by_channel else []),
    )
    user = [USER, "_nobody", *(["session_id"] if scope == SESSION else [])]
    # Shuffled before the counters are made: the name travels, not six longs.
    local = events.repartition(*user, "_block").withColumns(_indicators())
    inside = (
        f"(PARTITION BY {', '.join(user)}, _block ORDER BY {TS} DESC "
        "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    timed = f"CASE WHEN _counts THEN {TS} END"
    running = local.select(
        "*",
        *[F.expr(f"sum({c}) OVER {inside}").alias(f"_run_{c}") for c in COUNTERS],
        F.expr(f"max({timed}) OVER {inside}").alias(f"_run_{LAST}"),
    )
    group = list(dict.fromkeys([*user, USER, "session_id", "_block", *keys, "variant"]))
    rows = running.groupBy(*group).agg(
        F.min(TS).alias("session_start"),
        *[F.max(f"_run_{c}").alias(f"_run_{c}") for c in [*COUNTERS, LAST]],
        *_per_counter("sum({})"),
        F.max(F.expr(timed)).alias(LAST),
        *([F.min(source_candidate()).alias("_best")] if by_channel else []),
    )
    later = f"(PARTITION BY {', '.join(user)} ORDER BY _block DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    def after(function: str, c: str) -> str:
        """Over later blocks; rows without a time have no block and nothing after them."""
        return f"CASE WHEN _block IS NOT NULL THEN {function}({c}) OVER {later} END"

    best = F.min("_best").over(W.partitionBy(USER, "_nobody", "session_id")) if by_channel else None
    suffix = rows.select(
        *group, "session_start",
        *_per_counter(f"_run_{{0}} + coalesce({after('sum', '{0}')}, 0)"),
        F.expr(f"greatest(_run_{LAST}, {after('max', LAST)})").alias(LAST),
        *([best.alias("_best")] if by_channel else []),
    ).where(F.col("variant").isNotNull())
    found = suffix.groupBy(*keys, USER, "session_id", "variant").agg(
        F.min("session_start").alias("session_start"),
        *_per_counter("max({})"),
        F.max(LAST).alias(LAST),
        *([F.min("_best").alias("_best")] if by_channel else []),
    )
    known = F.col(USER).isNotNull() & F.col("session_id").isNotNull()
    channel = [F.when(known, resolved_channel(F.col("_best"))).alias("channel")] if by_channel else []
    return found.select(*keys, "variant", "session_id", USER, *channel, "session_start", *COUNTERS, LAST)


def metrics_of(totals: DataFrame) -> DataFrame:
    """The metrics per row of :func:`session_totals`."""
    minutes = (F.col(LAST) - F.col("session_start")).cast("double") / F.lit(float(MICROS_PER_MINUTE))
    own = [c for c in totals.columns if c not in ("session_start", LAST, *COUNTERS)]
    return totals.select(
        *own,
        (F.col("page_views") == 1).cast("int").alias("is_bounce"),
        round_half_away(minutes, 2).alias("session_duration_min"),
        F.col("page_views").alias("pages_per_session"),
        (F.col("cart_adds") > 0).cast("int").alias("added_to_cart"),
        (F.col("purchases") > 0).cast("int").alias("purchased"),
        F.col("engagements").alias("engagement_events"),
        "scrolls",
        "clicks",
        "purchases",
    )


def session_metrics(
    flat: DataFrame,
    experiments: Experiments = LANDING_PAGE,
    scope: str = USER_FORWARD,
    by_channel: bool = False,
) -> DataFrame:
    """Metrics per variant, session and user, from the first exposure on.

    With ``scope='session'`` only events of the same session count (events
    without a session id form one session). Exposures without a user id or
    without any time match no events: they keep zero counts and no duration.
    ``by_channel`` adds the session's ``channel``.
    """
    return metrics_of(session_totals(flat, experiments, scope, by_channel))
