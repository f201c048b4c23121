"""Attributing purchases to exposed users.

"Purchased at or after the first exposure" is ``last purchase >= first
exposure``. Both sides are plain maxima and minima per user, so one pass over
the events and one shuffle of partial aggregates do the work of the join of
exposures with all later events; a user with very many events costs no more
than any other after the map side.

An exposure without a time comes after nothing: its user stays, unconverted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splitscope.config import (
    BOTH,
    CROSSOVERS,
    EXCLUDE,
    FIRST,
    LANDING_PAGE,
    SCOPES,
    SESSION,
    USER_FORWARD,
    Experiment,
    Experiments,
    experiment_keys,
)
from splitscope.functions.urls import variant_label
from splitscope.operators.attribution import resolved_channel, source_candidate
from splitscope.operators.events import pin_column, pinned
from splitscope.operators.registry import exposed_rows

USER = "user_pseudo_id"
NEVER = 2**63 - 1


def _kept(firsts: list[Column], seen: list[Column], arm: int, crossover: str) -> Column:
    """Whether a user counts in this arm, given for all arms of the experiment
    whether they were seen and when first."""
    if crossover == BOTH:
        return seen[arm]
    others = [(j, f, s) for j, (f, s) in enumerate(zip(firsts, seen, strict=True)) if j != arm]
    if crossover == EXCLUDE:
        return reduce(and_, [~s for _, _, s in others], seen[arm])
    # First arm seen; at the same instant, the arm listed first; without a time, last.
    mine = F.coalesce(firsts[arm], F.lit(NEVER))
    earlier = [
        ~s | ((F.coalesce(f, F.lit(NEVER)) > mine) if j < arm else (F.coalesce(f, F.lit(NEVER)) >= mine))
        for j, f, s in others
    ]
    return reduce(and_, earlier, seen[arm])


def attributed_units(
    flat: DataFrame,
    experiments: Experiments = LANDING_PAGE,
    scope: str = USER_FORWARD,
    crossover: str = BOTH,
    carry: Sequence[str] = (),
    by_channel: bool = False,
) -> DataFrame:
    """One row per exposed user and variant:
    ``[experiment_id,] user_pseudo_id, variant, session_start, <carry>, [channel,] converted``.

    ``scope``: ``user_forward`` counts any later purchase, ``session`` only one
    in the session of the exposure (events without a session id form one
    session). ``crossover``: users seen in several arms count in ``both``, are
    left out (``exclude``), or count in the arm seen ``first``. ``carry`` names
    event columns to bring along from the first exposure. ``by_channel`` adds the
    channel of the session of the first exposure, null where that has no id: one
    state per user and session holds the session's source, exposures and last
    purchase, so the events are read once. Rows without a user id cannot be
    matched to a purchase; they form one unconverted unit.
    """
    if scope not in SCOPES or crossover not in CROSSOVERS:
        raise ValueError(f"unknown scope {scope!r} or crossover {crossover!r}")
    carry = [*carry, *(["session_id"] if by_channel and "session_id" not in carry else [])]
    units = _wide_units if isinstance(experiments, Experiment) else _long_units
    return units(flat, experiments, scope, crossover, carry, by_channel)


def _moment(carry: Sequence[str]) -> Column:
    """The time of an exposure with the carried columns behind it, so that the
    minimum is the first one; those without a time come last."""
    ts = F.col("event_timestamp")
    return F.struct(ts.isNull().alias("untimed"), ts, *carry)


def _channel() -> Column:
    """The session's channel, from its smallest candidate; sessions without an id or a user have none."""
    known = F.col(USER).isNotNull() & F.col("session_id").isNotNull()
    return F.when(known, resolved_channel(F.col("best")))


def _wide_units(
    flat: DataFrame, experiment: Experiment, scope: str, crossover: str, carry: Sequence[str], by_channel: bool
) -> DataFrame:
    """One experiment: its few arms side by side, in one shuffle, or two where sessions matter."""
    arms = [a.variant for a in experiment.arms]
    name, ts = F.col("event_name"), F.col("event_timestamp")
    is_view, is_purchase = name == "page_view", name == "purchase"
    tagged = pinned(
        flat if by_channel else flat.where(is_view | is_purchase),
        F.coalesce(is_purchase, F.lit(False)).alias("is_purchase"),
        F.when(is_view, variant_label(F.col("page_location"), experiment)).alias("arm"),
    )
    if not by_channel:
        tagged = tagged.where(F.col("is_purchase") | F.col("arm").isNotNull())
    moment = _moment(carry) if carry else ts

    def time_of(c: Column) -> Column:
        return c["event_timestamp"] if carry else c

    numbers = range(len(arms))
    sessions = by_channel or scope == SESSION
    in_arm = [F.col("arm") == a for a in arms]
    per_key = tagged.groupBy(USER, *(["session_id"] if sessions else [])).agg(
        F.max(F.when(F.col("is_purchase"), ts)).alias("last_purchase"),
        *[F.min(F.when(in_arm[n], moment)).alias(f"first{n}") for n in numbers],
        *[F.coalesce(F.max(in_arm[n]), F.lit(False)).alias(f"seen{n}") for n in numbers],
        *([F.min(source_candidate()).alias("best")] if by_channel else []),
    )
    extra = [*carry, *(["channel"] if by_channel else [])]
    if by_channel:
        per_key = per_key.withColumns({
            f"first{n}": F.when(F.col(f"first{n}").isNotNull(), F.struct(f"first{n}.*", _channel().alias("channel")))
            for n in numbers
        })

    def bought(n: int) -> Column:
        later = F.col(USER).isNotNull() & (F.col("last_purchase") >= time_of(F.col(f"first{n}")))
        return F.coalesce(later, F.lit(False)).cast("int")

    in_session = scope == SESSION
    if in_session:
        per_key = per_key.withColumns({f"bought{n}": bought(n) for n in numbers})
    if sessions:
        purchases = [] if in_session else [F.max("last_purchase").alias("last_purchase")]
        flags = [*(["bought"] if in_session else []), "seen"]
        per_key = per_key.groupBy(USER).agg(
            *purchases,
            *[F.min(f"first{n}").alias(f"first{n}") for n in numbers],
            *[F.max(f"{c}{n}").alias(f"{c}{n}") for n in numbers for c in flags],
        )
    if not in_session:
        per_key = per_key.withColumns({f"bought{n}": bought(n) for n in numbers})
    firsts = [time_of(F.col(f"first{n}")) for n in numbers]
    seen = [F.col(f"seen{n}") for n in numbers]
    units = [
        F.when(
            _kept(firsts, seen, n, crossover),
            F.struct(
                F.lit(arms[n]).alias("variant"),
                firsts[n].alias("session_start"),
                *[F.col(f"first{n}")[c].alias(c) for c in extra],
                F.col(f"bought{n}").alias("converted"),
            ),
        )
        for n in numbers
    ]
    rows = per_key.select(USER, F.inline_outer(F.array(*units)))
    return rows.where(F.col("variant").isNotNull()).select(USER, "variant", "session_start", *extra, "converted")


def arm_states(
    flat: DataFrame, experiments: Sequence[Experiment], keys: Sequence[str], carry: Sequence[str] = (), by_channel: bool = False
) -> DataFrame:
    """Per user, further ``keys``, experiment and variant the first exposure, ``first``; per user and keys alone, with nulls for
    the experiment, the last purchase, ``last``. Both merge, by minimum and maximum. With ``by_channel`` every row has the
    smallest candidate for the session's source, ``best``."""
    name, ts = F.col("event_name"), F.col("event_timestamp")
    is_view, is_purchase = name == "page_view", name == "purchase"
    events = pin_column(flat if by_channel else flat.where(is_view | is_purchase), "page_location")
    rows = exposed_rows(events, experiments, is_view, keep=True)
    itself = F.col("variant").isNull()
    if not by_channel:
        rows = rows.where(~itself | is_purchase)
    return rows.groupBy(USER, *keys, "experiment_id", "variant", "place").agg(
        F.min(F.when(~itself, _moment(carry))).alias("first"),
        F.max(F.when(itself & is_purchase, ts)).alias("last"),
        *([F.min(source_candidate()).alias("best")] if by_channel else []),
    )


def _long_units(
    flat: DataFrame, experiments: Sequence[Experiment], scope: str, crossover: str, carry: Sequence[str], by_channel: bool
) -> DataFrame:
    """A registry: a row per user, experiment and variant from the first
    aggregation on, so that the plan is the same for any number of experiments.
    A user's purchases, and what is known of the sessions, are rows of their own beside them."""
    keys = ["session_id"] if by_channel or scope == SESSION else []
    states = arm_states(flat, experiments, keys, carry, by_channel)
    return settled_units(states, scope, crossover, carry, by_channel)


def settled_units(
    states: DataFrame, scope: str, crossover: str, carry: Sequence[str] = (), by_channel: bool = False
) -> DataFrame:
    """Attributed units over a registry from :func:`arm_states`, which are per session where sessions matter."""
    sessions = by_channel or scope == SESSION
    of_session, of_user = W.partitionBy(USER, "session_id"), W.partitionBy(USER)
    timed = states.withColumn("last_purchase", F.max("last").over(of_session if scope == SESSION else of_user))
    if by_channel:
        timed = timed.withColumn("best", F.min("best").over(of_session))
        timed = timed.withColumn("first", F.struct("first.*", _channel().alias("channel")))
    timed = timed.where(F.col("variant").isNotNull())
    extra = [*carry, *(["channel"] if by_channel else [])]
    bought = F.col(USER).isNotNull() & (F.col("last_purchase") >= F.col("first.event_timestamp"))
    bought = F.coalesce(bought, F.lit(False)).cast("int")
    arm = [USER, "experiment_id", "variant", "place"]
    if scope == SESSION:
        timed = timed.withColumn("converted", bought)
    if sessions:
        last = F.max("converted").alias("converted") if scope == SESSION else F.max("last_purchase").alias("last_purchase")
        timed = timed.groupBy(*arm).agg(F.min("first").alias("first"), last)
    units = timed if scope == SESSION else timed.withColumn("converted", bought)
    arms = W.partitionBy(USER, "experiment_id")
    if crossover == EXCLUDE:
        units = units.withColumn("arms", F.count("*").over(arms)).where("arms = 1")
    elif crossover == FIRST:
        order = arms.orderBy("first.untimed", "first.event_timestamp", "place")
        units = units.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return units.select(
        "experiment_id", USER, "variant", F.col("first.event_timestamp").alias("session_start"),
        *[F.col(f"first.{c}").alias(c) for c in extra], "converted",
    )


def conversions(
    flat: DataFrame,
    experiments: Experiments = LANDING_PAGE,
    scope: str = USER_FORWARD,
    crossover: str = BOTH,
) -> DataFrame:
    """0/1 purchase at or after the first exposure, per user and variant."""
    return without_times(attributed_units(flat, experiments, scope, crossover), experiments)


def without_times(units: DataFrame, experiments: Experiments) -> DataFrame:
    return units.select(*experiment_keys(experiments), USER, "variant", "converted")
