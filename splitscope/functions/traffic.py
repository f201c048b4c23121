"""Default channel grouping of a session's source and medium."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIRECT_SOURCE = "(direct)"
NO_MEDIUM = "(none)"

# Exact, case-sensitive media of each channel. Social media are
# matched by substring, regardless of case, after the two search channels.
SEARCH_CHANNELS = {
    "Paid Search": ("cpc", "ppc", "paidsearch"),
    "Organic Search": ("organic",),
}
SOCIAL_CHANNEL, SOCIAL_FRAGMENT = "Social", "social"
OTHER_CHANNELS = {
    "Email": ("email",),
    "Display": ("display", "banner"),
    "Referral": ("referral",),
    "Affiliate": ("affiliate",),
    "Direct": (NO_MEDIUM, ""),
}


def channel_group(source: Column, medium: Column) -> Column:
    """Channel of a resolved source and medium (NULLs already replaced)."""
    rules = [(name, medium.isin(*media)) for name, media in SEARCH_CHANNELS.items()]
    rules.append((SOCIAL_CHANNEL, F.lower(medium).contains(SOCIAL_FRAGMENT)))
    rules += [(name, medium.isin(*media)) for name, media in OTHER_CHANNELS.items()]
    return F.coalesce(
        *[F.when(test, F.lit(name)) for name, test in rules],
        F.concat_ws(" / ", source, medium),
    )
