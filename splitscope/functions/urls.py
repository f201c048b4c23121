"""URL predicates and variant labels."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from splitscope.config import Experiment


def contains_any(location: Column, fragments: Iterable[str]) -> Column:
    return reduce(or_, [location.contains(f) for f in fragments])


def variant_label(location: Column, experiment: Experiment) -> Column:
    """Label of the first arm whose fragment occurs in the URL, else NULL."""
    return F.coalesce(
        *[F.when(location.contains(a.url_contains), F.lit(a.variant)) for a in experiment.arms]
    )
