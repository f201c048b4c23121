"""A registry of experiments as data: its arms are rows, and page views find theirs through an index of URL fragments.

A view is never compared with every arm. Each fragment is known by the rarest of its grams, strings of a few characters; a
view's own grams, as many as its URL is long, are looked up in the set of those, which leaves the few rows that go through a hash
join with the index, where the whole fragment is verified. So the work for a view grows with its URL and with the arms that it
does expose its user to, not with the registry. Both joined sides are configuration, a row for each arm, and are broadcast.

Experiments over the same fragments in the same order are one design. What is measured per design is named per experiment in
the end, so a thousand experiments over two pages cost what one does.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitscope.config import Experiment, Experiments, as_registry

#: Lengths of grams; a fragment goes by the longest that it holds.
GRAMS = (8, 4, 2, 1)
#: Registries of so few distinct fragments are compared directly, which is cheaper than taking a URL's grams.
DIRECT = 16

ARMS = (
    "array<struct<experiment_id:string,variant:string,place:int,share:double,fragment:string,"
    "earlier:string,design:string>>"
)


def literal_rows(spark: SparkSession, rows: Sequence[dict], schema: str) -> DataFrame:
    """Configuration as a small relation: one constant array, exploded."""
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def design_of(experiment: Experiment) -> str:
    return json.dumps([a.url_contains for a in experiment.arms])


def _any_of(fragments: Sequence[str]) -> str | None:
    """A pattern that finds any of the fragments."""
    quoted = ["".join(c if c.isalnum() else "\\" + c for c in f) for f in fragments]
    return "|".join(quoted) if quoted else None


def arms_relation(spark: SparkSession, experiments: Experiments) -> DataFrame:
    """One row per arm: ``experiment_id, variant, place, share, fragment, earlier, design``. The control has place 0;
    ``earlier`` is a pattern of the fragments of the arms that a URL belongs to first, null if there are none."""
    numbers: dict[str, str] = {}
    rows = []
    for e in as_registry(experiments):
        design = numbers.setdefault(design_of(e), str(len(numbers)))
        fragments = [a.url_contains for a in e.arms]
        earlier = [_any_of(fragments[:place]) for place in range(len(fragments))]
        rows += [
            {
                "experiment_id": e.experiment_id, "variant": a.variant, "place": place, "share": float(e.share_of(a)),
                "fragment": a.url_contains, "earlier": earlier[place], "design": design,
            }
            for place, a in enumerate(e.arms)
        ]
    return literal_rows(spark, rows, ARMS)


def designs(experiments: Sequence[Experiment]) -> tuple[Experiment, ...]:
    """An experiment for each distinct design, its arms labelled by place; ids as in :func:`arms_relation`."""
    first: dict[str, Experiment] = {}
    for e in as_registry(experiments):
        first.setdefault(design_of(e), e)
    return tuple(
        Experiment(str(n), tuple(replace(a, variant=str(place)) for place, a in enumerate(e.arms)))
        for n, e in enumerate(first.values())
    )


def named(frame: DataFrame, experiments: Sequence[Experiment]) -> DataFrame:
    """Rows per design, and per place if there is a ``variant``, told per experiment instead; the other columns stay."""
    labels = arms_relation(frame.sparkSession, experiments).select(
        F.col("design").alias("_design"), F.col("place").cast("string").alias("_place"), "experiment_id", "variant"
    )
    own, keys = frame.withColumnRenamed("experiment_id", "_design"), ["_design"]
    if "variant" in frame.columns:
        own, keys = own.withColumnRenamed("variant", "_place"), ["_design", "_place"]
    else:
        labels = labels.where("_place = '0'").drop("_place", "variant")
    return own.join(F.broadcast(labels), keys).select(*frame.columns)


def with_places(frame: DataFrame, experiments: Sequence[Experiment]) -> DataFrame:
    """Rows of ``experiment_id, variant`` with the arm's ``place``; rows of arms that are not in the registry go."""
    places = arms_relation(frame.sparkSession, experiments).select("experiment_id", "variant", "place")
    return frame.join(F.broadcast(places), ["experiment_id", "variant"])


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rarest_grams(fragments: Sequence[str]) -> dict[str, str]:
    """Each fragment's gram that the fewest other fragments hold; the last one of equals, as URLs begin alike."""

    def grams(fragment: str) -> list[str]:
        size = next((g for g in GRAMS if g <= len(fragment)), 0)
        return [fragment[i : i + size] for i in range(len(fragment) - size + 1)] if size else [""]

    counts = Counter(g for f in fragments for g in set(grams(f)))
    return {f: min(reversed(grams(f)), key=lambda g: counts[g]) for f in fragments}


def _grams_in(url: str, wanted: Sequence[str]) -> Column:
    """The grams of the URL column that are in the index, each once."""
    found = []
    for size in sorted({len(g) for g in wanted}):
        # One SQL text: thousands of literals would be as many calls. The list becomes a hash set.
        listed = ", ".join(_text(g) for g in wanted if len(g) == size)
        places = f"if(length({url}) < {size}, array(), sequence(1, length({url}) - {size} + 1))"
        grams = f"transform({places}, i -> substring({url}, i, {size}))"
        found.append(f"filter({grams}, g -> g IN ({listed}))" if size else "array('')")
    return F.expr(f"array_distinct(concat({', '.join(found)}))")


def exposed_rows(frame: DataFrame, experiments: Sequence[Experiment], when: Column, keep: bool = False) -> DataFrame:
    """``frame`` with ``experiment_id, variant, place``: a row for each arm that a row's ``page_location`` exposes its user to,
    of each experiment the first one that fits. Only rows with the condition ``when`` expose anybody.

    With ``keep`` every row is there once more, as itself, with nulls in these columns."""
    spark = frame.sparkSession
    arms = arms_relation(spark, experiments).select("experiment_id", "variant", "place", "fragment", "earlier")
    fragments = sorted({a.url_contains for e in as_registry(experiments) for a in e.arms})
    url = F.when(when, F.col("page_location"))
    itself = F.array(F.lit(None).cast("string"))
    nothing = F.array().cast("array<string>")
    if len(fragments) <= DIRECT:
        found = F.array_compact(F.array(*[F.when(url.contains(f), F.lit(f)) for f in fragments]))
        found = F.when(url.isNotNull(), found).otherwise(nothing)
        rows = frame.select("*", F.explode(F.concat(itself, found) if keep else found).alias("_fragment"))
    else:
        index = rarest_grams(fragments)
        keyed = literal_rows(
            spark, [{"_key": g, "_fragment": f} for f, g in index.items()], "array<struct<_key:string,_fragment:string>>"
        )
        found = F.when(url.isNotNull(), _grams_in("page_location", sorted(set(index.values())))).otherwise(nothing)
        rows = frame.select("*", F.explode(F.concat(itself, found) if keep else found).alias("_gram"))
        verified = (F.col("_gram") == F.col("_key")) & F.col("page_location").contains(F.col("_fragment"))
        rows = rows.join(F.broadcast(keyed), verified, "left" if keep else "inner")
        if keep:
            rows = rows.where(F.col("_gram").isNull() | F.col("_fragment").isNotNull())
        rows = rows.select(*frame.columns, "_fragment")
    first = F.col("earlier").isNull() | ~F.rlike("page_location", F.col("earlier"))
    joined = rows.join(F.broadcast(arms), (F.col("_fragment") == F.col("fragment")) & first, "left" if keep else "inner")
    if keep:
        joined = joined.where(F.col("_fragment").isNull() | F.col("experiment_id").isNotNull())
    return joined.select(*frame.columns, "experiment_id", "variant", "place")
