"""Pairs to try among texts that share keys, without pairing out a group.

Rows are (token, rid, component): a text of a component has a token. Texts of one component need no comparison. The others meet
first in pairs of neighbours, as many as there are rows, in an order drawn anew for each token and round; a group of near copies
grows together that way, one link joining whole components. Only then are the texts outside of a token's largest component
compared with all the others that have the token, by a join whose condition refutes nearly all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splitscope.llm.common import materialise

#: Rounds of neighbours before outsiders are compared; more or fewer change the cost, not the result.
ROUNDS = 2
#: Rows of a token that are ordered together; a common token's rows are dealt to as many blocks as it takes.
BLOCK = 500


def mixed(rows: DataFrame) -> DataFrame:
    """The rows whose token occurs in several components, with ``m``, how many rows have the token."""
    tokens = rows.groupBy("token").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")
    )
    return rows.join(tokens.filter("lo != hi").select("token", "m"), "token")


def neighbours(rows: DataFrame, seed: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of texts of different components that stand side by side under a common token."""
    draw = F.xxhash64(F.lit(seed), "token", "rid")
    block = F.pmod(F.shiftright(draw, 20), F.ceil(F.col("m") / BLOCK)).alias("block")
    side_by_side = W.partitionBy("token", "block").orderBy("draw", "rid")
    met = mixed(rows).select("token", "rid", "component", draw.alias("draw"), block)
    met = met.select("rid", "component", F.lag(F.struct("rid", "component")).over(side_by_side).alias("other"))
    apart = met.filter(F.col("other").isNotNull() & (F.col("component") != F.col("other.component")))
    return apart.select(F.least("rid", "other.rid").alias("a"), F.greatest("rid", "other.rid").alias("b")).distinct()


def outsiders(rows: DataFrame, payload: DataFrame, allowed: Column) -> DataFrame:
    """Distinct pairs (a, b), a < b, of texts of different components under a common token, if the condition allows them.

    ``payload`` has a row for each rid; the condition names its columns with ``_x`` and ``_y`` behind. One of the two texts is
    not of the largest component that has the token."""
    among = mixed(rows).select("token", "rid", "component")
    sizes = among.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n_own"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("n_own", "component")).alias("top"))
    placed = among.join(largest.select("token", F.col("top.component").alias("top")), "token").join(payload, "rid")
    carried = ["rid", "component", *[c for c in payload.columns if c != "rid"]]
    x, y = (placed.select("token", "top", *[F.col(c).alias(f"{c}_{s}") for c in carried]) for s in "xy")
    x, y = x.filter("component_x != top").drop("top"), y.withColumnRenamed("top", "top_y")
    once = F.expr("component_x != component_y AND (component_y = top_y OR component_x < component_y)")
    pairs = x.join(y, "token").filter(once & allowed)
    return pairs.select(F.least("rid_x", "rid_y").alias("a"), F.greatest("rid_x", "rid_y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """A row (rid, component) for each end of an edge; component is the smallest end that can be reached.

    Alternates two steps until they change nothing: each node ties its larger neighbours to the smallest one around
    it, then ties its smaller neighbours and itself to the smallest of them. Both are one grouped minimum and one join;
    paths shorten to stars in a number of rounds that grows with the logarithm of the edges."""
    stars = materialise(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    while True:
        around = stars.select("v", "u").union(stars.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = around.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = around.filter("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        tied = large.join(small, "v")
        step = tied.filter("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        now = materialise(step.union(small.select("v", F.col("m").alias("u"))).distinct())
        marks = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if marks(now) == marks(stars):
            heads = now.select("u").distinct().select(F.col("u").alias("rid"), F.col("u").alias("component"))
            return now.select(F.col("v").alias("rid"), F.col("u").alias("component")).union(heads)
        stars = now


def linked(
    rows: DataFrame,
    payload: DataFrame,
    allowed: Column,
    confirm: Callable[[DataFrame], DataFrame],
    parts: DataFrame | None = None,
    edges: DataFrame | None = None,
) -> DataFrame | None:
    """Components (rid, component) of the links among texts that share tokens; texts that no link reaches may be missing.

    ``rows`` has (token, rid); ``allowed`` is the condition of :func:`outsiders` over ``payload``; ``confirm`` gives the linked
    ones of pairs (a, b). ``parts`` and ``edges``: components and links that are known already."""
    side = lambda c, s: payload.select(F.col("rid").alias(c), *[F.col(n).alias(f"{n}_{s}") for n in payload.columns if n != "rid"])
    for step in range(ROUNDS + 1):
        if parts is None:
            placed = rows.select("token", "rid", F.col("rid").alias("component"))
        else:
            placed = rows.join(parts, "rid", "left").select("token", "rid", F.coalesce("component", "rid").alias("component"))
        if step < ROUNDS:
            pairs = neighbours(placed, step).join(side("a", "x"), "a").join(side("b", "y"), "b").filter(allowed).select("a", "b")
        else:
            pairs = outsiders(placed, payload, allowed)
        found = materialise(confirm(materialise(pairs)))
        if found.isEmpty():
            continue
        edges = found if edges is None else edges.union(found)
        parts = materialise(components(edges))
    return parts
