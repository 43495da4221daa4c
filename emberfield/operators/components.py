"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import written


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of a table of links."""
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of a link table (u, v) but the smallest of each component, which names it.

    Alternating star contractions: each round turns every node's larger neighbours, then its smaller
    ones, to the smallest node next to it, so distances between roots shrink by a factor and not by a
    step; a table of stars stays as it is, which ends the loop.  Minima are combined before the
    shuffle and joins may be split, so a node with very many links does not burden one task.
    Each round is written to the shared folder.  Self links and repeated links are allowed.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = written(edges, "links")
    state = _state(edges)
    if state[0] == 0:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        # Larger neighbours of each node go to the smallest of its neighbourhood.
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # Then each node and its smaller neighbours go to the smallest of these.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small.hint("merge"), "u")
        after = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        edges = written(after.filter("u <> v").distinct(), "links")
        previous, state = state, _state(edges)
        if state == previous:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
