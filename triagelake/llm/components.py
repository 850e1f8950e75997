"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.session import cut_lineage


def _towards_smallest(rows: DataFrame) -> DataFrame:
    """(v, least neighbour or v itself); combines before the shuffle, so a hub costs no more."""
    return rows.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003)).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node with a link, the smallest node it can reach.

    Each round hangs the larger neighbours of a node on its smallest one, then the smaller
    ones; rounds follow the logarithm of the longest chain. Links with a NULL end or from a
    node to itself are ignored. An empty table gives an empty one.
    """
    links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    links = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    links = cut_lineage(links, "links")
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _towards_smallest(both)
        large = both.join(least, "a").where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")
        ).distinct()
        least = _towards_smallest(large)
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct("a", F.col("m").alias("b")))).alias("x")
        ).select("x.*").where("a <> b").distinct()
        links = cut_lineage(small, "links")
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
