"""Connected components by alternating stars, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidefold.session import store


def _lowest(edges: DataFrame) -> DataFrame:
    """Each node of ``edges(u, v)`` with the smallest of itself and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = both.join(_lowest(both), "u").filter("v > u")
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from larger to smaller nodes."""
    low = _lowest(edges)
    met = edges.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` written, and their number and checksum."""
    seen = Observation()
    checksum = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("checksum")
    written = store(edges.observe(seen, F.count("*").alias("rows"), checksum))
    return written, (seen.get["rows"], seen.get["checksum"])


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node in ``pairs``; the root is the smallest node of its component.

    Every round is two grouped joins over the edges and is written once, with its
    count and checksum taken in the same job; it ends when a round changes nothing. A node with very many neighbours is a
    skewed side of a plain equi-join, which adaptive execution splits. NULLs are
    no nodes; a pair of equal nodes is a component of one.
    """
    known = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges, state = _stored(known.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while state != before:
        before = state
        edges, state = _stored(_small_star(_large_star(edges)))
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    selves = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    alone = known.filter(F.col(a) == F.col(b)).select(F.col(a).alias("node")).distinct().join(edges.select(F.explode(F.array("u", "v")).alias("node")), "node", "left_anti")
    return roots.unionByName(selves).unionByName(alone.select("node", F.col("node").alias("root")))
