"""Connected components of an edge table by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every step is a partial
aggregate and a join; nothing is collected but a count and a checksum of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import discard, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = both.where("v > u").join(least, F.col("u") == F.col("w"))
    return joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    joined = edges.join(least, F.col("u") == F.col("w"))
    kept = least.select(F.col("w").alias("u"), F.col("m").alias("v"))
    moved = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(moved).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v: long); component is the smallest node that can be reached.

    Self loops, repeated edges and either direction are allowed; a null end is ignored. An empty
    table gives an empty one. A node without an edge does not appear.
    """
    nodes = edges.where("u is not null and v is not null")
    loops = nodes.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    now = stage(nodes.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    was, state = None, _state(now)
    while state != was:
        after = stage(_small_star(_large_star(now)), "edges")
        discard(now)
        now, was, state = after, state, _state(after)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.distinct().join(stars.select("node"), "node", "left_anti").join(centres.select("node"), "node", "left_anti")
    return stars.unionByName(centres).unionByName(alone)
