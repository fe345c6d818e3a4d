"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, component (the smallest id reachable) for every end of an edge (columns a, b; loops and nulls go).

    A round sends each vertex's larger neighbours, then its smaller ones, to its
    smallest neighbour; at the end all edges are stars. Minima are pre-aggregated,
    and the joins put rows of edges against one row a vertex, so a vertex with very
    many edges is split like any skewed join. Each round is written to the shared folder."""
    star = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    held = cut(edges.where("a <> b").select(*star).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_cut(held)
        held = new
        now = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum("v")).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components have not settled")
    tops = held.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return held.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops)
