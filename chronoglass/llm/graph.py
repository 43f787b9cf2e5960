"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, spread_join


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for each node of edges (u, v): root is the smallest node reachable.

    Alternates large stars (each node's larger neighbours move to its smallest neighbour) and small stars (its smaller
    ones do) until edges no longer change; each round is written to the shared folder. A hub's neighbours are reduced by
    a map-side minimum and met by spread_join, so no hub's edges are gathered in one task. Nodes are compared as
    numbers. Self-loops are ignored; an empty table gives an empty result.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, "edges")
    before = _signature(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = spread_join(up, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u != v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, materialise(least, "least"), ["u"])
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialise(small.where("u != v").distinct(), "edges")
        now = _signature(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
