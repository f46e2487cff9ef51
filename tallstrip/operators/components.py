"""Connected components of an edge table: alternating large-star and small-star rounds, each a pair of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import discard, settle


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    lower = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return small.union(lower.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v), component being the smallest node it is connected to.

    Each round writes its edges to a table in the shared folder and compares them with the round before; the rounds
    end when every edge points at a component's smallest node. Nodes may be of any type with an order, structs too. Loops and repeated edges are allowed; an edge with a
    null end is ignored; no edges give no rows.
    """
    edges = settle(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == (state["n"], state["h"]) or not state["n"]:
            break
        seen = (state["n"], state["h"])
        after = settle(_stars(edges), "edges")
        discard(edges)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
