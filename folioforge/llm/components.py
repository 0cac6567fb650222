"""Connected components of a distributed edge list by alternating large-star and small-star steps (public algorithm of
Kiveris et al., "Connected Components in MapReduce and Beyond"). Neighbour lists are never gathered: each step takes the
smallest neighbour by aggregation and joins it back, so a hot component is spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import Scratch, stage


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (or itself)."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them. Edges hold u > v."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) -> (node, component), the component being its smallest node. Nodes without edges have no row."""
    with Scratch() as tmp:
        e = tmp(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        mark = None
        for _ in range(rounds):
            # A star: no node is both a child and a parent, and every child has one parent.
            now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == mark or now[0] == 0:
                break
            mark, old = now, e
            e = tmp(_small_star(_large_star(old)))
            tmp.drop(old)
        else:
            raise RuntimeError("components did not settle")
        return stage(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
