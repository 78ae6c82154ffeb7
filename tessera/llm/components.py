"""Connected components by alternating large-star and small-star steps, each round settled in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.durable import settled


def _least(pairs: DataFrame) -> DataFrame:
    """For (u, v) rows, the smallest of u and its v, as (u, m); settled, so that a join with it can split a node with very many links."""
    return settled(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))


def _large(edges: DataFrame) -> DataFrame:
    both = settled(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = settled(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    least = _least(down)
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v): the smallest node that links lead to. Loops and repeated edges are fine; nulls are dropped."""
    edges, before = settled(edges.where("u <> v").select("u", "v").distinct()), None
    while True:
        edges = settled(_small(settled(_large(edges))))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if now == before:
            break
        before = now
    tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return settled(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops))
