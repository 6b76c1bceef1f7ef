"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.shelf import Shelf


def components(links: DataFrame, shelf: Shelf, label: str = "links") -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; a component is its least node.

    A large-star step links the larger neighbours of each node to its least neighbour, a
    small-star step does so with the smaller ones. Only minima are gathered per node, so a
    hub with any number of links is no problem, and every step is stored.
    """
    pairs = links.where("a != b").select(
        F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")
    )
    edges, step = shelf.put(f"{label}-0", pairs.distinct()), 0
    while True:
        least = shelf.put(f"{label}-least", _least(edges))
        if _settled(least):
            break
        large = shelf.put(f"{label}-large", _large_star(edges, least).distinct())
        shelf.drop(f"{label}-{step}", f"{label}-least")
        least = shelf.put(f"{label}-least", _least(large))
        edges, step = shelf.put(f"{label}-{step + 1}", _small_star(large, least).distinct()), step + 1
        shelf.drop(f"{label}-large", f"{label}-least")
    roots = least.select("m").distinct().select(F.col("m").alias("node"), F.col("m").alias("component"))
    return roots.unionByName(least.select(F.col("big").alias("node"), F.col("m").alias("component")))


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("big").agg(F.min("small").alias("m"), F.count(F.lit(1)).alias("n"))


def _settled(least: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one only, and that one has none."""
    if not least.where("n > 1").isEmpty():
        return False
    return least.join(least.select(F.col("big").alias("m")), "m", "left_semi").isEmpty()


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    near = least.select(F.col("big").alias("small"), "m")
    return edges.join(near, "small", "left").select("big", F.coalesce("m", "small").alias("small"))


def _small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    moved = edges.join(least, "big").where("small != m").select(F.col("small").alias("big"), "m")
    return moved.unionByName(least.select("big", "m")).withColumnRenamed("m", "small")
