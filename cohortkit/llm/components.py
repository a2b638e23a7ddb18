"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every node's larger neighbours to the smallest node of its neighbourhood, itself included."""
    near = edges.select(F.col("low").alias("node"), F.col("low").alias("m")).union(edges.select("high", "low"))
    least = near.groupBy("node").agg(F.min("m").alias("m"))
    return edges.join(least.withColumnRenamed("node", "low"), "low").select("high", F.col("m").alias("low"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("m"))
    moved = (edges.join(least, "high").where("low <> m")
             .select(F.col("low").alias("high"), F.col("m").alias("low")))
    return least.select("high", F.col("m").alias("low")).union(moved).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has links both to a larger and to a smaller node, or to two smaller ones."""
    ends = edges.select(F.col("high").alias("node"), "low").union(edges.select("low", F.lit(None).cast(edges.schema["low"].dataType)))
    seen = ends.groupBy("node").agg(F.min("low").alias("least"), F.max("low").alias("most"), F.count("low").alias("n"), F.count("*").alias("all"))
    return seen.where("n > 0 and (n < all or least < most)").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """Return (node, label) for every node of a link; label is its component's smallest node.

    Large-star and small-star steps alternate until all links lead to their
    component's smallest node.  A path of n nodes, in whatever order, takes
    about log2(n) rounds.  Neighbourhoods are never collected, only their
    smallest node.  Every step is written to the shared
    folder and read back, so plans and size estimates do not grow.  No links:
    no rows.  Links with a null end are ignored; a node linked only with
    itself is its own component.  ``rows``: the number of links, where known.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    alone = ends.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("label"))
    edges = staged(ends.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "edges", rows)
    rows = edges.count()  # no step makes more links
    while not _are_stars(edges):
        edges = staged(_small_star(staged(_large_star(edges), "large-star", rows)), "small-star", rows)
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("label"))
    return staged(edges.select(F.col("high").alias("node"), F.col("low").alias("label")).union(roots).union(alone)
                  .groupBy("node").agg(F.min("label").alias("label")), "labels", 2 * rows)
