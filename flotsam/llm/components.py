"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PARTITION_ROWS, Scratch, spread_join


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """Every neighbour of a vertex (larger ones for a large star, smaller ones for a small star) is tied to its least.

    The least is found by a group with partial sums and joined back; the neighbours of a hub are dealt over tasks there.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    tied = spread_join(near, least, ["a"], ["b"], 2 * n if large else n)
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").coalesce(1 + 2 * n // PARTITION_ROWS)  # few edges leave few partitions


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the edges (a, b): component is the least id that can be reached.

    Loops and repeated edges have no effect; null ends are ignored; no edges give an empty table.
    """
    scratch, before = Scratch(edges.sparkSession), None
    state = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, now = scratch.measured("edges", ends, **state)
    while now != before and now["n"]:
        before = now
        edges, now = scratch.measured("edges", _star(_star(edges, True, now["n"]), False, now["n"]).distinct(), **state)
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return scratch.last(edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots).distinct(), 2 * now["n"])


def extended(found: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components ``found`` (id, component) joined further by links (a, b): only their roots are worked on."""
    root = lambda end: found.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}"))
    ends = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    links, n = scratch.counted("links", ends.where("a <> b"))
    if not n:
        return found
    upper = components(links)
    alone = upper.join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    moved = upper.select(F.col("id").alias("component"), F.col("component").alias("to"))
    moved = found.unionByName(alone).join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return scratch.table("found", moved)
