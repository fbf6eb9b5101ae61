"""Connected components of an edge table, by stars around least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.session import PARTITION_ROWS, Scratch

#: A hub has more neighbours than the first, and than one in the second of all: so there are never more hubs than that.
LEAST_HUB, HUBS = 1000, 1000


def _around_least(near: DataFrame, n: int) -> DataFrame:
    """(a, b, m): m is the least of a and its neighbours b, for n rows.  The few hubs are broadcast, so their neighbours stay apart."""
    least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "a"))
    most = max(LEAST_HUB, n // HUBS)
    if n <= most:
        return near.join(least.drop("n"), "a")
    hubs = F.broadcast(least.where(F.col("n") > most).drop("n"))
    others = near.join(hubs.select("a"), "a", "left_anti").join(least.where(F.col("n") <= most).drop("n"), "a")
    return near.join(hubs, "a").unionByName(others)


#: Edges up to which a vertex's neighbours may meet in one task.
FEW = 200_000


def _stars_of_few(edges: DataFrame) -> DataFrame:
    """A large and a small star of at most FEW edges (a, b), a over b: each in one shuffle, as no task can get more than these."""
    least, ends = F.min("b").over(Window.partitionBy("a")), lambda *pairs: F.explode(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs))).alias("e")
    both = edges.select(ends(("a", "b"), ("b", "a"))).select("e.*")
    large = both.select("a", "b", F.least(least, "a").alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    small = large.select("a", "b", least.alias("m")).select(ends(("b", "m"), ("a", "m"))).select("e.*")
    return small.where("a <> b").distinct()


def _stars(edges: DataFrame, n: int) -> DataFrame:
    """A large and a small star of n edges (a, b), a over b."""
    few = 1 + 2 * n // PARTITION_ROWS  # few edges leave few partitions
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = _around_least(both, 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").coalesce(few).distinct()
    tied = _around_least(large, n)
    small = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(tied.select("a", F.col("m").alias("b")))
    return small.where("a <> b").coalesce(few).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of edges (a, b): the least id reached.  Loops and repeats have no effect."""
    scratch, seen = Scratch(edges.sparkSession), None
    state = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, now = scratch.measured("edges", ends, **state)
    while now != seen and now["n"]:
        seen, n = now, now["n"]
        # few edges take two rounds at once
        edges, now = scratch.measured("edges", _stars_of_few(_stars_of_few(edges)) if n <= FEW else _stars(edges, n), **state)
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return scratch.last(edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots).distinct(), 2 * now["n"])
