"""Outlines of clusters: the sides of their spans, joined end to end to closed rings.

Rows run down, columns to the right.  Sides are directed so that the cluster lies to their right hand: a ring around a cluster
runs clockwise as seen, and a ring around a hole the other way.  Where two pixels of a cluster touch at a corner alone, a ring
turns right, so rings don't cross.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.session import Scratch

CLUSTER = ["scene_id", "first_y", "first_x"]
#: Directions in the order of right turns: right, down, left, up.
EAST, SOUTH, WEST, NORTH = range(4)


def boundary_sides(spans: DataFrame) -> DataFrame:
    """(cluster, x1, y1, x2, y2, way): the sides of clusters' spans (cluster, y, x_from, x_to) that have no pixel of it beyond.

    Sides between two rows of pixels follow from the ends of the spans above and below, whatever their length.
    """
    side = lambda x1, y1, x2, y2, way: F.struct(*(v.alias(k) for k, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))), F.lit(way).alias("way"))
    y, left, right = F.col("y"), F.col("x_from"), F.col("x_to") + 1
    upright = spans.select(*CLUSTER, F.explode(F.array(side(right, y, right, y + 1, SOUTH), side(left, y + 1, left, y, NORTH))).alias("s")).select(*CLUSTER, "s.*")
    # a span begins and ends at the line above it, where it lies below, and at the line below it, where it lies above
    mark = lambda line, x, below, above: F.struct(line.alias("line"), x.alias("x"), F.lit(below).alias("below"), F.lit(above).alias("above"))
    marks = F.explode(F.array(mark(y, left, 1, 0), mark(y, right, -1, 0), mark(y + 1, left, 0, 1), mark(y + 1, right, 0, -1)))
    ends = spans.select(*CLUSTER, marks.alias("m")).select(*CLUSTER, "m.*").groupBy(*CLUSTER, "line", "x").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
    along = Window.partitionBy(*CLUSTER, "line").orderBy("x")
    open_ = ends.select(*CLUSTER, "line", "x", F.lead("x").over(along).alias("to"), F.sum("below").over(along).alias("below"), F.sum("above").over(along).alias("above")).where("below <> above")
    line, x, to = F.col("line"), F.col("x"), F.col("to")
    flat = open_.select(*CLUSTER, F.when(F.col("below") == 1, side(x, line, to, line, EAST)).otherwise(side(to, line, x, line, WEST)).alias("s")).select(*CLUSTER, "s.*")
    return upright.unionByName(flat)


def rings(spans: DataFrame) -> DataFrame:
    """(cluster, ring, corners, area): the closed rings of clusters, numbered from 0 by their first corner.

    corners are (x, y) in order from the least, the first not repeated; area counts pixels and is negative for a hole.  A
    side finds the next one by its end, and both the ring's least side and the places along it by doubling how far a side
    sees, so rounds grow with the logarithm of a ring's length.  Spans of a cluster are expected not to meet.
    """
    scratch = Scratch(spans.sparkSession)
    sides = scratch.table("sides", boundary_sides(spans).withColumn("id", F.monotonically_increasing_id()))
    starts = sides.select(*CLUSTER, F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("id").alias("next"), F.col("way").alias("turn"))
    met = sides.join(starts, [*CLUSTER, "x2", "y2"])
    # at a corner of two pixels there are two ways on; the right turn comes first
    onward = met.groupBy(*CLUSTER, "id", "x1", "y1", "way").agg(F.min_by("next", F.pmod(F.col("way") + 1 - F.col("turn"), F.lit(4))).alias("next"))
    key = F.struct("y1", "x1", "way")
    state = onward.select("id", key.alias("key"), F.col("next").alias("ahead"), key.alias("least"))
    n = {"total": F.sum(F.hash("least").cast("long"))}
    state, now = scratch.measured("least", state, **n)
    seen = None
    while now != seen:
        seen = now
        ahead = state.select(F.col("id").alias("ahead"), F.col("ahead").alias("beyond"), F.col("least").alias("other"))
        state, now = scratch.measured("least", state.join(ahead, "ahead").select("id", "key", F.col("beyond").alias("ahead"), F.least("least", "other").alias("least")), **n)
    leasts = scratch.table("leasts", state.select("id", "least", (F.col("key") == F.col("least")).alias("is_first")))
    # steps to the ring's first side: the first side stands still
    ranked = onward.join(leasts, "id").select("id", F.when(F.col("is_first"), F.col("id")).otherwise(F.col("next")).alias("ahead"), F.when(F.col("is_first"), 0).otherwise(1).cast("long").alias("steps"))
    total = {"total": F.sum("steps")}
    ranked, now = scratch.measured("steps", ranked, **total)
    seen = None
    while now != seen:
        seen = now
        ahead = ranked.select(F.col("id").alias("ahead"), F.col("ahead").alias("beyond"), F.col("steps").alias("more"))
        ranked, now = scratch.measured("steps", ranked.join(ahead, "ahead").select("id", F.col("beyond").alias("ahead"), (F.col("steps") + F.col("more")).alias("steps")), **total)
    placed = sides.join(ranked.select("id", "steps"), "id").join(leasts, "id")
    # most steps to go come next after the first, which has none
    order = F.struct((-F.when(F.col("is_first"), F.lit(1 << 62)).otherwise(F.col("steps"))).alias("o"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    whole = placed.groupBy(*CLUSTER, "least").agg(F.array_sort(F.collect_list(order)).alias("c"), (F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"))
    number = F.row_number().over(Window.partitionBy(*CLUSTER).orderBy("least")) - 1
    return scratch.last(whole.select(*CLUSTER, number.alias("ring"), F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("corners"), "area"))


def cluster_outlines(spans: DataFrame, pixel_area: float = 100.0, min_area: float = 0.0) -> DataFrame:
    """(cluster, rings, holes, sides, area_m2): clusters by their rings, those of ``min_area`` and more."""
    out = rings(spans).groupBy(*CLUSTER).agg(F.count("*").alias("rings"), F.sum((F.col("area") < 0).cast("long")).alias("holes"), F.sum(F.size("corners")).alias("corners"), (F.sum("area") * pixel_area).alias("area_m2"))
    return out.where(F.col("area_m2") >= min_area)
