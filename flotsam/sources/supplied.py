"""The engine's domain tables, derived from the supplied star schema."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table

#: An embedding of 64 values is an 8 by 8 tile; a hundred tiles, twenty to a row, are a scene.
TILE, ACROSS, SCENE_TILES = 8, 20, 100


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, bands): eleven reflectances."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 11), lambda x: F.abs(x).cast("double")).alias("bands"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, logits): fifteen class scores."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 12, 15), lambda x: x.cast("double") * 10).alias("logits"))


def tile_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, r, c, value): the pixels of each tile."""
    # a table of one row group is read by one task, and a join that Spark turns to a broadcast would go on with that task's rows in one
    tiles = table(spark, sf_dir, "embeddings").repartition(3 * spark.sparkContext.defaultParallelism, "vec_id")
    cells = tiles.select("vec_id", F.posexplode("embedding").alias("p", "v"))
    return cells.select("vec_id", F.floor(F.col("p") / TILE).cast("int").alias("r"), (F.col("p") % TILE).alias("c"), F.col("v").cast("double").alias("value"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, y, x, value): the tiles laid out in scenes."""
    k = F.col("vec_id") % SCENE_TILES
    place = lambda tile, at: (tile * TILE + F.col(at)).cast("int")
    return tile_values(spark, sf_dir).select(F.floor(F.col("vec_id") / SCENE_TILES).alias("scene_id"), place(F.floor(k / ACROSS), "r").alias("y"), place(k % ACROSS, "c").alias("x"), "value")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, h, w): the sizes of the scenes."""
    return pixels(spark, sf_dir).groupBy("scene_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, aoi, acquired, cloud_cover, lon, lat): orders read as scene items."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("scene_id"), (F.col("o_custkey") % 40).alias("aoi"), F.col("o_orderdate").alias("acquired"), (F.col("o_totalprice") % 100).alias("cloud_cover"), (F.col("o_custkey") % 360 - 180).cast("double").alias("lon"), (F.col("o_orderkey") % 140 - 70).cast("double").alias("lat"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, cluster_id, lon, lat, half): source regions as boxes around suppliers' places."""
    s = table(spark, sf_dir, "supplier")
    lon, lat = (F.col("s_suppkey") * 37 % 360 - 180).cast("double"), (F.col("s_suppkey") * 53 % 170 - 85).cast("double")
    return s.select(F.col("s_suppkey").alias("source_id"), (F.col("s_suppkey") % 10).alias("cluster_id"), lon.alias("lon"), lat.alias("lat"), (0.5 + F.col("s_nationkey") % 5 / 4).cast("double").alias("half"))


def vessel_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vessel_id, ts, lon, lat): events read as vessel positions."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("vessel_id"), "ts", (F.col("user_id") * 7 % 360 - 180).cast("double").alias("lon"), (F.col("event_id") % 170 - 85).cast("double").alias("lat"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, name, tag, lon, lat): parts read as coastal sites."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("site_id"), F.col("p_name").alias("name"), F.col("p_type").alias("tag"), (F.col("p_partkey") * 11 % 360 - 180).cast("double").alias("lon"), (F.col("p_partkey") * 29 % 170 - 85).cast("double").alias("lat"))


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lane_id, lon_min, lat_min, lon_max, lat_max): nations read as shipping lanes."""
    n = table(spark, sf_dir, "nation")
    lon, lat = (F.col("n_nationkey") * 14 - 180).cast("double"), (F.col("n_nationkey") * 31 % 120 - 60).cast("double")
    return n.select(F.col("n_nationkey").alias("lane_id"), lon.alias("lon_min"), lat.alias("lat_min"), (lon + 25).alias("lon_max"), (lat + 12).alias("lat_max"))


def ring_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lane_id, ring): nations read as shipping lanes of four to eight corners (x, y)."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    corners, cx, cy = 4 + F.col("id") % 5, F.col("id") * 14 - 170, F.col("id") * 31 % 120 - 60
    turn = lambda k: 2 * math.pi * k / corners
    x = lambda k: cx + (8 + F.col("id") * (k + 1) % 11) * F.cos(turn(k))
    y = lambda k: cy + (5 + (F.col("id") + 3) * (k + 2) % 7) * F.sin(turn(k))
    return n.select(F.col("id").alias("lane_id"), F.transform(F.sequence(F.lit(0).cast("long"), corners - 1), lambda k: F.struct(x(k).alias("x"), y(k).alias("y"))).alias("ring"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(patch, r, c, raw, pred): tiles with a file label 0 to 15 and a predicted class 0 to 14 for each pixel."""
    e = tile_values(spark, sf_dir)
    raw = F.pmod(F.col("vec_id") + F.col("r") * 3 + F.floor(F.abs("value") * 40), F.lit(16)).cast("int")
    pred = F.when(F.pmod(F.col("c") + F.col("vec_id"), F.lit(3)) == 0, F.pmod(F.col("r") + F.col("vec_id"), F.lit(15))).otherwise(F.greatest(raw - 1, F.lit(0))).cast("int")
    return e.select(F.col("vec_id").alias("patch"), "r", "c", raw.alias("raw"), pred.alias("pred"))
