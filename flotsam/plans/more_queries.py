"""Queries over dates, orders of reports, balanced splits, sinks' rows and the forest."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import BANDS
from ..operators import audit as U
from ..operators import catalogue as C
from ..operators import drift as D
from ..operators import rasters as O
from ..operators import signatures as G
from ..sources import supplied as S
from ..sources.session import new_folder
from .audit_queries import CATALOGUE, truth
from .band_queries import SPECTRA, forest
from .drift_queries import ATTRIBUTED, attributed, regions
from .raster_queries import PIXELS, TILES, mask
from .registry import register


@register("b27_date_window", "scene_id:i start:s end_:s", """SELECT scene_id, strftime(e - INTERVAL 30 DAY, '%Y-%m-%d') AS start, strftime(e, '%Y-%m-%d') AS end_ FROM (SELECT scene_id, CASE WHEN scene_id % 3 = 0 THEN TIMESTAMP '2024-01-15' ELSE acquired END AS e FROM ca)""", CATALOGUE)
def _(spark, sf_dir):
    c = S.catalogue(spark, sf_dir)
    caller = F.when(F.col("scene_id") % 3 == 0, "2024-01-15T00:00:00Z").when(F.col("scene_id") % 3 == 1, "no date")
    start, end = C.date_window(caller, F.date_format("acquired", "yyyy-MM-dd HH:mm:ss"), 30)
    return c.select("scene_id", F.date_format(start, "yyyy-MM-dd").alias("start"), F.date_format(end, "yyyy-MM-dd").alias("end_"))


@register("c14_date_lookup", "scene_id:i detection_date:s", "SELECT d.scene_id, coalesce(strftime(acquired, '%Y-%m-%d'), '') AS detection_date FROM (SELECT s_suppkey * 7 AS scene_id FROM supplier) d LEFT JOIN ca ON ca.scene_id = d.scene_id AND ca.scene_id % 2 = 0", CATALOGUE)
def _(spark, sf_dir):
    wanted = regions(spark, sf_dir).select((F.col("source_id") * 7).alias("scene_id"))
    return C.with_dates(wanted, S.catalogue(spark, sf_dir).where("scene_id % 2 = 0"))


@register("c13_tiles_with_predictions", "scene_id:i predicted:i tiles:i", "SELECT scene_id, count(*) FILTER (WHERE (tr + tc) % 4 <> 0) AS predicted, count(*) AS tiles FROM ti GROUP BY 1", TILES)
def _(spark, sf_dir):
    tiles = O.tile_index(S.scenes(spark, sf_dir), 16, 4)
    known = tiles.where((F.col("tile_row") + F.col("tile_col")) % 4 != 0).select("scene_id", "patch_id", F.array_repeat(F.lit(0.5), 3).alias("probs"))
    found = F.get("probs", F.lit(0)) > 0  # a missing prediction is zeros
    return O.complete_tiles(tiles, known, 3).groupBy("scene_id").agg(F.count_if(found).alias("predicted"), F.count("*").alias("tiles"))


@register("e3_source_rank", "source_id:i source_rank:i", "SELECT source_id, source_rank FROM atr", ATTRIBUTED)
def _(spark, sf_dir):
    return attributed(spark, sf_dir)


@register("e10_report_order", "cluster_id:i report_rank:i source_id:i", "SELECT cluster_id, report_rank, source_id FROM atr WHERE report_rank <= 3", ATTRIBUTED)
def _(spark, sf_dir):
    return attributed(spark, sf_dir).where("report_rank <= 3")


@register("a14_report_json", "value:s", """SELECT '{"source_id":' || source_id || ',"source_type":"' || source_type || '","country":"' || CASE WHEN 79 < lon AND lon < 82 AND 5 < lat AND lat < 10 THEN 'Sri Lanka' WHEN 87 < lon AND lon < 93 AND 20 < lat AND lat < 27 THEN 'Bangladesh' WHEN 68 < lon AND lon < 78 AND 8 < lat AND lat < 24 THEN 'India' WHEN 95 < lon AND lon < 106 AND 5 < lat AND lat < 21 THEN 'Thailand/Vietnam' ELSE 'International Waters' END || '"}' AS value FROM atr""", ATTRIBUTED)
def _(spark, sf_dir):
    path = new_folder(spark, "report")
    C.write_json(attributed(spark, sf_dir).select("source_id", "source_type", "country"), path)
    return spark.read.text(path)


@register("a15_pixel_results", "scene_id:i y:i x:i is_debris:b prob:d cls:i", "SELECT scene_id, y, x, value > 0.15 AS is_debris, abs(value) AS prob, CASE WHEN value > 0.15 THEN 0 ELSE 1 + floor(abs(value) * 1000)::BIGINT % 14 END AS cls FROM px", PIXELS)
def _(spark, sf_dir):
    """Every pixel with its mask, probability and class, written by scene and read back."""
    cls = F.when(F.col("is_debris"), 0).otherwise(1 + F.floor(F.col("prob") * 1000) % 14)
    path = new_folder(spark, "pixels")
    C.write_pixels(mask(spark, sf_dir).withColumn("cls", cls.cast("int")), path)
    return spark.read.parquet(path)


@register("s3_balanced_split", "kind:s rows:i", """SELECT CASE WHEN has THEN 'debris' ELSE 'other' END AS kind, count(*) AS rows FROM (SELECT vec_id, bool_or(label < 3) AS has FROM embeddings GROUP BY 1) GROUP BY 1
 UNION ALL SELECT 'augmented', count(*) FROM (SELECT unnest(range(greatest(0, floor((SELECT count(*) FROM embeddings) * 0.5)::BIGINT - (SELECT count(*) FROM embeddings WHERE label < 3)))) AS i)""")
def _(spark, sf_dir):
    p = S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patch"), (F.col("label") < 3).alias("has_debris"))
    kind = F.when(F.col("name").contains("_aug"), "augmented").when(F.col("has_debris"), "debris").otherwise("other")
    return U.oversample(p, 0.5).groupBy(kind.alias("kind")).agg(F.count("*").alias("rows"))


@register("d8_patches_per_split", "split:s patches:i with_debris:i", "SELECT ['train', 'val', 'test'][vec_id % 3 + 1] AS split, count(*) AS patches, count(*) FILTER (WHERE list_contains(list_transform(range(64), lambda p: (vec_id + (p // 8) * 3 + floor(abs(embedding[p + 1]::DOUBLE) * 40)::BIGINT) % 16), 1)) AS with_debris FROM embeddings GROUP BY 1")
def _(spark, sf_dir):
    return U.imbalance(truth(spark, sf_dir))


@register("m3_forest_scoring", "vec_id:i polymer_type:s is_false_positive:b rf_confidence:d")
def _(spark, sf_dir):
    model, rows = forest(spark, sf_dir)
    return G.score_forest(model, rows)


@register("e6_feature_importance", "band:s rank:i importance:d")
def _(spark, sf_dir):
    model, rows = forest(spark, sf_dir)
    weights = model.stages[0].featureImportances.toArray()
    named = spark.createDataFrame(list(zip(BANDS, map(float, weights), strict=True)), "band string, importance double")
    return named.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "band")))


#: A forest whose nodes are suppliers: fifteen in a row are a tree of seven splits and eight leaves.
_NODES = """nd0 AS (SELECT s_suppkey // 15 AS tree, s_suppkey % 15 AS node, s_suppkey * 7 % 11 AS feature, abs(s_acctbal) % 30 / 100 AS threshold, s_suppkey % 15 AS cls, (1 + s_nationkey)::DOUBLE AS weight, abs(s_acctbal) % 7 AS gain FROM supplier),
 nd AS (SELECT * FROM nd0 WHERE tree IN (SELECT tree FROM nd0 GROUP BY 1 HAVING count(*) = 15))"""
_WALK = """, r0 AS (SELECT vec_id, tree, node, b[feature + 1] <= threshold AS goes FROM sp, nd WHERE node < 7),
 w1 AS (SELECT vec_id, tree, CASE WHEN goes THEN 1 ELSE 2 END AS node FROM r0 WHERE node = 0),
 w2 AS (SELECT vec_id, tree, CASE WHEN goes THEN 2 * node + 1 ELSE 2 * node + 2 END AS node FROM w1 JOIN r0 USING (vec_id, tree, node)),
 w3 AS (SELECT vec_id, tree, CASE WHEN goes THEN 2 * node + 1 ELSE 2 * node + 2 END AS node FROM w2 JOIN r0 USING (vec_id, tree, node)),
 vt AS (SELECT vec_id, cls, count(*) * 0.625 AS v, sum(count(*)) OVER (PARTITION BY vec_id) AS trees FROM w3 JOIN nd USING (tree, node) GROUP BY 1, 2)"""


def table_forest(spark, sf_dir):
    s = S.table(spark, sf_dir, "supplier")
    k, money = F.col("s_suppkey"), F.abs("s_acctbal")
    node = k % 15
    child = lambda side: F.when(node < 7, 2 * node + side).otherwise(-1).cast("int")
    shares = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda c: F.when(c == k % 15, 0.65).otherwise(0.025))
    nodes = s.select(F.floor(k / 15).cast("int").alias("tree"), node.cast("int").alias("node"), (k * 7 % 11).cast("int").alias("feature"), (money % 30 / 100).alias("threshold"), child(1).alias("left"), child(2).alias("right"), shares.alias("shares"), (1 + F.col("s_nationkey")).cast("double").alias("weight"), (money % 7).alias("gain"))
    return nodes.join(nodes.groupBy("tree").agg(F.count("*").alias("n")).where("n = 15").select("tree"), "tree")


@register(
    "m3_table_forest",
    "vec_id:i prediction:i rf_confidence:d",
    "SELECT vec_id, arg_min(cls, (-v, cls)) AS prediction, (max(v) + 0.025 * any_value(trees)) / any_value(trees) AS rf_confidence FROM vt GROUP BY 1",
    SPECTRA + ", " + _NODES + _WALK,
)
def _(spark, sf_dir):
    """Spectra by a forest that is read from a table of nodes."""
    voted = G.vote(table_forest(spark, sf_dir), S.spectra(spark, sf_dir), 3).where("votes IS NOT NULL")  # as where there is no tree
    # votes of trees are added up in their order, so equal votes of two classes are told apart by less than a rounding
    votes = F.transform("votes", lambda v: F.round(v, 9))
    return voted.select("vec_id", (F.array_position(votes, F.array_max(votes)) - 1).alias("prediction"), F.array_max("votes").alias("rf_confidence"))


@register(
    "e6_table_importance",
    "feature:i rank:i importance:d",
    """SELECT feature, row_number() OVER (ORDER BY round(importance, 9) DESC, feature) AS rank, importance FROM (SELECT feature, sum(share) / (SELECT count(DISTINCT tree) FROM nd) AS importance
 FROM (SELECT tree, feature, sum(gain * weight) / sum(sum(gain * weight)) OVER (PARTITION BY tree) AS share FROM nd WHERE node < 7 GROUP BY 1, 2) GROUP BY 1)""",
    _NODES,
)
def _(spark, sf_dir):
    """Features of the forest in the order of their importance: a row for each of eleven bands."""
    ranked = G.feature_importance(table_forest(spark, sf_dir))
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("importance", 9)), "feature")))


@register("m7_fallback_velocity", "cluster_id:i step:i moved:b")
def _(spark, sf_dir):
    seeds = regions(spark, sf_dir).where("abs(lat) < 80").select(F.col("source_id").alias("cluster_id"), F.lit(0).alias("particle"), "lon", "lat")
    start = seeds.select("cluster_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return D.trace_back(seeds, None, hours=3).join(start, "cluster_id").select("cluster_id", "step", ((F.abs(F.col("lon") - F.col("x")) + F.abs(F.col("lat") - F.col("y"))) > 0).alias("moved"))
