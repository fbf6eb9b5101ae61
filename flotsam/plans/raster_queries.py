"""Queries over tiles, masks and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import BAND_MEANS, BAND_STDS, DELIVERED
from ..functions import bands as B
from ..functions import geo as E
from ..functions.bands import normalize, softmax_boost
from ..operators import outlines as L
from ..operators import rasters as O
from ..operators import signatures as G
from ..operators.audit import patch_checks
from ..sources import supplied as S
from ..sources.session import cut
from .band_queries import INDICES, SPECTRA, forest
from .registry import register

PIXELS = """px AS (SELECT vec_id // 100 AS scene_id, ((vec_id % 100) // 20) * 8 + p // 8 AS y, (vec_id % 20) * 8 + p % 8 AS x, v AS value, vec_id, p // 8 AS r, p % 8 AS c
 FROM (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings)),
 sc AS (SELECT scene_id, max(y) + 1 AS h, max(x) + 1 AS w FROM px GROUP BY 1)"""
#: Tiles of 16 pixels that overlap by 4.
TILES = PIXELS + """, cnt AS (SELECT scene_id, h, w, CASE WHEN h <= 16 THEN 1 ELSE CAST(ceil((h - 16) / 12.0) AS BIGINT) + 1 END AS down, CASE WHEN w <= 16 THEN 1 ELSE CAST(ceil((w - 16) / 12.0) AS BIGINT) + 1 END AS across FROM sc),
 ti AS (SELECT scene_id, h, w, across, tr, tc FROM (SELECT *, unnest(range(down)) AS tr FROM cnt), LATERAL (SELECT unnest(range(across)) AS tc))"""
TILED = TILES + ", tp AS (SELECT px.scene_id, y, x, value, tr, tc, y - tr * 12 AS r, x - tc * 12 AS c FROM px JOIN ti ON px.scene_id = ti.scene_id AND y >= tr * 12 AND y < tr * 12 + 16 AND x >= tc * 12 AND x < tc * 12 + 16)"
MASK = PIXELS + ", mk AS (SELECT scene_id, y, x, abs(value) AS prob FROM px WHERE value > 0.15)"
#: Least pixel of each 4-connected cluster by repeated spreading of labels.
LABELS = MASK + """, nb AS (SELECT a.scene_id AS s, a.y * 100000 + a.x AS a, b.y * 100000 + b.x AS b FROM mk a JOIN mk b ON a.scene_id = b.scene_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
 reach AS (SELECT scene_id AS s, y * 100000 + x AS a, y * 100000 + x AS l FROM mk UNION SELECT nb.s, nb.b, reach.l FROM reach JOIN nb ON nb.s = reach.s AND nb.a = reach.a WHERE reach.l < nb.b),
 lb AS (SELECT s AS scene_id, a // 100000 AS y, a % 100000 AS x, min(l) // 100000 AS first_y, min(l) % 100000 AS first_x FROM reach GROUP BY s, a)"""


def tiled(spark, sf_dir):
    return O.tile_pixels(S.pixels(spark, sf_dir), S.scenes(spark, sf_dir), 16, 4)


@register("d1_tile_pixels", "scene_id:i tile_row:i tile_col:i pixels:i total:d", "SELECT scene_id, tr AS tile_row, tc AS tile_col, count(*) AS pixels, sum(value * (r * 16 + c + 1)) AS total FROM tp GROUP BY 1, 2, 3", TILED)
def _(spark, sf_dir):
    return tiled(spark, sf_dir).groupBy("scene_id", "tile_row", "tile_col").agg(F.count("*").alias("pixels"), F.sum(F.col("value") * (F.col("r") * 16 + F.col("c") + 1)).alias("total"))


@register("d2_stitch_overlap_mean", "scene_id:i y:i x:i value:d", "SELECT scene_id, y, x, avg(value * (1 + (tr + tc) % 3)) AS value FROM tp GROUP BY 1, 2, 3", TILED)
def _(spark, sf_dir):
    return O.stitch(tiled(spark, sf_dir).withColumn("value", F.col("value") * (1 + (F.col("tile_row") + F.col("tile_col")) % 3)), "value", 16, 4)


@register("a6_tile_index", "scene_id:i patch_id:s row_start:i col_start:i actual_h:i actual_w:i east:d north:d", """SELECT scene_id, 'patch_' || lpad((tr * across + tc)::VARCHAR, 4, '0') AS patch_id, tr * 12 AS row_start, tc * 12 AS col_start, least(16, h - tr * 12) AS actual_h, least(16, w - tc * 12) AS actual_w,
 1000 * scene_id + 10 * tc * 12 AS east, -10 * tr * 12 AS north FROM ti""", TILES)
def _(spark, sf_dir):
    t = F.array(F.lit(10.0), F.lit(0.0), (F.col("scene_id") * 1000).cast("double"), F.lit(0.0), F.lit(-10.0), F.lit(0.0))
    out = O.tile_index(S.scenes(spark, sf_dir).withColumn("transform", t), 16, 4)
    return out.select("*", F.get("transform", F.lit(2)).alias("east"), F.get("transform", F.lit(5)).alias("north"))


@register("a7_complete_tiles", "scene_id:i patch_id:s filled:b total:d", "SELECT scene_id, 'patch_' || lpad((tr * across + tc)::VARCHAR, 4, '0') AS patch_id, (tr + tc) % 4 = 0 AS filled, CASE WHEN (tr + tc) % 4 = 0 THEN 0 ELSE 3 * tr END AS total FROM ti", TILES)
def _(spark, sf_dir):
    tiles = O.tile_index(S.scenes(spark, sf_dir), 16, 4)
    known = tiles.where((F.col("tile_row") + F.col("tile_col")) % 4 != 0).select("scene_id", "patch_id", F.array_repeat(F.col("tile_row").cast("double"), 3).alias("probs"))
    out = O.complete_tiles(tiles, known, 3)
    return out.select("*", ((F.col("tile_row") + F.col("tile_col")) % 4 == 0).alias("filled"), F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("total"))


@register("b30_scene_shape", "scene_id:i h:i w:i", "SELECT scene_id, h, w FROM sc", PIXELS)
def _(spark, sf_dir):
    return O.tile_index(S.scenes(spark, sf_dir), 16, 4).groupBy("scene_id").agg(F.max(F.col("row_start") + F.col("actual_h")).alias("h"), F.max(F.col("col_start") + F.col("actual_w")).alias("w"))


@register("a4_assemble_bands", "scene_id:i y:i x:i total:d", "SELECT vec_id AS scene_id, r AS y, c AS x, value * (1 + 4 * (vec_id % 3 > 0)::INT) AS total FROM px", PIXELS)
def _(spark, sf_dir):
    tiles = S.tile_values(spark, sf_dir).select(F.col("vec_id").alias("scene_id"), F.col("r").alias("y"), F.col("c").alias("x"), "value")
    rows = tiles.select("*", F.explode(F.array(F.lit("B02"), F.lit("B8A"), F.lit("B01"))).alias("band")).where((F.col("band") != "B8A") | (F.col("scene_id") % 3 > 0))
    rows = rows.withColumn("value", F.when(F.col("band") == "B8A", F.col("value") * 4).otherwise(F.col("value")))
    return O.assemble_bands(rows).select("*", F.aggregate("bands", F.lit(0.0), lambda a, v: a + v).alias("total"))


@register("b2_regrid", "scene_id:i y:i x:i value:d", """SELECT scene_id, ty AS y, tx AS x, sum(wt * value) AS value FROM (SELECT vec_id AS scene_id, ty, tx, value, greatest(0, 1 - abs(sy - r)) * greatest(0, 1 - abs(sx - c)) AS wt
 FROM px, (SELECT a AS ty, b AS tx, a * 7 / 11.0::DOUBLE AS sy, b * 7 / 4.0::DOUBLE AS sx FROM range(12) t(a), range(5) u(b)) WHERE abs(sy - r) < 1 AND abs(sx - c) < 1) GROUP BY 1, 2, 3""", PIXELS)
def _(spark, sf_dir):
    tiles = S.tile_values(spark, sf_dir).select(F.col("vec_id").alias("scene_id"), F.col("r").alias("y"), F.col("c").alias("x"), "value")
    return O.regrid(tiles, 12, 5)


_KINDS = {"original": ("r", "c"), "hflip": ("r", "7-c"), "vflip": ("7-r", "c"), "rot90": ("7-c", "r"), "rot180": ("7-r", "7-c"), "rot270": ("c", "7-r")}


@register("b15_augment", "vec_id:i kind:s total:d", " UNION ALL ".join(f"SELECT vec_id, '{k}' AS kind, sum(value * (({a}) * 8 + ({b}) + 1)) AS total FROM px GROUP BY 1" for k, (a, b) in _KINDS.items()), PIXELS)
def _(spark, sf_dir):
    t, out = S.tile_values(spark, sf_dir), None
    for kind in O.AUGMENTATIONS:
        r, c = O.augment(F.col("r"), F.col("c"), 8, kind)
        part = t.groupBy("vec_id").agg(F.sum(F.col("value") * (r * 8 + c + 1)).alias("total")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@register("b16_augmented_mean", "vec_id:i r:i c:i value:d", "SELECT vec_id, r, c, value * 3.5 AS value FROM px", PIXELS)
def _(spark, sf_dir):
    t, out = S.tile_values(spark, sf_dir), None
    for k, kind in enumerate(O.AUGMENTATIONS):  # predictions of a model that scales by the number of the augmentation
        r, c = O.augment(F.col("r"), F.col("c"), 8, kind)
        part = t.select("vec_id", F.lit(kind).alias("kind"), r.alias("r"), c.alias("c"), (F.col("value") * (k + 1)).alias("value"))
        out = part if out is None else out.unionByName(part)
    return O.augmented_mean(out, 8, ["vec_id"])


def mask(spark, sf_dir):
    return S.pixels(spark, sf_dir).select("scene_id", "y", "x", F.abs("value").alias("prob"), (F.col("value") > 0.15).alias("is_debris"))


def labelled(spark, sf_dir):
    m = mask(spark, sf_dir)
    return cut(O.label_components(m, block=32).join(m.select("scene_id", "y", "x", "prob"), ["scene_id", "y", "x"]))


@register("c11_adjacent_pixels", "scene_id:i edges:i", "SELECT a.scene_id, count(*) AS edges FROM mk a JOIN mk b ON a.scene_id = b.scene_id AND ((a.y = b.y AND a.x = b.x + 1) OR (a.x = b.x AND a.y = b.y + 1)) GROUP BY 1", MASK)
def _(spark, sf_dir):
    return O.adjacent_pixels(mask(spark, sf_dir)).groupBy(F.col("a.scene_id").alias("scene_id")).agg(F.count("*").alias("edges"))


@register("d3_label_components", "scene_id:i y:i x:i first_y:i first_x:i", "SELECT * FROM lb", "RECURSIVE " + LABELS)
def _(spark, sf_dir):
    return labelled(spark, sf_dir)


MEASURES = LABELS + """, cl AS (SELECT scene_id, first_y, first_x, count(*) AS n_pixels, avg(prob) AS mean_confidence, avg(x) + 0.5 AS centre_x, avg(y) + 0.5 AS centre_y, 100.0 * count(*) AS area_m2 FROM lb JOIN mk USING (scene_id, y, x) GROUP BY 1, 2, 3),
 kept AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY first_y, first_x) - 1 AS cluster_id FROM cl WHERE n_pixels >= 2 AND area_m2 <= 5e7)"""


@register("d4_cluster_measures", "scene_id:i cluster_id:i n_pixels:i mean_confidence:d centre_x:d centre_y:d area_m2:d", "SELECT * FROM kept", "RECURSIVE " + MEASURES)
def _(spark, sf_dir):
    return O.cluster_measures(labelled(spark, sf_dir), min_area=200.0)


@register("d5_cluster_spans", "scene_id:i first_y:i first_x:i y:i x_from:i x_to:i", "SELECT scene_id, first_y, first_x, y, min(x) AS x_from, max(x) AS x_to FROM (SELECT *, x - row_number() OVER (PARTITION BY scene_id, first_y, first_x, y ORDER BY x) AS g FROM lb) GROUP BY scene_id, first_y, first_x, y, g", "RECURSIVE " + LABELS)
def _(spark, sf_dir):
    return O.cluster_spans(labelled(spark, sf_dir))


@register(
    "d5_outlines",
    "scene_id:i first_y:i first_x:i sides:i area_m2:d",
    "SELECT scene_id, first_y, first_x, 4 * count(*) - coalesce(sum(k), 0) AS sides, 100.0 * count(*) AS area_m2 FROM lb LEFT JOIN (SELECT s AS scene_id, a // 100000 AS y, a % 100000 AS x, count(*) AS k FROM nb GROUP BY 1, 2, 3) USING (scene_id, y, x) GROUP BY 1, 2, 3 HAVING count(*) >= 2",
    "RECURSIVE " + LABELS,
)
def _(spark, sf_dir):
    """Clusters of two pixels and more by their rings: the length of all sides and the area, with holes taken off."""
    found = L.rings(O.cluster_spans(labelled(spark, sf_dir)))
    corners = F.concat("corners", F.slice("corners", 1, 1))
    steps = F.zip_with(F.slice(corners, 1, F.size(corners) - 1), F.slice(corners, 2, F.size(corners) - 1), lambda p, q: F.abs(p["x"] - q["x"]) + F.abs(p["y"] - q["y"]))
    length = F.aggregate(steps, F.lit(0).cast("long"), lambda a, n: a + n)
    out = found.groupBy("scene_id", "first_y", "first_x").agg(F.sum(length).alias("sides"), (F.sum("area") * 100.0).alias("area_m2"))
    return out.where(F.col("area_m2") >= 200.0)


@register("e4_cluster_numbers", "scene_id:i clusters:i last_id:i", "SELECT scene_id, count(*) AS clusters, max(cluster_id) AS last_id FROM kept GROUP BY 1", "RECURSIVE " + MEASURES)
def _(spark, sf_dir):
    return O.cluster_measures(labelled(spark, sf_dir), min_area=200.0).groupBy("scene_id").agg(F.count("*").alias("clusters"), F.max("cluster_id").alias("last_id"))


@register("d7_debris_share", "scene_id:i share:d confidence:d", "SELECT scene_id, avg((value > 0.15)::INT) AS share, coalesce(avg(abs(value)) FILTER (WHERE value > 0.15), 0) AS confidence FROM px GROUP BY 1", PIXELS)
def _(spark, sf_dir):
    m = mask(spark, sf_dir)
    return m.groupBy("scene_id").agg(F.avg(F.col("is_debris").cast("double")).alias("share"), F.coalesce(F.avg(F.when(F.col("is_debris"), F.col("prob"))), F.lit(0.0)).alias("confidence"))


ZONES = LABELS + ", " + SPECTRA + """, zp AS (SELECT lb.scene_id, first_y, first_x, vec_id % 5 = 0 AS gone, b FROM lb JOIN px USING (scene_id, y, x) JOIN sp USING (vec_id)),
 zn AS (SELECT scene_id, first_y, first_x, avg(gone::INT) AS nodata_share, [""" + ",".join(f"avg(CASE WHEN gone THEN 0 ELSE b[{k}] END)" for k in range(1, 12)) + "] AS b FROM zp GROUP BY 1, 2, 3)"


def zones(spark, sf_dir, stored=False):
    """Spectra of clusters; ``stored`` takes the scene through its normalised form, as a stage before this one keeps it."""
    k = F.col("vec_id") % 100
    at = S.tile_values(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / 100).alias("scene_id"), (F.floor(k / 20) * 8 + F.col("r")).cast("int").alias("y"), (k % 20 * 8 + F.col("c")).cast("int").alias("x"))
    bands = F.when(F.col("vec_id") % 5 == 0, F.array_repeat(F.lit(0.0), 11)).otherwise(F.col("bands"))
    pixels = at.join(S.spectra(spark, sf_dir), "vec_id").select("scene_id", "y", "x", bands.alias("bands"))
    if stored:
        scores = cut(pixels.select("scene_id", "y", "x", B.normalize(F.col("bands"), scale=1.0).alias("scores"), B.is_nodata(F.col("bands")).alias("gone")))
        pixels = cut(scores.select("scene_id", "y", "x", B.denormalize(F.col("scores"), F.col("gone")).alias("bands")))
    return O.zonal_spectrum(labelled(spark, sf_dir), pixels)


@register("c2_zonal_spectrum", "scene_id:i first_y:i first_x:i b4:d b8:d", "SELECT scene_id, first_y, first_x, b[4] AS b4, b[8] AS b8 FROM zn", "RECURSIVE " + ZONES)
def _(spark, sf_dir):
    return zones(spark, sf_dir).select("*", F.get("spectrum", F.lit(3)).alias("b4"), F.get("spectrum", F.lit(7)).alias("b8"))


@register("c3_zonal_nodata", "scene_id:i empty_zones:i share:d", "SELECT scene_id, count(*) FILTER (WHERE nodata_share > 0.7) AS empty_zones, avg(nodata_share) AS share FROM zn GROUP BY 1", "RECURSIVE " + ZONES)
def _(spark, sf_dir):
    return zones(spark, sf_dir).groupBy("scene_id").agg(F.sum((F.col("nodata_share") > 0.7).cast("long")).alias("empty_zones"), F.avg("nodata_share").alias("share"))


_NORMAL = ", ".join(f"{{'m': {m}::DOUBLE, 's': {s}::DOUBLE}}" for m, s in zip(BAND_MEANS, BAND_STDS, strict=True))
#: Spectra of zones as they come back from the scores that scenes are kept in.
_BACK = "list_transform(range(11), lambda k: CASE WHEN gone OR k IN (0, 5, 6) THEN 0 ELSE greatest(-5, least(5, (greatest(0.0001, least(0.5, b[k + 1])) - nm[k + 1].m) / (nm[k + 1].s + 0.000001))) * nm[k + 1].s + nm[k + 1].m END)"
RESTORED = LABELS + ", " + SPECTRA + f""", zp AS (SELECT scene_id, first_y, first_x, gone, {_BACK} AS b FROM (SELECT lb.scene_id, first_y, first_x, vec_id % 5 = 0 AS gone, b, [{_NORMAL}] AS nm FROM lb JOIN px USING (scene_id, y, x) JOIN sp USING (vec_id))),
 zn AS (SELECT scene_id, first_y, first_x, avg(gone::INT) AS nodata_share, [""" + ",".join(f"avg(b[{k}])" for k in range(1, 12)) + "] AS b FROM zp GROUP BY 1, 2, 3)"
_ZONE_RULES = INDICES.split("ix AS", 1)[1].replace("SELECT vec_id, label,", "SELECT scene_id, first_y, first_x, nodata_share,").replace("FROM sp)", "FROM zn)")


@register(
    "m4_classify_clusters",
    "scene_id:i first_y:i first_x:i pi_value:d sr_value:d nsi_value:d fdi_value:d polymer_type:s is_false_positive:b rf_confidence:d",
    """SELECT scene_id, first_y, first_x, CASE WHEN nodata_share > 0.7 THEN 0 ELSE pi END AS pi_value, CASE WHEN nodata_share > 0.7 THEN 0 ELSE sr END AS sr_value, CASE WHEN nodata_share > 0.7 THEN 0 ELSE nsi END AS nsi_value,
 CASE WHEN nodata_share > 0.7 THEN 0 ELSE fdi END AS fdi_value, CASE WHEN nodata_share > 0.7 THEN 'No Data Region' ELSE polymer_type END AS polymer_type, nodata_share > 0.7 OR is_false_positive AS is_false_positive, 0 AS rf_confidence FROM ruled""",
    "RECURSIVE " + RESTORED + ", ix AS" + _ZONE_RULES,
    4,
)
def classified(spark, sf_dir, model=None):
    """Clusters by their mean spectra, denormalised from the scores of the scene; by the rules, as there is no model."""
    out = G.classify_zones(zones(spark, sf_dir, stored=True), model)
    return out.withColumnsRenamed({k: f"{k}_value" for k in ("pi", "sr", "nsi", "fdi")})


@register("m4_forest_clusters", "scene_id:i first_y:i first_x:i polymer_type:s is_false_positive:b rf_confidence:d")
def _(spark, sf_dir):
    """The same by a forest that is trained on spectra with the rules' polymers."""
    return classified(spark, sf_dir, forest(spark, sf_dir)[0])


@register("b18_pixel_to_map", "scene_id:i y:i x:i east:d north:d", "SELECT scene_id, y, x, 10 * x + 5 AS east, -10 * y - 5 AS north FROM mk", MASK)
def _(spark, sf_dir):
    east, north = E.pixel_to_map(F.col("y") + 0.5, F.col("x") + 0.5)
    return mask(spark, sf_dir).where("is_debris").select("scene_id", "y", "x", east.alias("east"), north.alias("north"))


@register("d14_threshold_profile", "over_0:d over_1:d over_2:d", "SELECT avg((value > 0.1)::INT) AS over_0, avg((value > 0.01)::INT) AS over_1, avg((value > 0.001)::INT) AS over_2 FROM px", PIXELS)
def _(spark, sf_dir):
    from ..operators.metrics import threshold_profile

    return threshold_profile(S.pixels(spark, sf_dir), "value")


#: Class scores of a model for the pixels of tiles, but for some tiles that it has not seen; their means over tiles.
_SCORED = TILED + """, lg AS (SELECT scene_id, y, x, tr, tc, k, CASE WHEN (tr + 2 * tc) % 6 = 5 THEN NULL WHEN k = 0 THEN value * 12 + 0.5 ELSE (k * 5 + r + 2 * c + tr + tc) % 7 / 2.0::DOUBLE - 1 END AS l FROM (SELECT *, unnest(range(15)) AS k FROM tp)),
 pb AS (SELECT scene_id, y, x, k, coalesce(exp(l) / sum(exp(l)) OVER (PARTITION BY scene_id, y, x, tr, tc), 0) AS p FROM lg),
 ps AS (SELECT scene_id, y, x, list(p ORDER BY k) AS ps FROM (SELECT scene_id, y, x, k, round(avg(p), 12) AS p FROM pb GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
 pr AS (SELECT scene_id, y, x, ps[1] AS prob, list_position(ps, list_max(ps)) - 1 AS cls FROM ps)"""
_DETECTED = MEASURES.split("mk AS", 1)[1].split(", nb AS", 1)[1]


def scored(spark, sf_dir):
    """Tiles of the scenes, and class probabilities of the pixels of those that were predicted."""
    t = tiled(spark, sf_dir).where((F.col("tile_row") + 2 * F.col("tile_col")) % 6 != 5)
    others = (((k * 5 + F.col("r") + 2 * F.col("c") + F.col("tile_row") + F.col("tile_col")) % 7 / 2 - 1) for k in range(1, 15))
    probs = softmax_boost(F.array(F.col("value") * 12, *others))
    return O.tile_index(S.scenes(spark, sf_dir), 16, 4), t.select("scene_id", "tile_row", "tile_col", "r", "c", probs.alias("probs"))


@register("m12_pixel_results", "scene_id:i y:i x:i prob:d cls:i is_debris:b", "SELECT scene_id, y, x, prob, cls, cls = 0 AND prob > 0.1 AS is_debris FROM pr", _SCORED)
def _(spark, sf_dir):
    return O.pixel_results(*scored(spark, sf_dir), 16, 4, pixels=S.pixels(spark, sf_dir))  # the last scene may lack tiles


@register(
    "m12_detect",
    "scene_id:i cluster_id:i n_pixels:i mean_confidence:d centre_x:d centre_y:d area_m2:d",
    "SELECT * FROM kept",
    "RECURSIVE " + _SCORED + ", mk AS (SELECT scene_id, y, x, prob FROM pr WHERE cls = 0 AND prob > 0.1), nb AS" + _DETECTED,
)
def _(spark, sf_dir):
    """Completed tiles, stitched class means, mask, clusters and their measures."""
    m = cut(O.pixel_results(*scored(spark, sf_dir), 16, 4).where("is_debris"))
    found = O.label_components(m, block=32).join(m.select("scene_id", "y", "x", "prob"), ["scene_id", "y", "x"])
    return O.cluster_measures(found, min_area=200.0)


@register(
    "m13_preprocess",
    "scene_id:i tile_row:i tile_col:i band:i least:d most:d mean:d in_range:b varies:b",
    f"""SELECT scene_id, tr AS tile_row, tc AS tile_col, band, min(z) AS least, max(z) AS most, avg(z) AS mean, min(z) >= -5.5 AND max(z) <= 5.5 AS in_range, stddev_pop(z) > 0.01 AS varies
 FROM (SELECT scene_id, tr, tc, band, CASE WHEN value = 0 OR d IS NULL AND false THEN 0 ELSE greatest(-5, least(5, (greatest(0.0001, least(0.5, coalesce(abs(value) * 4000 * (1 + d / 10.0::DOUBLE) / 10000, 0))) - n.m) / (n.s + 0.000001))) END AS z
 FROM (SELECT *, [{_NORMAL}][band + 1] AS n, [NULL, 0, 1, 2, 3, NULL, NULL, 4, 5, 6, 7][band + 1] AS d FROM (SELECT *, unnest(range(11)) AS band FROM tp))) GROUP BY 1, 2, 3, 4""".replace(" OR d IS NULL AND false", ""),
    TILED,
    4,
)
def _(spark, sf_dir):
    """All delivered bands of a scene as digital numbers: assembled, padded, normalised, tiled and checked, tile by tile and band by band."""
    numbers = [F.struct(F.lit(b).alias("band"), (F.abs("value") * 4000 * (1 + F.lit(k) / 10)).alias("value")) for k, b in enumerate(DELIVERED)]
    rows = S.pixels(spark, sf_dir).select("scene_id", "y", "x", F.explode(F.array(*numbers)).alias("b")).select("scene_id", "y", "x", "b.*")
    tiles = O.tile_pixels(O.assemble_bands(rows).withColumn("bands", normalize(F.col("bands"))), S.scenes(spark, sf_dir), 16, 4)
    each = tiles.select("scene_id", "tile_row", "tile_col", F.posexplode("bands").alias("band", "value"))
    return patch_checks(each.select(F.struct("scene_id", "tile_row", "tile_col", "band").alias("patch"), "value"), "patch").select("patch.*", "least", "most", "mean", "in_range", "varies")
