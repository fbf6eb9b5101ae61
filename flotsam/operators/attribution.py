"""Scoring of source regions against rivers, lanes, sites and vessel activity, and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import CORRIDORS, KM_PER_DEGREE, RADIUS_KM, RIVER_KM, RIVERS, WEIGHTS
from ..functions.geo import equirect_km
from ..functions.rules import attribution_score, confidence_band, country_name, dominant_source, explanation, location_name
from .quadtree import counts_in_boxes


def nearest_river(lon: Column, lat: Column, rivers=RIVERS, reach_km: float = RIVER_KM) -> tuple[Column, Column, Column]:
    """Name, distance in km and score of the nearest river mouth, the first one on ties.  The mouths are a short list."""
    each = F.array(*(F.struct(equirect_km(lon, lat, F.lit(x), F.lit(y)).alias("km"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, x, y) in enumerate(rivers)))
    best = F.array_min(each)
    return best["name"], best["km"], F.greatest(F.lit(0.0), 1 - best["km"] / reach_km)


def corridor_score(lon: Column, lat: Column) -> Column:
    inside = F.lit(False)
    for x1, y1, x2, y2 in CORRIDORS:
        inside = inside | ((lon > x1) & (lon < x2) & (lat > y1) & (lat < y2))
    return F.when(inside, 0.6).otherwise(0.2)


def fishing_heuristic(lat: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(lat) / 60) * 0.5


def _cells(frame: DataFrame, lon1: Column, lat1: Column, lon2: Column, lat2: Column, size: float) -> DataFrame:
    """A row for each grid cell that a box touches, so that boxes and points meet by equality of cells."""
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return frame.select("*", F.explode(span(lon1, lon2)).alias("cx")).select("*", F.explode(span(lat1, lat2)).alias("cy"))


def _grown_counts(regions: DataFrame, points: DataFrame, radius_km: float) -> DataFrame:
    """(source_id, n, firsts) of points (id, name, lon, lat) within the boxes of regions grown by the radius."""
    grow = radius_km / KM_PER_DEGREE
    sides = ((F.col(k) + (grow if k.endswith("max") else -grow)).alias(b) for k, b in (("lon_min", "x1"), ("lat_min", "y1"), ("lon_max", "x2"), ("lat_max", "y2")))
    return counts_in_boxes(regions.select(F.col("source_id").alias("box"), *sides), points).withColumnRenamed("box", "source_id")


def site_scores(regions: DataFrame, sites: DataFrame, tags: list[str] | None = None, radius_km: float = RADIUS_KM) -> DataFrame:
    """(source_id, site_count, site_names, industrial): sites of the tags (of any, without a list) near each region; 0.2 near the poles.

    site_names are those of the first ten sites by site_id.
    """
    wanted = sites if tags is None else sites.where(F.col("tag").isin(tags))
    found = _grown_counts(regions, wanted.select(F.col("site_id").alias("id"), "name", "lon", "lat"), radius_km)
    polar = F.abs("lat") >= 80
    out = regions.select("source_id", ((F.col("lat_min") + F.col("lat_max")) / 2).alias("lat")).join(found, "source_id", "left")
    n = F.when(polar, 0).otherwise(F.coalesce("n", F.lit(0)))
    names = F.when(polar | F.col("firsts").isNull(), F.array().cast("array<string>")).otherwise(F.transform("firsts", lambda s: s["name"]))
    return out.select("source_id", n.cast("long").alias("site_count"), names.alias("site_names"), F.when(polar, 0.2).otherwise(F.least(F.lit(1.0), n / 10)).alias("industrial"))


def fishing_scores(regions: DataFrame, activity: DataFrame, start: str, end: str, radius_km: float = RADIUS_KM) -> DataFrame:
    """(source_id, vessel_count, vessel_ids, fishing): vessels near each region between two dates; the first ten ids.

    Once a region, in order of source_id within its cluster, lies near a pole, later ones of the cluster take the
    heuristic too.
    """
    within = activity.where(F.col("ts").between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))
    found = _grown_counts(regions, within.select(F.col("vessel_id").alias("id"), F.lit(None).cast("string").alias("name"), "lon", "lat"), radius_km)
    polar = (F.abs("lat") >= 80).cast("int")
    earlier = Window.partitionBy("cluster_id").orderBy("source_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = regions.select("source_id", "cluster_id", ((F.col("lat_min") + F.col("lat_max")) / 2).alias("lat")).withColumn("off", F.max(polar).over(earlier) == 1)
    n = F.when(F.col("off"), 0).otherwise(F.coalesce("n", F.lit(0)))
    ids = F.when(F.col("off") | F.col("firsts").isNull(), F.array().cast(f"array<{dict(activity.dtypes)['vessel_id']}>")).otherwise(F.transform("firsts", lambda v: v["id"]))
    score = F.when(F.col("off"), fishing_heuristic(F.col("lat"))).otherwise(F.least(F.lit(1.0), n / 20))
    return placed.join(found, "source_id", "left").select("source_id", n.cast("long").alias("vessel_count"), ids.alias("vessel_ids"), score.alias("fishing"))


def lane_scores(regions: DataFrame, lanes: DataFrame, cell: float = 10.0) -> DataFrame:
    """(source_id, overlap_area, shipping): share of each region's box under lane boxes, in square degrees.

    Lanes that overlap count twice.  A pair that shares several cells counts in the cell of its overlap's corner.
    """
    names = ("lon_min", "lat_min", "lon_max", "lat_max")
    left = _cells(regions.select("source_id", *names), *(F.col(n) for n in names), cell)
    right = _cells(lanes.select("lane_id", *(F.col(n).alias(f"l_{n}") for n in names)), *(F.col(f"l_{n}") for n in names), cell)
    x1, y1 = F.greatest("lon_min", "l_lon_min"), F.greatest("lat_min", "l_lat_min")
    x2, y2 = F.least("lon_max", "l_lon_max"), F.least("lat_max", "l_lat_max")
    once = (F.floor(x1 / cell) == F.col("cx")) & (F.floor(y1 / cell) == F.col("cy"))
    area = left.join(right, ["cx", "cy"]).where((x1 < x2) & (y1 < y2) & once).groupBy("source_id").agg(F.sum((x2 - x1) * (y2 - y1)).alias("a"))
    own = (F.col("lon_max") - F.col("lon_min")) * (F.col("lat_max") - F.col("lat_min"))
    total = F.coalesce("a", F.lit(0.0))
    return regions.join(area, "source_id", "left").select("source_id", total.alias("overlap_area"), F.least(F.lit(1.0), total / (own + 1e-10)).alias("shipping"))


def _clipped(ring: Column, axis: str, bound: Column, upper: bool) -> Column:
    """A ring cut by one half-plane: up to ``bound`` on the axis, or from it on."""
    other = "y" if axis == "x" else "x"
    inside = lambda p: p[axis] <= bound if upper else p[axis] >= bound

    def crossing(p: Column, q: Column) -> Column:
        at = p[other] + (q[other] - p[other]) * (bound - p[axis]) / (q[axis] - p[axis])
        return F.struct(*((bound.alias("x"), at.alias("y")) if axis == "x" else (at.alias("x"), bound.alias("y"))))

    def corners(e: Column) -> Column:
        p, q = e["p"], e["q"]
        kept = F.when(inside(q), F.array(q)).otherwise(F.filter(F.array(q), lambda _: F.lit(False)))
        return F.when(inside(p) == inside(q), kept).otherwise(F.concat(F.array(crossing(p, q)), kept))

    return F.flatten(F.transform(edges(ring), corners))


def edges(ring: Column) -> Column:
    """The sides (p, q) of a ring of corners (x, y), from the last corner to the first one on."""
    before = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))
    return F.zip_with(before, ring, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def ring_area(ring: Column) -> Column:
    """Area within a ring by the shoelace formula; 0 with fewer than three corners."""
    twice = F.aggregate(edges(ring), F.lit(0.0), lambda a, e: a + (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]))
    return F.when(F.size(ring) >= 3, F.abs(twice) / 2).otherwise(0.0)


def polygon_lane_scores(regions: DataFrame, lanes: DataFrame, cell: float = 10.0) -> DataFrame:
    """(source_id, overlap_area, shipping) as of ``lane_scores`` for lanes (lane_id, ring), rings of corners (x, y).

    Rings may be closed or open, wound either way and concave, but don't cross themselves; those with null or non-finite
    corners or fewer than three have no area.  Each is cut by the four sides of the region's box in turn.
    """
    names = ("lon_min", "lat_min", "lon_max", "lat_max")
    whole = F.forall("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull() & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    rings = lanes.where((F.size("ring") >= 3) & whole).select("lane_id", F.transform("ring", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("ring"))
    end = lambda of, k: of(F.transform("ring", lambda p: p[k]))
    boxed = rings.select("lane_id", "ring", end(F.array_min, "x").alias("l_lon_min"), end(F.array_min, "y").alias("l_lat_min"), end(F.array_max, "x").alias("l_lon_max"), end(F.array_max, "y").alias("l_lat_max"))
    left = _cells(regions.select("source_id", *names), *(F.col(n) for n in names), cell)
    right = _cells(boxed, *(F.col(f"l_{n}") for n in names), cell)
    x1, y1 = F.greatest("lon_min", "l_lon_min"), F.greatest("lat_min", "l_lat_min")
    once = (F.floor(x1 / cell) == F.col("cx")) & (F.floor(y1 / cell) == F.col("cy"))
    met = left.join(right, ["cx", "cy"]).where((x1 < F.least("lon_max", "l_lon_max")) & (y1 < F.least("lat_max", "l_lat_max")) & once)
    for axis, bound, upper in (("x", "lon_min", False), ("x", "lon_max", True), ("y", "lat_min", False), ("y", "lat_max", True)):
        met = met.select("source_id", *names, _clipped(F.col("ring"), axis, F.col(bound), upper).alias("ring"))
    area = met.groupBy("source_id").agg(F.sum(ring_area(F.col("ring"))).alias("a"))
    own = (F.col("lon_max") - F.col("lon_min")) * (F.col("lat_max") - F.col("lat_min"))
    total = F.coalesce("a", F.lit(0.0))
    return regions.join(area, "source_id", "left").select("source_id", total.alias("overlap_area"), F.least(F.lit(1.0), total / (own + 1e-10)).alias("shipping"))


def attribute(regions: DataFrame, sites: DataFrame, tags: list[str] | None, activity: DataFrame, lanes: DataFrame, start: str, end: str, weights=WEIGHTS) -> DataFrame:
    """One row per region with its four scores, the weighted score, kind, place, country, band, and explanation.

    source_rank is the place of the region within its cluster by source_id, report_rank by falling score.
    """
    lon, lat = (F.col("lon_min") + F.col("lon_max")) / 2, (F.col("lat_min") + F.col("lat_max")) / 2
    out = regions.join(fishing_scores(regions, activity, start, end), "source_id").join(site_scores(regions, sites, tags), "source_id").join(lane_scores(regions, lanes), "source_id")
    river, km, score = nearest_river(lon, lat)
    out = out.select("*", lon.alias("mid_lon"), lat.alias("mid_lat"), river.alias("nearest_river"), km.alias("river_km"), score.alias("river"))
    scores = {k: F.col(k) for k in weights}
    out = out.select("*", attribution_score(scores, weights).alias("attribution_score"), dominant_source(scores).alias("source_type"))
    mid = (F.col("mid_lon"), F.col("mid_lat"))
    text = explanation(F.col("attribution_score"), F.col("source_type"), *mid, F.lit(30), F.col("vessel_count"), F.col("site_count"), F.col("site_names"), F.col("nearest_river"), F.col("river_km"))
    out = out.select("*", location_name(*mid).alias("location_name"), country_name(*mid).alias("country"), confidence_band(F.col("attribution_score")).alias("confidence"), text.alias("explanation"))
    by = Window.partitionBy("cluster_id")
    return out.withColumns({"source_rank": F.row_number().over(by.orderBy("source_id")), "report_rank": F.row_number().over(by.orderBy(F.desc("attribution_score"), "source_id"))})
