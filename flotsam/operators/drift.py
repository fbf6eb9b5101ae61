"""Back-tracking: fields, particles, trajectories, end points, and density clusters of end points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import CURRENT_SHARE, HOURS, METRES_PER_DEGREE, MIN_SAMPLES, PARTICLES, WIND_SHARE
from ..sources.session import cut
from .density import dbscan, near_counts  # noqa: F401  a part of back-tracking


def nearest_index(value: Column, first: float, step: float, n: int) -> Column:
    """Index of the nearest place on a regular axis, the lower one on ties, the ends beyond them."""
    return F.least(F.greatest(F.ceil((value - first) / step - 0.5), F.lit(0)), F.lit(n - 1)).cast("int")


def nearest_places(points: DataFrame, column: str, axis: DataFrame, name: str) -> DataFrame:
    """points with ``name``: the idx of the nearest place on an axis (idx, place) of any steps and order, the lower idx on ties.

    Points and places are sorted together by ranges; a point takes the better of the last place before it and the first one
    after it, which may stand in another range: then they are carried over the ends of ranges, a row for each.  Points
    without a finite value have null, and so has every point where the axis has no finite place.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    value, place = F.col(column).cast("double"), F.col("place").cast("double")
    marks = axis.where(finite(place)).groupBy(place.alias("at")).agg(F.min("idx").alias("idx"))
    row, none = F.struct(*points.columns), F.lit(None).cast(points.schema)
    marks = marks.select("at", F.struct("at", "idx").alias("mark"), none.alias("row"), F.lit(0).cast("long").alias("salt"))
    known = points.where(finite(value)).select(value.alias("at"), F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"), row.alias("row"), F.xxhash64(*points.columns).alias("salt"))
    order = [F.col("at"), F.col("mark").isNull(), F.col("salt")]  # points of one value may be very many, so the salt parts them
    both = cut(marks.unionByName(known).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    ranges, so_far = Window.orderBy("_range"), lambda *by: Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    # the first mark after a row is the last one before it in the opposite order: frames that shrink would be quadratic in a range
    before, after = F.last("mark", True).over(so_far(*order)), F.last("mark", True).over(so_far(*(o.desc() for o in order)))
    ends = both.groupBy("_range").agg(F.min("mark").alias("least"), F.max("mark").alias("most"))
    carried = ends.select("_range", F.last("most", True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("lower"), F.first("least", True).over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("upper"))
    found = both.select("*", before.alias("before"), after.alias("after")).where("row IS NOT NULL").join(F.broadcast(carried), "_range")
    found = found.select("row", "at", F.coalesce("before", "lower").alias("b"), F.coalesce("after", "upper").alias("a"))
    down, up = F.col("at") - F.col("b.at"), F.col("a.at") - F.col("at")
    idx = F.when(F.col("b").isNull() | (up < down), F.col("a.idx")).when(F.col("a").isNull() | (down < up), F.col("b.idx")).otherwise(F.least("a.idx", "b.idx"))
    rest = points.where(~F.coalesce(finite(value), F.lit(False))).select("*", F.lit(None).cast(axis.schema["idx"].dataType).alias(name))
    return found.select("row.*", idx.alias(name)).unionByName(rest)


def field_at(points: DataFrame, field: DataFrame, axes: dict[str, DataFrame]) -> DataFrame:
    """points with u and v of the nearest grid place on axes read from tables, each on its own; NaN and missing ones as 0.

    The axes are (idx, place) by the column of points that they measure; field has ``<column>_idx`` for each, u and v.
    """
    placed = points
    for column, axis in axes.items():
        placed = nearest_places(placed, column, axis, f"{column}_idx")
    joined = placed.join(field, [f"{c}_idx" for c in axes], "left")
    return joined.select(*points.columns, *(f"{c}_idx" for c in axes), *(F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c) for c in ("u", "v")))


def nearest_field(points: DataFrame, field: DataFrame, axes: dict[str, tuple[float, float, int]]) -> DataFrame:
    """points (t, lat, lon, ...) with u and v of the nearest grid place, each axis on its own; NaN as 0.

    field is (t_idx, lat_idx, lon_idx, u, v); axes give (first, step, count).  The place follows by arithmetic, so the
    field is joined by equality.
    """
    placed = points.select("*", *(nearest_index(F.col(k), *axes[k]).alias(f"{k}_idx") for k in ("t", "lat", "lon")))
    joined = placed.join(field, ["t_idx", "lat_idx", "lon_idx"], "left")
    return joined.select(*points.columns, *(F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c) for c in ("u", "v")))


def seed_particles(clusters: DataFrame, n: int = PARTICLES, sigma: float = 0.05) -> DataFrame:
    """(cluster_id, particle, lon, lat, ts): n places around each cluster, drawn lon and lat in turn from its own seed."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = []
            for row in frame.itertuples(index=False):
                d = np.random.default_rng(int(row.cluster_id) + 42).normal(0, sigma, (n, 2))
                parts.append(pd.DataFrame({"cluster_id": row.cluster_id, "particle": np.arange(n, dtype="int32"), "lon": row.lon + d[:, 0], "lat": row.lat + d[:, 1], "ts": row.ts}))
            yield pd.concat(parts) if parts else pd.DataFrame({"cluster_id": [], "particle": [], "lon": [], "lat": [], "ts": []})

    schema = f"cluster_id {clusters.schema['cluster_id'].dataType.simpleString()}, particle int, lon double, lat double, ts timestamp"
    return clusters.select("cluster_id", "lon", "lat", "ts").mapInPandas(draw, schema)


def _velocity(field: dict | None, lon: np.ndarray, lat: np.ndarray, hours: float):
    """Current and wind of a dense field at its nearest places; without a field small seeded draws for both."""
    if field is None:
        seeds = np.abs(lon * 1000 + lat * 1000).astype(np.int64)
        uv = np.array([np.random.default_rng(s).normal((0.02, 0.01), 0.01) for s in seeds]).reshape(-1, 2)
        return uv[:, 0], uv[:, 1], uv[:, 0], uv[:, 1]
    at = [np.abs(field["hours"] - hours).argmin(), np.abs(field["lats"][None] - lat[:, None]).argmin(1), np.abs(field["lons"][None] - lon[:, None]).argmin(1)]
    return tuple(np.nan_to_num(field[k][at[0], at[1], at[2]]) for k in ("u", "v", "u_wind", "v_wind"))


def trace_back(particles: DataFrame, field: dict | None, hours: int = HOURS, dt: float = 1.0) -> DataFrame:
    """(cluster_id, particle, step, hours_back, lon, lat): every particle's way back, step 0 being where it was seen.

    Fourth-order Runge-Kutta over batches of particles; ``field`` is one space-time block of numpy arrays on axes hours
    (back from the sighting), lats and lons, small enough to go to every task.  Latitude is held within 85 degrees and
    longitude wrapped after each step.
    """

    def speed(lon, lat, back):
        u, v, uw, vw = _velocity(field, lon, lat, back)
        east, north = CURRENT_SHARE * u + WIND_SHARE * uw, CURRENT_SHARE * v + WIND_SHARE * vw
        return -east / (METRES_PER_DEGREE * np.cos(np.radians(lat)) + 1e-10) * 3600, -north / METRES_PER_DEGREE * 3600

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lon, lat = frame["lon"].to_numpy(float), frame["lat"].to_numpy(float)
            for step in range(int(hours / dt) + 1):
                if step:
                    back = (step - 1) * dt
                    ax, ay = speed(lon, lat, back)
                    bx, by = speed(lon + ax * dt / 2, lat + ay * dt / 2, back + dt / 2)
                    cx, cy = speed(lon + bx * dt / 2, lat + by * dt / 2, back + dt / 2)
                    dx, dy = speed(lon + cx * dt, lat + cy * dt, back + dt)
                    lon = (lon + (ax + 2 * bx + 2 * cx + dx) / 6 * dt + 180) % 360 - 180
                    lat = np.clip(lat + (ay + 2 * by + 2 * cy + dy) / 6 * dt, -85, 85)
                yield pd.DataFrame({"cluster_id": frame["cluster_id"], "particle": frame["particle"], "step": np.int32(step), "hours_back": step * dt, "lon": lon, "lat": lat})

    schema = f"cluster_id {particles.schema['cluster_id'].dataType.simpleString()}, particle int, step int, hours_back double, lon double, lat double"
    # a table of one file is read by one task, and every particle makes a row a step
    dealt = particles.select("cluster_id", "particle", "lon", "lat").repartition(3 * particles.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInPandas(run, schema)


def endpoints(trajectories: DataFrame) -> DataFrame:
    """The oldest point of each particle."""
    return trajectories.groupBy("cluster_id", "particle").agg(F.max_by(F.struct("lon", "lat"), "step").alias("p")).select("cluster_id", "particle", "p.lon", "p.lat")


def trajectory_lines(trajectories: DataFrame) -> DataFrame:
    """Each particle's points from the oldest on, where there are two or more."""
    lines = trajectories.groupBy("cluster_id", "particle").agg(F.array_sort(F.collect_list(F.struct((-F.col("step")).alias("o"), "lon", "lat"))).alias("l"))
    return lines.where(F.size("l") >= 2).select("cluster_id", "particle", F.transform("l", lambda p: F.array(p["lon"], p["lat"])).alias("line"))


def source_regions(labelled: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """One row per region of labelled end points (grp, lon, lat, label): centre, extent, share of all the group's points.

    Noise is no region but counts in the share; a group of fewer than min_samples points is one region of share 1.
    """
    total = labelled.groupBy("grp").agg(F.count("*").alias("total"))
    sized = labelled.join(total, "grp").withColumn("label", F.when(F.col("total") < min_samples, 0).otherwise(F.col("label"))).where("label >= 0")
    out = sized.groupBy("grp", "label", "total").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.min("lon").alias("lon_min"), F.min("lat").alias("lat_min"), F.max("lon").alias("lon_max"), F.max("lat").alias("lat_max"), F.count("*").alias("n_particles"))
    ranked = out.withColumn("source_probability", F.col("n_particles") / F.col("total")).drop("total")
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n_particles"), "label")))
