"""Ways back of particles through fields that are tables: Runge-Kutta steps as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CURRENT_SHARE, HOURS, METRES_PER_DEGREE, WIND_SHARE
from ..functions.geo import clamp_lat, wrap_lon
from ..sources.session import Scratch
from .drift import nearest_field, nearest_index

#: Cells of a field that tasks may hold as one array (two doubles a cell); a larger field is joined step by step.
HELD_CELLS = 100_000

_CELL = ("t_idx", "lat_idx", "lon_idx")


def _place(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def _moved(at: Column, pace: Column, hours: float) -> Column:
    return _place(at["lon"] + pace["lon"] * hours, at["lat"] + pace["lat"] * hours)


def _pace(lat: Column, u: Column, v: Column) -> Column:
    """Degrees an hour backwards at a latitude, from metres a second."""
    return _place(-u / (METRES_PER_DEGREE * F.cos(F.radians(lat)) + 1e-10) * 3600, -v / METRES_PER_DEGREE * 3600)


def _arrived(at: Column, a: Column, b: Column, c: Column, d: Column, dt: float) -> Column:
    mean = lambda k: (a[k] + 2 * b[k] + 2 * c[k] + d[k]) / 6 * dt
    lat = at["lat"] + mean("lat")
    return _place(wrap_lon(at["lon"] + mean("lon")), F.when(lat.isNotNull(), clamp_lat(lat)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _drifts(field: DataFrame) -> DataFrame:
    """(t_idx, lat_idx, lon_idx, u, v): current and wind as one velocity; what is not finite counts as 0."""
    known = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double")).otherwise(0.0)
    both = lambda k: CURRENT_SHARE * known(k) + WIND_SHARE * known(f"{k}_wind")
    one = field.groupBy(*_CELL).agg(F.min(F.struct(both("u").alias("u"), both("v").alias("v"))).alias("m"))
    return one.select(*_CELL, "m.u", "m.v")


def trace_paths(
    particles: DataFrame,
    field: DataFrame,
    axes: dict[str, tuple[float, float, int]],
    hours: int = HOURS,
    dt: float = 1.0,
    held_cells: int = HELD_CELLS,
) -> DataFrame:
    """(cluster_id, particle, step, hours_back, lon, lat): every particle's way back, step 0 being where it was seen.

    ``field`` is (t_idx, lat_idx, lon_idx, u, v, u_wind, v_wind) on regular axes, (first, step, count) each of t (hours
    back from the sighting), lat and lon.  A velocity is that of the nearest cell; missing cells and values that are not
    finite are still water, and of several rows for a cell the least counts.  Latitude is held within 85 degrees and
    longitude wrapped after each step.  A particle without a finite place has null places at every step; repeated
    particles give repeated rows.

    A field of up to ``held_cells`` cells (by its axes) is one row that is broadcast, and a way is a fold over its steps:
    particles are shuffled once, to deal them over tasks.  A larger one is joined by cell, four times a step, and every step is a table.
    """
    steps, field = int(hours / dt), _drifts(field)
    finite = (F.abs(F.col("lon")) < float("inf")) & (F.abs(F.col("lat")) < float("inf"))
    start = F.when(finite, _place(F.col("lon").cast("double"), F.col("lat").cast("double"))).otherwise(
        _place(F.lit(None).cast("double"), F.lit(None).cast("double"))
    )
    seeds = particles.select("cluster_id", "particle", start.alias("at"))
    cells = axes["t"][2] * axes["lat"][2] * axes["lon"][2]
    ways = _folded(seeds, field, axes, cells, steps, dt) if cells <= held_cells else _joined(seeds, field, axes, steps, dt)
    return ways.select("cluster_id", "particle", F.col("step").cast("int").alias("step"), (F.col("step") * F.lit(float(dt))).alias("hours_back"), "at.lon", "at.lat")


def _folded(seeds: DataFrame, field: DataFrame, axes: dict, cells: int, steps: int, dt: float) -> DataFrame:
    n_lat, n_lon = axes["lat"][2], axes["lon"][2]
    number = lambda t, lat, lon: (t * n_lat + lat) * n_lon + lon
    inside = F.lit(True)
    for name, (_, _, n) in axes.items():
        inside = inside & F.col(f"{name}_idx").between(0, n - 1)
    numbered = field.where(inside).select(number(*(F.col(c).cast("long") for c in _CELL)).alias("id"), "u", "v")
    dense = seeds.sparkSession.range(cells).join(numbered, "id", "left")
    row = dense.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("u", F.lit(0.0)).alias("u"), F.coalesce("v", F.lit(0.0)).alias("v")))).alias("cells"))
    row = row.select(F.transform("cells", lambda c: F.struct(c["u"].alias("u"), c["v"].alias("v"))).alias("cells"))

    def speed(at: Column, back: Column) -> Column:
        t, lat, lon = nearest_index(back, *axes["t"]), nearest_index(at["lat"], *axes["lat"]), nearest_index(at["lon"], *axes["lon"])
        return _let(F.element_at("cells", number(t, lat, lon) + 1), lambda w: _pace(at["lat"], w["u"], w["v"]))

    def step(way: Column, k: Column) -> Column:
        def onward(at: Column) -> Column:
            back = (k - 1) * F.lit(float(dt))
            half, whole = back + dt / 2, back + dt
            d = lambda a, b, c: _let(speed(_moved(at, c, dt), whole), lambda d: _arrived(at, a, b, c, d, dt))
            c = lambda a, b: _let(speed(_moved(at, b, dt / 2), half), lambda c: d(a, b, c))
            b = lambda a: _let(speed(_moved(at, a, dt / 2), half), lambda b: c(a, b))
            return _let(speed(at, back), b)

        return F.concat(way, F.array(_let(F.element_at(way, -1), onward)))

    later = F.sequence(F.lit(1), F.lit(steps)) if steps else F.array().cast("array<int>")
    way = F.aggregate(later, F.array("at"), step)
    # a table of one file is read by one task, and a way is much work for a row
    dealt = seeds.repartition(3 * seeds.sparkSession.sparkContext.defaultParallelism)
    return dealt.crossJoin(F.broadcast(row)).select("cluster_id", "particle", F.posexplode(way).alias("step", "at"))


def _joined(seeds: DataFrame, field: DataFrame, axes: dict, steps: int, dt: float) -> DataFrame:
    scratch = Scratch(seeds.sparkSession)

    def speed(rows: DataFrame, name: str, at: Column, back: float) -> DataFrame:
        found = nearest_field(rows.withColumns({"t": F.lit(float(back)), "lat": at["lat"], "lon": at["lon"]}), field, axes)
        return found.withColumn(name, _pace(F.col("lat"), F.col("u"), F.col("v"))).drop("t", "lat", "lon", "u", "v")

    now = scratch.table("0", seeds.withColumn("step", F.lit(0)))
    for k in range(1, steps + 1):
        at, back, rows = F.col("at"), (k - 1) * dt, now.drop("step")
        rows = speed(rows, "a", at, back)
        rows = speed(rows, "b", _moved(at, F.col("a"), dt / 2), back + dt / 2)
        rows = speed(rows, "c", _moved(at, F.col("b"), dt / 2), back + dt / 2)
        rows = speed(rows, "d", _moved(at, F.col("c"), dt), back + dt)
        arrived = _arrived(at, *(F.col(x) for x in "abcd"), dt)
        now = scratch.table(str(k), rows.select("cluster_id", "particle", arrived.alias("at"), F.lit(k).alias("step")))
    return scratch.last(seeds.sparkSession.read.schema(now.schema).parquet(*scratch.paths.values()))
