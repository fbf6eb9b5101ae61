"""Queries over boxes, drift, source regions and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import RIVERS
from ..functions import geo as G
from ..functions import rules as R
from ..operators import attribution as A
from ..operators import drift as D
from ..operators import paths as P
from ..sources import supplied as S
from ..sources.session import cut, table
from .registry import register

REGIONS = "rg0 AS (SELECT s_suppkey AS source_id, s_suppkey % 10 AS cluster_id, (s_suppkey * 37 % 360 - 180)::DOUBLE AS lon, (s_suppkey * 53 % 170 - 85)::DOUBLE AS lat, (0.5 + s_nationkey % 5 / 4)::DOUBLE AS half FROM supplier), rg AS (SELECT *, lon - half AS lon_min, lat - half AS lat_min, lon + half AS lon_max, lat + half AS lat_max FROM rg0)"
#: Points of suppliers' customers' kind: groups of end points.
POINTS = "pt AS (SELECT c_nationkey AS grp, c_custkey AS id, (c_custkey * 7919 % 1000) / 1000.0::DOUBLE * 2 + c_custkey % 3 * 4 AS lon, (c_custkey * 104729 % 1000) / 1000.0::DOUBLE * 2 AS lat FROM customer)"
GROW = 10.0 / 111.0


def regions(spark, sf_dir):
    r = S.regions(spark, sf_dir)
    return r.select("*", *((F.col(c) + F.col("half") * sign).alias(f"{c}_{end}") for end, sign in (("min", -1), ("max", 1)) for c in ("lon", "lat")))


def points(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 7919 % 1000) / 1000.0 * 2 + F.col("c_custkey") % 3 * 4).alias("lon"), ((F.col("c_custkey") * 104729 % 1000) / 1000.0 * 2).alias("lat"))


@register("b17_expand_box", "source_id:i lon_min:d lat_min:d lon_max:d lat_max:d", f"SELECT source_id, lon_min - {GROW} AS lon_min, lat_min - {GROW} AS lat_min, lon_max + {GROW} AS lon_max, lat_max + {GROW} AS lat_max FROM rg", REGIONS)
def _(spark, sf_dir):
    return regions(spark, sf_dir).select("source_id", G.expand_box(F.struct("lon_min", "lat_min", "lon_max", "lat_max"), GROW).alias("b")).select("source_id", "b.*")


def _utm_sql() -> str:
    """The inverse series of the transverse Mercator projection with its constants worked out for WGS 84."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    e1, ep2 = (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5), e2 / (1 - e2)
    d = lambda v: f"{v!r}::DOUBLE"
    series = [(2, 3 * e1 / 2 - 27 * e1**3 / 32), (4, 21 * e1**2 / 16 - 55 * e1**4 / 32), (6, 151 * e1**3 / 96), (8, 1097 * e1**4 / 512)]
    steps = [
        "u0 AS (SELECT o_orderkey AS scene_id, floor((o_custkey % 360) / 6.0) + 1 AS zone, (500000 + o_orderkey % 1000 * 200 - 100000)::DOUBLE AS x, abs(o_orderkey % 140 - 70) * 110000::DOUBLE AS y FROM orders)",
        f"u1 AS (SELECT *, y / {d(k0)} / {d(a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))} AS mu FROM u0)",
        "u2 AS (SELECT *, mu + " + " + ".join(f"{d(w)} * sin({n} * mu)" for n, w in series) + " AS phi FROM u1)",
        f"u3 AS (SELECT *, {d(ep2)} * cos(phi) ** 2 AS c, tan(phi) ** 2 AS t, {d(a)} / sqrt(1 - {d(e2)} * sin(phi) ** 2) AS n, {d(a * (1 - e2))} / (1 - {d(e2)} * sin(phi) ** 2) ** 1.5 AS r FROM u2)",
        f"u4 AS (SELECT *, (x - 500000) / (n * {d(k0)}) AS d FROM u3)",
    ]
    lat = f"phi - n * tan(phi) / r * (d ** 2 / 2 - (5 + 3 * t + 10 * c - 4 * c ** 2 - {d(9 * ep2)}) * d ** 4 / 24 + (61 + 90 * t + 298 * c + 45 * t ** 2 - {d(252 * ep2)} - 3 * c ** 2) * d ** 6 / 720)"
    lon = f"(d - (1 + 2 * t + c) * d ** 3 / 6 + (5 - 2 * c + 28 * t - 3 * c ** 2 + {d(8 * ep2)} + 24 * t ** 2) * d ** 5 / 120) / cos(phi)"
    return ", ".join([*steps, f"u5 AS (SELECT scene_id, zone, degrees({lon}) AS dlon, degrees({lat}) AS lat FROM u4)"])


@register("b19_utm_to_lonlat", "scene_id:i near:b lon:d lat:d", "SELECT scene_id, abs(dlon) < 8 AS near, dlon + zone * 6 - 183 AS lon, lat FROM u5", _utm_sql())
def _(spark, sf_dir):
    """Places within zones of the catalogue's longitudes as longitude and latitude; ``near`` says that they lie by the zone."""
    c = S.catalogue(spark, sf_dir)
    zone = F.floor((F.col("lon") + 180) / 6) + 1
    x, y = F.lit(500000.0) + F.col("scene_id") % 1000 * 200 - 100000, F.abs("lat") * 110000
    lon, lat = G.utm_to_lonlat(x, y, zone)
    return c.select("scene_id", lon.alias("lon"), lat.alias("lat"), (F.abs(lon - (zone * 6 - 183)) < 8).alias("near"))


_RIVER = "rv AS (SELECT unnest([" + ",".join(f"{{'k': {k}, 'name': '{n}', 'x': {x}::DOUBLE, 'y': {y}::DOUBLE}}" for k, (n, x, y) in enumerate(RIVERS)) + "]) AS r), dist AS (SELECT source_id, r.k AS k, r.name AS name, sqrt(((lon - r.x) * 111 * cos(radians(lat))) ** 2 + ((lat - r.y) * 111) ** 2) AS km FROM rg, rv), nr AS (SELECT source_id, arg_min(name, (km, k)) AS nearest_river, min(km) AS river_km, greatest(0, 1 - min(km) / 200) AS river FROM dist GROUP BY 1)"


@register("c5_nearest_river", "source_id:i nearest_river:s river_km:d river:d", "SELECT * FROM nr", REGIONS + ", " + _RIVER)
def _(spark, sf_dir):
    name, km, score = A.nearest_river(F.col("lon"), F.col("lat"))
    return regions(spark, sf_dir).select("source_id", name.alias("nearest_river"), km.alias("river_km"), score.alias("river"))


@register("b20_flat_distance", "source_id:i km:d", "SELECT source_id, sqrt(((lon - half) * 111 * cos(radians(lat))) ** 2 + ((lat - 10) * 111) ** 2) AS km FROM rg", REGIONS)
def _(spark, sf_dir):
    return regions(spark, sf_dir).select("source_id", G.equirect_km(F.col("lon"), F.col("lat"), F.col("half"), F.lit(10.0)).alias("km"))


@register("b21_drift", "source_id:i east:d north:d", "SELECT source_id, (0.97 * half + 0.03 * 5) / (111000 * cos(radians(lat)) + 1e-10) * 3600 AS east, (0.97 * 0.2 - 0.03 * half) / 111000.0 * 3600 AS north FROM rg", REGIONS)
def _(spark, sf_dir):
    east, north = G.drift_per_hour(F.col("lat"), F.col("half"), F.lit(0.2), F.lit(5.0), -F.col("half"))
    return regions(spark, sf_dir).select("source_id", east.alias("east"), north.alias("north"))


@register("b22_wrap_and_clamp", "source_id:i lon:d lat:d", "SELECT source_id, ((lon * 3 + 180) - 360 * floor((lon * 3 + 180) / 360)) - 180 AS lon, greatest(-85, least(85, lat * 1.5)) AS lat FROM rg", REGIONS)
def _(spark, sf_dir):
    return regions(spark, sf_dir).select("source_id", G.wrap_lon(F.col("lon") * 3).alias("lon"), G.clamp_lat(F.col("lat") * 1.5).alias("lat"))


LOCATION = """CASE WHEN 79 < lon AND lon < 82 AND 5 < lat AND lat < 10 THEN 'Sri Lankan Coast' WHEN 87 < lon AND lon < 90 AND 20 < lat AND lat < 23 THEN 'Bay of Bengal (Bangladesh)'
 WHEN 100 < lon AND lon < 110 AND 5 < lat AND lat < 15 THEN 'Gulf of Thailand'
 ELSE 'Ocean region (' || printf('%.1f', abs(lon)) || '°' || CASE WHEN lon < 0 THEN 'W' ELSE 'E' END || ', ' || printf('%.1f', abs(lat)) || '°' || CASE WHEN lat < 0 THEN 'S' ELSE 'N' END || ')' END"""
COUNTRY = """CASE WHEN 79 < lon AND lon < 82 AND 5 < lat AND lat < 10 THEN 'Sri Lanka' WHEN 87 < lon AND lon < 93 AND 20 < lat AND lat < 27 THEN 'Bangladesh'
 WHEN 68 < lon AND lon < 78 AND 8 < lat AND lat < 24 THEN 'India' WHEN 95 < lon AND lon < 106 AND 5 < lat AND lat < 21 THEN 'Thailand/Vietnam' ELSE 'International Waters' END"""


@register("b26_place_names", "source_id:i location:s country:s", f"SELECT source_id, {LOCATION} AS location, {COUNTRY} AS country FROM rg", REGIONS)
def _(spark, sf_dir):
    return regions(spark, sf_dir).select("source_id", R.location_name(F.col("lon"), F.col("lat")).alias("location"), R.country_name(F.col("lon"), F.col("lat")).alias("country"))


@register("c4_nearest_field", "vessel_id:i u:d v:d", """SELECT vessel_id, CASE WHEN li % 7 = 3 THEN 0 ELSE (ti + 2 * li + oi) / 100.0 END AS u, (ti * li - oi) / 1000.0 AS v FROM (SELECT event_id AS vessel_id,
 greatest(0, least(30, ceil((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 86400.0 - 0.5)))::BIGINT AS ti, greatest(0, least(16, ceil((event_id % 170 - 85 + 80) / 10.0 - 0.5)))::BIGINT AS li, greatest(0, least(17, ceil((user_id * 7 % 360 - 180 + 170) / 20.0 - 0.5)))::BIGINT AS oi FROM events)""")
def _(spark, sf_dir):
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 86400
    p = S.vessel_activity(spark, sf_dir).select("vessel_id", "lon", "lat", at.alias("t"))
    axes = {"t": (0.0, 1.0, 31), "lat": (-80.0, 10.0, 17), "lon": (-170.0, 20.0, 18)}
    grid = spark.range(31 * 17 * 18).select(F.floor(F.col("id") / 306).cast("int").alias("t_idx"), (F.floor(F.col("id") / 18) % 17).cast("int").alias("lat_idx"), (F.col("id") % 18).cast("int").alias("lon_idx"))
    t, la, lo = F.col("t_idx"), F.col("lat_idx"), F.col("lon_idx")
    field = grid.select("*", F.when(la % 7 == 3, F.lit(float("nan"))).otherwise((t + 2 * la + lo) / 100).alias("u"), ((t * la - lo) / 1000).alias("v"))
    return D.nearest_field(p, field, axes)


#: Axes with uneven steps in no order: latitudes by nation, longitudes by supplier; customers are the field's places.
_UNEVEN = """lata AS (SELECT n_nationkey AS idx, n_nationkey * n_nationkey * 7 % 160 - 80 AS place FROM nation), lona AS (SELECT s_suppkey AS idx, s_suppkey * s_suppkey * 13 % 36000 / 100.0::DOUBLE - 180 AS place FROM supplier),
 ve AS (SELECT event_id AS vessel_id, user_id * 7.3::DOUBLE % 360 - 180 AS lon, (event_id % 170 - 85)::DOUBLE AS lat FROM events),
 lats AS (SELECT lat, arg_min(idx, (abs(lat - place), idx)) AS lat_idx FROM (SELECT DISTINCT lat FROM ve), lata GROUP BY 1), lons AS (SELECT lon, arg_min(idx, (abs(lon - place), idx)) AS lon_idx FROM (SELECT DISTINCT lon FROM ve), lona GROUP BY 1),
 fd AS (SELECT c_nationkey AS lat_idx, c_custkey % 50 AS lon_idx, sum(c_acctbal) AS u, CASE WHEN c_nationkey % 7 = 3 THEN 0 ELSE count(*) END AS v FROM customer GROUP BY 1, 2)"""


@register("c4_uneven_axes", "vessel_id:i lat_idx:i lon_idx:i u:d v:d", "SELECT vessel_id, lat_idx, lon_idx, coalesce(u, 0) AS u, coalesce(v, 0) AS v FROM ve JOIN lats USING (lat) JOIN lons USING (lon) LEFT JOIN fd USING (lat_idx, lon_idx)", _UNEVEN, 4)
def _(spark, sf_dir):
    e, n, s, c = (table(spark, sf_dir, t) for t in ("events", "nation", "supplier", "customer"))
    lat = n.select(F.col("n_nationkey").cast("long").alias("idx"), (F.col("n_nationkey") * F.col("n_nationkey") * 7 % 160 - 80).alias("place"))
    lon = s.select(F.col("s_suppkey").alias("idx"), (F.col("s_suppkey") * F.col("s_suppkey") * 13 % 36000 / 100.0 - 180).alias("place"))
    field = c.groupBy(F.col("c_nationkey").cast("long").alias("lat_idx"), (F.col("c_custkey") % 50).alias("lon_idx")).agg(F.sum("c_acctbal").alias("u"), F.count("*").cast("double").alias("v"))
    field = field.withColumn("v", F.when(F.col("lat_idx") % 7 == 3, F.lit(float("nan"))).otherwise(F.col("v")))
    vessels = e.select(F.col("event_id").alias("vessel_id"), (F.col("user_id") * F.lit(7.3) % 360 - 180).alias("lon"), (F.col("event_id") % 170 - 85).cast("double").alias("lat"))
    return D.field_at(vessels, field, {"lat": lat, "lon": lon})


@register("m5_seed_particles", "cluster_id:i particles:i near:b", f"SELECT source_id AS cluster_id, {D.PARTICLES} AS particles, true AS near FROM rg", REGIONS)
def _(spark, sf_dir):
    p = D.seed_particles(regions(spark, sf_dir).select(F.col("source_id").alias("cluster_id"), "lon", "lat", F.to_timestamp(F.lit("2024-01-15")).alias("ts")))
    r = regions(spark, sf_dir).select(F.col("source_id").alias("cluster_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return p.join(r, "cluster_id").groupBy("cluster_id").agg(F.count("*").alias("particles"), F.max((F.abs(F.col("lon") - F.col("x")) < 0.4).cast("int")).cast("boolean").alias("near"))


def trajectories(spark, sf_dir):
    """A day and a half back in a field that flows north at 0.5 m/s everywhere."""
    import numpy as np

    flat = np.zeros((1, 1, 1))
    field = {"hours": np.zeros(1), "lats": np.zeros(1), "lons": np.zeros(1), "u": flat, "v": flat + 0.5, "u_wind": flat, "v_wind": flat}
    seeds = regions(spark, sf_dir).where("abs(lat) < 80").select(F.col("source_id").alias("cluster_id"), F.lit(0).alias("particle"), "lon", "lat")
    return D.trace_back(seeds, field, hours=36)


@register("m6_trace_back", "cluster_id:i step:i lon:d lat:d", "SELECT source_id AS cluster_id, step, lon, lat - step * 0.97 * 0.5 / 111000 * 3600 AS lat FROM rg, (SELECT unnest(range(37)) AS step) WHERE abs(rg.lat) < 80", REGIONS)
def _(spark, sf_dir):
    return trajectories(spark, sf_dir)


#: A field of the customers' making on 6 x 14 x 21 places; cells without a customer are still water.
FLOW_AXES = {"t": (0.0, 6.3, 6), "lat": (-83.3, 12.9, 14), "lon": (-179.3, 17.7, 21)}
_FLOW = """fd AS (SELECT c_custkey % 1764 AS cell, 0.97::DOUBLE * flow_u + 0.03::DOUBLE * wind_u AS u, 0.97::DOUBLE * v + 0.03::DOUBLE * wind_v AS v
 FROM (SELECT c_custkey, c_acctbal::DOUBLE / 5000 AS flow_u, (c_nationkey - 12) / 10.0::DOUBLE AS v,
  (c_custkey * 7 % 31 - 15)::DOUBLE AS wind_u, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE (c_custkey * 11 % 29 - 14)::DOUBLE END AS wind_v,
  row_number() OVER (PARTITION BY c_custkey % 1764 ORDER BY c_custkey) AS k FROM customer) WHERE k = 1)"""


def _way_sql(keys: str, start: str, hours: int) -> str:
    """The steps as a recursive query: four looks at the nearest cell for each, every one from where the last one leads."""

    def nearest(axis: str, value: str) -> str:
        first, step, n = FLOW_AXES[axis]
        return f"greatest(0, least({n - 1}, ceil(({value} - ({first}::DOUBLE)) / {step}::DOUBLE - 0.5)))::BIGINT"

    def look(rows: str, name: str, lon: str, lat: str, back: str) -> str:
        cell = f"({nearest('t', back)} * 14 + {nearest('lat', lat)}) * 21 + {nearest('lon', lon)}"
        east = f"-coalesce(u, 0) / (111000 * cos(radians({lat})) + 1e-10) * 3600 AS {name}x"
        return f"(SELECT s.*, {east}, -coalesce(v, 0) / 111000 * 3600 AS {name}y FROM {rows} s LEFT JOIN fd ON fd.cell = {cell})"

    rows = look(f"(SELECT * FROM way WHERE step < {hours})", "p1", "lon", "lat", "step")
    rows = look(rows, "p2", "(lon + p1x * 0.5)", "(lat + p1y * 0.5)", "(step + 0.5)")
    rows = look(rows, "p3", "(lon + p2x * 0.5)", "(lat + p2y * 0.5)", "(step + 0.5)")
    rows = look(rows, "p4", "(lon + p3x)", "(lat + p3y)", "(step + 1)")
    turned = "(lon + (p1x + 2 * p2x + 2 * p3x + p4x) / 6 + 180)"
    wrapped = f"{turned} - 360 * floor({turned} / 360) - 180"
    onward = f"SELECT {keys}, step + 1, {wrapped}, greatest(-85, least(85, lat + (p1y + 2 * p2y + 2 * p3y + p4y) / 6)) FROM {rows}"
    return f"way AS ({start} UNION ALL {onward})"


def flow(spark, sf_dir):
    """The field as a table; one component is NaN in places."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    first = c.groupBy((key % 1764).alias("cell")).agg(F.min_by(F.struct("c_custkey", "c_nationkey", "c_acctbal"), key).alias("c")).select("cell", "c.*")
    at = {"t_idx": F.floor(F.col("cell") / 294), "lat_idx": F.floor(F.col("cell") / 21) % 14, "lon_idx": F.col("cell") % 21}
    wind_v = F.when(key % 5 == 0, F.lit(float("nan"))).otherwise((key * 11 % 29 - 14).cast("double"))
    parts = {"u": F.col("c_acctbal").cast("double") / 5000, "v": (F.col("c_nationkey") - 12) / 10.0, "u_wind": (key * 7 % 31 - 15).cast("double"), "v_wind": wind_v}
    return first.select(*(v.cast("int").alias(k) for k, v in at.items()), *(v.alias(k) for k, v in parts.items()))


_FROM_REGIONS = _way_sql("cluster_id", "SELECT source_id AS cluster_id, 0 AS step, lon, lat FROM rg", 36)


@register("m6_trace_field", "cluster_id:i step:i lon:d lat:d", "SELECT * FROM way", ", ".join(("RECURSIVE " + REGIONS, _FLOW, _FROM_REGIONS)), 4)
def _(spark, sf_dir):
    """A day and a half back, from every region, through a field that changes by place and time."""
    seeds = regions(spark, sf_dir).select(F.col("source_id").alias("cluster_id"), F.lit(0).alias("particle"), "lon", "lat")
    return P.trace_paths(seeds, flow(spark, sf_dir), FLOW_AXES, hours=36)


PATHS = "tj AS (SELECT user_id % 20 AS cluster_id, user_id AS particle, event_id AS step, (user_id * 7 % 360 - 180)::DOUBLE AS lon, (event_id % 170 - 85)::DOUBLE AS lat FROM events)"


def paths(spark, sf_dir):
    """The events of a user as the steps of a particle."""
    e = S.table(spark, sf_dir, "events")
    lon, lat = F.col("user_id") * 7 % 360 - 180, F.col("event_id") % 170 - 85
    return e.select((F.col("user_id") % 20).alias("cluster_id"), F.col("user_id").alias("particle"), F.col("event_id").alias("step"), lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


@register("d26_endpoints", "cluster_id:i particle:i lon:d lat:d", "SELECT cluster_id, particle, arg_max(lon, step) AS lon, arg_max(lat, step) AS lat FROM tj GROUP BY 1, 2", PATHS)
def _(spark, sf_dir):
    return D.endpoints(paths(spark, sf_dir))


@register("d27_trajectory_lines", "cluster_id:i particle:i n:i first_lat:d last_lat:d", "SELECT cluster_id, particle, count(*) AS n, arg_max(lat, step) AS first_lat, arg_min(lat, step) AS last_lat FROM tj GROUP BY 1, 2 HAVING count(*) > 1", PATHS)
def _(spark, sf_dir):
    at = lambda k: F.element_at(F.element_at("line", k), 2)
    return D.trajectory_lines(paths(spark, sf_dir)).select("cluster_id", "particle", F.size("line").alias("n"), at(1).alias("first_lat"), at(-1).alias("last_lat"))


NEAR = POINTS + ", nb AS (SELECT a.grp, a.id AS a, b.id AS b FROM pt a JOIN pt b ON a.grp = b.grp AND (a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2 <= 0.25)"
DBSCAN = NEAR + """, core AS (SELECT grp, a AS id FROM nb GROUP BY 1, 2 HAVING count(*) >= 5), ce AS (SELECT nb.* FROM nb JOIN core x ON nb.grp = x.grp AND nb.a = x.id JOIN core y ON nb.grp = y.grp AND nb.b = y.id),
 reach AS (SELECT grp, id, id AS l FROM core UNION SELECT ce.grp, ce.b, reach.l FROM reach JOIN ce ON ce.grp = reach.grp AND ce.a = reach.id WHERE reach.l < ce.b),
 root AS (SELECT grp, id, min(l) AS root FROM reach GROUP BY 1, 2), num AS (SELECT *, dense_rank() OVER (PARTITION BY grp ORDER BY root) - 1 AS label FROM root),
 bd AS (SELECT nb.grp, nb.a AS id, min(label) AS label FROM nb JOIN num ON nb.grp = num.grp AND nb.b = num.id GROUP BY 1, 2),
 lab AS (SELECT pt.*, coalesce(num.label, bd.label, -1) AS label FROM pt LEFT JOIN num USING (grp, id) LEFT JOIN bd USING (grp, id))"""


@register("c12_near_pairs", "grp:i id:i neighbours:i", "SELECT grp, a AS id, count(*) AS neighbours FROM nb GROUP BY 1, 2", NEAR)
def _(spark, sf_dir):
    return D.near_counts(points(spark, sf_dir), 0.5).select("grp", "id", F.col("near").alias("neighbours"))


@register("m8_dbscan", "grp:i id:i label:i", "SELECT grp, id, label FROM lab", "RECURSIVE " + DBSCAN)
def _(spark, sf_dir):
    return D.dbscan(points(spark, sf_dir))


#: Regions of labelled points.
_SUMMED = """SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY n DESC, label) AS rank, label, lon, lat, n AS n_particles, n / total AS source_probability
 FROM (SELECT grp, label, avg(lon) AS lon, avg(lat) AS lat, count(*) AS n, any_value(total) AS total FROM (SELECT grp, lon, lat, CASE WHEN count(*) OVER (PARTITION BY grp) < 5 THEN 0 ELSE label END AS label, count(*) OVER (PARTITION BY grp) AS total FROM lab) WHERE label >= 0 GROUP BY 1, 2)"""


@register("d28_source_regions", "grp:i rank:i label:i lon:d lat:d n_particles:i source_probability:d", _SUMMED, "RECURSIVE " + DBSCAN)
def _(spark, sf_dir):
    return D.source_regions(D.dbscan(points(spark, sf_dir)))


#: Customers as particles, on steps that leave no two of them exactly the radius apart, which rounding would decide.
_STARTS = "SELECT c_nationkey AS grp, c_custkey AS id, 0 AS step, (c_custkey * 7919 % 1000) * 0.0020137::DOUBLE + c_custkey % 3 * 4 AS lon, (c_custkey * 104729 % 1000) * 0.0020071::DOUBLE AS lat FROM customer"
_ENDS = "pt AS (SELECT grp, id, lon, lat FROM way WHERE step = 24)"


@register(
    "m9_backtrack_field",
    "grp:i rank:i label:i lon:d lat:d n_particles:i source_probability:d",
    _SUMMED,
    ", ".join(("RECURSIVE " + _FLOW, _way_sql("grp, id", _STARTS, 24), DBSCAN.replace(POINTS, _ENDS))),
    4,
)
def _(spark, sf_dir):
    """Back-tracking from end to end: customers as particles of their nation, a day back, end points clustered and summed up."""
    key = F.col("c_custkey")
    lon, lat = (key * 7919 % 1000) * F.lit(0.0020137) + key % 3 * 4, (key * 104729 % 1000) * F.lit(0.0020071)
    seeds = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cluster_id"), key.alias("particle"), lon.alias("lon"), lat.alias("lat"))
    ends = cut(D.endpoints(P.trace_paths(seeds, flow(spark, sf_dir), FLOW_AXES, hours=24)))  # read more than once
    return D.source_regions(D.dbscan(ends.select(F.col("cluster_id").alias("grp"), F.col("particle").alias("id"), "lon", "lat")))


SITES = "st AS (SELECT p_partkey AS site_id, p_name AS name, p_type AS tag, (p_partkey * 11 % 360 - 180)::DOUBLE AS slon, (p_partkey * 29 % 170 - 85)::DOUBLE AS slat FROM part)"
VESSELS = "va AS (SELECT event_id AS vessel_id, ts, (user_id * 7 % 360 - 180)::DOUBLE AS vlon, (event_id % 170 - 85)::DOUBLE AS vlat FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20')"
LANES = "ln AS (SELECT n_nationkey AS lane_id, (n_nationkey * 14 - 180)::DOUBLE AS x1, (n_nationkey * 31 % 120 - 60)::DOUBLE AS y1 FROM nation)"
_BOX = f"lon_min - {GROW} AND lon_max + {GROW}", f"lat_min - {GROW} AND lat_max + {GROW}"
SITE_SCORES = SITES + f", ss AS (SELECT source_id, CASE WHEN abs(lat) >= 80 THEN 0 ELSE n END AS site_count, CASE WHEN abs(lat) >= 80 THEN '' ELSE coalesce(names, '') END AS names, CASE WHEN abs(lat) >= 80 THEN 0.2 ELSE least(1, n / 10) END AS industrial FROM (SELECT source_id, any_value((lat_min + lat_max) / 2) AS lat, count(site_id) AS n, array_to_string((list(name ORDER BY site_id) FILTER (site_id IS NOT NULL))[1:10], '|') AS names FROM rg LEFT JOIN st ON slon BETWEEN {_BOX[0]} AND slat BETWEEN {_BOX[1]} GROUP BY 1))"
FISHING = VESSELS + f", fs AS (SELECT source_id, CASE WHEN off THEN 0 ELSE n END AS vessel_count, CASE WHEN off THEN '' ELSE coalesce(ids, '') END AS ids, CASE WHEN off THEN greatest(0, 1 - abs(mid) / 60) * 0.5 ELSE least(1, n / 20) END AS fishing FROM (SELECT source_id, mid, n, ids, max(abs(mid) >= 80) OVER (PARTITION BY cluster_id ORDER BY source_id) AS off FROM (SELECT source_id, any_value(cluster_id) AS cluster_id, any_value((lat_min + lat_max) / 2) AS mid, count(vessel_id) AS n, array_to_string((list(vessel_id ORDER BY vessel_id) FILTER (vessel_id IS NOT NULL))[1:10], '|') AS ids FROM rg LEFT JOIN va ON vlon BETWEEN {_BOX[0]} AND vlat BETWEEN {_BOX[1]} GROUP BY 1)))"
SHIPPING = LANES + ", ls AS (SELECT source_id, coalesce(sum(greatest(0, least(lon_max, x1 + 25) - greatest(lon_min, x1)) * greatest(0, least(lat_max, y1 + 12) - greatest(lat_min, y1))), 0) AS overlap_area, any_value((lon_max - lon_min) * (lat_max - lat_min)) AS own FROM rg, ln GROUP BY 1), sh AS (SELECT source_id, overlap_area, least(1, overlap_area / (own + 1e-10)) AS shipping FROM ls)"


@register("c7_site_scores", "source_id:i site_count:i names:s industrial:d", "SELECT * FROM ss", REGIONS + ", " + SITE_SCORES)
def _(spark, sf_dir):
    return A.site_scores(regions(spark, sf_dir), S.sites(spark, sf_dir)).withColumn("names", F.array_join("site_names", "|"))


@register("c8_fishing_scores", "source_id:i vessel_count:i ids:s fishing:d", "SELECT * FROM fs", REGIONS + ", " + FISHING)
def _(spark, sf_dir):
    return A.fishing_scores(regions(spark, sf_dir), S.vessel_activity(spark, sf_dir), "2024-01-05", "2024-01-20").withColumn("ids", F.array_join("vessel_ids", "|"))


@register("c6_lane_scores", "source_id:i overlap_area:d shipping:d", "SELECT * FROM sh", REGIONS + ", " + SHIPPING)
def _(spark, sf_dir):
    return A.lane_scores(regions(spark, sf_dir), S.lanes(spark, sf_dir))


#: Rings of four to eight corners around the nations' places, some of them concave.
_RINGS = """rl AS (SELECT lane_id, n, [{'x': cx + (8 + lane_id * (k + 1) % 11) * cos(2 * pi() * k / n), 'y': cy + (5 + (lane_id + 3) * (k + 2) % 7) * sin(2 * pi() * k / n)} for k in range(n)] AS ring
 FROM (SELECT n_nationkey AS lane_id, 4 + n_nationkey % 5 AS n, (n_nationkey * 14 - 170)::DOUBLE AS cx, (n_nationkey * 31 % 120 - 60)::DOUBLE AS cy FROM nation)),
 re AS (SELECT lane_id, ring[k].x AS px, ring[k].y AS py, ring[k % n + 1].x AS qx, ring[k % n + 1].y AS qy FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM rl))"""
#: The area of a ring within a box as a sum over its sides: the integral, over the part of a side between the box's left and
#: right, of its height above the box's bottom, held between 0 and the box's height (mean of a clamp of a linear function).
_STRIPS = """eb AS (SELECT source_id, lane_id, greatest(lon_min, least(lon_max, px)) AS xa, greatest(lon_min, least(lon_max, qx)) AS xb, px, py, qx, qy, lat_min, lat_max - lat_min AS h FROM rg, re),
 ec AS (SELECT source_id, lane_id, xb - xa AS w, h, CASE WHEN qx = px THEN 0 ELSE py + (xa - px) * (qy - py) / (qx - px) - lat_min END AS u, CASE WHEN qx = px THEN 0 ELSE py + (xb - px) * (qy - py) / (qx - px) - lat_min END AS v FROM eb),
 ed AS (SELECT *, CASE WHEN u < 0 THEN 0 WHEN u < h THEN u * u / 2 ELSE h * u - h * h / 2 END AS gu, CASE WHEN v < 0 THEN 0 WHEN v < h THEN v * v / 2 ELSE h * v - h * h / 2 END AS gv FROM ec),
 pa AS (SELECT source_id, lane_id, abs(sum(CASE WHEN abs(v - u) < 1e-12 THEN w * greatest(0, least(h, u)) ELSE w * (gv - gu) / (v - u) END)) AS area FROM ed GROUP BY 1, 2),
 ps AS (SELECT source_id, sum(area) AS overlap_area FROM pa GROUP BY 1)"""


@register("c6_polygon_lanes", "source_id:i overlap_area:d shipping:d", "SELECT source_id, overlap_area, least(1, overlap_area / ((lon_max - lon_min) * (lat_max - lat_min) + 1e-10)) AS shipping FROM ps JOIN rg USING (source_id)", ", ".join((REGIONS, _RINGS, _STRIPS)))
def _(spark, sf_dir):
    return A.polygon_lane_scores(regions(spark, sf_dir), S.ring_lanes(spark, sf_dir))


@register("c6_corridor_heuristic", "source_id:i score:d", "SELECT source_id, CASE WHEN (5 < lat AND lat < 25 AND 60 < lon AND lon < 120) OR (0 < lat AND lat < 40 AND -10 < lon AND lon < 40) OR (20 < lat AND lat < 50 AND 100 < lon AND lon < 180) THEN 0.6 ELSE 0.2 END AS score FROM rg", REGIONS)
def _(spark, sf_dir):
    return regions(spark, sf_dir).select("source_id", A.corridor_score(F.col("lon"), F.col("lat")).alias("score"))


@register("e5_latching_breaker", "cluster_id:i heuristic:i", "SELECT cluster_id, count(*) FILTER (WHERE off) AS heuristic FROM (SELECT cluster_id, max(abs(lat) >= 80) OVER (PARTITION BY cluster_id ORDER BY source_id) AS off FROM rg) GROUP BY 1", REGIONS)
def _(spark, sf_dir):
    r = regions(spark, sf_dir)
    polar = r.where("abs(lat) >= 80").groupBy("cluster_id").agg(F.min("source_id").alias("first"))
    scored = A.fishing_scores(r, S.vessel_activity(spark, sf_dir), "2024-01-05", "2024-01-20").join(r.select("source_id", "cluster_id"), "source_id")
    out = scored.join(polar, "cluster_id", "left").withColumn("off", F.coalesce(F.col("source_id") >= F.col("first"), F.lit(False)))
    return out.groupBy("cluster_id").agg(F.sum(F.col("off").cast("long")).alias("heuristic"))


def attributed(spark, sf_dir):
    return A.attribute(regions(spark, sf_dir), S.sites(spark, sf_dir), None, S.vessel_activity(spark, sf_dir), S.lanes(spark, sf_dir), "2024-01-05", "2024-01-20")


_SPOT = "'(' || printf('%.2f', lon) || ', ' || printf('%.2f', lat) || ')'"
_WHY = f"""CASE WHEN attribution_score > 0.6 THEN 'High' WHEN attribution_score > 0.3 THEN 'Moderate' ELSE 'Low' END || ' probability (' || printf('%.0f', attribution_score * 100) || '%): '
 || CASE source_type WHEN 'fishing' THEN 'Fishing activity near ' || {_SPOT} || '. ' || vessel_count || ' vessel(s) detected in this area ~30 days before detection.'
 WHEN 'industrial' THEN site_count || ' industrial/waste site(s)' || CASE WHEN names = '' THEN '' ELSE ' (' || array_to_string(string_split(names, '|')[1:3], ', ') || ')' END || ' within search radius of source region at ' || {_SPOT} || '.'
 WHEN 'shipping' THEN 'Major shipping lane overlap near ' || {_SPOT} || '. Estimated 30 days drift time.'
 ELSE 'River discharge from ' || nearest_river || ' (' || printf('%.0f', river_km) || ' km from source region). Estimated 30 days drift time.' END"""
ATTRIBUTED = ", ".join((REGIONS, _RIVER, SITE_SCORES, FISHING, SHIPPING)) + f""", sc AS (SELECT *, 0.4 * fishing + 0.3 * industrial + 0.2 * shipping + 0.1 * river AS attribution_score, greatest(fishing, industrial, shipping, river) AS most,
 {LOCATION} AS location_name, {COUNTRY} AS country
 FROM rg JOIN fs USING (source_id) JOIN ss USING (source_id) JOIN sh USING (source_id) JOIN nr USING (source_id)),
 atk AS (SELECT *, CASE WHEN fishing = most THEN 'fishing' WHEN industrial = most THEN 'industrial' WHEN shipping = most THEN 'shipping' ELSE 'river' END AS source_type,
 row_number() OVER (PARTITION BY cluster_id ORDER BY source_id) AS source_rank, row_number() OVER (PARTITION BY cluster_id ORDER BY attribution_score DESC, source_id) AS report_rank FROM sc),
 atr AS (SELECT *, {_WHY} AS explanation, CASE WHEN attribution_score > 0.6 THEN 'high' WHEN attribution_score > 0.3 THEN 'moderate' ELSE 'low' END AS confidence FROM atk)"""
_REPORT = (
    "source_id:i cluster_id:i source_rank:i report_rank:i source_type:s location_name:s country:s attribution_score:d confidence:s explanation:s "
    "lon:d lat:d lon_min:d lat_min:d lon_max:d lat_max:d fishing:d industrial:d shipping:d river:d ids:s"
)


@register("m10_attribution", _REPORT, "SELECT * FROM atr", ATTRIBUTED)
def _(spark, sf_dir):
    """Every field of a report's entry: ranks, kind, place, score, band, reason, centre, box, the four scores, vessels' ids."""
    return attributed(spark, sf_dir).withColumn("ids", F.array_join("vessel_ids", "|"))


@register("d29_dominant_source", "source_type:s sources:i score:d", "SELECT source_type, count(*) AS sources, avg(attribution_score) AS score FROM atr GROUP BY 1", ATTRIBUTED)
def _(spark, sf_dir):
    return attributed(spark, sf_dir).groupBy("source_type").agg(F.count("*").alias("sources"), F.avg("attribution_score").alias("score"))


@register("b24_confidence_band", "confidence:s sources:i", "SELECT confidence, count(*) AS sources FROM atr GROUP BY 1", ATTRIBUTED)
def _(spark, sf_dir):
    return attributed(spark, sf_dir).groupBy("confidence").agg(F.count("*").alias("sources"))


@register("b25_explanation", "source_id:i explanation:s", "SELECT source_id, explanation FROM atr", ATTRIBUTED)
def _(spark, sf_dir):
    return attributed(spark, sf_dir)


@register("d33_extent", "lon_min:d lat_min:d lon_max:d lat_max:d", "SELECT min(lon) - 5 AS lon_min, min(lat) - 5 AS lat_min, max(lon) + 5 AS lon_max, max(lat) + 5 AS lat_max FROM rg", REGIONS)
def _(spark, sf_dir):
    e = regions(spark, sf_dir).agg(F.struct(F.min("lon").alias("lon_min"), F.min("lat").alias("lat_min"), F.max("lon").alias("lon_max"), F.max("lat").alias("lat_max")).alias("b"))
    return e.select(G.expand_box(F.col("b"), 5.0).alias("b")).select("b.*")


@register("c1_report_join", "cluster_id:i best_type:s last_type:s", """SELECT cluster_id, arg_min(source_type, report_rank) AS best_type, arg_max(source_type, report_rank) AS last_type FROM atr GROUP BY 1""", ATTRIBUTED)
def _(spark, sf_dir):
    from ..operators.catalogue import report_join

    a = attributed(spark, sf_dir)
    d = regions(spark, sf_dir).select("cluster_id").distinct()
    last = report_join(d, a, "last").select("cluster_id", F.col("source_type").alias("last_type"))
    return report_join(d, a).select("cluster_id", F.col("source_type").alias("best_type")).join(last, "cluster_id")


@register("m9_backtrack_regions", "grp:i regions:i share:d")
def _(spark, sf_dir):
    """Particles seeded around regions, traced back, end points clustered and summed up."""
    import numpy as np

    flat = np.zeros((1, 1, 1))
    field = {"hours": np.zeros(1), "lats": np.zeros(1), "lons": np.zeros(1), "u": flat + 0.1, "v": flat, "u_wind": flat, "v_wind": flat}
    seeds = D.seed_particles(regions(spark, sf_dir).where("abs(lat) < 80").select(F.col("source_id").alias("cluster_id"), "lon", "lat", F.to_timestamp(F.lit("2024-01-15")).alias("ts")), n=20)
    ends = cut(D.endpoints(D.trace_back(seeds, field, hours=24)))  # read more than once
    p = ends.select(F.col("cluster_id").alias("grp"), F.col("particle").cast("long").alias("id"), "lon", "lat")
    return D.source_regions(D.dbscan(p)).groupBy("grp").agg(F.count("*").alias("regions"), F.sum("source_probability").alias("share"))
