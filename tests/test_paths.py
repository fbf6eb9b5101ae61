"""Ways through a field of cells against the plain trace over arrays."""

import math

import numpy as np
import pytest

from flotsam.operators.drift import trace_back
from flotsam.operators.paths import trace_paths

AXES = {"t": (0.0, 1.3, 4), "lat": (-83.3, 12.9, 14), "lon": (-179.3, 17.7, 21)}
FIELD = "t_idx int, lat_idx int, lon_idx int, u double, v double, u_wind double, v_wind double"
SEEDS = "cluster_id long, particle int, lon double, lat double"


def _places(name):
    first, step, n = AXES[name]
    return first + step * np.arange(n)


def _rows(df):
    return sorted((r.cluster_id, r.particle, r.step, r.hours_back, r.lon, r.lat) for r in df.collect())


@pytest.mark.parametrize("held", [10_000, 0])
def test_ways_equal_the_plain_trace(spark, held):
    rng = np.random.default_rng(7)
    shape = tuple(AXES[k][2] for k in ("t", "lat", "lon"))
    blocks = {k: rng.normal(0, 4, shape) for k in ("u", "v", "u_wind", "v_wind")}
    blocks["u"][1, :, 3] = np.nan
    kept = rng.random(shape) < 0.8
    cells = [(*map(int, at), *(float(blocks[k][at]) for k in blocks)) for at in np.ndindex(shape) if kept[at]]
    plain = {k: np.where(kept, b, 0) for k, b in blocks.items()}
    seeds = [(k, 0, float(rng.uniform(-180, 180)), float(rng.uniform(-84, 84))) for k in range(12)]
    seeds += [(20, 0, 179.99, 0.3), (21, 0, -179.99, 0.3), (22, 0, 5.1, 84.99), (23, 1, 5.1, -84.99)]
    particles = spark.createDataFrame(seeds, SEEDS)
    got = _rows(trace_paths(particles, spark.createDataFrame(cells, FIELD), AXES, 4, held_cells=held))
    want = _rows(trace_back(particles, {"hours": _places("t"), "lats": _places("lat"), "lons": _places("lon"), **plain}, 4))
    assert [g[:4] for g in got] == [w[:4] for w in want] and len(got) == 5 * len(seeds)
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], atol=1e-9)


@pytest.mark.parametrize("held", [10_000, 0])
def test_odd_particles_and_fields(spark, held):
    nan, inf = float("nan"), float("inf")
    odd = [(1, 0, None, 3.0), (2, 0, nan, 3.0), (3, 0, 4.0, inf), (4, 0, 1.0, 2.0), (4, 0, 1.0, 2.0)]
    particles = spark.createDataFrame(odd, SEEDS)
    still = spark.createDataFrame([], FIELD)
    rows = trace_paths(particles, still, AXES, 2, held_cells=held).collect()
    assert len(rows) == 15
    assert all((r.lon, r.lat) == ((1.0, 2.0) if r.cluster_id == 4 else (None, None)) for r in rows)
    assert trace_paths(particles.limit(0), still, AXES, 2, held_cells=held).count() == 0
    assert trace_paths(particles, still, AXES, 0, held_cells=held).count() == 5
    # two rows for a cell: the least counts; values without an end are still water; a cell beyond the axes is none
    lat, lon = (round((at - AXES[k][0]) / AXES[k][1]) for k, at in (("lat", 2.0), ("lon", 1.0)))
    flow = [(0, lat, lon, inf, 1.0, nan, None), (0, lat, lon, 0.0, 2.0, 0.0, 0.0), (99, lat, lon, 9.0, 9.0, 9.0, 9.0)]
    moved = trace_paths(particles, spark.createDataFrame(flow, FIELD), AXES, 1, 0.5, held_cells=held).where("cluster_id = 4 AND step = 1").collect()
    assert len(moved) == 2
    for r in moved:
        assert r.hours_back == 0.5 and r.lon == 1.0 and math.isclose(r.lat, 2.0 - 0.97 / 111000 * 3600 * 0.5)
