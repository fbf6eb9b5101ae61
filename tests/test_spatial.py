"""Boxes over points, polygons under boxes, and uneven axes against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flotsam.operators import attribution as A
from flotsam.operators import drift as D
from flotsam.operators import quadtree as Q


@pytest.mark.parametrize("leaf", [3, 1000])
def test_boxes_count_their_points(spark, monkeypatch, leaf):
    monkeypatch.setattr(Q, "LEAF", leaf)
    rng = random.Random(4)
    points = [(k, f"p{k}", round(rng.gauss(0, 2), 1), round(rng.gauss(50, 1), 1)) for k in range(300)] + [(9, "p9", 1.25, 50.0)] * 9
    points += [(400, "nan", float("nan"), 50.0), (401, "null", None, 50.0), (402, None, 0.5, 50.5)]
    boxes = [(k, *(lambda x, y, w, h: (x, y, x + w, y + h))(rng.uniform(-5, 5), rng.uniform(47, 53), rng.uniform(0, 4), rng.uniform(0, 3))) for k in range(25)]
    boxes += [(30, -1.0, 49.0, 1.0, 51.0), (31, 1.25, 50.0, 1.25, 50.0), (32, 100.0, 0.0, 101.0, 1.0), (33, None, 0.0, 1.0, 1.0), (34, -180.0, -90.0, 180.0, 90.0)]
    got = Q.counts_in_boxes(spark.createDataFrame(boxes, "box int, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(points, "id int, name string, lon double, lat double"))
    want = {}
    for box, x1, y1, x2, y2 in boxes:
        inside = [] if x1 is None else sorted(((i, n or "") for i, n, x, y in points if x is not None and x1 <= x <= x2 and y1 <= y <= y2))
        if inside:
            want[box] = (len(inside), inside[:10])
    assert {r.box: (r.n, [(f.id, f.name or "") for f in r.firsts]) for r in got.collect()} == want


def test_a_crowd_in_one_cell(spark):
    """A million points in one cell of the largest size: boxes that hold it take its counts."""
    n = 1_000_000
    crowd = spark.range(n).select(F.col("id"), F.lit("v").alias("name"), (F.rand(1) * 1.9).alias("lon"), (F.rand(2) * 1.9).alias("lat"))
    boxes = [(1, -1.0, -1.0, 3.0, 3.0), (2, 0.0, 0.0, 0.95, 3.0), (3, 1.95, 0.0, 3.0, 3.0)]
    got = {r.box: (r.n, [f.id for f in r.firsts]) for r in Q.counts_in_boxes(spark.createDataFrame(boxes, "box int, x1 double, y1 double, x2 double, y2 double"), crowd).collect()}
    assert got[1] == (n, list(range(10))) and abs(got[2][0] - n / 2) < 3000 and 3 not in got
    assert got[2][0] == crowd.where("lon <= 0.95").count()


def plain_area(ring, box):
    """Area of a ring within a box by cutting it with each side in turn, and then the shoelace."""
    x1, y1, x2, y2 = box
    for axis, bound, sign in ((0, x1, 1), (0, x2, -1), (1, y1, 1), (1, y2, -1)):
        out = []
        for p, q in zip(ring[-1:] + ring[:-1], ring):
            a, b = sign * (p[axis] - bound), sign * (q[axis] - bound)
            if (a >= 0) != (b >= 0):
                t = a / (a - b)
                out.append(tuple(u + (v - u) * t for u, v in zip(p, q)))
            if b >= 0:
                out.append(q)
        ring = out
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring[-1:] + ring[:-1], ring))) / 2


def test_polygons_under_boxes(spark):
    rng = random.Random(6)
    lanes = {}
    for k in range(30):
        n = rng.randint(3, 8)
        cx, cy = rng.uniform(-20, 20), rng.uniform(-20, 20)
        ring = [(cx + rng.uniform(2, 9) * math.cos(2 * math.pi * i / n), cy + rng.uniform(2, 9) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        lanes[k] = ring[::-1] if k % 3 == 0 else ring + ring[:1] if k % 3 == 1 else ring
    boxes = {k: (x := rng.uniform(-25, 25), y := rng.uniform(-25, 25), x + rng.uniform(0.1, 15), y + rng.uniform(0.1, 15)) for k in range(40)}
    odd = [(90, []), (91, [(0.0, 0.0), (9.0, 9.0)]), (92, None), (93, [(0.0, 0.0), (float("nan"), 1.0), (1.0, 1.0)])]
    r = spark.createDataFrame([(k, *b) for k, b in boxes.items()], "source_id int, lon_min double, lat_min double, lon_max double, lat_max double")
    got = A.polygon_lane_scores(r, spark.createDataFrame([*lanes.items(), *odd], "lane_id int, ring array<struct<x:double,y:double>>"))
    areas = {x.source_id: x.overlap_area for x in got.collect()}
    assert areas == {k: pytest.approx(sum(plain_area(ring, b) for ring in lanes.values()), abs=1e-9) for k, b in boxes.items()}
    assert sum(a > 0 for a in areas.values()) > 20
    square = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])], "lane_id int, ring array<struct<x:double,y:double>>")
    one = A.polygon_lane_scores(spark.createDataFrame([(1, 1.0, 1.0, 3.0, 3.0), (2, 8.0, 8.0, 9.0, 9.0)], r.schema), square)
    assert {x.source_id: (x.overlap_area, round(x.shipping, 6)) for x in one.collect()} == {1: (1.0, 0.25), 2: (0.0, 0.0)}


def test_nearest_places_of_uneven_axes(spark):
    rng = np.random.default_rng(3)
    places = np.round(rng.uniform(-50, 50, 40), 0).tolist()  # in no order, some of them twice
    values = np.round(rng.uniform(-70, 70, 300), 1).tolist() + [5.5] * 200 + places[:5]
    points = spark.createDataFrame([(k, v) for k, v in enumerate(values)] + [(900, None), (901, float("nan"))], "id int, v double").repartition(5)
    axis = spark.createDataFrame(list(enumerate(places)) + [(77, None), (78, float("inf"))], "idx int, place double")
    got = {r.id: r.near for r in D.nearest_places(points, "v", axis, "near").collect()}
    assert got == {**{k: int(np.abs(np.array(places) - v).argmin()) for k, v in enumerate(values)}, 900: None, 901: None}
    assert {r.near for r in D.nearest_places(points, "v", axis.limit(0), "near").collect()} == {None}
