"""Report files and outlines of clusters."""

import json
import random

import pytest
from pyspark.sql import functions as F

from flotsam.operators import outlines as L
from flotsam.operators import rasters as O
from flotsam.sources import files as W


def features(spark, n):
    rows = spark.range(n).select(F.col("id").alias("cluster_id"), F.lit('a "b",\n').alias("kind"), F.col("id").cast("double").alias("lon"), F.lit(1.5).alias("lat"))
    return W.geojson_features(rows, "lon", "lat")


@pytest.mark.parametrize("n", [0, 1, 25])
def test_every_file_is_a_collection(spark, tmp_path, n):
    path = str(tmp_path / "out")
    for _ in range(2):  # the second replaces the first
        W.write_collections(features(spark, n).repartition(4) if n else features(spark, 1).where("false"), path)
    files = [f for f in (tmp_path / "out").iterdir() if f.suffix == ".txt" and f.stat().st_size]
    read = [json.loads(f.read_text()) for f in files]
    assert read and all(c["type"] == "FeatureCollection" for c in read)
    found = [f for c in read for f in c["features"]]
    assert sorted(f["properties"]["cluster_id"] for f in found) == list(range(n)) and all(f["properties"]["kind"] == 'a "b",\n' for f in found)
    assert sorted(r.value for r in W.read_collections(spark, path).collect()) == sorted(r.value for r in features(spark, n).collect())
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_csv_comes_back_as_it_was(spark, tmp_path):
    path = str(tmp_path / "csv")
    rows = spark.createDataFrame([(1, 'a "b", c', 1.5), (2, "", None), (3, None, -0.25), (None, "two\nlines", 1e300)], "id long, name string, x double")
    W.write_csv(rows, path)
    assert sorted(map(tuple, W.read_csv(spark, path, rows.schema).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    for empty in (rows.where("id > 9"), spark.createDataFrame([], rows.schema)):
        W.write_csv(empty, path)
        heads = [f.read_text().strip() for f in (tmp_path / "csv").iterdir() if f.name.startswith("part") and f.stat().st_size]
        assert heads and set(heads) == {"id,name,x"}
        assert W.read_csv(spark, path, rows.schema).count() == 0


def test_an_aborted_write_leaves_what_was(spark, tmp_path):
    path = str(tmp_path / "csv")
    rows = spark.range(20).select("id")
    bad = rows.repartition(4).select(F.when(F.col("id") == 13, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        W.write_csv(bad, path)
    assert list(tmp_path.iterdir()) == []
    W.write_csv(rows, path)
    with pytest.raises(Exception, match="stop"):
        W.write_csv(bad, path)
    assert [p.name for p in tmp_path.iterdir()] == ["csv"] and W.read_csv(spark, path, rows.schema).count() == 20


def holes(on, size):
    """Parts of the background that the outside does not reach, over sides and corners."""
    off = {(y, x) for y in range(-1, size + 1) for x in range(-1, size + 1)} - on
    parts = 0
    while off:
        todo = [off.pop()]
        parts += 1
        while todo:
            y, x = todo.pop()
            for near in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if near in off:
                    off.remove(near)
                    todo.append(near)
    return parts - 1


def test_rings_of_random_clusters(spark):
    rng, size = random.Random(7), 24
    on = {(y, x) for y in range(size) for x in range(size) if rng.random() < 0.62} | {(30 + k, 2) for k in range(40)} | {(30, x) for x in range(2, 60)}
    mask = spark.createDataFrame([(0, y, x, True, 1.0) for y, x in on], "scene_id int, y int, x int, is_debris boolean, prob double")
    labelled = O.label_components(mask, 16)
    spans = O.cluster_spans(labelled)
    members = {}
    for r in labelled.collect():
        members.setdefault((r.first_y, r.first_x), set()).add((r.y, r.x))
    found = {}
    for r in L.rings(spans).collect():
        found.setdefault((r.first_y, r.first_x), []).append(r)
    assert set(found) == set(members)
    for c, pixels in members.items():
        assert sum(r.area for r in found[c]) == len(pixels)
        # sides of one pixel stay apart on the upright, and a pinched corner parts holes that touch at it
        assert sum(r.area > 0 for r in found[c]) == 1 and sum(r.area < 0 for r in found[c]) >= holes(pixels, 80)
        walked = set()
        for r in found[c]:
            corners = [(p.x, p.y) for p in r.corners]
            assert corners[0] == min(corners, key=lambda p: (p[1], p[0]))
            for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
                assert (x1 == x2) != (y1 == y2)
                step = max(abs(x2 - x1), abs(y2 - y1))
                walked |= {((x1 + (x2 - x1) * k // step, y1 + (y2 - y1) * k // step), (x1 + (x2 - x1) * (k + 1) // step, y1 + (y2 - y1) * (k + 1) // step)) for k in range(step)}
        want = set()
        for y, x in pixels:
            want |= {((x, y), (x + 1, y))} if (y - 1, x) not in pixels else set()
            want |= {((x + 1, y), (x + 1, y + 1))} if (y, x + 1) not in pixels else set()
            want |= {((x + 1, y + 1), (x, y + 1))} if (y + 1, x) not in pixels else set()
            want |= {((x, y + 1), (x, y))} if (y, x - 1) not in pixels else set()
        assert walked == want


def test_a_frame_has_a_hole(spark):
    on = [(y, x) for y in range(5) for x in range(5) if not (1 <= y <= 3 and 1 <= x <= 3)]
    mask = spark.createDataFrame([(0, y, x, True, 1.0) for y, x in on], "scene_id int, y int, x int, is_debris boolean, prob double")
    spans = O.cluster_spans(O.label_components(mask))
    (c,) = L.cluster_outlines(spans, min_area=1600.0).collect()
    assert (c.rings, c.holes, c.area_m2) == (2, 1, 1600.0)
    assert L.cluster_outlines(spans, min_area=1600.1).count() == 0 == L.rings(spans.where("false")).count()
