"""Plans that keep to the size of their input, and results that don't hang on the order of a sum."""

import random

import duckdb
from pyspark.sql import functions as F

from flotsam.constants import N_CLASSES
from flotsam.functions.bands import softmax_boost
from flotsam.operators import drift as D
from flotsam.operators import paths as P
from flotsam.operators import quadtree as Q
from flotsam.operators import rasters as O
from flotsam.operators import signatures as G
from flotsam.plans import raster_queries as R
from flotsam.plans.queries import QUERIES, SQL
from flotsam.sources import supplied as S

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_regrid_makes_no_grid_for_each_scene(spark):
    df = QUERIES["b2_regrid"](spark, SMALL)
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    # pixels meet the places of a side, which are made once for each length: no grid of a scene meets them
    assert joins and not any("scene_id#" in line and " y#" in line.replace("(", " ") for line in joins)


def test_regrid_of_sides_of_one_and_of_unequal_scenes(spark):
    rows = [(1, 0, 0, 5.0), (2, 0, 0, 0.0), (2, 0, 1, 1.0), (2, 0, 2, 4.0)]
    got = O.regrid(spark.createDataFrame(rows, "scene_id int, y int, x int, value double"), 2, 5)
    values = {(r.scene_id, r.y, r.x): r.value for r in got.collect()}
    assert values == {(s, y, x): v for s, line in ((1, [5.0] * 5), (2, [0.0, 0.5, 1.0, 2.5, 4.0])) for y in (0, 1) for x, v in enumerate(line)}


def test_nearest_places_look_forward_without_shrinking_frames(spark):
    points, axis = spark.createDataFrame([(1, 0.2), (2, 7.5), (3, 9.9)], "id int, lon double"), spark.createDataFrame([(0, 5.0), (1, 10.0), (2, 0.0)], "idx long, place double")
    found = D.nearest_places(points, "lon", axis, "lon_idx")
    assert {r.id: r.lon_idx for r in found.collect()} == {1: 2, 2: 0, 3: 1}
    window = [line for line in plan(found).splitlines() if "_range" in line and "mark" in line]
    assert not any("currentrow$(), unboundedfollowing" in line for line in window)


def test_classes_with_equal_means_are_equal_in_whatever_order_they_are_added(spark):
    parts = [(0.1, 0.3), (0.2, 0.2), (0.3, 0.1)]
    rows = [(scene, tile // 2, tile % 2, 1 - tile // 2, 1 - tile % 2, [*(pair if scene else pair[::-1]), *[0.0] * (N_CLASSES - 2)]) for scene in (0, 1) for tile, pair in enumerate(parts)]
    seen = spark.createDataFrame(rows, "scene_id int, tile_row int, tile_col int, r int, c int, probs array<double>").coalesce(1)
    tiles = seen.select("scene_id", "tile_row", "tile_col", F.lit(2).alias("actual_h"), F.lit(2).alias("actual_w"))
    got = O.pixel_results(tiles, seen, 2, 1).where("y = 1 AND x = 1").collect()
    assert [r.cls for r in got] == [0, 0]


def test_spectra_are_dealt_over_tasks_and_go_right_where_a_feature_lacks(spark):
    nodes = [(t, 0, t, 0.5, 1, 2, None) for t in range(3)] + [(t, n, None, None, -1, -1, [float(n == 1), float(n == 2)]) for t in range(3) for n in (1, 2)]
    nodes = [(*row[:6], row[6] or [0.5, 0.5]) for row in nodes]
    forest = spark.createDataFrame(nodes, "tree int, node int, feature int, threshold double, left int, right int, shares array<double>")
    rows = [(0, [0.1, 0.5, 0.6]), (1, [float("nan"), 0.2, None]), (2, [0.1]), (3, None), (4, [])]
    spectra = spark.createDataFrame(rows, "id int, bands array<float>").coalesce(1)
    got = G.vote(forest, spectra, 4)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {r.id: r.votes for r in got.collect()} == {0: [2 / 3, 1 / 3], 1: [1 / 3, 2 / 3], 2: [1 / 3, 2 / 3], 3: [0.0, 1.0], 4: [0.0, 1.0]}
    assert {r.votes for r in G.vote(forest.where("tree > 9"), spectra, 4).collect()} == {None}


def test_points_of_one_place_and_equal_boxes_are_not_met_pair_by_pair(spark, monkeypatch):
    seen, plain = {}, Q.Scratch.table
    monkeypatch.setattr(Q.Scratch, "table", lambda self, name, df: seen.setdefault(name, plain(self, name, df)))
    held = {}
    monkeypatch.setattr(Q.Scratch, "last", lambda self, df, rows=None: held.setdefault("hits", seen["hits"].count()) and df)
    points = spark.range(900).selectExpr("id", "cast(id AS string) AS name", "1.5D AS lon", "IF(id < 890, 0.5D, 0.25D) AS lat")
    boxes = spark.range(200).selectExpr("id AS box", "1.0D AS x1", "IF(id < 100, 0.4D, 0.0D) AS y1", "2.0D AS x2", "1.0D AS y2")
    got = {r.box: (r.n, [f.id for f in r.firsts]) for r in Q.counts_in_boxes(boxes, points).collect()}
    assert got == {k: (890 if k < 100 else 900, list(range(10))) for k in range(200)}
    assert held["hits"] <= 40


def test_particles_of_one_partition_are_dealt_over_tasks(spark):
    seeds = spark.createDataFrame([(1, k, 10.0, 20.0) for k in range(40)], "cluster_id long, particle int, lon double, lat double").coalesce(1)
    still = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 0.0, 0.0)], "t_idx int, lat_idx int, lon_idx int, u double, v double, u_wind double, v_wind double")
    axes = {"t": (0.0, 1.0, 1), "lat": (0.0, 1.0, 1), "lon": (0.0, 1.0, 1)}
    for ways in (P.trace_paths(seeds, still, axes, hours=1), D.trace_back(seeds, None, hours=1)):
        assert ways.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert ways.count() == 80


def test_blocks_are_labelled_once_and_many_at_once(spark):
    rng, on = random.Random(5), []
    for scene in range(3):
        on += [(scene, y, x, True) for y in range(-9, 20) for x in range(-5, 24) if rng.random() < 0.6]
    mask = spark.createDataFrame(on + on[::7], "scene_id int, y int, x int, is_debris boolean")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for rows in ("3", before):  # a block is taken whole from several batches, and a batch has several blocks
            spark.conf.set(name, rows)
            found = O.label_components(mask, 8)
            got = sorted(map(tuple, found.collect()))
            # what reads the labels again doesn't label again
            assert not [step for step in ("InPandas", "InArrow") if step in plan(found)]
            left, least = {r[:3] for r in on}, {}
            while left:
                todo = [first := min(left)]
                left.remove(first)
                while todo:
                    least[at := todo.pop()] = first
                    near = {(at[0], at[1] + i, at[2] + j) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))} & left
                    left -= near
                    todo += near
            assert got == sorted((*r[:3], *least[r[:3]][1:]) for r in on + on[::7])
    finally:
        spark.conf.set(name, before)


def test_a_filter_on_the_mask_works_class_scores_out_once(spark):
    found = O.pixel_results(*R.scored(spark, SMALL), 16, 4).where("is_debris")
    filters = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line and "EXP(" in line]
    assert filters and all(line.count("EXP(") == N_CLASSES for line in filters)


def test_pixels_of_one_row_group_are_dealt_over_tasks(spark):
    rows = S.pixels(spark, SMALL).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) > 4 and max(r["count"] for r in rows) < sum(r["count"] for r in rows) / 4


def test_class_scores_are_shares_of_one_sum(spark):
    scores = spark.range(1).select(F.array(*(F.lit(k / 3) for k in range(N_CLASSES))).alias("logits")).select(softmax_boost(F.col("logits")).alias("p"))
    steps = scores._jdf.queryExecution().analyzed().toString()
    # the sum stands beside the exponentials, not within the step over them
    assert "aggregate(" in steps and "/ aggregate(" not in steps and abs(sum(scores.first().p) - 1) < 1e-12


def test_scenes_that_lack_tiles_get_no_pixels_made_up(spark, tmp_path):
    path = f"{tmp_path}/embeddings.parquet"
    spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id < 56").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want, got = con.execute(SQL["m12_pixel_results"]).fetchall(), QUERIES["m12_pixel_results"](spark, str(tmp_path)).collect()
    assert len(got) == 56 * 64 and sorted((*map(tuple, got),)) == sorted(want)
