"""Operators on small inputs with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flotsam.constants import RIVERS
from flotsam.functions import bands as B
from flotsam.functions import geo as G
from flotsam.functions import rules as R
from flotsam.operators import attribution as A
from flotsam.operators import catalogue as C
from flotsam.operators import drift as D
from flotsam.operators import metrics as M
from flotsam.operators import rasters as O


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()


def array(*values):
    return F.array(*(F.lit(float(v)) for v in values))


def test_padding_puts_bands_where_they_belong(spark):
    (out,) = one(spark, B.pad_bands(array(*range(1, 9))))
    assert [out[k] for k in (0, 5, 6)] == [0, 0, 0] and out[1] == 1 and out[7] == 5 and len(out) == 11


@pytest.mark.parametrize("n", [3, 8, 11, 14])
def test_any_number_of_bands_becomes_eleven(spark, n):
    (out,) = one(spark, B.fit_bands(array(*range(1, n + 1))))
    assert len(out) == 11
    if n == 3:
        assert out == [1, 2, 3] + [0] * 8


def test_normalised_values_stay_within_bounds(spark):
    flat, empty, bad = one(spark, B.normalize(array(*[0.05] * 11)), B.normalize(array(*[0] * 11)), B.normalize(array(*[float("nan")] + [2000] * 10)))
    assert all(-5 <= x <= 5 for x in flat) and set(empty) == {0} and bad[0] == 0 and max(bad[1:]) <= 5


def test_rules_take_the_first_that_fits(spark):
    name = lambda pi, sr, nsi, fdi: R.classify_polymer(*map(F.lit, (pi, sr, nsi, fdi)))
    got = one(spark, name(0.15, 0.2, -0.1, 0.1), name(0.05, 0.3, 0.4, 0.01), name(0.15, 0.6, -0.05, 0.08), name(0.15, 0.4, 0.1, 0.06))
    assert list(got) == [R.PE_PP, R.ORGANIC, R.PET, R.UNIDENTIFIED]


def test_softmax_is_boosted_and_sums_to_one(spark):
    (p,) = one(spark, B.softmax_boost(array(*[1.0] * 15)))
    assert sum(p) == pytest.approx(1) and p[0] == pytest.approx(math.exp(1.5) / (math.exp(1.5) + 14 * math.exp(1)))


@pytest.mark.parametrize("kind", O.AUGMENTATIONS)
def test_augmentation_is_undone_and_is_numpys(spark, kind):
    tile = np.arange(25).reshape(5, 5)
    turned = {"original": tile, "hflip": tile[:, ::-1], "vflip": tile[::-1], "rot90": np.rot90(tile), "rot180": np.rot90(tile, 2), "rot270": np.rot90(tile, 3)}[kind]
    there = O.augment(F.col("r"), F.col("c"), 5, kind)
    cells = spark.range(25).select((F.col("id") / 5).cast("int").alias("r"), (F.col("id") % 5).cast("int").alias("c"), "id").select("r", "c", "id", there[0].alias("y"), there[1].alias("x"))
    back = O.augment(F.col("y"), F.col("x"), 5, kind, inverse=True)
    for row in cells.select("*", back[0].alias("r2"), back[1].alias("c2")).collect():
        assert turned[row.y, row.x] == row.id and (row.r, row.c) == (row.r2, row.c2)


def pixels(spark, array2d):
    rows = [(0, y, x, float(v)) for (y, x), v in np.ndenumerate(array2d)]
    return spark.createDataFrame(rows, "scene_id int, y int, x int, value double")


def test_tiles_cover_and_stitch_back(spark):
    p = pixels(spark, np.arange(23 * 17).reshape(23, 17))
    scene = spark.createDataFrame([(0, 23, 17)], "scene_id int, h int, w int")
    tiles = O.tile_pixels(p, scene, 8, 3)
    assert tiles.select("tile_row", "tile_col").distinct().count() == O.tile_index(scene, 8, 3).count()
    assert O.stitch(tiles, "value", 8, 3).exceptAll(p).count() == 0
    assert O.tile_index(spark.createDataFrame([(0, 300, 300)], "scene_id int, h int, w int")).count() == 4
    with pytest.raises(ValueError):
        O.tile_index(scene, 8, 8)


def mask(spark, on):
    return spark.createDataFrame([(0, int(y), int(x), True, 0.8) for y, x in on], "scene_id int, y int, x int, is_debris boolean, prob double")


def test_one_square_is_one_cluster(spark):
    m = mask(spark, [(y, x) for y in range(40, 50) for x in range(40, 50)])
    for block in (7, 256):
        found = O.label_components(m, block).join(m, ["scene_id", "y", "x"])
        (c,) = O.cluster_measures(found).collect()
        assert c.area_m2 == 10_000 and c.mean_confidence == pytest.approx(0.8) and c.cluster_id == 0
    assert O.cluster_spans(found).count() == 10


def test_diagonal_pixels_are_two_clusters_and_none_is_none(spark):
    assert O.label_components(mask(spark, [(0, 0), (1, 1)])).select("first_y", "first_x").distinct().count() == 2
    empty = O.label_components(mask(spark, []))
    assert empty.count() == 0 and empty.columns == ["scene_id", "y", "x", "first_y", "first_x"]


def test_labels_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    m = mask(spark, np.argwhere(rng.random((40, 40)) < 0.6))
    a, b = (sorted(map(tuple, O.label_components(m, block).collect())) for block in (8, 64))
    assert a == b


def test_regrid_keeps_corners(spark):
    out = {(r.y, r.x): r.value for r in O.regrid(pixels(spark, np.array([[0.0, 2.0], [4.0, 6.0]])), 3, 3).collect()}
    assert out[0, 0] == 0 and out[2, 2] == 6 and out[1, 1] == 3 and out[0, 1] == 1


def test_particles_move_and_keep_time(spark):
    p = spark.createDataFrame([(0, 0, 80.5, 7.5)], "cluster_id int, particle int, lon double, lat double")
    t = D.trace_back(p, None, hours=48)
    assert t.count() == 49 and D.trace_back(p, None, hours=0).count() == 1
    end = D.endpoints(t).first()
    assert (end.lon, end.lat) != (80.5, 7.5) and D.trajectory_lines(t).count() == 1


def test_longitudes_wrap(spark):
    lon, low = one(spark, G.wrap_lon(F.lit(190.0)), G.wrap_lon(F.lit(-190.0)))
    assert lon == -170 and low == 170


def test_density_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(0, k, float(x), float(y)) for k, (x, y) in enumerate(np.concatenate((rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (20, 2)), [[20.0, 20.0]])))]
    out = D.dbscan(spark.createDataFrame(rows, "grp int, id long, lon double, lat double"))
    labels = {r.id: r.label for r in out.collect()}
    assert {labels[k] for k in range(20)} == {0} and {labels[k] for k in range(20, 40)} == {1} and labels[40] == -1
    r = D.source_regions(out).orderBy("rank").collect()
    assert [x.n_particles for x in r] == [20, 20] and r[0].source_probability == pytest.approx(20 / 41)
    assert D.dbscan(spark.createDataFrame([], "grp int, id long, lon double, lat double")).count() == 0


def test_scores_and_ties(spark):
    scores = {k: F.lit(v) for k, v in zip(("fishing", "industrial", "shipping", "river"), (0.8, 0.5, 0.3, 0.1), strict=True)}
    none = {k: F.lit(None).cast("double") for k in scores}
    a, b, c, d = one(spark, R.attribution_score(scores), R.dominant_source(scores), R.attribution_score(none), R.dominant_source(none))
    assert a == pytest.approx(0.54) and b == "fishing" and c == 0 and d == "fishing"


def test_rivers(spark):
    for name, lon, lat in RIVERS:
        got, km, score = one(spark, *A.nearest_river(F.lit(lon), F.lit(lat)))
        assert (got, km, score) == (name, 0, 1)


def test_utm_of_known_points(spark):
    # the central meridian of a zone, and a place on the equator at its edge
    lon, lat, edge, zero = one(spark, *G.utm_to_lonlat(F.lit(500000.0), F.lit(4982950.40), F.lit(31)), *G.utm_to_lonlat(F.lit(833978.56), F.lit(0.0), F.lit(31)))
    assert lon == pytest.approx(3) and lat == pytest.approx(45, abs=1e-6) and edge == pytest.approx(6, abs=1e-6) and zero == pytest.approx(0, abs=1e-9)


def test_patch_metrics_of_perfect_and_empty(spark):
    t = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (1, 2, 1), (2, 0, 0)], "patch int, raw int, pred int")
    rows = {r.patch: r for r in M.patch_metrics(t).collect()}
    assert rows[0].iou == pytest.approx(1) and rows[1].iou is None and 2 not in rows


def test_weights_have_mean_one(spark):
    t = spark.createDataFrame([(0, r, 0) for r in [1] + [2] * 50 + [7] * 500], "patch int, raw int, pred int")
    for boost, cap in ((1.0, 10.0), (3.0, None)):
        w = [r.weight for r in M.class_weights(t, boost, cap).collect()]
        assert len(w) == 15 and sum(w) / 15 == pytest.approx(1)


def test_catalogue(spark, tmp_path):
    s = spark.sql("SELECT 1L scene_id, TIMESTAMP'2024-01-15' acquired, 5.0D cloud_cover, 80.5D lon, 7.5D lat")
    assert C.find_scenes(s, (80, 7, 81, 8), "2024-01-01", "2024-02-01", 20).count() == 1
    assert C.find_scenes(s, (80, 7, 81, 8), "2024-01-01", "2024-02-01", 5.0).count() == 0
    C.write_csv(s, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    (ok, bad) = one(spark, G.parse_box(F.lit("1, 2,3,4.5")), G.parse_box(F.lit("1,2,x,4")))
    assert ok["lat_max"] == 4.5 and bad is None


def test_weighted_draws_take_rows_by_their_weights(spark):
    from flotsam.operators.audit import weighted_sample

    rows = spark.createDataFrame([(k, float(k % 4)) for k in range(400)] + [(999, None)], "id long, w double")
    drawn = weighted_sample(rows, "id", "w", 60000).groupBy((F.col("id") % 4).alias("m")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
    got = {r.m: (r.n, r.ids) for r in drawn.collect()}
    assert set(got) == {1, 2, 3} and all(v[1] == 100 for v in got.values())
    assert all(abs(got[m][0] - 10000 * m) < 600 for m in got)
    assert weighted_sample(rows, "id", "w", 500).agg(F.count_distinct("draw")).first()[0] == 500


def test_walked_trees_vote_as_the_model(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from flotsam.operators import signatures as S

    rng = np.random.default_rng(2)
    rows = [(k, [float(v) for v in rng.normal(0, 1, 11)]) for k in range(300)]
    df = spark.createDataFrame([(k, b, int(b[1] > 0) + 2 * int(b[4] > 0.5)) for k, b in rows], "id int, bands array<double>, label int")
    model = S.train_forest(df, trees=12, depth=7, least=2)
    want = {r.id: (r.prediction, r.p) for r in model.transform(df.withColumn("features", array_to_vector("bands"))).select("id", "prediction", vector_to_array("probability").alias("p")).collect()}
    got = S.score_forest(model, df)
    assert {r.id: r.prediction for r in got.collect()} == {k: p for k, (p, _) in want.items()}
    assert all(r.rf_confidence == pytest.approx(max(want[r.id][1])) for r in got.collect())
    none = S.score_forest(None, df).collect()
    assert {(r.prediction, r["class"], r.rf_confidence) for r in none} == {(None, None, 0.0)} and all(r.polymer_type for r in none)
    zones = spark.createDataFrame([(1, None, 1.0), (2, [None] * 11, 0.1), (3, rows[0][1], 0.8), (4, rows[0][1], 0.2)], "zone int, spectrum array<double>, nodata_share double")
    for m in (model, None):
        kinds = {r.zone: (r.polymer_type, r.is_false_positive, r.rf_confidence > 0) for r in S.classify_zones(zones, m).collect()}
        assert kinds[1] == kinds[3] == ("No Data Region", True, False) and kinds[2] == ("Unknown (insufficient spectral data)", False, False)
        assert kinds[4][2] == (m is not None)
    weights = model.stages[0].featureImportances.toArray()
    assert {r.feature: r.importance for r in S.feature_importance(S.forest_nodes(model)).collect()} == {k: pytest.approx(w) for k, w in enumerate(weights) if w}
