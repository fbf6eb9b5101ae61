"""Zonal means, stitched rims and exact percentiles against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flotsam.operators import audit as U
from flotsam.operators import rasters as O
from flotsam.operators import zones as Z
from flotsam.operators.percentiles import exact_percentiles


@pytest.mark.parametrize("strip", [4, 256])
def test_zonal_means_equal_those_over_pixels(spark, strip):
    rng = np.random.default_rng(1)
    pixels = {}
    for s in (0, 1):
        for y in range(6):
            for x in range(40):
                if rng.random() < 0.9:
                    bands = rng.normal(0, 1, 11).tolist() if rng.random() < 0.8 else [0.0] * 11
                    if rng.random() < 0.1:
                        bands[3] = rng.choice([float("nan"), None, float("inf")])
                    pixels[s, y, x] = bands if rng.random() < 0.97 else None
    spans = [(s, int(y), z, int(a), int(a + rng.integers(0, 17))) for z in range(30) for s in (0, 1) for y, a in zip(rng.integers(0, 7, 2), rng.integers(0, 30, 2))]
    p = spark.createDataFrame([(*k, v) for k, v in pixels.items()], "scene_id int, y int, x int, bands array<double>")
    df = spark.createDataFrame(spans, "scene_id int, y int, zone int, x_from int, x_to int")
    got = {(r.scene_id, r.zone): r for r in Z.zonal_means(df, Z.row_strips(p, strip), ["zone"], strip).collect()}
    want = {}
    for s, y, z, a, b in spans:
        want.setdefault((s, z), []).extend(pixels.get((s, y, x)) for x in range(a, b + 1))
    assert set(got) == set(want)
    for key, found in want.items():
        for k in range(11):
            known = [b[k] for b in found if b and b[k] is not None and np.isfinite(b[k])]
            assert got[key].spectrum[k] == (pytest.approx(np.mean(known), abs=1e-9) if known else None)
        full = [b for b in found if b and None not in b and sum(b) != 0]
        assert got[key].nodata_share == pytest.approx(1 - len(full) / len(found))


def test_spans_meet_strips_not_pixels(spark):
    spans = spark.createDataFrame([(0, 1, 7, 0, 99), (0, 2, 7, 250, 260), (0, 3, 7, 0, 1023)], "scene_id int, y int, zone int, x_from int, x_to int")
    cut = sorted((r.y, r.strip, r.x_from, r.x_to) for r in Z.span_strips(spans).collect())
    assert cut == [(1, 0, 0, 99), (2, 0, 250, 255), (2, 1, 256, 260), (3, 0, 0, 255), (3, 1, 256, 511), (3, 2, 512, 767), (3, 3, 768, 1023)]


@pytest.mark.parametrize("patch, overlap", [(8, 3), (8, 0), (6, 4)])
def test_stitching_groups_the_rims_alone(spark, patch, overlap):
    h, w, step = 29, 23, patch - overlap
    scene = spark.createDataFrame([(0, h, w)], "scene_id int, h int, w int")
    pixels = spark.createDataFrame([(0, y, x, float(y * w + x)) for y in range(h) for x in range(w)], "scene_id int, y int, x int, value double")
    tiled = O.tile_pixels(pixels, scene, patch, overlap).withColumn("probs", F.array(F.col("value") + F.col("tile_row"), F.col("tile_col").cast("double"), F.lit(1.0)))
    rows = tiled.collect()
    want, times = {}, {}
    for r in rows:
        want.setdefault((r.y, r.x), []).append(r.probs)
        times[r.y, r.x] = times.get((r.y, r.x), 0) + 1
    got = {(r.y, r.x): r.probs for r in O.stitch(tiled, "probs", patch, overlap, 3).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(np.mean(v, axis=0)) for k, v in want.items())
    shared = {(r.y, r.x, r.tile_row, r.tile_col) for r in tiled.where(O.is_shared(patch, overlap)).collect()}
    # what several tiles cover is grouped; besides that only the far rim of the last tiles
    last = max(r.tile_row for r in rows), max(r.tile_col for r in rows)
    for r in rows:
        far = r.r >= step and r.tile_row == last[0] or r.c >= step and r.tile_col == last[1]
        assert ((r.y, r.x, r.tile_row, r.tile_col) in shared) == (times[r.y, r.x] > 1 or far)


def test_missing_tiles_are_zeros_that_count(spark):
    scene = spark.createDataFrame([(0, 4, 7)], "scene_id int, h int, w int")
    tiles = O.tile_index(scene, 4, 1)
    seen = spark.createDataFrame([(0, 0, 0, r, c, [0.75, 0.25]) for r in range(4) for c in range(4)], "scene_id int, tile_row int, tile_col int, r int, c int, probs array<double>")
    done = O.complete_pixels(tiles, seen, 2)
    assert done.count() == 32 and done.where("tile_col = 1").select(F.sum(F.col("probs")[0])).first()[0] == 0
    stitched = {(r.y, r.x): r.probs for r in O.stitch(done, "probs", 4, 1, 2).collect()}
    assert stitched[0, 0] == [0.75, 0.25] and stitched[0, 3] == [0.375, 0.125] and stitched[3, 6] == [0.0, 0.0]


@pytest.mark.parametrize("buckets", [16, 1024])
def test_percentiles_equal_numpys(spark, monkeypatch, buckets):
    import flotsam.operators.percentiles as P

    monkeypatch.setattr(P, "BUCKETS", buckets)
    rng, rows = random.Random(3), []
    groups = {"one": [4.5], "same": [2.0] * 50, "ties": [float(rng.randint(0, 5)) for _ in range(200)], "wide": [rng.uniform(-1, 1) * 10 ** rng.uniform(-20, 20) for _ in range(300)], "far": [-1.7e308, 1.7e308, 0.0], None: [1.0, 2.0]}
    for g, values in groups.items():
        rows += [(g, v) for v in values] + [(g, None), (g, float("nan"))]
    rows += [("none", None)] * 3
    fractions = [0.0, 0.02, 0.5, 0.98, 1.0]
    got = {r.g: r for r in exact_percentiles(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v", fractions).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        values = sorted(values)
        assert got[g].n == len(values)
        for k, f in enumerate(fractions):
            at = f * (len(values) - 1)
            low, part = int(at), at - int(at)
            want = values[low] * (1 - part) + (values[low + 1] * part if part else 0)
            assert got[g][f"p{k}"] == pytest.approx(want, rel=1e-12)
            if abs(want) < 1e300:
                assert want == pytest.approx(np.percentile(values, 100 * f), rel=1e-9, abs=1e-300)


def test_stretches(spark):
    rng = np.random.default_rng(5)
    few, many = rng.normal(0, 1, 99).tolist() + [-5.0] * 50, rng.normal(0, 1, 150).tolist() + [-9.0] * 20
    df = spark.createDataFrame([(1, v) for v in few] + [(2, v) for v in many] + [(2, None)], "g int, value double")
    rows = U.gamma_stretch(df, ["g"]).collect()
    assert {r.stretched for r in rows if r.g == 1} == {0.0}
    valid = [v for v in many if v > -4.5]
    lo, hi = np.percentile(valid, 1), np.percentile(valid, 99)
    assert sorted(r.stretched for r in rows if r.g == 2 and r.value is not None) == pytest.approx(sorted((np.clip((np.array(many) - lo) / (hi - lo + 1e-6), 0, 1) ** 0.7).tolist()))
    assert [r.stretched for r in rows if r.value is None] == [None]
