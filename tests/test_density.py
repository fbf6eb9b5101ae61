"""Density clusters and neighbour counts against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flotsam.operators import density as D

SCHEMA = "grp int, id long, lon double, lat double"


def plain(rows, eps, least):
    """(neighbours, labels) by id of one group, every pair of points compared."""
    ids, xy = np.array([r[1] for r in rows]), np.array([r[2:4] for r in rows], float).reshape(-1, 2)
    order = np.argsort(ids)
    ids, xy = ids[order], xy[order]
    near = ((xy[:, None, 0] - xy[None, :, 0]) ** 2 + (xy[:, None, 1] - xy[None, :, 1]) ** 2) <= eps * eps
    core = near.sum(1) >= least
    labels, n = np.full(len(ids), -1), 0
    for k in range(len(ids)):
        if core[k] and labels[k] < 0:
            todo = [k]
            labels[k] = n
            while todo:
                for j in np.nonzero(near[todo.pop()] & core & (labels < 0))[0]:
                    labels[j] = n
                    todo.append(j)
            n += 1
    for k in np.nonzero(~core)[0]:
        around = labels[near[k] & core]
        labels[k] = around.min() if len(around) else -1
    return dict(zip(ids.tolist(), near.sum(1).tolist())), dict(zip(ids.tolist(), labels.tolist()))


def check(spark, rows, eps, least):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    counts = {(r.grp, r.id): r.near for r in D.near_counts(df, eps).collect()}
    labels = {(r.grp, r.id): r.label for r in D.dbscan(df, eps, least).collect()}
    assert len(labels) == len(rows)
    for grp in {r[0] for r in rows}:
        near, label = plain([r for r in rows if r[0] == grp], eps, least)
        assert {k[1]: v for k, v in counts.items() if k[0] == grp} == near
        assert {k[1]: v for k, v in labels.items() if k[0] == grp} == label


def test_random_clouds(spark):
    rng = np.random.default_rng(5)
    rows = []
    for grp, (n, spread) in enumerate([(150, 2.0), (300, 6.0), (4, 0.1), (200, 0.8)]):
        at = np.round(rng.normal(0, spread, (n, 2)), 1 if grp == 1 else 9)  # rounded places: ties and distances of just eps
        rows += [(grp, int(i), float(x), float(y)) for i, (x, y) in zip(rng.permutation(n), at)]
    check(spark, rows, 0.5, 5)
    check(spark, rows, 0.3, 1)


@pytest.mark.parametrize("gap", [0.499999, 0.500001])
def test_two_crowds_whose_nearest_points_decide(spark, monkeypatch, gap):
    """Two bent rows of points face each other: only one pair in the middle is about eps apart, outermost points are not."""
    t = np.linspace(-0.12, 0.12, 61)
    left = np.stack([-3 * t**2, t], 1)
    right = np.stack([gap + 3 * t**2, t], 1)
    rows = [(1, k, float(x), float(y)) for k, (x, y) in enumerate(np.concatenate([left, right]) + [[10.07, 0.2]])]
    check(spark, rows, 0.5, 5)
    assert len({r.label for r in D.dbscan(spark.createDataFrame(rows, SCHEMA), 0.5, 5).collect()}) == (1 if gap < 0.5 else 2)
    monkeypatch.setattr(D, "HALVINGS", 2)  # the rest point by point
    check(spark, rows, 0.5, 5)


def test_a_crowded_cell_makes_few_rows(spark):
    """50,000 points in one cell, as many in one place, and some around: every step's rows stay in proportion."""
    n = 50_000
    crowd = spark.range(n).select(F.lit(0).alias("grp"), "id", (F.rand(1) * 0.3 + 0.01).alias("lon"), (F.rand(2) * 0.3 + 0.01).alias("lat"))
    same = spark.range(n, 2 * n).select(F.lit(0).alias("grp"), "id", F.lit(0.2).alias("lon"), F.lit(0.2).alias("lat"))
    few = [(0, 2 * n, 0.4, 0.2), (0, 2 * n + 1, 0.95, 0.2), (0, 2 * n + 2, 30.0, 0.2)]
    out = D.dbscan(crowd.unionByName(same).unionByName(spark.createDataFrame(few, SCHEMA)))
    got = {(r.label, r.far): r.n for r in out.groupBy("label", (F.col("id") >= 2 * n).alias("far")).agg(F.count("*").alias("n")).collect()}
    assert got == {(0, False): 2 * n, (0, True): 1, (-1, True): 2}


def test_points_without_a_place_are_noise(spark):
    rows = [(0, k, 1.0, 1.0) for k in range(5)] + [(0, 7, None, 1.0), (0, 8, float("nan"), 1.0), (0, 9, float("inf"), 1.0), (None, 3, 1.0, 1.0)]
    out = {(r.grp, r.id): r.label for r in D.dbscan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {**{(0, k): 0 for k in range(5)}, (0, 7): -1, (0, 8): -1, (0, 9): -1, (None, 3): -1}
    assert D.near_counts(spark.createDataFrame(rows, SCHEMA), 0.5).where("grp = 0").count() == 5
    assert D.dbscan(spark.createDataFrame([], SCHEMA)).count() == 0 == D.near_counts(spark.createDataFrame([], SCHEMA), 0.5).count()
