"""Neighbours within a distance, and density clusters, over a graph of cells.

A cell's diagonal is just under ``eps``, so points of one cell are neighbours, and a cell with ``min_samples`` points has
cores only.  What remains to be compared with single points is the few of the other cells.  Two cells of cores are linked by
a nearest pair: the outermost points of both in eight directions show most links, boxes further apart than ``eps`` have none,
and what is left is split into quarters until each part is one or the other.  No step makes a row for every pair of points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import EPS, MIN_SAMPLES
from ..sources.session import Scratch
from .graph import connected_components

#: A cell's side in eps: the diagonal stays under eps however sums are rounded.
SIDE = 0.5**0.5 * (1 - 1e-9)
#: Cells reach each other over at most two cells between them.
REACH = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
#: Points of a cell that are counted together.
BLOCK = 256
#: Halvings of cells after which what is still open is compared point by point; parts then hold points that are next to equal.
HALVINGS = 24
CELL = ["grp", "cx", "cy"]


def _cell(lon: Column, lat: Column, side: float) -> list[Column]:
    return [F.floor(lon / side).alias("cx"), F.floor(lat / side).alias("cy")]


def _is_place(lon: str = "lon", lat: str = "lat") -> Column:
    """Has a group and a finite place; never null."""
    return F.coalesce(F.col("grp").isNotNull() & ~F.isnan(lon) & ~F.isnan(lat) & (F.abs(lon) < float("inf")) & (F.abs(lat) < float("inf")), F.lit(False))


def _around(frame: DataFrame, offsets=REACH) -> DataFrame:
    """Each row once for each cell of the offsets: (cx, cy) becomes that cell, (ax, ay) is the row's own."""
    near = F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i, j in offsets)))
    rest = [c for c in frame.columns if c not in ("cx", "cy")]
    return frame.select(*rest, F.col("cx").alias("ax"), F.col("cy").alias("ay"), near.alias("near")).select(*rest, "ax", "ay", "near.*")


def _apart(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance."""
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def _placed(points: DataFrame, eps: float) -> DataFrame:
    return points.where(_is_place()).select("*", *_cell(F.col("lon"), F.col("lat"), eps * SIDE))


def near_counts(points: DataFrame, eps: float) -> DataFrame:
    """(grp, id, near): how many points (grp, id, lon, lat) of its group lie at most eps degrees from each point, itself included.

    Those of its own cell are a count; blocks of other cells are compared as arrays inside tasks, which give one row for each
    point and block.  ids are distinct within a group; points without a place have no row.
    """
    placed = _placed(points.select("grp", "id", "lon", "lat"), eps)
    cells = placed.groupBy(*CELL).agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK)
    # a crowded cell's rows meet its one count, in a join that Spark can split, and then go to tasks by blocks
    dealt = placed.join(cells.select(*CELL, blocks.alias("blocks")), CELL).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    packed = dealt.groupBy(*CELL, "block").agg(F.collect_list("id").alias("ids"), F.collect_list("lon").alias("x"), F.collect_list("lat").alias("y"))
    others = packed.select(*CELL, F.col("x").alias("x2"), F.col("y").alias("y2"))
    met = _around(packed, [o for o in REACH if o != (0, 0)]).join(others, CELL).select("grp", "ids", "x", "y", "x2", "y2")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = {c: (batch.column(c).flatten(), batch.column(c).offsets.to_numpy()) for c in ("ids", "x", "y", "x2", "y2")}
            values = {c: v.to_numpy(zero_copy_only=False) for c, (v, _) in flat.items() if c != "ids"}
            near, part = np.zeros(len(values["x"]), np.int64), lambda c, k: values[c][flat[c][1][k] - flat[c][1][0] : flat[c][1][k + 1] - flat[c][1][0]]
            at = flat["x"][1] - flat["x"][1][0]
            for k in range(batch.num_rows):
                x, y, x2, y2 = (part(c, k) for c in ("x", "y", "x2", "y2"))
                near[at[k] : at[k + 1]] = (((x[:, None] - x2) ** 2 + (y[:, None] - y2) ** 2) <= eps * eps).sum(1)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(at))
            some = near > 0
            yield pa.RecordBatch.from_arrays([batch.column("grp").take(pa.array(rows[some])), flat["ids"][0].filter(pa.array(some)), pa.array(near[some])], names=["grp", "id", "k"])

    kinds = dict(points.dtypes)
    beyond = met.mapInArrow(count, f"grp {kinds['grp']}, id {kinds['id']}, k long")
    own = dealt.join(cells, CELL).select("grp", "id", F.col("n").alias("k"))
    return own.unionByName(beyond).groupBy("grp", "id").agg(F.sum("k").alias("near"))


#: The eight directions whose outermost points stand for a cell.
_WAYS = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1)]


def _outline(cores: DataFrame, keys: list[str], eps: float, halvings: int) -> DataFrame:
    """(grp, cx, cy, sx, sy, edge, box, first): outermost points, box and least id of the cores in each part of a cell after so many halvings."""
    side = eps * SIDE / 2**halvings
    part = [F.floor(F.col(c) / side).alias(s) if halvings else F.col(k).alias(s) for c, k, s in (("lon", "cx", "sx"), ("lat", "cy", "sy"))]
    place = F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))
    edge = F.array(*(F.max_by(place, F.col("lon") * i + F.col("lat") * j) for i, j in _WAYS))
    box = F.struct(F.min("lon").alias("x1"), F.max("lon").alias("x2"), F.min("lat").alias("y1"), F.max("lat").alias("y2"))
    return cores.select(*keys, "id", "lon", "lat", *part).groupBy(*keys, "sx", "sy").agg(F.array_distinct(edge).alias("edge"), box.alias("box"), F.min("id").alias("first"))


def _judged(pairs: DataFrame, eps: float) -> DataFrame:
    """Pairs of parts (a_edge, a_box, b_edge, b_box) with ``linked``; those that are too far apart are left out."""
    gap = lambda lo, hi: F.greatest(F.col(f"b_box.{lo}") - F.col(f"a_box.{hi}"), F.col(f"a_box.{lo}") - F.col(f"b_box.{hi}"), F.lit(0.0))
    wide, high = gap("x1", "x2"), gap("y1", "y2")
    seen = F.exists("a_edge", lambda p: F.exists("b_edge", lambda q: _apart(p["x"], p["y"], q["x"], q["y"]) <= eps * eps))
    # a rounded gap may be a little too wide, so what is close to eps stays
    return pairs.where(wide * wide + high * high <= eps * eps * (1 + 1e-9)).select("*", seen.alias("linked"))


def _side(outline: DataFrame, end: str, keys: dict[str, str]) -> DataFrame:
    return outline.select("grp", *(F.col(k).alias(v) for k, v in keys.items()), *(F.col(c).alias(f"{end}_{c}") for c in ("sx", "sy", "edge", "box")))


def _connected_cells(cores: DataFrame, whole: DataFrame, eps: float, scratch: Scratch) -> DataFrame:
    """(id, component) of cells, as structs of group and place, that hold cores within eps of each other; ``whole`` is their outline."""
    a_keys, b_keys = {"cx": "ax", "cy": "ay"}, {"cx": "bx", "cy": "by"}
    later = [o for o in REACH if o > (0, 0)]  # each pair of cells once
    b = _side(whole, "b", {"cx": "cx", "cy": "cy"})
    first = _around(whole.select(*CELL, *(F.col(c).alias(f"a_{c}") for c in ("sx", "sy", "edge", "box"))), later).join(b, CELL).withColumnsRenamed({"cx": "bx", "cy": "by"})
    names = ["grp", "ax", "ay", "bx", "by"]
    state = {"open": F.coalesce(F.sum((~F.col("linked")).cast("long")), F.lit(0))}
    pairs, seen = scratch.measured("pairs0", _judged(first, eps).select(*names, "a_sx", "a_sy", "b_sx", "b_sy", "linked"), **state)
    ends = lambda df: df.select(F.struct("grp", F.col("ax").alias("cx"), F.col("ay").alias("cy")).alias("a"), F.struct("grp", F.col("bx").alias("cx"), F.col("by").alias("cy")).alias("b"))
    links = ends(pairs.where("linked"))
    found = connected_components(links)
    if seen["open"]:
        # cells that others connect need no nearest pair of their own
        of = lambda end, x, y: found.select(F.col("id.grp").alias("grp"), F.col("id.cx").alias(x), F.col("id.cy").alias(y), F.col("component").alias(end))
        still = pairs.where("not linked").join(of("p", "ax", "ay"), ["grp", "ax", "ay"], "left").join(of("q", "bx", "by"), ["grp", "bx", "by"], "left").where("p is null or q is null or p <> q").drop("p", "q")
        still, seen = scratch.measured("open0", still, open=F.count(F.lit(1)))
        halvings, more = 0, []
        while seen["open"] and halvings < HALVINGS:
            halvings += 2
            parts = still.select("grp", F.col("ax").alias("cx"), F.col("ay").alias("cy")).unionByName(still.select("grp", F.col("bx").alias("cx"), F.col("by").alias("cy"))).distinct()
            nodes = scratch.table("nodes", _outline(cores.join(parts, CELL, "left_semi"), CELL, eps, halvings))
            up = lambda c: F.floor(F.col(c) / 4)  # noqa: E731  a part lies in the part of the halvings before, up to the cell itself
            parent = nodes.select("*", up("sx").alias("px"), up("sy").alias("py"))
            side = lambda end, keys: parent.select("grp", *(F.col(k).alias(v) for k, v in keys.items()), F.col("px").alias(f"{end}_sx"), F.col("py").alias(f"{end}_sy"), F.struct("sx", "sy", "edge", "box").alias(end))
            split = still.join(side("a", a_keys), ["grp", "ax", "ay", "a_sx", "a_sy"]).join(side("b", b_keys), ["grp", "bx", "by", "b_sx", "b_sy"])
            split = split.select(*names, *(F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in "ab" for c in ("sx", "sy", "edge", "box")))
            pairs, _ = scratch.measured(f"pairs{halvings}", _judged(split, eps).select(*names, "a_sx", "a_sy", "b_sx", "b_sy", "linked"), **state)
            now = pairs.where("linked").select(*names).distinct()
            more.append(now)
            still, seen = scratch.measured(f"open{halvings}", pairs.where("not linked").drop("linked").join(now, names, "left_anti"), open=F.count(F.lit(1)))
        if seen["open"]:
            side = eps * SIDE / 2**halvings
            at = cores.select(*CELL, "lon", "lat", F.floor(F.col("lon") / side).alias("sx"), F.floor(F.col("lat") / side).alias("sy"))
            mine = lambda end, keys: at.select("grp", *(F.col(k).alias(v) for k, v in keys.items()), F.col("sx").alias(f"{end}_sx"), F.col("sy").alias(f"{end}_sy"), F.col("lon").alias(f"{end}_x"), F.col("lat").alias(f"{end}_y"))
            met = still.join(mine("a", a_keys), ["grp", "ax", "ay", "a_sx", "a_sy"]).join(mine("b", b_keys), ["grp", "bx", "by", "b_sx", "b_sy"])
            more.append(met.where(_apart(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y")) <= eps * eps).select(*names).distinct())
        if more:
            found = connected_components(reduce(DataFrame.unionByName, [links, *(ends(m) for m in more)]))
    return found


def dbscan(points: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """points (grp, id, lon, lat) with label: clusters of a group from 0 by their first core, -1 for noise.

    A core has at least min_samples points within eps, itself included; a border point takes the lowest label near it.
    ids are distinct within a group.  Points of no group, or whose place is null, NaN or
    infinite, are noise and near nothing.
    """
    scratch, columns = Scratch(points.sparkSession), points.columns
    placed = scratch.table("placed", _placed(points, eps))
    cells = scratch.table("cells", placed.groupBy(*CELL).agg(F.count("*").alias("n")))
    full = cells.where(F.col("n") >= min_samples).select(*CELL)
    thin = scratch.table("thin", placed.join(cells.where(F.col("n") < min_samples).select(*CELL), CELL).select(*columns, "cx", "cy"))
    # a thin cell has under min_samples points, so a point meets a bounded number of them
    here = F.col("lon"), F.col("lat")
    thin_around = _around(thin.select("grp", "id", F.col("lon").alias("t_lon"), F.col("lat").alias("t_lat"), "cx", "cy"))
    close = _apart(F.col("t_lon"), F.col("t_lat"), *here) <= eps * eps
    counted = thin_around.join(placed.select(*CELL, "lon", "lat"), CELL).where(close).groupBy("grp", "id").agg(F.count("*").alias("k"))
    alone = scratch.table("alone", counted.where(F.col("k") >= min_samples).select("grp", "id"))
    core_cells = placed.join(full, CELL, "left_semi").select(*CELL, "id", "lon", "lat")
    cores = scratch.table("cores", core_cells.unionByName(thin.join(alone, ["grp", "id"], "left_semi").select(*CELL, "id", "lon", "lat")))
    whole = scratch.table("outline", _outline(cores, CELL, eps, 0))
    found = _connected_cells(cores, whole, eps, scratch).select("id.*", "component")
    joined = whole.select(*CELL, "first").join(found, CELL, "left").withColumn("component", F.coalesce("component", F.struct(*CELL)))
    numbers = joined.groupBy("grp", "component").agg(F.min("first").alias("first")).withColumn("label", F.row_number().over(Window.partitionBy("grp").orderBy("first")) - 1)
    labels = scratch.table("labels", joined.join(numbers.select("grp", "component", "label"), ["grp", "component"]).select(*CELL, "label"))
    inside = placed.join(full, CELL, "left_semi").join(labels, CELL).select(*columns, "label")
    named = thin.join(alone.select("grp", "id", F.lit(True).alias("core")), ["grp", "id"], "left").join(labels, CELL, "left")
    border = thin_around.join(alone, ["grp", "id"], "left_anti").join(cores.select(*CELL, "lon", "lat"), CELL).where(close)
    border = border.select("grp", "id", "cx", "cy").distinct().join(labels, CELL).groupBy("grp", "id").agg(F.min("label").alias("near"))
    named = named.join(border, ["grp", "id"], "left").select(*columns, F.coalesce(F.when(F.col("core"), F.col("label")), "near", F.lit(-1)).alias("label"))
    nowhere = points.where(~_is_place()).select(*columns, F.lit(-1).alias("label"))
    return scratch.last(inside.unionByName(named).unionByName(nowhere))
