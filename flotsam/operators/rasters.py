"""Rasters as pixel tables: assembling bands, tiles, stitching, augmentation, labelled clusters and their spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..constants import BANDS, DEBRIS_THRESHOLD, DELIVERED, MAX_AREA, MIN_AREA, N_CLASSES, OVERLAP, PATCH
from ..functions.bands import is_debris, softmax_boost, top_class
from ..sources.session import Scratch
from .graph import connected_components
from .zones import row_strips, zonal_means

AUGMENTATIONS = ("original", "hflip", "vflip", "rot90", "rot180", "rot270")


def assemble_bands(band_pixels: DataFrame) -> DataFrame:
    """(scene_id, y, x, bands) from rows (scene_id, band, y, x, value); bands that a scene lacks are zero.

    A scene without any delivered band has no rows.
    """
    wide = band_pixels.where(F.col("band").isin(*DELIVERED)).groupBy("scene_id", "y", "x").pivot("band", list(DELIVERED)).agg(F.first("value"))
    value = lambda b: F.coalesce(F.col(b).cast("double"), F.lit(0.0)) if b in DELIVERED else F.lit(0.0)
    return wide.select("scene_id", "y", "x", F.array(*map(value, BANDS)).alias("bands"))


def regrid(pixels: DataFrame, to_h: int, to_w: int) -> DataFrame:
    """Bilinear samples (scene_id, y, x, value) on a to_h by to_w grid whose corners are those of the input grid."""
    size = pixels.groupBy("scene_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    place = lambda t, n, to: t * (n - 1) / (to - 1) if to > 1 else F.lit(0.0)

    def parts(n: str, to: int, at: str, t: str) -> DataFrame:
        """(n, at, t, weight): which places of a side of each length that occurs have a part in which samples."""
        sides = size.select(n).distinct().select(n, F.explode(F.sequence(F.lit(0), F.lit(to - 1))).alias(t)).withColumn("s", place(F.col(t), F.col(n), to))
        two = sides.select(n, t, "s", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
        part = F.col("s") - F.floor("s")
        return two.select(n, t, (F.floor("s") + F.col("k")).cast("int").alias(at), F.when(F.col("k") == 1, part).otherwise(1 - part).alias(f"{t}_weight")).where(f"{t}_weight > 0")

    # pixels meet tables that are as small as the sides are few; a grid for each scene would be many times its pixels
    met = pixels.join(size, "scene_id").join(parts("h", to_h, "y", "ty"), ["h", "y"]).join(parts("w", to_w, "x", "tx"), ["w", "x"])
    return met.groupBy("scene_id", F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum(F.col("ty_weight") * F.col("tx_weight") * F.col("value")).alias("value"))


def _tiles_along(length: Column, patch: int, overlap: int) -> Column:
    """How many tiles cover a side: the last one is the first to reach the edge."""
    if not 0 <= overlap < patch:
        raise ValueError("tiles must overlap by less than their size")
    return F.when(length <= patch, 1).otherwise(F.ceil((length - patch) / (patch - overlap)).cast("int") + 1)


def tile_index(scenes: DataFrame, patch: int = PATCH, overlap: int = OVERLAP) -> DataFrame:
    """One row per tile of scenes (scene_id, h, w[, transform]): place, actual size, id by rows, own transform."""
    step = patch - overlap
    out = scenes.select("*", _tiles_along(F.col("w"), patch, overlap).alias("across"), F.explode(F.sequence(F.lit(0), _tiles_along(F.col("h"), patch, overlap) - 1)).alias("tile_row"))
    out = out.select("*", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("tile_col"))
    out = out.select("*", (F.col("tile_row") * step).alias("row_start"), (F.col("tile_col") * step).alias("col_start"))
    name = F.format_string("patch_%04d", F.col("tile_row") * F.col("across") + F.col("tile_col"))
    cols = ["scene_id", name.alias("patch_id"), "tile_row", "tile_col", "row_start", "col_start", F.least(F.lit(patch), F.col("h") - F.col("row_start")).alias("actual_h"), F.least(F.lit(patch), F.col("w") - F.col("col_start")).alias("actual_w")]
    if "transform" in scenes.columns:
        t = [F.get("transform", F.lit(k)) for k in range(6)]
        moved = F.array(t[0], t[1], t[2] + t[0] * F.col("col_start") + t[1] * F.col("row_start"), t[3], t[4], t[5] + t[3] * F.col("col_start") + t[4] * F.col("row_start"))
        cols.append(moved.alias("transform"))
    return out.select(*cols)


def tile_pixels(pixels: DataFrame, scenes: DataFrame, patch: int = PATCH, overlap: int = OVERLAP) -> DataFrame:
    """pixels once for each tile that covers them, with tile_row, tile_col and the place r, c within it.

    The tiles of a pixel follow from its place by arithmetic, so nothing is joined but the scenes' sizes.
    """
    step = patch - overlap
    sized = pixels.join(scenes.select("scene_id", _tiles_along(F.col("h"), patch, overlap).alias("down"), _tiles_along(F.col("w"), patch, overlap).alias("across")), "scene_id")
    span = lambda at, n: F.sequence(F.greatest(F.ceil((at - patch + 1) / step), F.lit(0)).cast("int"), F.least(F.floor(at / step).cast("int"), n - 1))
    out = sized.select("*", F.explode(span(F.col("y"), F.col("down"))).alias("tile_row")).select("*", F.explode(span(F.col("x"), F.col("across"))).alias("tile_col"))
    return out.select(*pixels.columns, "tile_row", "tile_col", (F.col("y") - F.col("tile_row") * step).alias("r"), (F.col("x") - F.col("tile_col") * step).alias("c"))


def complete_tiles(tiles: DataFrame, predictions: DataFrame, n: int = N_CLASSES) -> DataFrame:
    """Every tile with its prediction; a missing one is zeros and still counts in means."""
    return tiles.join(predictions.select("scene_id", "patch_id", "probs"), ["scene_id", "patch_id"], "left").withColumn("probs", F.coalesce("probs", F.array_repeat(F.lit(0.0), n)))


def complete_pixels(tiles: DataFrame, predictions: DataFrame, n: int = N_CLASSES, pixels: DataFrame | None = None) -> DataFrame:
    """predictions (scene_id, tile_row, tile_col, r, c, probs) and zeros for every pixel of the tiles that have none.

    tiles are those of ``tile_index``.  A tile counts as predicted if one of its pixels is.  Where scenes may lack pixels,
    ``pixels`` (scene_id, y, x) has those that there are, and no others get zeros.
    """
    tile = ["scene_id", "tile_row", "tile_col"]
    missing = tiles.join(predictions.select(*tile).distinct(), tile, "left_anti")
    rows = missing.select("*", F.explode(F.sequence(F.lit(0), F.col("actual_h") - 1)).alias("r"))
    zeros = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("actual_w") - 1)).alias("c"))
    if pixels is not None:
        zeros = zeros.withColumns({"y": F.col("row_start") + F.col("r"), "x": F.col("col_start") + F.col("c")})
        place = ["scene_id", "y", "x"]
        zeros = zeros.join(pixels.select(*place).hint("merge"), place, "left_semi")  # pixels are sized too low after an explode
    zeros = zeros.select(*tile, "r", "c", F.array_repeat(F.lit(0.0), n).alias("probs"))
    return predictions.select(*tile, "r", "c", "probs").unionByName(zeros)


def pixel_results(tiles: DataFrame, predictions: DataFrame, patch: int = PATCH, overlap: int = OVERLAP, threshold: float = DEBRIS_THRESHOLD, pixels: DataFrame | None = None) -> DataFrame:
    """(scene_id, y, x, prob, cls, is_debris): completed tiles stitched to class means, the likeliest class, and the debris mask.

    ``pixels`` as in ``complete_pixels``.
    """
    stitched = stitch(complete_pixels(tiles, predictions, pixels=pixels), "probs", patch, overlap, N_CLASSES)
    # means that differ by the order of a sum alone are the same, so equal classes stay equal
    means = F.transform(F.slice("probs", 1, N_CLASSES), lambda p: F.rint(p * 1e12) / 1e12)
    # an array of one array binds the means to a name: Spark moves a filter on the mask below, with a copy of them for each use
    found = F.transform(F.array(means), lambda p: F.struct(F.get(p, F.lit(0)).alias("prob"), top_class(p).alias("cls"), is_debris(p, threshold).alias("is_debris")))
    return stitched.select("scene_id", "y", "x", F.get(found, F.lit(0)).alias("found")).select("scene_id", "y", "x", "found.*")


def is_shared(patch: int, overlap: int) -> Column:
    """True where a tile's pixel may lie in another tile too: in the overlap with a tile before, or beyond where the next begins."""
    before = lambda at, tile: (F.col(at) < overlap) & (F.col(tile) > 0)
    after = lambda at: F.col(at) >= patch - overlap
    return before("r", "tile_row") | before("c", "tile_col") | after("r") | after("c")


def stitch(tiled: DataFrame, value: str = "value", patch: int = PATCH, overlap: int = OVERLAP, n: int | None = None) -> DataFrame:
    """Mean over the tiles that cover a pixel: (scene_id, y, x, value) from (scene_id, tile_row, tile_col, r, c, value).

    The value is a number, or an array of ``n`` numbers that each have their mean.  A tile is expected to hold a pixel once.
    Pixels that only one tile can cover pass as they are; those of the rims alone are grouped.
    """
    step = patch - overlap
    place = [F.col("scene_id"), (F.col("tile_row") * step + F.col("r")).alias("y"), (F.col("tile_col") * step + F.col("c")).alias("x")]
    kind = "double" if n is None else "array<double>"
    mean = F.avg(value) if n is None else F.array(*(F.avg(F.get(value, F.lit(k))) for k in range(n)))
    shared = is_shared(patch, overlap)
    rim = tiled.where(shared).select(*place, value).groupBy("scene_id", "y", "x").agg(mean.alias(value))
    return tiled.where(~shared).select(*place, F.col(value).cast(kind).alias(value)).unionByName(rim)


def augment(r: Column, c: Column, n: int, kind: str, inverse: bool = False) -> tuple[Column, Column]:
    """Where a pixel of an n by n tile goes under an augmentation, or from where it came."""
    last = F.lit(n - 1)
    moves = {
        "original": (r, c),
        "hflip": (r, last - c),
        "vflip": (last - r, c),
        "rot90": (last - c, r),
        "rot180": (last - r, last - c),
        "rot270": (c, last - r),
    }
    if inverse:
        kind = {"rot90": "rot270", "rot270": "rot90"}.get(kind, kind)
    return moves[kind]


def augmented_mean(predictions: DataFrame, n: int, keys: list[str], value: str = "value") -> DataFrame:
    """Mean of predictions (keys, kind, r, c, value) of augmented tiles, each put back to where its pixel came from."""
    r, c = F.lit(None).cast("int"), F.lit(None).cast("int")
    for kind in AUGMENTATIONS:
        back = augment(F.col("r"), F.col("c"), n, kind, inverse=True)
        r, c = F.when(F.col("kind") == kind, back[0]).otherwise(r), F.when(F.col("kind") == kind, back[1]).otherwise(c)
    return predictions.select(*keys, r.alias("r"), c.alias("c"), value).groupBy(*keys, "r", "c").agg(F.avg(value).alias(value))


def score_tiles(tile_rows: DataFrame, predict: Callable[[np.ndarray], np.ndarray], keys: list[str]) -> DataFrame:
    """(keys, probs): class probabilities for rows with a column ``bands``, by a callable from (n, 11) to (n, 15) logits.

    Rows go to the callable in Arrow batches; boost and softmax stay in Spark.
    """
    schema = tile_rows.select(*keys).schema.add("logits", T.ArrayType(T.DoubleType()))

    def run(frames):
        for frame in frames:
            logits = predict(np.stack(frame["bands"].to_numpy())) if len(frame) else np.empty((0, N_CLASSES))
            yield pd.concat([frame[keys], pd.Series(list(logits.astype(float)), name="logits", index=frame.index)], axis=1)

    return tile_rows.select(*keys, "bands").mapInPandas(run, schema).select(*keys, softmax_boost(F.col("logits")).alias("probs"))


def adjacent_pixels(mask: DataFrame) -> DataFrame:
    """Edges (a, b) between debris pixels that share a side; a pixel's id is a struct of scene, row and column.

    Runs along a row and column are found by the pixel before, so no pixel meets more than two others.
    """
    here = mask.where("is_debris").select("scene_id", "y", "x")
    me, near = F.struct("scene_id", "y", "x"), []
    for along, across in (("x", "y"), ("y", "x")):
        w = Window.partitionBy("scene_id", across).orderBy(along)
        before = F.lag(along).over(w)
        step = here.select("*", before.alias("before")).where(F.col("before") == F.col(along) - 1)
        prior = F.struct("scene_id", F.col("y") if along == "x" else F.col("before").alias("y"), F.col("before").alias("x") if along == "x" else F.col("x"))
        near.append(step.select(me.alias("a"), prior.alias("b")))
    return near[0].unionByName(near[1])


def _least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0 to n - 1 that each is linked with, over links (a, b)."""
    least = np.arange(n)
    while True:  # roots go under the least root that they are linked with, then all see their root
        low, high = np.minimum(least[a], least[b]), np.maximum(least[a], least[b])
        apart = low != high
        if not apart.any():
            return least
        a, b = a[apart], b[apart]
        np.minimum.at(least, high[apart], low[apart])
        while True:
            further = least[least]
            if (further == least).all():
                break
            least = further


def _first_of_blocks(block: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The row of the first pixel of each pixel's 4-connected cluster within its block, for rows in the order (block, y, x)."""
    same = lambda k: block[k:] == block[: len(block) - k]
    new = np.append(True, ~same(1) | (y[1:] != y[:-1]) | (x[1:] != x[:-1]))
    row = np.flatnonzero(new)
    block, y, x = block[row], y[row].astype(np.int64), x[row].astype(np.int64)
    at = np.arange(len(row))
    beside = at[1:][same(1) & (y[1:] == y[:-1]) & (x[1:] == x[:-1] + 1)]
    # the pixel above is looked up by its number in an order of all places of these blocks
    begin = np.flatnonzero(np.append(True, ~same(1)))
    sizes = np.diff(np.append(begin, len(row)))
    down, right = (v - np.repeat(np.minimum.reduceat(v, begin), sizes) for v in (y, x))
    height, width = down.max() + 2, right.max() + 1
    place = lambda dy: (np.repeat(np.arange(len(begin)), sizes) * height + down + 1 - dy) * width + right
    here, above = place(0), place(1)
    found = np.minimum(np.searchsorted(here, above), len(here) - 1)
    under = at[here[found] == above]
    least = _least_linked(len(row), np.concatenate((beside, under)), np.concatenate((beside - 1, found[under])))
    return row[least][np.cumsum(new) - 1]


def _labelled_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(scene_id, y, x, label_y, label_x) from (scene_id, y, x, k) where k counts each block's pixels from 1, in order; whole blocks at a time."""
    held: list[pa.RecordBatch] = []

    def labelled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        scene, y, x, k = (c.combine_chunks() for c in rows.columns)
        first = pa.array(_first_of_blocks(np.cumsum(k.to_numpy() == 1), y.to_numpy(), x.to_numpy()))
        yield from pa.table([scene, y, x, y.take(first).cast(pa.int32()), x.take(first).cast(pa.int32())], names=["scene_id", "y", "x", "label_y", "label_x"]).to_batches()

    for batch in batches:
        begins = np.flatnonzero(batch.column(3).to_numpy() == 1)
        if len(begins):
            end = int(begins[-1])
            done = pa.Table.from_batches([*held, batch.slice(0, end)])
            if len(done):
                yield from labelled(done)
            held, batch = [], batch.slice(end)
        held.append(batch)
    if held and (rest := pa.Table.from_batches(held)).num_rows:
        yield from labelled(rest)


def label_components(mask: DataFrame, block: int = 256) -> DataFrame:
    """(scene_id, y, x, first_y, first_x): debris pixels with the first pixel, by rows, of their 4-connected cluster.

    Pixels are first joined within blocks of a scene, so that the iterative part only sees one edge for each pair of labels
    that meet at a block's rim.  Blocks are labelled many at once, and only once: their labels are a table.
    """
    scratch = Scratch(mask.sparkSession)
    here = mask.where("is_debris").select("scene_id", "y", "x")
    in_block = Window.partitionBy("scene_id", F.floor(F.col("y") / block), F.floor(F.col("x") / block)).orderBy("y", "x")
    schema = here.schema.add("label_y", "integer").add("label_x", "integer")
    local = scratch.table("local", here.withColumn("k", F.row_number().over(in_block)).mapInArrow(_labelled_blocks, schema))
    label = F.struct("scene_id", F.col("label_y").alias("y"), F.col("label_x").alias("x")).alias("label")
    rim = []
    for axis, dy, dx in (("y", 1, 0), ("x", 0, 1)):
        ends = local.where(F.pmod(F.col(axis), F.lit(block)) == block - 1).select("scene_id", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), label.alias("a"))
        starts = local.where(F.pmod(F.col(axis), F.lit(block)) == 0).select("scene_id", "y", "x", label.alias("b"))
        rim.append(ends.join(starts, ["scene_id", "y", "x"]).select("a", "b"))
    joined = connected_components(rim[0].unionByName(rim[1]))
    out = local.select("scene_id", "y", "x", label).join(joined.withColumnRenamed("id", "label"), "label", "left").withColumn("first", F.coalesce("component", "label"))
    return scratch.last(out.select("scene_id", "y", "x", F.col("first.y").alias("first_y"), F.col("first.x").alias("first_x")))


def cluster_measures(labelled: DataFrame, pixel_area: float = 100.0, min_area: float = MIN_AREA, max_area: float = MAX_AREA) -> DataFrame:
    """One row per kept cluster of labelled pixels (with prob): size, confidence, centre and extent in pixels.

    cluster_id counts the kept clusters of a scene from 0 by their first pixel.
    """
    least = max(1, int(min_area / pixel_area))
    found = labelled.groupBy("scene_id", "first_y", "first_x").agg(
        F.count("*").alias("n_pixels"), F.avg("prob").alias("mean_confidence"), (F.avg("x") + 0.5).alias("centre_x"), (F.avg("y") + 0.5).alias("centre_y"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.min("x").alias("x_min"), F.max("x").alias("x_max")
    )
    kept = found.withColumn("area_m2", F.col("n_pixels") * pixel_area).where((F.col("n_pixels") >= least) & (F.col("area_m2") <= max_area))
    return kept.withColumn("cluster_id", F.row_number().over(Window.partitionBy("scene_id").orderBy("first_y", "first_x")) - 1)


def cluster_spans(labelled: DataFrame) -> DataFrame:
    """(scene_id, first_y, first_x, y, x_from, x_to): the runs of each cluster along rows, its exact outline."""
    w = Window.partitionBy("scene_id", "first_y", "first_x", "y").orderBy("x")
    runs = labelled.withColumn("island", F.col("x") - F.row_number().over(w))
    return runs.groupBy("scene_id", "first_y", "first_x", "y", "island").agg(F.min("x").alias("x_from"), F.max("x").alias("x_to")).drop("island")


def zonal_spectrum(labelled: DataFrame, pixels: DataFrame) -> DataFrame:
    """Mean of each band and share of pixels without data per cluster: (scene_id, first_y, first_x, spectrum, nodata_share)."""
    return zonal_means(cluster_spans(labelled), row_strips(pixels), ["first_y", "first_x"])


def classify_clusters(zones: DataFrame) -> DataFrame:
    """Adds pi, sr, nsi, fdi, polymer_type and is_false_positive to zones (spectrum, nodata_share).

    Mostly empty zones are ``No Data Region`` and false positives with indices 0; zones without pixels are unknown.
    """
    from ..functions.bands import spectral_indices
    from ..functions.rules import classify_polymer, is_false_positive

    index = spectral_indices(F.col("spectrum"))
    empty = F.coalesce(F.col("nodata_share"), F.lit(1.0)) > 0.7
    out = zones.select("*", *(F.when(empty, 0.0).otherwise(c).alias(k) for k, c in index.items()))
    kind = F.when(empty, "No Data Region").when(F.get("spectrum", F.lit(0)).isNull(), "Unknown (insufficient spectral data)").otherwise(classify_polymer(*map(F.col, ("pi", "sr", "nsi", "fdi"))))
    return out.select("*", kind.alias("polymer_type"), (empty | is_false_positive(F.col("nsi"))).alias("is_false_positive"))
