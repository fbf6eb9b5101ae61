"""Zonal means by running sums along raster rows: a run of a zone looks up its two ends, not its pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import BANDS
from ..functions.bands import is_nodata

#: Pixels of a raster row that are kept together with their running sums.
STRIP = 256


def row_strips(pixels: DataFrame, strip: int = STRIP) -> DataFrame:
    """(scene_id, y, strip, at): the pixels (scene_id, y, x, bands) of a stretch of a raster row, in order.

    Each has its x, the sums and counts of every band up to it (null, NaN and infinite entries left out), and how many
    pixels up to it have data.  Pixels that a raster lacks are not filled in; a place is expected once.
    """
    names, so_far = range(len(BANDS)), Window.partitionBy("scene_id", "y", "strip").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    placed = pixels.withColumn("strip", F.floor(F.col("x") / strip))
    value = [F.get("bands", F.lit(k)).cast("double") for k in names]
    known = [F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)) for v in value]
    flat = placed.select("scene_id", "y", "strip", "x", *(F.when(ok, v).otherwise(0.0).alias(f"v{k}") for k, v, ok in zip(names, value, known, strict=True)), *(ok.cast("long").alias(f"n{k}") for k, ok in zip(names, known, strict=True)), F.coalesce(~is_nodata(F.col("bands")), F.lit(False)).cast("long").alias("full"))
    upto = lambda c: F.sum(c).over(so_far)
    summed = flat.select("scene_id", "y", "strip", F.struct("x", F.array(*(upto(f"v{k}") for k in names)).alias("sums"), F.array(*(upto(f"n{k}") for k in names)).alias("counts"), upto("full").alias("full")).alias("p"))
    return summed.groupBy("scene_id", "y", "strip").agg(F.array_sort(F.collect_list("p")).alias("at"))


def _upto(x: Column) -> Column:
    """The running sums at the last pixel of a strip up to x; null before its first."""
    return F.get("at", F.aggregate("at", F.lit(0), lambda n, p: n + (p["x"] <= x).cast("int")) - 1)


def span_strips(spans: DataFrame, strip: int = STRIP) -> DataFrame:
    """Spans (scene_id, y, x_from, x_to, ...) cut where strips end, with the strip's number."""
    cut = spans.withColumn("strip", F.explode(F.sequence(F.floor(F.col("x_from") / strip), F.floor(F.col("x_to") / strip))))
    return cut.withColumns({"x_from": F.greatest("x_from", F.col("strip") * strip), "x_to": F.least("x_to", (F.col("strip") + 1) * strip - 1)})


def zonal_means(spans: DataFrame, strips: DataFrame, zone: list[str], strip: int = STRIP) -> DataFrame:
    """(scene_id, zone, spectrum, nodata_share) over the pixels of a zone's spans: the mean of each band, and the share without data.

    A pixel that the raster lacks counts as one without data; a band without any value is null.
    """
    met = span_strips(spans, strip).join(strips, ["scene_id", "y", "strip"], "left")
    # two steps, so that each end is looked up once
    ends = met.select("scene_id", *zone, (F.col("x_to") - F.col("x_from") + 1).alias("pixels"), _upto(F.col("x_from") - 1).alias("a"), _upto(F.col("x_to")).alias("b"))
    within = lambda c, k, zero: F.coalesce(F.get(f"b.{c}", F.lit(k)), F.lit(zero)) - F.coalesce(F.get(f"a.{c}", F.lit(k)), F.lit(zero))
    full = F.coalesce("b.full", F.lit(0)) - F.coalesce("a.full", F.lit(0))
    names = range(len(BANDS))
    sums = ends.groupBy("scene_id", *zone).agg(F.sum("pixels").alias("pixels"), F.sum(full).alias("full"), *(F.sum(within("sums", k, 0.0)).alias(f"v{k}") for k in names), *(F.sum(within("counts", k, 0)).alias(f"n{k}") for k in names))
    spectrum = F.array(*(F.when(F.col(f"n{k}") > 0, F.col(f"v{k}") / F.col(f"n{k}")) for k in names))
    return sums.select("scene_id", *zone, spectrum.alias("spectrum"), (1 - F.col("full") / F.col("pixels")).alias("nodata_share"))
