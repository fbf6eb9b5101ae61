"""Column functions over band and class vectors. Vectors are arrays; arithmetic is unrolled so that it stays compiled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BAND_MEANS, BAND_STDS, BANDS, DEBRIS_BOOST, DELIVERED, EMPTY_BANDS, N_CLASSES, WL_NIR, WL_RED, WL_SWIR


def _at(bands: Column, k: int) -> Column:
    return F.get(bands, F.lit(k)).cast("double")


def _clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def pad_bands(bands: Column) -> Column:
    """Eight delivered bands as eleven, with zeros where a band was not delivered."""
    return F.array(*(_at(bands, DELIVERED.index(b)) if b in DELIVERED else F.lit(0.0) for b in BANDS))


def fit_bands(bands: Column) -> Column:
    """Any number of bands as eleven: eight are the delivered ones, more are cut, fewer get zeros at the end."""
    n, want = F.size(bands), len(BANDS)
    bands = F.transform(bands, lambda x: x.cast("double"))
    return F.when(n == len(DELIVERED), pad_bands(bands)).when(n >= want, F.slice(bands, 1, want)).otherwise(F.concat(bands, F.array_repeat(F.lit(0.0), F.greatest(F.lit(want) - n, F.lit(0)))))


def is_nodata(bands: Column) -> Column:
    """True where the bands add up to zero (which they may without all being zero)."""
    total = F.lit(0.0)
    for k in range(len(BANDS)):
        total = total + _at(bands, k)
    return total == 0


def normalize(bands: Column, scale: float = 10000.0) -> Column:
    """Standard scores of reflectances: scaled, clipped to [0.0001, 0.5], centred, nodata to 0, clipped to 5, NaN to 0."""
    gone = is_nodata(bands)
    out = []
    for k, (mean, std) in enumerate(zip(BAND_MEANS, BAND_STDS, strict=True)):
        x = _at(bands, k)
        # NaN is the largest value to Spark's least(), so it is put aside before clipping
        z = F.when(F.isnan(x), F.lit(float("nan"))).otherwise((_clip(x / scale, 1e-4, 0.5) - mean) / (std + 1e-6))
        out.append(F.when(gone, F.lit(0.0)).when(F.isnan(z), F.lit(0.0)).otherwise(_clip(z, -5.0, 5.0)))
    return F.array(*out)


def training_scale(bands: Column, scores: bool = False) -> Column:
    """Reflectances clipped to [0, 1] with NaN as 0; with ``scores`` centred and scaled besides, without a clip."""
    out = []
    for k, (mean, std) in enumerate(zip(BAND_MEANS, BAND_STDS, strict=True)):
        x = _clip(F.nanvl(_at(bands, k), F.lit(0.0)) / 10000.0, 0.0, 1.0)
        out.append((x - mean) / (std + 1e-6) if scores else x)
    return F.array(*out)


def denormalize(bands: Column, nodata: Column) -> Column:
    """Reflectances of standard scores; zero where there is no data and in the bands that are never delivered."""
    out = [F.lit(0.0) if k in EMPTY_BANDS else F.when(nodata, 0.0).otherwise(_at(bands, k) * std + mean) for k, (mean, std) in enumerate(zip(BAND_MEANS, BAND_STDS, strict=True))]
    return F.array(*out)


def spectral_indices(spectrum: Column) -> dict[str, Column]:
    """pi, sr, nsi and fdi of a mean spectrum."""
    red, edge, nir, narrow, swir = (_at(spectrum, BANDS.index(b)) for b in ("B04", "B06", "B08", "B8A", "B11"))
    eps = 1e-8
    step = (WL_NIR - WL_RED) / (WL_SWIR - WL_RED + eps)
    return {"pi": (nir - red) / (nir + red + eps), "sr": swir / (nir + eps), "nsi": (narrow - swir) / (narrow + swir + eps), "fdi": nir - (edge + (swir - edge) * step)}


def features(spectrum: Column, names: list[str]) -> Column:
    """The named bands as an array; an unknown name takes the first band."""
    return F.array(*(_at(spectrum, BANDS.index(n) if n in BANDS else 0) for n in names))


def softmax_boost(logits: Column, boost: float = DEBRIS_BOOST, n: int = N_CLASSES) -> Column:
    """Class probabilities: the first logit is raised, all are held within 30 of zero."""
    parts = F.array(*(F.exp(_clip(_at(logits, k) + (boost if k == 0 else 0.0), -30.0, 30.0)) for k in range(n)))
    # arrays of one entry bind the exponentials and their sum to names, so both are computed once
    bound = F.transform(F.array(parts), lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, y: a + y).alias("total")))
    shares = F.transform(bound, lambda b: F.transform(b["e"], lambda x: x / b["total"]))
    return F.get(shares, F.lit(0))


def top_class(probs: Column) -> Column:
    """Index of the largest probability, the lowest one on ties."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def is_debris(probs: Column, threshold: float, floor: float = 0.0) -> Column:
    """Debris is the first class: the likeliest one, with more than ``threshold`` and ``floor``."""
    return (top_class(probs) == 0) & (_at(probs, 0) > max(threshold, floor))


def label_index(raw: Column) -> Column:
    """File labels 1 to 15 as 0 to 14; 0, null and no data as null."""
    return F.when(raw > 0, raw - 1)
