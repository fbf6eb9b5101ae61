"""Rules that name things: polymers, classes, confidence, places, explanations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CLASSES, COUNTRIES, PLACES, WEIGHTS

# Outcomes of the spectral rules.
ORGANIC, PE_PP, PET, MIXED, UNIDENTIFIED, UNCLASSIFIED = "Organic Matter", "PE/PP (Polyethylene/Polypropylene)", "PET/Nylon", "Mixed/Degraded Polymer", "Unidentified Plastic", "Unclassified Debris"


def classify_polymer(pi: Column, sr: Column, nsi: Column, fdi: Column) -> Column:
    return (
        F.when(nsi > 0.35, ORGANIC)
        .when((pi > 0.1) & (sr < 0.3), PE_PP)
        .when((pi > 0.1) & (sr > 0.5), PET)
        .when((pi > 0.05) & (nsi < 0), MIXED)
        .when(fdi > 0.05, UNIDENTIFIED)
        .otherwise(UNCLASSIFIED)
    )


def is_false_positive(nsi: Column) -> Column:
    return F.coalesce(nsi > 0.35, F.lit(False))


def keeps_unless_false_positive(flag: Column) -> Column:
    """Rows stay unless the flag is true; an unknown flag stays."""
    return ~F.coalesce(flag, F.lit(False))


def class_name(index: Column) -> Column:
    out = F.lit("Unclassified")
    for k, (name, _, _) in enumerate(CLASSES):
        out = F.when(index == k, name).otherwise(out)
    return out


def class_polymer(name: Column) -> Column:
    """Polymer name of a class name; an unknown one passes through."""
    out = name
    for n, polymer, _ in CLASSES:
        out = F.when(name == n, polymer).otherwise(out)
    return out


def class_is_false_positive(name: Column) -> Column:
    return name.isin([n for n, _, false in CLASSES if false])


def confidence_band(score: Column) -> Column:
    return F.when(score > 0.6, "high").when(score > 0.3, "moderate").otherwise("low")


def _inside(lon: Column, lat: Column, box) -> Column:
    return (lon > box[0]) & (lon < box[2]) & (lat > box[1]) & (lat < box[3])


def _fixed(x: Column, digits: int) -> Column:
    """A number with so many digits, halves to even."""
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def location_name(lon: Column, lat: Column) -> Column:
    east = F.when(lon < 0, "W").otherwise("E")
    north = F.when(lat < 0, "S").otherwise("N")
    out = F.concat(F.lit("Ocean region ("), _fixed(F.abs(lon), 1), F.lit("°"), east, F.lit(", "), _fixed(F.abs(lat), 1), F.lit("°"), north, F.lit(")"))
    for name, *box in reversed(PLACES):
        out = F.when(_inside(lon, lat, box), name).otherwise(out)
    return out


def country_name(lon: Column, lat: Column) -> Column:
    out = F.lit("International Waters")
    for name, *box in reversed(COUNTRIES):
        out = F.when(_inside(lon, lat, box), name).otherwise(out)
    return out


def attribution_score(scores: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted sum; a missing score counts as 0."""
    out = F.lit(0.0)
    for name, weight in weights.items():
        out = out + weight * F.coalesce(scores[name], F.lit(0.0))
    return out


def dominant_source(scores: dict[str, Column]) -> Column:
    """The source type with the largest score; earlier ones in the order of weights win ties."""
    known = {k: F.coalesce(scores[k], F.lit(0.0)) for k in WEIGHTS}
    most = F.greatest(*known.values())
    *first, last = WEIGHTS
    out = F.lit(last)
    for name in reversed(first):
        out = F.when(known[name] == most, name).otherwise(out)
    return out


def explanation(score: Column, kind: Column, lon: Column, lat: Column, days: Column, vessels: Column, sites: Column, site_names: Column, river: Column, river_km: Column) -> Column:
    """One sentence on why a source is likely."""
    band = F.when(score > 0.6, "High").when(score > 0.3, "Moderate").otherwise("Low")
    head = F.concat(band, F.lit(" probability ("), _fixed(score * 100, 0), F.lit("%): "))
    spot = F.concat(F.lit("("), _fixed(lon, 2), F.lit(", "), _fixed(lat, 2), F.lit(")"))
    text = lambda x: x.cast("string")
    names = F.when(F.size(site_names) > 0, F.concat(F.lit(" ("), F.array_join(F.slice(site_names, 1, 3), ", "), F.lit(")"))).otherwise("")
    fishing = F.concat(F.lit("Fishing activity near "), spot, F.lit(". "), text(vessels), F.lit(" vessel(s) detected in this area ~"), text(days), F.lit(" days before detection."))
    industrial = F.concat(text(sites), F.lit(" industrial/waste site(s)"), names, F.lit(" within search radius of source region at "), spot, F.lit("."))
    shipping = F.concat(F.lit("Major shipping lane overlap near "), spot, F.lit(". Estimated "), text(days), F.lit(" days drift time."))
    from_river = F.concat(F.lit("River discharge from "), river, F.lit(" ("), _fixed(river_km, 0), F.lit(" km from source region). Estimated "), text(days), F.lit(" days drift time."))
    return F.concat(head, F.when(kind == "fishing", fishing).when(kind == "industrial", industrial).when(kind == "shipping", shipping).otherwise(from_river))
