"""Data-set audits, class balance and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import CLASSES
from ..functions.rules import class_name
from ..sources.session import cut
from .percentiles import exact_percentiles


def class_distribution(truth: DataFrame, by: str = "split") -> DataFrame:
    """(split, cls, name, pixels, percent) for file labels 1 to 15; percent of the split's labelled pixels."""
    out = truth.where(F.col("raw").between(1, len(CLASSES))).groupBy(by, F.col("raw").alias("cls")).agg(F.count("*").alias("pixels"))
    return out.select(by, "cls", class_name(F.col("cls") - 1).alias("name"), "pixels", (100.0 * F.col("pixels") / F.sum("pixels").over(Window.partitionBy(by))).alias("percent"))


def imbalance(truth: DataFrame, by: str = "split", target: float = 0.35) -> DataFrame:
    """Per split: debris and other pixels, their ratio, patches with debris, and how many to add to reach the target share."""
    px = F.col("raw")
    pixels = truth.groupBy(by).agg(F.sum((px == 1).cast("long")).alias("debris_px"), F.sum((px > 1).cast("long")).alias("other_px"))
    patches = truth.groupBy(by, "patch").agg(F.max((px == 1).cast("int")).alias("has")).groupBy(by).agg(F.count("*").alias("patches"), F.sum("has").cast("long").alias("with_debris"))
    out = pixels.join(patches, by)
    ratio = F.col("other_px") / F.when(F.col("debris_px") > 0, F.col("debris_px").cast("double")).otherwise(1e-9)
    return out.select("*", ratio.alias("ratio"), F.greatest(F.lit(0).cast("long"), F.floor(F.col("patches") * target) - F.col("with_debris")).alias("to_add"))


def level_distribution(levels: DataFrame, column: str) -> DataFrame:
    """(level, n, percent) of the levels above 0."""
    out = levels.where(F.col(column) > 0).groupBy(F.col(column).alias("level")).agg(F.count("*").alias("n"))
    return out.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def parse_patch_labels(lines: DataFrame, column: str = "value") -> DataFrame:
    """(patch, labels) from lines ``name [1, 7]`` or ``name 1 7``; other lines are skipped."""
    line = F.trim(column)
    inside = F.regexp_extract(line, r"\[([^\]]*)\]", 1)
    text = F.when(line.contains("["), inside).otherwise(F.regexp_replace(line, r"^\S+", ""))
    labels = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))
    return lines.select(F.regexp_extract(line, r"^([^\s\[]+)", 1).alias("patch"), labels.alias("labels")).where((F.col("patch") != "") & (F.size("labels") > 0))


def label_frequency(patch_labels: DataFrame) -> DataFrame:
    """(label, patches, percent): how many patches carry each label."""
    total = patch_labels.agg(F.count("*").alias("all"))
    out = patch_labels.select(F.explode(F.array_distinct("labels")).alias("label")).groupBy("label").agg(F.count("*").alias("patches"))
    return out.join(F.broadcast(total), on=F.lit(True)).select("label", "patches", (100.0 * F.col("patches") / F.col("all")).alias("percent"))


def label_combinations(patch_labels: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent sets of labels, as text."""
    combo = F.array_join(F.transform(F.array_sort(F.array_distinct("labels")), lambda x: x.cast("string")), "+")
    return patch_labels.groupBy(combo.alias("combination")).agg(F.count("*").alias("patches")).orderBy(F.desc("patches"), "combination").limit(top)


def band_statistics(tiles: DataFrame, patch: str = "vec_id") -> DataFrame:
    """(band, mean, std): means over patches of each patch's mean and population deviation."""
    per_patch = tiles.groupBy(patch, "band").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return per_patch.groupBy("band").agg(F.avg("m").alias("mean"), F.avg("s").alias("std"))


def patch_checks(tiles: DataFrame, patch: str, value: str = "value", bound: float = 5.5) -> DataFrame:
    """Least, largest, mean, deviation of each patch, and whether values are in bounds and vary."""
    out = tiles.groupBy(patch).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.select("*", ((F.col("least") >= -bound) & (F.col("most") <= bound)).alias("in_range"), (F.col("std") > 0.01).alias("varies"))


def percentile_stretch(tiles: DataFrame, keys: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """tiles with ``stretched``: values between two percentiles of their group as 0 to 1."""
    marks = exact_percentiles(tiles, keys, "value", [low, high])
    x = (F.col("value") - F.col("p0")) / (F.col("p1") - F.col("p0") + 1e-6)
    return tiles.join(marks, keys).select(*tiles.columns, F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)).alias("stretched"))


def gamma_stretch(tiles: DataFrame, keys: list[str], over: float = -4.5, least: int = 100, low: float = 0.01, high: float = 0.99, gamma: float = 0.7) -> DataFrame:
    """tiles with ``stretched``: as ``percentile_stretch``, by percentiles of the values above ``over``, then raised to a power.

    A group with fewer than ``least`` such values is 0 throughout; a value that is null or NaN gives null or NaN elsewhere.
    """
    marks = exact_percentiles(tiles.where(F.col("value") > over), keys, "value", [low, high]).where(F.col("n") >= least)
    x = (F.col("value") - F.col("p0")) / (F.col("p1") - F.col("p0") + 1e-6)
    held = F.when(F.isnan("value"), F.col("value")).otherwise(F.pow(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), F.lit(gamma)))
    return tiles.join(marks, keys, "left").select(*tiles.columns, F.when(F.col("n").isNull(), 0.0).when(F.col("value").isNotNull(), held).alias("stretched"))


def patch_name_parts(name) -> dict[str, F.Column]:
    """Date, tile and folder of a patch name like ``S2_1-12-19_48MYU_0``; null with fewer than three parts."""
    parts = F.split(name, "_")
    ok = F.size(parts) >= 3
    folder = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), "_")
    return {"date": F.when(ok, F.get(parts, F.lit(1))), "tile": F.when(ok, F.get(parts, F.lit(2))), "folder": F.when(ok, folder)}


def file_kinds(files: DataFrame, column: str = "file") -> DataFrame:
    """files with kind (mask, confidence or image by suffix) and stem, the name without suffix and ending."""
    base = F.regexp_replace(column, r"\.tif$", "")
    kind = F.when(base.endswith("_cl"), "mask").when(base.endswith("_conf"), "confidence").otherwise("image")
    return files.select("*", kind.alias("kind"), F.regexp_replace(base, "_(cl|conf)$", "").alias("stem"))


def resolve_pairs(split_names: DataFrame, files: DataFrame) -> DataFrame:
    """(name, image, mask) for the names of a split list that have both; prefix ``S2_`` is put where it lacks."""
    name = F.trim("value")
    wanted = split_names.where(name != "").select(F.when(F.lower(name).startswith("s2_"), name).otherwise(F.concat(F.lit("S2_"), name)).alias("name")).distinct()
    kinds = file_kinds(files)
    image, mask = (kinds.where(F.col("kind") == k).select(F.col("stem").alias("name"), F.col("file").alias(k)) for k in ("image", "mask"))
    return wanted.join(image, "name").join(mask, "name")


def pair_files(files: DataFrame) -> DataFrame:
    """(name, image, mask): images and masks by their stems; a file without the other stands alone."""
    kinds = file_kinds(files)
    image, mask = (kinds.where(F.col("kind") == k).select(F.col("stem").alias("name"), F.col("file").alias(k)) for k in ("image", "mask"))
    return image.join(mask, "name", "full")


def patches_with_class(truth: DataFrame, raw: int = 1, without: bool = False) -> DataFrame:
    """The patches that have (or have not) a pixel of a file label."""
    patches, has = truth.select("patch").distinct(), truth.where(F.col("raw") == raw).select("patch").distinct()
    return patches.join(has, "patch", "left_anti" if without else "left_semi")


def numbered(rows: DataFrame, column: str, name: str = "k") -> DataFrame:
    """rows with their place from 0 in the order of a column of distinct values.

    Ranges of the column are numbered side by side; only the ranges' counts, a row each, are added up in one place.
    """
    ranged = cut(rows.repartitionByRange(column).withColumn("_range", F.spark_partition_id()))
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_first", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(column)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_own") + F.col("_first")).drop("_range", "_own", "_n", "_first")


def oversample(patches: DataFrame, ratio: float = 0.35) -> DataFrame:
    """patches (patch, has_debris) and cyclic copies of those with debris up to ``ratio`` of the original count.

    Copies are named ``<patch>_aug<i>``; the i-th copy is of the debris patch at i modulo their number.
    """
    n = patches.agg(F.count("*").alias("n"), F.sum(F.col("has_debris").cast("long")).alias("d")).select("d", F.greatest(F.lit(0).cast("long"), F.floor(F.col("n") * ratio) - F.col("d")).alias("extra"))
    with_debris = numbered(patches.where("has_debris"), "patch")
    # copies of the patch at k are k, k + d, k + 2d ... below the number of extra ones
    copies = with_debris.join(F.broadcast(n), on=F.lit(True)).where("k < extra").select("patch", F.explode(F.sequence(F.col("k").cast("long"), F.col("extra") - 1, F.col("d"))).alias("i"))
    return patches.select(F.col("patch").cast("string").alias("name"), "has_debris").unionByName(copies.select(F.concat(F.col("patch").cast("string"), F.lit("_aug"), F.col("i").cast("string")).alias("name"), F.lit(True).alias("has_debris")))


def uniform(draw: Column, seed: int) -> Column:
    """A number from 0 to below 1 with 52 bits of the md5 of "<seed>:<draw>"."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), draw.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / 2**52


def weighted_sample(rows: DataFrame, key: str, weight: str, n: int, seed: int = 7) -> DataFrame:
    """(draw, key): n draws with replacement, each row with probability by its weight; weights that are null or not over 0 give none.

    A draw's place comes from the md5 of seed and draw, so it is the same wherever it is made.  Rows take stretches of a line in the order of their keys, draws fall on it, and both are sorted together: a draw's row
    is the last one that begins before it.  Sorting goes by ranges; only a row for each range is added up in one place.
    """
    ranged = lambda df, *by: cut(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spread = ranged(rows.select(key, F.col(weight).cast("double").alias("w")).where("w > 0"), key)
    sizes = spread.groupBy("_range").agg(F.sum("w").alias("size"))
    first = sizes.select("_range", F.coalesce(F.sum("size").over(before), F.lit(0.0)).alias("first"))
    own = F.sum("w").over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    line = spread.withColumn("own", own).join(F.broadcast(first), "_range").select((F.col("first") + F.col("own")).alias("at"), key, F.lit(None).cast("long").alias("draw"))
    whole = F.broadcast(sizes.agg(F.sum("size").alias("whole")))
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), uniform(F.col("id"), seed).alias("u")).join(whole, on=F.lit(True))
    draws = draws.select((F.col("u") * F.col("whole")).alias("at"), F.lit(None).cast(rows.schema[key].dataType).alias(key), "draw")
    both = ranged(line.unionByName(draws), "at")
    order = [F.col("at"), F.col("draw").isNotNull(), F.col(key)]
    latest = F.last(key, ignorenulls=True).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = both.groupBy("_range").agg(F.max(F.when(F.col("draw").isNull(), F.struct("at", F.col(key).alias("k")))).alias("end"))
    carried = ends.select("_range", F.last("end.k", ignorenulls=True).over(before).alias("carried"))
    found = both.withColumn("latest", latest).where("draw is not null").join(F.broadcast(carried), "_range", "left")
    return found.select("draw", F.coalesce("latest", "carried").alias(key))


def numbered_labels(labels: DataFrame, column: str) -> DataFrame:
    """(label, id): the distinct labels numbered from 0 in alphabetical order."""
    return numbered(labels.select(F.col(column).alias("label")).where("label is not null").distinct(), "label", "id")
