"""Spectral signatures: loading, forest training, and scoring to polymer names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.bands import spectral_indices, top_class
from ..functions.rules import class_is_false_positive, class_name, class_polymer, classify_polymer, is_false_positive
from ..sources.session import new_folder


def load_signatures(rows: DataFrame, wanted: list[str], label: str = "label") -> DataFrame:
    """The wanted columns that rows have, as floats, and the label as text."""
    return rows.select(*(F.col(c).cast("float").alias(c) for c in wanted if c in rows.columns), F.col(label).cast("string").alias("label"))


def train_forest(signatures: DataFrame, trees: int = 256, depth: int = 20, least: int = 5, debris_weight: float = 20.0, seed: int = 42) -> PipelineModel:
    """A forest over (bands, label); the first class weighs more."""
    rows = signatures.select(array_to_vector("bands").alias("features"), F.col("label").cast("double").alias("label"), F.when(F.col("label") == 0, debris_weight).otherwise(1.0).alias("weight"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=least, weightCol="weight", seed=seed)
    return Pipeline(stages=[forest]).fit(rows)


def forest_nodes(model: PipelineModel) -> DataFrame:
    """(tree, node, feature, threshold, left, right, shares, weight, gain): the nodes of a forest; leaves have -1 for their children.

    shares are the classes' parts of the training weight at a node, gain is what its split takes off the impurity.  The
    table is as large as the forest.
    """
    spark = SparkSession.active()
    path = new_folder(spark, "forest")
    model.stages[-1].write().save(path)
    at = lambda c: F.col(f"nodeData.{c}")
    total = F.aggregate(at("impurityStats"), F.lit(0.0), lambda a, x: a + x)
    split = (at("split.featureIndex").alias("feature"), F.get(at("split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"))
    return spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), at("id").alias("node"), *split, at("leftChild").alias("left"), at("rightChild").alias("right"), F.transform(at("impurityStats"), lambda x: x / total).alias("shares"), total.alias("weight"), at("gain").alias("gain"))


def feature_importance(nodes: DataFrame) -> DataFrame:
    """(feature, importance): each feature's part of the gain, by weight, of a tree's splits, averaged over the trees that split."""
    inner = nodes.where("left >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("gain"))
    shares = inner.withColumn("share", F.col("gain") / F.sum("gain").over(Window.partitionBy("tree"))).groupBy("feature").agg(F.sum("share").alias("share"))
    return shares.join(F.broadcast(shares.agg(F.sum("share").alias("all"))), on=F.lit(True)).select("feature", (F.col("share") / F.col("all")).alias("importance"))


def vote(nodes: DataFrame, spectra: DataFrame, depth: int) -> DataFrame:
    """spectra (bands) with votes, the class probabilities by the forest of a node table, whose trees are ``depth`` deep at most.

    Spectra are dealt over tasks and the forest goes to each, so the node table must be of a size that a worker holds.  Every
    spectrum goes through every tree: a batch of them takes a step of a tree at once.  Null votes where there is no tree.
    """
    context, out = spectra.sparkSession.sparkContext, T.StructType([*spectra.schema.fields, T.StructField("votes", T.ArrayType(T.DoubleType()))])
    held = context.broadcast(_held_forest(nodes.select("tree", "node", "feature", F.col("threshold").cast("double"), "left", "right", "shares").orderBy("tree", "node").toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = _walked(_padded(batch.column(batch.schema.get_field_index("bands"))), held.value, depth)
            kept = pa.nulls(batch.num_rows, pa.list_(pa.float64())) if votes is None else pa.ListArray.from_arrays(np.arange(0, votes.size + 1, votes.shape[1], dtype=np.int32), votes.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, kept], names=[*batch.schema.names, "votes"])

    return spectra.repartition(3 * context.defaultParallelism).mapInArrow(run, out)


def _held_forest(table: pa.Table) -> tuple[np.ndarray, ...] | None:
    """(first, feature, threshold, left, right, shares): the first node of each tree, and the nodes by tree and number; leaves lead to themselves."""
    if not table.num_rows:
        return None
    column = lambda c, kind, gap: table[c].combine_chunks().cast(kind).fill_null(gap).to_numpy(zero_copy_only=False)
    tree, n = column("tree", pa.int64(), -1), np.arange(table.num_rows)
    first = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
    base = np.repeat(first, np.diff(np.append(first, len(tree))))
    ends = [column(c, pa.int64(), -1) for c in ("left", "right")]
    left, right = (np.where(ends[0] < 0, n, base + e) for e in ends)
    shares = table["shares"].combine_chunks()
    shares = shares.flatten().to_numpy(zero_copy_only=False).reshape(len(tree), -1)
    return first, column("feature", pa.int64(), -1), column("threshold", pa.float64(), np.nan), left, right, shares


def _padded(bands: pa.Array) -> np.ndarray:
    """Features by spectrum, as columns; NaN where there is none, and in one more column, which goes right at every split as NaN does."""
    sizes = bands.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.full((int(sizes.max(initial=0)) + 1, len(bands)), np.nan)
    values = bands.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(bands)), sizes)
    out[np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = values
    return out


def _walked(features: np.ndarray, forest: tuple[np.ndarray, ...] | None, depth: int) -> np.ndarray | None:
    """The mean of the shares at the leaves, tree by tree in order."""
    if forest is None:
        return None
    first, feature, threshold, left, right, shares = forest
    n = features.shape[1]
    place, flat = np.arange(n), features.ravel()
    start = np.where((feature >= 0) & (feature < len(features) - 1), feature, len(features) - 1) * n
    votes = np.zeros((n, shares.shape[1]))
    for root in first.tolist():
        at = np.full(n, root)
        for _ in range(depth):
            at = np.where(flat[start[at] + place] <= threshold[at], left[at], right[at])
        votes += shares[at]
    return votes / len(first)


def score_forest(model: PipelineModel | None, spectra: DataFrame) -> DataFrame:
    """spectra (bands) with prediction, class, polymer_type, is_false_positive, rf_confidence and the four indices.

    The forest's node table is read and its trees are walked by batches of spectra.  Without a model the rules give the
    polymer, prediction and class are null, and the confidence is 0.
    """
    index = [c.alias(k) for k, c in spectral_indices(F.col("bands")).items()]
    if model is None:
        ruled = spectra.select("*", *index)
        kind = (classify_polymer(*map(F.col, ("pi", "sr", "nsi", "fdi"))).alias("polymer_type"), is_false_positive(F.col("nsi")).alias("is_false_positive"), F.lit(0.0).alias("rf_confidence"))
        return ruled.select(*spectra.columns, F.lit(None).cast("double").alias("prediction"), F.lit(None).cast("string").alias("class"), *kind, "pi", "sr", "nsi", "fdi")
    depth = model.stages[-1].getMaxDepth()
    voted = vote(forest_nodes(model), spectra, depth)
    out = voted.select(*spectra.columns, top_class(F.col("votes")).cast("double").alias("prediction"), F.array_max("votes").alias("rf_confidence"))
    name = class_name(F.col("prediction").cast("int"))
    return out.select(*spectra.columns, "prediction", name.alias("class"), class_polymer(name).alias("polymer_type"), class_is_false_positive(name).alias("is_false_positive"), "rf_confidence", *index)


def classify_zones(zones: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """zones (spectrum, nodata_share) with indices, polymer_type, is_false_positive and rf_confidence, by the forest or else the rules.

    Zones mostly without data are ``No Data Region`` and false positives; those without a spectrum are unknown, and no false
    positives; both have indices and a confidence of 0.
    """
    empty = F.coalesce(F.col("nodata_share"), F.lit(1.0)) > 0.7
    unknown = F.get("spectrum", F.lit(0)).isNull()
    scored = score_forest(model, zones.withColumn("bands", F.col("spectrum")))
    held = [F.when(empty | unknown, 0.0).otherwise(F.col(c)).alias(c) for c in ("pi", "sr", "nsi", "fdi", "rf_confidence")]
    kind = F.when(empty, "No Data Region").when(unknown, "Unknown (insufficient spectral data)").otherwise(F.col("polymer_type"))
    return scored.select(*zones.columns, *held, kind.alias("polymer_type"), F.when(empty, True).when(unknown, False).otherwise(F.col("is_false_positive")).alias("is_false_positive"))


def fit_and_score(spectra: DataFrame, trees: int = 24, depth: int = 8) -> DataFrame:
    """One row: how many spectra were held out of training, the share told right, whether that beats the commonest label."""
    model = train_forest(spectra.where("vec_id % 4 <> 0"), trees, depth, debris_weight=1.0)
    scored = score_forest(model, spectra.where("vec_id % 4 = 0"))
    most = spectra.where("vec_id % 4 = 0").groupBy("label").count().agg((F.max("count") / F.sum("count")).alias("chance"))
    right = scored.agg(F.count("*").alias("held"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("right_share"))
    return right.join(F.broadcast(most), on=F.lit(True)).select("held", "right_share", (F.col("right_share") >= F.col("chance")).alias("over_chance"))
