"""Evaluation of predicted classes against labels, and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import N_CLASSES
from ..functions.bands import label_index
from .percentiles import exact_percentiles


def _count(condition) -> F.Column:
    return F.sum(condition.cast("long"))


def labelled_pixels(truth: DataFrame) -> DataFrame:
    """truth (patch, raw, pred) with gt 0 to 14; pixels without a label go."""
    return truth.withColumn("gt", label_index(F.col("raw"))).where("gt is not null")


def patch_metrics(truth: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Debris counts, precision, recall, IoU and F1 per patch; null where there is neither debris nor a false alarm."""
    p, g = F.col("pred") == 0, F.col("gt") == 0
    out = labelled_pixels(truth).groupBy("patch").agg(_count(p & g).alias("tp"), _count(p & ~g).alias("fp"), _count(~p & g).alias("fn"), F.count("*").alias("labeled_px"))
    any_ = (F.col("tp") + F.col("fn") > 0) | (F.col("fp") > 0)
    out = out.withColumns({"precision": F.when(any_, F.col("tp") / (F.col("tp") + F.col("fp") + eps)), "recall": F.when(any_, F.col("tp") / (F.col("tp") + F.col("fn") + eps)), "iou": F.when(any_, F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn") + eps))})
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps))


def patch_class_iou(truth: DataFrame, eps: float = 1e-9) -> DataFrame:
    """(patch, cls, inter, union, iou) for the classes that a patch has in labels or predictions."""
    rows = labelled_pixels(truth)
    sides = rows.select("patch", F.explode(F.array_distinct(F.array("gt", "pred"))).alias("cls"), (F.col("gt") == F.col("pred")).alias("hit"))
    out = sides.groupBy("patch", "cls").agg(_count(F.col("hit")).alias("inter"), F.count("*").alias("union"))
    return out.withColumn("iou", F.col("inter") / (F.col("union") + eps))


def evaluation_summary(patches: DataFrame) -> DataFrame:
    """One row over patch metrics: mean and median IoU, how many pass 0.5, 0.7 and 0.9, means; nulls are left out."""
    passes = [_count(F.coalesce(F.col("iou") > t, F.lit(False))).alias(f"over_{int(100 * t)}") for t in (0.5, 0.7, 0.9)]
    one = patches.agg(F.count("*").alias("patches"), F.avg("iou").alias("mean_iou"), *passes, F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.avg("f1").alias("mean_f1"))
    median = exact_percentiles(patches.select(F.lit(0).alias("all"), "iou"), ["all"], "iou", [0.5]).select(F.col("p0").alias("median_iou"))
    return one.join(F.broadcast(median), on=F.lit(True), how="left")  # one row each


def confusion(truth: DataFrame) -> DataFrame:
    return labelled_pixels(truth).groupBy("gt", "pred").agg(F.count("*").alias("n"))


def micro_iou(truth: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(cls, inter, union, iou) over all pixels, for classes that occur."""
    sides = confusion(truth).select(F.explode(F.array_distinct(F.array("gt", "pred"))).alias("cls"), (F.col("gt") == F.col("pred")).alias("hit"), "n")
    return sides.groupBy("cls").agg(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("inter"), F.sum("n").alias("union")).withColumn("iou", F.col("inter") / (F.col("union") + eps))


def micro_summary(truth: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(miou, pixel_accuracy) over all pixels."""
    accuracy = confusion(truth).agg((F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)) / (F.sum("n") + eps)).alias("pixel_accuracy"))
    return micro_iou(truth, eps).agg(F.avg("iou").alias("miou")).join(F.broadcast(accuracy), how="inner", on=F.lit(True))


def debris_micro(patches: DataFrame, least: int = 5, eps: float = 1e-9) -> DataFrame:
    """Debris metrics over the patches with at least ``least`` debris pixels, and their mean IoU."""
    kept = patches.where(F.col("tp") + F.col("fn") >= least)
    out = kept.agg(F.count("*").alias("patches"), *(F.sum(k).alias(k) for k in ("tp", "fp", "fn")), F.avg("iou").alias("mean_patch_iou"))
    return out.withColumns({"iou": F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn") + eps), "precision": F.col("tp") / (F.col("tp") + F.col("fp") + eps), "recall": F.col("tp") / (F.col("tp") + F.col("fn") + eps)})


def debris_patches_only(truth: DataFrame, top: int = 30, ignored_count: bool = True, eps: float = 1e-9) -> DataFrame:
    """The patches with most debris; with ``ignored_count`` the union also has predictions on unlabelled pixels."""
    gt, pred = F.coalesce(F.col("raw") == 1, F.lit(False)), F.col("pred") == 0
    counted = pred if ignored_count else pred & (F.col("raw") > 0)
    out = truth.groupBy("patch").agg(_count(gt).alias("gt_px"), _count(gt & pred).alias("tp"), _count(counted | gt).alias("union_px"), _count(pred & ~gt & (F.col("raw") > 0)).alias("fp")).where("gt_px > 0")
    return out.withColumn("iou", F.col("tp") / (F.col("union_px") + eps)).orderBy(F.desc("gt_px"), "patch").limit(top)


def classification_report(truth: DataFrame) -> DataFrame:
    """(cls, precision, recall, f1, support) of the classes that occur; 0 where a share has no base."""
    c = confusion(truth)
    rows = c.groupBy(F.col("gt").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    cols = c.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    out = rows.join(cols, "cls", "full").na.fill(0)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumns({"precision": share(F.col("tp"), F.col("predicted")), "recall": share(F.col("tp"), F.col("support"))})
    return out.select("cls", "precision", "recall", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def class_weights(truth: DataFrame, boost: float = 1.0, cap: float | None = 10.0) -> DataFrame:
    """(cls, weight) for the 15 classes: inverse frequency with mean 1.

    With ``cap`` an absent class counts one pixel and weights are held to cap times the median; without it an absent
    class weighs 1 before scaling.  ``boost`` multiplies the first class.
    """
    spark = truth.sparkSession
    counts = labelled_pixels(truth).groupBy(F.col("gt").cast("int").alias("cls")).agg(F.count("*").alias("n"))
    every = spark.range(N_CLASSES).select(F.col("id").cast("int").alias("cls")).join(counts, "cls", "left")
    all_ = Window.partitionBy(F.lit(1))
    share = lambda n: F.sum("n").over(all_) / (N_CLASSES * n)
    out = every.withColumn("w", share(F.coalesce("n", F.lit(1))) if cap else F.coalesce(share(F.col("n")), F.lit(1.0)))
    if cap:
        out = out.withColumn("w", F.least("w", cap * F.median("w").over(all_)))
    out = out.withColumn("w", F.when(F.col("cls") == 0, F.col("w") * boost).otherwise(F.col("w")))
    return out.select("cls", (F.col("w") / F.avg("w").over(all_)).alias("weight"))


def threshold_profile(probs: DataFrame, value: str, thresholds=(0.1, 0.01, 0.001)) -> DataFrame:
    """One row: the share of pixels above each threshold."""
    return probs.agg(*(F.avg((F.col(value) > t).cast("double")).alias(f"over_{k}") for k, t in enumerate(thresholds)))


def compare_models(scores: DataFrame) -> DataFrame:
    """(metric, one column per model, best) from rows (model, metric, value); models without a value cannot win."""
    models = [r["model"] for r in scores.select("model").distinct().orderBy("model").collect()]
    best = scores.where("value is not null").groupBy("metric").agg(F.max_by("model", F.struct("value", "model")).alias("best"))
    return scores.groupBy("metric").pivot("model", models).agg(F.first("value")).join(best, "metric", "left")
