"""Queries over labels, metrics, balance, catalogues, runs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CLASSES
from ..operators import audit as U
from ..operators import catalogue as C
from ..operators import metrics as M
from ..sources import files as W
from ..sources import supplied as S
from ..sources.session import cut, new_folder, table
from ..streaming import runs as live
from .band_queries import INDICES, ruled
from .drift_queries import ATTRIBUTED, attributed
from .registry import register

TRUTH = """tr0 AS (SELECT vec_id AS patch, p // 8 AS r, p % 8 AS c, v, (vec_id + (p // 8) * 3 + floor(abs(v) * 40)::BIGINT) % 16 AS raw FROM (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings)),
 tr AS (SELECT patch, ['train', 'val', 'test'][patch % 3 + 1] AS split, r, c, raw, CASE WHEN (c + patch) % 3 = 0 THEN (r + patch) % 15 ELSE greatest(raw - 1, 0) END AS pred FROM tr0),
 lab AS (SELECT *, raw - 1 AS gt FROM tr WHERE raw > 0)"""
PATCHES = TRUTH + """, pm0 AS (SELECT patch, count(*) FILTER (WHERE pred = 0 AND gt = 0) AS tp, count(*) FILTER (WHERE pred = 0 AND gt <> 0) AS fp, count(*) FILTER (WHERE pred <> 0 AND gt = 0) AS fn, count(*) AS labeled_px FROM lab GROUP BY 1),
 pm1 AS (SELECT *, CASE WHEN tp + fn > 0 OR fp > 0 THEN tp / (tp + fp + 1e-9) END AS precision, CASE WHEN tp + fn > 0 OR fp > 0 THEN tp / (tp + fn + 1e-9) END AS recall, CASE WHEN tp + fn > 0 OR fp > 0 THEN tp / (tp + fp + fn + 1e-9) END AS iou FROM pm0),
 pm AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-9) AS f1 FROM pm1)"""
SIDES = TRUTH + ", sd AS (SELECT patch, unnest(list_distinct([gt, pred])) AS cls, (gt = pred)::INT AS hit FROM lab), cls AS (SELECT cls, sum(hit) AS inter, count(*) AS uni FROM sd GROUP BY 1)"
_COUNTS = TRUTH + ", ct AS (SELECT gt, count(*) AS n FROM lab GROUP BY 1), ev AS (SELECT k, n FROM (SELECT unnest(range(15)) AS k) LEFT JOIN ct ON gt = k)"


def truth(spark, sf_dir):
    t = S.truth(spark, sf_dir)
    return t.withColumn("split", F.get(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("patch") % 3).cast("int")))


@register("d16_patch_metrics", "patch:i tp:i fp:i fn:i labeled_px:i precision:d recall:d iou:d f1:d", "SELECT * FROM pm", PATCHES)
def _(spark, sf_dir):
    return M.patch_metrics(truth(spark, sf_dir))


@register("d16_patch_class_iou", "patch:i cls:i inter:i uni:i iou:d", "SELECT patch, cls, sum(hit) AS inter, count(*) AS uni, sum(hit) / (count(*) + 1e-9) AS iou FROM sd GROUP BY 1, 2", SIDES)
def _(spark, sf_dir):
    return M.patch_class_iou(truth(spark, sf_dir)).withColumnRenamed("union", "uni")


_IOUS = [f"iou_{name.replace(' ', '_')}" for name, _, _ in CLASSES]


@register(
    "a16_evaluation_rows",
    "patch:i labeled_px:i gt_debris_px:i debris_iou:d debris_f1:d debris_prec:d debris_recall:d tp:i fp:i fn:i " + " ".join(f"{c}:d" for c in _IOUS),
    "SELECT patch, labeled_px, tp + fn AS gt_debris_px, iou AS debris_iou, f1 AS debris_f1, precision AS debris_prec, recall AS debris_recall, tp, fp, fn, " + ", ".join(f'"{c}"' for c in _IOUS) + " FROM pm JOIN wide USING (patch)",
    PATCHES + SIDES.removeprefix(TRUTH) + ", wide AS (SELECT patch, " + ", ".join(f"sum(hit) FILTER (WHERE cls = {k}) / (count(*) FILTER (WHERE cls = {k}) + 1e-9) AS \"{c}\"" for k, c in enumerate(_IOUS)) + " FROM sd GROUP BY 1)",
)
def _(spark, sf_dir):
    """A row for each patch with a column for each class, written as CSV and read back."""
    t = truth(spark, sf_dir)
    wide = M.patch_class_iou(t).groupBy("patch").pivot("cls", list(range(len(CLASSES)))).agg(F.first("iou")).withColumnsRenamed({str(k): c for k, c in enumerate(_IOUS)})
    m = M.patch_metrics(t).withColumns({"gt_debris_px": F.col("tp") + F.col("fn"), "debris_iou": F.col("iou"), "debris_f1": F.col("f1"), "debris_prec": F.col("precision"), "debris_recall": F.col("recall")})
    rows = m.join(wide, "patch").select("patch", "labeled_px", "gt_debris_px", "debris_iou", "debris_f1", "debris_prec", "debris_recall", "tp", "fp", "fn", *_IOUS)
    path = new_folder(spark, "evaluation-csv")
    W.write_csv(rows, path)
    return W.read_csv(spark, path, rows.schema)


@register("d17_evaluation_summary", "patches:i mean_iou:d median_iou:d over_50:i over_70:i over_90:i mean_precision:d mean_recall:d mean_f1:d", "SELECT count(*) AS patches, avg(iou) AS mean_iou, median(iou) AS median_iou, count(*) FILTER (WHERE iou > 0.5) AS over_50, count(*) FILTER (WHERE iou > 0.7) AS over_70, count(*) FILTER (WHERE iou > 0.9) AS over_90, avg(precision) AS mean_precision, avg(recall) AS mean_recall, avg(f1) AS mean_f1 FROM pm", PATCHES)
def _(spark, sf_dir):
    return M.evaluation_summary(M.patch_metrics(truth(spark, sf_dir)))


@register("d18_micro_iou", "cls:i inter:i uni:i iou:d", "SELECT cls, inter, uni, inter / (uni + 1e-6) AS iou FROM cls", SIDES)
def _(spark, sf_dir):
    return M.micro_iou(truth(spark, sf_dir)).withColumnRenamed("union", "uni")


@register("d18_micro_summary", "miou:d pixel_accuracy:d", "SELECT (SELECT avg(inter / (uni + 1e-6)) FROM cls) AS miou, (SELECT sum((gt = pred)::INT) / (count(*) + 1e-6) FROM lab) AS pixel_accuracy", SIDES)
def _(spark, sf_dir):
    return M.micro_summary(truth(spark, sf_dir))


@register("d19_debris_micro", "patches:i tp:i fp:i fn:i mean_patch_iou:d iou:d precision:d recall:d", "SELECT count(*) AS patches, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(iou) AS mean_patch_iou, sum(tp) / (sum(tp) + sum(fp) + sum(fn) + 1e-9) AS iou, sum(tp) / (sum(tp) + sum(fp) + 1e-9) AS precision, sum(tp) / (sum(tp) + sum(fn) + 1e-9) AS recall FROM pm WHERE tp + fn >= 5", PATCHES)
def _(spark, sf_dir):
    return M.debris_micro(M.patch_metrics(truth(spark, sf_dir)))


@register("d20_debris_patches", "patch:i gt_px:i tp:i union_px:i fp:i iou:d", "SELECT patch, count(*) FILTER (WHERE raw = 1) AS gt_px, count(*) FILTER (WHERE raw = 1 AND pred = 0) AS tp, count(*) FILTER (WHERE raw = 1 OR pred = 0) AS union_px, count(*) FILTER (WHERE raw > 1 AND pred = 0) AS fp, count(*) FILTER (WHERE raw = 1 AND pred = 0) / (count(*) FILTER (WHERE raw = 1 OR pred = 0) + 1e-9) AS iou FROM tr GROUP BY 1 HAVING gt_px > 0 ORDER BY gt_px DESC, patch LIMIT 30", TRUTH)
def _(spark, sf_dir):
    return M.debris_patches_only(truth(spark, sf_dir))


@register("d21_patch_label_accuracy", "accuracy:d", "SELECT avg((label + 0 = gt)::INT) AS accuracy FROM lab JOIN embeddings ON patch = vec_id", TRUTH)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patch"), "label")
    return M.labelled_pixels(truth(spark, sf_dir)).join(e, "patch").agg(F.avg((F.col("label") == F.col("gt")).cast("double")).alias("accuracy"))


@register("d22_model_comparison", "metric:s a:d b:d best:s", """SELECT metric, max(v) FILTER (WHERE model = 'a') AS a, max(v) FILTER (WHERE model = 'b') AS b, arg_max(model, (v, model)) FILTER (WHERE v IS NOT NULL) AS best FROM (
 SELECT 'iou_' || cls AS metric, 'a' AS model, inter / (uni + 1e-6) AS v FROM cls UNION ALL SELECT 'iou_' || gt, 'b', CASE WHEN gt % 4 > 0 THEN avg((gt = pred)::INT) END FROM lab GROUP BY gt) GROUP BY 1""", SIDES)
def _(spark, sf_dir):
    t = M.labelled_pixels(truth(spark, sf_dir))
    a = M.micro_iou(truth(spark, sf_dir)).select(F.concat(F.lit("iou_"), F.col("cls").cast("string")).alias("metric"), F.lit("a").alias("model"), F.col("iou").alias("value"))
    hit = F.avg((F.col("gt") == F.col("pred")).cast("double"))
    b = t.groupBy("gt").agg(hit.alias("v")).select(F.concat(F.lit("iou_"), F.col("gt").cast("string")).alias("metric"), F.lit("b").alias("model"), F.when(F.col("gt") % 4 > 0, F.col("v")).alias("value"))
    return M.compare_models(a.unionByName(b))


@register("d23_classification_report", "cls:i precision:d recall:d f1:d support:i", """SELECT cls, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, support FROM (SELECT cls, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r
 FROM (SELECT cls, (SELECT count(*) FROM lab WHERE gt = cls) AS support, (SELECT count(*) FROM lab WHERE pred = cls) AS predicted, (SELECT count(*) FROM lab WHERE gt = cls AND pred = cls) AS tp FROM cls))""", SIDES)
def _(spark, sf_dir):
    return M.classification_report(truth(spark, sf_dir))


@register("d24_class_weights", "cls:i weight:d", "SELECT k AS cls, w / avg(w) OVER () AS weight FROM (SELECT k, least(w, 10 * median(w) OVER ()) AS w FROM (SELECT k, sum(n) OVER () / (15 * coalesce(n, 1)) AS w FROM ev))", _COUNTS)
def _(spark, sf_dir):
    return M.class_weights(truth(spark, sf_dir))


@register("d25_boosted_weights", "cls:i weight:d", "SELECT k AS cls, w / avg(w) OVER () AS weight FROM (SELECT k, coalesce(sum(n) OVER () / (15 * n), 1) * CASE WHEN k = 0 THEN 3 ELSE 1 END AS w FROM ev)", _COUNTS)
def _(spark, sf_dir):
    return M.class_weights(truth(spark, sf_dir), boost=3.0, cap=None)


@register("d8_class_distribution", "split:s cls:i pixels:i percent:d", "SELECT split, raw AS cls, count(*) AS pixels, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split) AS percent FROM tr WHERE raw BETWEEN 1 AND 15 GROUP BY 1, 2", TRUTH)
def _(spark, sf_dir):
    return U.class_distribution(truth(spark, sf_dir))


@register("d9_imbalance", "split:s debris_px:i other_px:i patches:i with_debris:i ratio:d to_add:i", """SELECT *, other_px / greatest(debris_px, 1e-9) AS ratio, greatest(0, floor(patches * 0.35) - with_debris) AS to_add FROM (SELECT split, count(*) FILTER (WHERE raw = 1) AS debris_px, count(*) FILTER (WHERE raw > 1) AS other_px, count(DISTINCT patch) AS patches, count(DISTINCT CASE WHEN raw = 1 THEN patch END) AS with_debris FROM tr GROUP BY 1)""", TRUTH)
def _(spark, sf_dir):
    return U.imbalance(truth(spark, sf_dir))


@register("d10_confidence_levels", "level:i n:i percent:d", "SELECT raw % 4 AS level, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS percent FROM tr WHERE raw % 4 > 0 GROUP BY 1", TRUTH)
def _(spark, sf_dir):
    return U.level_distribution(truth(spark, sf_dir).withColumn("l", F.col("raw") % 4), "l")


LINES = "li AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'S2_' || source || '_' || doc_id || ' [' || quality || ', ' || (toxic + 2) || ']' WHEN doc_id % 5 = 1 THEN '' ELSE '  S2_' || source || '_' || doc_id || ' ' || (quality + 4) || ' ' || (doc_id % 7) END AS value FROM labels JOIN documents USING (doc_id))"
PARSED = LINES + ", pa AS (SELECT regexp_extract(trim(value), '^([^ \\[]+)', 1) AS patch, list_transform(regexp_extract_all(CASE WHEN contains(value, '[') THEN regexp_extract(value, '\\[([^\\]]*)\\]', 1) ELSE regexp_replace(trim(value), '^[^ ]+', '') END, '([0-9]+)', 1), lambda x: x::INT) AS labels FROM li WHERE value <> '')"


def label_lines(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    s = lambda c: F.col(c).cast("string")
    name = F.concat(F.lit("S2_"), F.col("source"), F.lit("_"), s("doc_id"))
    bracket = F.concat(name, F.lit(" ["), s("quality"), F.lit(", "), (F.col("toxic") + 2).cast("string"), F.lit("]"))
    plain = F.concat(F.lit("  "), name, F.lit(" "), (F.col("quality") + 4).cast("string"), F.lit(" "), (F.col("doc_id") % 7).cast("string"))
    return d.select(F.when(F.col("doc_id") % 5 == 0, bracket).when(F.col("doc_id") % 5 == 1, "").otherwise(plain).alias("value"))


@register("a10_parse_patch_labels", "patch:s first:i n:i", "SELECT patch, labels[1] AS first, len(labels) AS n FROM pa", PARSED)
def _(spark, sf_dir):
    return U.parse_patch_labels(label_lines(spark, sf_dir)).select("patch", F.get("labels", F.lit(0)).alias("first"), F.size("labels").alias("n"))


@register("d11_label_frequency", "label:i patches:i percent:d", "SELECT label, count(*) AS patches, 100.0 * count(*) / (SELECT count(*) FROM pa) AS percent FROM (SELECT unnest(list_distinct(labels)) AS label FROM pa) GROUP BY 1", PARSED)
def _(spark, sf_dir):
    return U.label_frequency(U.parse_patch_labels(label_lines(spark, sf_dir)))


@register("d11_label_combinations", "combination:s patches:i", "SELECT array_to_string(list_sort(list_distinct(labels)), '+') AS combination, count(*) AS patches FROM pa GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", PARSED)
def _(spark, sf_dir):
    return U.label_combinations(U.parse_patch_labels(label_lines(spark, sf_dir)))


@register("d12_band_statistics", "band:i mean:d std:d", "SELECT band, avg(m) AS mean, avg(s) AS std FROM (SELECT patch, c AS band, avg(v) AS m, stddev_pop(v) AS s FROM tr0 GROUP BY 1, 2) GROUP BY 1", TRUTH)
def _(spark, sf_dir):
    return U.band_statistics(S.tile_values(spark, sf_dir).withColumn("band", F.col("c")))


@register("d13_patch_checks", "vec_id:i least:d most:d mean:d std:d in_range:b varies:b", "SELECT patch AS vec_id, min(v) AS least, max(v) AS most, avg(v) AS mean, stddev_pop(v) AS std, min(v) >= -5.5 AND max(v) <= 5.5 AS in_range, stddev_pop(v) > 0.01 AS varies FROM tr0 GROUP BY 1", TRUTH)
def _(spark, sf_dir):
    return U.patch_checks(S.tile_values(spark, sf_dir), "vec_id")


@register("b28_percentile_stretch", "vec_id:i r:i c:i stretched:d", "SELECT patch AS vec_id, r, c, greatest(0, least(1, (v - quantile_cont(v, 0.02) OVER w) / (quantile_cont(v, 0.98) OVER w - quantile_cont(v, 0.02) OVER w + 1e-6))) AS stretched FROM tr0 WINDOW w AS (PARTITION BY patch)", TRUTH, 4)
def _(spark, sf_dir):
    return U.percentile_stretch(S.tile_values(spark, sf_dir), ["vec_id"])


@register(
    "b28_gamma_stretch",
    "vec_id:i r:i c:i stretched:d",
    """SELECT vec_id, r, c, CASE WHEN valid < 100 THEN 0 ELSE greatest(0, least(1, (v - lo) / (hi - lo + 1e-6))) ** 0.7 END AS stretched
 FROM tr1 JOIN (SELECT g, count(*) FILTER (v > -4.5) AS valid, quantile_cont(v, 0.01) FILTER (v > -4.5) AS lo, quantile_cont(v, 0.99) FILTER (v > -4.5) AS hi FROM tr1 GROUP BY 1) USING (g)""",
    TRUTH + ", tr1 AS (SELECT patch AS vec_id, patch // 3 AS g, r, c, v * 16 AS v FROM tr0)",
    4,
)
def _(spark, sf_dir):
    """Bands of three tiles each, some of which have under 100 values that count."""
    tiles = S.tile_values(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / 3).alias("g"), "r", "c", (F.col("value") * 16).alias("value"))
    return U.gamma_stretch(tiles, ["g"])


@register("b29_patch_names", "doc_id:i day:s tile:s folder:s", "SELECT doc_id, CASE WHEN n >= 3 THEN p[2] END AS day, CASE WHEN n >= 3 THEN p[3] END AS tile, CASE WHEN n >= 3 THEN array_to_string(p[1:n - 1], '_') END AS folder FROM (SELECT doc_id, string_split(name, '_') AS p, len(string_split(name, '_')) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'S2_' || source ELSE 'S2_' || source || '_48MYU_' || doc_id END AS name FROM documents))")
def _(spark, sf_dir):
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("S2_"), "source")).otherwise(F.concat(F.lit("S2_"), F.col("source"), F.lit("_48MYU_"), F.col("doc_id").cast("string")))
    p = U.patch_name_parts(F.col("name"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).select("doc_id", p["date"].alias("day"), p["tile"].alias("tile"), p["folder"].alias("folder"))


FILES = "fl AS (SELECT 'S2_' || source || '_' || doc_id || ['.tif', '_cl.tif', '_conf.tif'][k + 1] AS file, 'S2_' || source || '_' || doc_id AS stem, k, doc_id FROM documents, (SELECT unnest(range(3)) AS k) WHERE (doc_id + k) % 4 > 0)"


def files(spark, sf_dir):
    stem = F.concat(F.lit("S2_"), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", stem.alias("stem"), F.posexplode(F.array(*map(F.lit, (".tif", "_cl.tif", "_conf.tif")))).alias("k", "end"))
    return d.where((F.col("doc_id") + F.col("k")) % 4 > 0).select(F.concat("stem", "end").alias("file"))


@register("a8_resolve_pairs", "name:s image:s mask:s", "SELECT DISTINCT stem AS name, a.file AS image, b.file AS mask FROM fl a JOIN fl b USING (stem) WHERE a.k = 0 AND b.k = 1 AND a.doc_id % 2 = 0", FILES)
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    names = d.select(F.concat(F.when(F.col("doc_id") % 4 == 0, F.lit(" S2_")).otherwise(F.lit("")), F.col("source"), F.lit("_"), F.col("doc_id").cast("string")).alias("value"))
    return U.resolve_pairs(names, files(spark, sf_dir))


@register("c9_image_mask_pairs", "name:s image:s mask:s", """SELECT coalesce(a.stem, b.stem) AS name, a.file AS image, b.file AS mask
 FROM (SELECT * FROM fl WHERE k = 0) a FULL JOIN (SELECT * FROM fl WHERE k = 1) b ON a.stem = b.stem""", FILES)
def _(spark, sf_dir):
    return U.pair_files(files(spark, sf_dir))


@register("d15_dataset_overview", "kind:s files:i stems:i", "SELECT ['image', 'mask', 'confidence'][k + 1] AS kind, count(*) AS files, count(DISTINCT stem) AS stems FROM fl GROUP BY 1", FILES)
def _(spark, sf_dir):
    return U.file_kinds(files(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("files"), F.count_distinct("stem").alias("stems"))


@register("c10_patches_with_debris", "patch:i has:b", "SELECT patch, bool_or(raw = 1) AS has FROM tr GROUP BY 1", TRUTH)
def _(spark, sf_dir):
    t = truth(spark, sf_dir)
    return U.patches_with_class(t).withColumn("has", F.lit(True)).unionByName(U.patches_with_class(t, without=True).withColumn("has", F.lit(False)))


@register("s4_oversample", "name:s has_debris:b", """SELECT patch::VARCHAR AS name, has AS has_debris FROM fg UNION ALL SELECT p.patch || '_aug' || i, true FROM (SELECT unnest(range(greatest(0, floor((SELECT count(*) FROM fg) * 0.35)::BIGINT - (SELECT count(*) FROM fg WHERE has)))) AS i)
 JOIN (SELECT patch, row_number() OVER (ORDER BY patch) - 1 AS k FROM fg WHERE has) p ON k = i % (SELECT count(*) FROM fg WHERE has)""", TRUTH + ", fg AS (SELECT patch, bool_or(raw = 1 AND patch % 4 = 0) AS has FROM tr GROUP BY 1)")
def _(spark, sf_dir):
    p = truth(spark, sf_dir).groupBy("patch").agg(F.max(((F.col("raw") == 1) & (F.col("patch") % 4 == 0)).cast("int")).alias("h"))
    return U.oversample(p.select("patch", (F.col("h") == 1).alias("has_debris")))


@register(
    "s5_weighted_sample",
    "draw:i patch:i",
    """SELECT draw, arg_max(patch, first) AS patch FROM (SELECT i AS draw, ('0x' || substr(md5('7:' || i), 1, 13))::BIGINT / 2.0::DOUBLE ** 52 AS u FROM range((SELECT count(*) FROM wt)) t(i)) JOIN wt ON first <= u * whole GROUP BY 1""",
    TRUTH + ", wt AS (SELECT patch, sum(w) OVER (ORDER BY patch) - w AS first, sum(w) OVER () AS whole FROM (SELECT patch, CASE WHEN bool_or(raw = 1) THEN 8.0 ELSE 1.0 END::DOUBLE AS w FROM tr GROUP BY 1))",
)
def _(spark, sf_dir):
    """As many draws as patches, those with debris eight times as likely."""
    p = truth(spark, sf_dir).groupBy("patch").agg(F.max((F.col("raw") == 1).cast("int")).alias("has"))
    rows = p.withColumn("w", F.when(F.col("has") == 1, 8.0).otherwise(1.0))
    return U.weighted_sample(rows, "patch", "w", rows.count())


@register("s2_label_universe", "label:s id:i", "SELECT o_orderpriority AS label, row_number() OVER (ORDER BY o_orderpriority) - 1 AS id FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def _(spark, sf_dir):
    return U.numbered_labels(table(spark, sf_dir, "orders"), "o_orderpriority")


@register("s1_train_and_val", "label:i n:i", "SELECT label, count(*) AS n FROM (SELECT * FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT * FROM embeddings WHERE vec_id % 2 = 0) GROUP BY 1")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 3 = 0").unionByName(e.where("vec_id % 2 = 0")).groupBy("label").agg(F.count("*").alias("n"))


@register("a9_load_signatures", "label:s n:i total:d", "SELECT label::VARCHAR AS label, count(*) AS n, sum(embedding[1]::DOUBLE + embedding[2]::DOUBLE) AS total FROM embeddings GROUP BY 1", digits=4)
def _(spark, sf_dir):
    from ..operators.signatures import load_signatures

    e = table(spark, sf_dir, "embeddings").select("label", F.get("embedding", F.lit(0)).alias("nm440"), F.get("embedding", F.lit(1)).alias("nm490"))
    out = load_signatures(e, ["nm440", "nm490", "nm560"])
    return out.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("nm440").cast("double") + F.col("nm490").cast("double")).alias("total"))


CATALOGUE = "ca AS (SELECT o_orderkey AS scene_id, o_custkey % 40 AS aoi, o_orderdate AS acquired, o_totalprice % 100 AS cloud_cover, (o_custkey % 360 - 180)::DOUBLE AS lon, (o_orderkey % 140 - 70)::DOUBLE AS lat FROM orders)"


@register("a1_find_scenes", "scene_id:i cloud_cover:d", "SELECT scene_id, cloud_cover FROM ca WHERE lon BETWEEN -60 AND 90 AND lat BETWEEN -20 AND 30 AND acquired BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-01-01' AND cloud_cover < 20 ORDER BY acquired DESC, scene_id LIMIT 5", CATALOGUE)
def _(spark, sf_dir):
    return C.find_scenes(S.catalogue(spark, sf_dir), (-60, -20, 90, 30), "1995-01-01", "1998-01-01", 20.0, 5)


@register("e1_newest_per_area", "aoi:i scene_id:i", "SELECT aoi, arg_max(scene_id, (acquired, -scene_id)) AS scene_id FROM ca WHERE cloud_cover < 20 GROUP BY 1", CATALOGUE)
def _(spark, sf_dir):
    return C.newest_per(S.catalogue(spark, sf_dir))


def scene_assets(spark, sf_dir):
    c = S.catalogue(spark, sf_dir)
    key = lambda b, e: F.concat(F.lit(e), F.lit(b))
    href = lambda b: F.concat(F.lit("s3://"), F.col("scene_id").cast("string"), F.lit(f"/{b}"))
    return c.select("scene_id", F.create_map(key("b02", "x-"), href("1"), F.when(F.col("scene_id") % 3 == 0, F.lit("zz")).otherwise(F.lit("B04-10m")), href("2"), key("b02", "y-"), href("3")).alias("assets"))


@register("a2_resolve_assets", "scene_id:i band:s href:s", "SELECT scene_id, 'B02' AS band, 's3://' || scene_id || '/1' AS href FROM ca UNION ALL SELECT scene_id, 'B04', 's3://' || scene_id || '/2' FROM ca WHERE scene_id % 3 > 0", CATALOGUE)
def _(spark, sf_dir):
    return C.resolve_assets(scene_assets(spark, sf_dir), ["B02", "B04", "B12"])


@register("a3_manifest", "scene_id:i bands:s", """SELECT scene_id, '[{"band":"B02","href":"s3://' || scene_id || '/1"}' || CASE WHEN scene_id % 3 > 0 THEN ',{"band":"B04","href":"s3://' || scene_id || '/2"}' ELSE '' END || ']' AS bands FROM ca""", CATALOGUE)
def _(spark, sf_dir):
    return C.manifest(C.resolve_assets(scene_assets(spark, sf_dir), ["B02", "B04", "B12"]))


RUNS = "ru AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'PENDING' END AS status, o_orderdate AS created_at, o_orderdate + to_seconds(o_custkey) AS completed_at, o_totalprice % 101 AS cloud_cover, CASE WHEN o_orderkey % 5 = 0 THEN '1,2,x,4' WHEN o_orderkey % 7 = 0 THEN '1,2,3' ELSE '1, 2.5,3,' || o_orderkey END AS bbox FROM orders)"


def runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    box = F.when(F.col("o_orderkey") % 5 == 0, "1,2,x,4").when(F.col("o_orderkey") % 7 == 0, "1,2,3").otherwise(F.concat(F.lit("1, 2.5,3,"), F.col("o_orderkey").cast("string")))
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("PENDING")
    return o.select(F.col("o_orderkey").alias("run_id"), status.alias("status"), at.alias("created_at"), F.timestamp_add("SECOND", F.col("o_custkey").cast("int"), at).alias("completed_at"), (F.col("o_totalprice") % 101).alias("cloud_cover"), box.alias("bbox"))


@register("a11_valid_runs", "run_id:i", "SELECT run_id FROM ru WHERE run_id % 5 > 0 AND run_id % 7 > 0", RUNS)
def _(spark, sf_dir):
    return C.valid_runs(runs(spark, sf_dir))


@register("d31_run_kpis", "total:i completed:i failed:i running:i pending:i success_rate:i", "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status IN ('RUNNING', 'PENDING')) AS running, count(*) FILTER (WHERE status = 'PENDING') AS pending, floor(100 * count(*) FILTER (WHERE status = 'COMPLETED') / count(*) + 0.5) AS success_rate FROM ru", RUNS)
def _(spark, sf_dir):
    return C.run_kpis(runs(spark, sf_dir))


@register("d31_cloud_buckets", "bucket:i runs:i", "SELECT least(floor(cloud_cover / 20), 4) AS bucket, count(*) AS runs FROM ru GROUP BY 1", RUNS)
def _(spark, sf_dir):
    return C.cloud_buckets(runs(spark, sf_dir))


@register("e7_last_active_days", "day:s runs:i", "SELECT created_at::DATE AS day, count(*) AS runs FROM ru GROUP BY 1 ORDER BY 1 DESC LIMIT 14", RUNS)
def _(spark, sf_dir):
    return C.last_active_days(runs(spark, sf_dir))


@register("e9_run_durations", "run_id:i seconds:i", "SELECT run_id, epoch(completed_at)::BIGINT - epoch(created_at)::BIGINT AS seconds FROM ru ORDER BY created_at DESC, run_id LIMIT 50", RUNS)
def _(spark, sf_dir):
    return C.with_duration(runs(spark, sf_dir)).orderBy(F.desc("created_at"), "run_id").limit(50)


@register("d32_run_rollup", "run_id:i stages_done:i failures:i status:s", "SELECT *, CASE WHEN failures > 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM (SELECT l_orderkey AS run_id, count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_linenumber END) AS stages_done, count(*) FILTER (WHERE l_returnflag = 'R') AS failures FROM lineitem GROUP BY 1)")
def _(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return C.run_rollup(l.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("stage"), (F.col("l_returnflag") != "R").alias("ok")))


@register("s6_stages_left", "run_id:i n:i", "SELECT run_id, 7 - 2 - count(DISTINCT CASE WHEN stage BETWEEN 3 AND 7 THEN stage END) AS n FROM (SELECT l_orderkey AS run_id, l_linenumber AS stage FROM lineitem) GROUP BY 1")
def _(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.collect_set("l_linenumber").alias("done"))
    return done.select("run_id", F.size(C.stages_left(F.sequence(F.lit(1), F.lit(7)), F.array(F.lit(1), F.lit(2)), F.col("done"))).alias("n"))


DETECTIONS = INDICES + ", de AS (SELECT vec_id % 10 AS cluster_id, vec_id, polymer_type, is_false_positive, 100.0 * (1 + label) AS area_m2, (label % 5) / 5.0 AS mean_confidence, '2024-01-' || lpad((1 + vec_id % 28)::VARCHAR, 2, '0') AS detection_date, vec_id % 90 AS centroid_lat, vec_id % 180 AS centroid_lon FROM ruled)"


def detections(spark, sf_dir):
    day = F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("vec_id") % 28).cast("string"), 2, "0"))
    return ruled(spark, sf_dir).select((F.col("vec_id") % 10).alias("cluster_id"), "vec_id", "polymer_type", "is_false_positive", (100.0 * (1 + F.col("label"))).alias("area_m2"), (F.col("label") % 5 / 5).alias("mean_confidence"), day.alias("detection_date"), (F.col("vec_id") % 90).cast("double").alias("centroid_lat"), (F.col("vec_id") % 180).cast("double").alias("centroid_lon"))


@register("d30_executive_summary", "clusters:i false_positives:i area_km2:d mean_confidence:d detection_date:s dominant_polymer:s", "SELECT count(*) AS clusters, count(*) FILTER (WHERE is_false_positive) AS false_positives, sum(area_m2) / 1e6 AS area_km2, avg(mean_confidence) AS mean_confidence, min(detection_date) AS detection_date, (SELECT polymer_type FROM de GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS dominant_polymer FROM de", DETECTIONS)
def _(spark, sf_dir):
    return C.executive_summary(detections(spark, sf_dir))


#: The flat report's rows, and how often each polymer stands with each best source.
_FLAT = DETECTIONS + ", " + ATTRIBUTED + """, best AS (SELECT cluster_id, source_type, location_name, country, attribution_score FROM atr WHERE report_rank = 1),
 flat AS (SELECT cluster_id, centroid_lat AS lat, centroid_lon AS lon, area_m2 AS area_sq_m, polymer_type, mean_confidence AS confidence, coalesce(source_type, '') AS top_source_type, coalesce(location_name, '') AS top_source_location,
 coalesce(country, '') AS top_source_country, coalesce(attribution_score, 0) AS attribution_score, detection_date, 'S1' AS scene_id FROM de LEFT JOIN best USING (cluster_id))"""


@register(
    "a13_csv_rows",
    "cluster_id:i lat:d lon:d area_sq_m:d polymer_type:s confidence:d top_source_type:s top_source_location:s top_source_country:s attribution_score:d detection_date:s scene_id:s",
    "SELECT * FROM flat",
    _FLAT,
)
def flat_report(spark, sf_dir):
    """The twelve columns of the flat report, written as CSV and read back."""
    rows, path = C.csv_rows(C.report_join(detections(spark, sf_dir), attributed(spark, sf_dir)), "S1"), new_folder(spark, "report-csv")
    W.write_csv(rows, path)
    return W.read_csv(spark, path, rows.schema)


@register(
    "m11_report_tables",
    "polymer_type:s top_source_type:s clusters:i area:d features:i share:d is_dominant:b",
    """SELECT polymer_type, top_source_type, count(*) AS clusters, sum(area_sq_m) AS area, any_value(features) AS features, count(*) / (SELECT count(*) FROM de) AS share,
 polymer_type = (SELECT polymer_type FROM de GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS is_dominant FROM flat JOIN (SELECT polymer_type, count(*) AS features FROM de GROUP BY 1) USING (polymer_type) GROUP BY 1, 2""",
    _FLAT,
)
def report(spark, sf_dir):
    """The report's parts side by side: rows of the CSV, features of the collections, and the summary."""
    d = detections(spark, sf_dir)
    path = new_folder(spark, "report-geojson")
    W.write_collections(W.geojson_features(d.select("cluster_id", "polymer_type", "centroid_lon", "centroid_lat"), "centroid_lon", "centroid_lat"), path)
    features = W.read_collections(spark, path).groupBy(F.get_json_object("value", "$.properties.polymer_type").alias("polymer_type")).agg(F.count("*").alias("features"))
    rows = flat_report(spark, sf_dir).groupBy("polymer_type", "top_source_type").agg(F.count("*").alias("clusters"), F.sum("area_sq_m").alias("area"))
    whole = C.executive_summary(d).select(F.col("clusters").alias("all"), "dominant_polymer")
    out = rows.join(features, "polymer_type").join(F.broadcast(whole), on=F.lit(True))
    return out.select("*", (F.col("clusters") / F.col("all")).alias("share"), (F.col("polymer_type") == F.col("dominant_polymer")).alias("is_dominant"))


@register("a12_geojson", "value:s", """SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (vec_id % 180) || '.0,' || (vec_id % 90) || '.0]},"properties":{"cluster_id":' || cluster_id || ',"polymer_type":"' || polymer_type || '"}}' AS value FROM de""", DETECTIONS)
def _(spark, sf_dir):
    """The features of the collections that were written."""
    path = new_folder(spark, "geojson")
    W.write_collections(C.geojson_features(detections(spark, sf_dir).select("cluster_id", "polymer_type", "centroid_lon", "centroid_lat"), "centroid_lon", "centroid_lat"), path)
    return W.read_collections(spark, path)


@register("e2_top_clusters", "vec_id:i area_m2:d", "SELECT vec_id, area_m2 FROM de ORDER BY area_m2 DESC, vec_id DESC LIMIT 20", DETECTIONS)
def _(spark, sf_dir):
    return detections(spark, sf_dir).orderBy(F.desc("area_m2"), F.desc("vec_id")).limit(20)


@register("e8_percent_of_total", "polymer_type:s percent:d", "SELECT polymer_type, 100.0 * count(*) / sum(count(*)) OVER () AS percent FROM de GROUP BY 1", DETECTIONS)
def _(spark, sf_dir):
    d = detections(spark, sf_dir)
    counts = d.groupBy("polymer_type").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(d.agg(F.count("*").alias("all"))), on=F.lit(True)).select("polymer_type", (100.0 * F.col("n") / F.col("all")).alias("percent"))


@register("m14_balance_workflow", "split:s to_add:i debris_weight:d", """SELECT split, greatest(0, floor(patches * 0.35) - with_debris) AS to_add, (SELECT w / avg_w FROM (SELECT k, w, avg(w) OVER () AS avg_w FROM (SELECT k, coalesce(sum(n) OVER () / (15 * n), 1) * CASE WHEN k = 0 THEN 2 ELSE 1 END AS w FROM ev)) WHERE k = 0) AS debris_weight
 FROM (SELECT split, count(DISTINCT patch) AS patches, count(DISTINCT CASE WHEN raw = 1 THEN patch END) AS with_debris FROM tr GROUP BY 1)""", _COUNTS)
def _(spark, sf_dir):
    t = truth(spark, sf_dir)
    w = M.class_weights(t, boost=2.0, cap=None).where("cls = 0").select(F.col("weight").alias("debris_weight"))
    return U.imbalance(t).join(F.broadcast(w), on=F.lit(True))


#: Days of arrival that come in one file, and the days that every seventh user's events are on their way.
FILE_DAYS, DELAY_DAYS, LATE_DAYS, SILENT_DAYS = 6, 5, 2, 10


def streamed(spark, sf_dir, of, keys):
    """What ``of`` makes of the events as they arrive, some of them days after their time: the newest row of each key.

    After every arrival of files the stream goes on from its state, so a file is part of one batch.
    """
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.datediff("ts", F.lit("2024-01-01")) + F.when(F.col("user_id") % 7 == 0, DELAY_DAYS).otherwise(0)
    dealt, arrived, folder = cut(e.withColumn("file", F.floor(day / FILE_DAYS))), new_folder(spark, "arrivals"), new_folder(spark, "live")
    for k in sorted(r["file"] for r in dealt.where("file IS NOT NULL").select("file").distinct().collect()):  # a row for some days of time
        dealt.where(F.col("file") == k).drop("file").write.mode("append").parquet(arrived)
        out = of(spark.readStream.schema(e.schema).parquet(arrived))
        live.follow(out, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return live.current(spark, f"{folder}/rows", out.schema, keys)


#: Events with the file that they come in, the watermark from the files before it, and the last one.
_ARRIVED = f"""ar AS (SELECT *, (date_diff('day', DATE '2024-01-01', ts::DATE) + CASE WHEN user_id % 7 = 0 THEN {DELAY_DAYS} ELSE 0 END) // {FILE_DAYS} AS file FROM events),
 fl AS (SELECT file, max(date_trunc('milliseconds', ts)) AS newest FROM ar GROUP BY 1),
 wm AS (SELECT file, max(newest) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL {LATE_DAYS} DAY AS mark FROM fl),
 last AS (SELECT max(newest) - INTERVAL {LATE_DAYS} DAY AS mark FROM fl)"""


@register(
    "r1_live_daily_counts",
    "day:s event_type:s runs:i",
    "SELECT ts::DATE AS day, event_type, count(*) AS runs FROM ar JOIN wm USING (file) WHERE mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark GROUP BY 1, 2",
    _ARRIVED,
)
def _(spark, sf_dir):
    counted = streamed(spark, sf_dir, lambda events: live.daily_counts(events, late=f"{LATE_DAYS} days"), ["day_start", "event_type"])
    return counted.select(F.to_date("day_start").cast("string").alias("day"), "event_type", "runs")


@register(
    "r1_latest_status",
    "user_id:i status:s is_live:b",
    f"""SELECT user_id, status, date_trunc('milliseconds', newest) + INTERVAL {SILENT_DAYS} DAY >= (SELECT mark FROM last) AS is_live
 FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS newest FROM ar JOIN wm USING (file) WHERE mark IS NULL OR ts > mark GROUP BY 1)""",
    _ARRIVED,
)
def _(spark, sf_dir):
    return streamed(spark, sf_dir, lambda events: live.latest_status(events, f"{LATE_DAYS} days", f"{SILENT_DAYS} days"), ["user_id"])
