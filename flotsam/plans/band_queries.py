"""Queries over spectra, class scores and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import BAND_MEANS, BAND_STDS, CLASSES
from ..functions import bands as B
from ..functions import rules as R
from ..operators import rasters
from ..operators import signatures as G
from ..sources import supplied as S
from .registry import register

SPECTRA = "sp AS (SELECT vec_id, label, list_transform(embedding[1:11], lambda x: abs(x)::DOUBLE) AS b FROM embeddings)"
NUMBERED = "means AS (SELECT unnest(range(11)) AS pos, unnest([" + ",".join(f"{x}::DOUBLE" for x in BAND_MEANS) + "]) AS m, unnest([" + ",".join(f"{x}::DOUBLE" for x in BAND_STDS) + "]) AS s)"
INDICES = SPECTRA + """, ix AS (SELECT vec_id, label, (b[8]-b[4])/(b[8]+b[4]+1e-8) AS pi, b[10]/(b[8]+1e-8) AS sr, (b[9]-b[10])/(b[9]+b[10]+1e-8) AS nsi,
 b[8]-(b[6]+(b[10]-b[6])*(167::DOUBLE/(945+1e-8))) AS fdi FROM sp),
 ruled AS (SELECT *, CASE WHEN nsi > 0.35 THEN 'Organic Matter' WHEN pi > 0.1 AND sr < 0.3 THEN 'PE/PP (Polyethylene/Polypropylene)' WHEN pi > 0.1 AND sr > 0.5 THEN 'PET/Nylon'
 WHEN pi > 0.05 AND nsi < 0 THEN 'Mixed/Degraded Polymer' WHEN fdi > 0.05 THEN 'Unidentified Plastic' ELSE 'Unclassified Debris' END AS polymer_type, nsi > 0.35 AS is_false_positive FROM ix)"""
SOFTMAX = """lg AS (SELECT vec_id, label, list_transform(embedding[12:26], lambda x: x::DOUBLE * 10) AS l FROM embeddings),
 ex AS (SELECT vec_id, label, pos, exp(greatest(least(l[pos + 1] + CASE WHEN pos = 0 THEN 0.5 ELSE 0.0 END, 30), -30)) AS e FROM (SELECT vec_id, label, l, unnest(range(15)) AS pos FROM lg)),
 pr AS (SELECT vec_id, label, pos, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM ex)"""


def indexed(spark, sf_dir):
    s = S.spectra(spark, sf_dir)
    return s.select("vec_id", "label", "bands", *(c.alias(k) for k, c in B.spectral_indices(F.col("bands")).items()))


def ruled(spark, sf_dir):
    i = indexed(spark, sf_dir)
    return i.select("*", R.classify_polymer(*map(F.col, ("pi", "sr", "nsi", "fdi"))).alias("polymer_type"), R.is_false_positive(F.col("nsi")).alias("is_false_positive"))


def spread(df, column, *keys):
    return df.select(*keys, F.posexplode(column).alias("pos", "value"))


def forest(spark, sf_dir):
    """A forest trained on the spectra with the polymers that the rules give, and those rows."""
    kinds = (R.ORGANIC, R.PE_PP, R.PET, R.MIXED, R.UNIDENTIFIED, R.UNCLASSIFIED)
    number = F.lit(0)
    for k, kind in enumerate(kinds):
        number = F.when(F.col("polymer_type") == kind, k).otherwise(number)
    rows = ruled(spark, sf_dir).select("vec_id", "bands", number.alias("label"))
    return G.train_forest(rows, trees=16, depth=6), rows


@register("b8_spectral_indices", "vec_id:i pi:d sr:d nsi:d fdi:d", "SELECT * FROM ix", INDICES, 4)
def _(spark, sf_dir):
    return indexed(spark, sf_dir)


@register("b9_polymer_rules", "vec_id:i polymer_type:s is_false_positive:b", "SELECT * FROM ruled", INDICES)
def _(spark, sf_dir):
    return ruled(spark, sf_dir)


@register("d6_polymer_counts", "polymer_type:s clusters:i pi:d sr:d fdi:d", "SELECT polymer_type, count(*) AS clusters, avg(pi) AS pi, avg(sr) AS sr, avg(fdi) AS fdi FROM ruled GROUP BY 1", INDICES, 4)
def polymer_counts(spark, sf_dir):
    return ruled(spark, sf_dir).groupBy("polymer_type").agg(F.count("*").alias("clusters"), *(F.avg(k).alias(k) for k in ("pi", "sr", "fdi"))).orderBy(F.desc("clusters"), "polymer_type")


@register("b23_unless_false_positive", "label:i kept:i", "SELECT label, count(*) AS kept FROM ruled WHERE NOT is_false_positive GROUP BY 1", INDICES)
def _(spark, sf_dir):
    return ruled(spark, sf_dir).where(R.keeps_unless_false_positive(F.col("is_false_positive"))).groupBy("label").agg(F.count("*").alias("kept"))


@register("b1_pad_bands", "vec_id:i pos:i value:d", "SELECT vec_id, pos, CASE WHEN pos IN (0, 5, 6) THEN 0.0 ELSE b[CASE WHEN pos < 5 THEN pos ELSE pos - 2 END] END AS value FROM (SELECT vec_id, b, unnest(range(11)) AS pos FROM sp)", SPECTRA)
def _(spark, sf_dir):
    s = S.spectra(spark, sf_dir)
    return spread(s.select("vec_id", B.pad_bands(F.slice("bands", 1, 8)).alias("b")), "b", "vec_id")


@register("a5_fit_bands", "vec_id:i pos:i value:d", """SELECT vec_id, pos, CASE WHEN n = 8 AND pos IN (0, 5, 6) THEN 0.0 WHEN n = 8 THEN b[CASE WHEN pos < 5 THEN pos ELSE pos - 2 END] WHEN pos < n THEN b[pos + 1] ELSE 0.0 END AS value
 FROM (SELECT vec_id, list_transform(embedding[1:1 + vec_id % 13], lambda x: x::DOUBLE) AS b, 1 + vec_id % 13 AS n, unnest(range(11)) AS pos FROM embeddings)""")
def _(spark, sf_dir):
    e = S.table(spark, sf_dir, "embeddings").select("vec_id", B.fit_bands(F.slice("embedding", F.lit(1), (F.col("vec_id") % 13 + 1).cast("int"))).alias("b"))
    return spread(e, "b", "vec_id")


SCORED = SPECTRA + ", " + NUMBERED + ", dn AS (SELECT vec_id, unnest(range(11)) AS pos, unnest(CASE WHEN vec_id % 17 = 0 THEN list_transform(b, lambda x: 0.0) ELSE b END) AS x, vec_id % 17 = 0 AS gone FROM sp)"


def reflectance(spark, sf_dir):
    """Spectra, every seventeenth of which has no data."""
    s = S.spectra(spark, sf_dir)
    return s.withColumn("bands", F.when(F.col("vec_id") % 17 == 0, F.array_repeat(F.lit(0.0), 11)).otherwise(F.col("bands")))


@register("b3_normalize", "vec_id:i pos:i value:d", "SELECT vec_id, pos, CASE WHEN gone THEN 0 ELSE greatest(-5, least(5, (greatest(0.0001, least(0.5, x * 10000 / 10000)) - m) / (s + 1e-6))) END AS value FROM dn JOIN means USING (pos)", SCORED, 4)
def _(spark, sf_dir):
    s = reflectance(spark, sf_dir).select("vec_id", F.transform("bands", lambda x: x * 10000).alias("b"))
    return spread(s.select("vec_id", B.normalize(F.col("b")).alias("b")), "b", "vec_id")


@register("b4_nodata_flags", "nodata:b spectra:i", "SELECT gone AS nodata, count(DISTINCT vec_id) AS spectra FROM dn GROUP BY 1", SCORED)
def _(spark, sf_dir):
    return reflectance(spark, sf_dir).groupBy(B.is_nodata(F.col("bands")).alias("nodata")).agg(F.count("*").alias("spectra"))


@register("b5_normalize_reflectance", "vec_id:i pos:i value:d", "SELECT vec_id, pos, CASE WHEN gone THEN 0 ELSE greatest(-5, least(5, (greatest(0.0001, least(0.5, x)) - m) / (s + 1e-6))) END AS value FROM dn JOIN means USING (pos)", SCORED, 4)
def _(spark, sf_dir):
    return spread(reflectance(spark, sf_dir).select("vec_id", B.normalize(F.col("bands"), scale=1.0).alias("b")), "b", "vec_id")


@register("b6_training_scale", "vec_id:i pos:i value:d scored:d", "SELECT vec_id, pos, greatest(0, least(1, x)) AS value, (greatest(0, least(1, x)) - m) / (s + 1e-6) AS scored FROM dn JOIN means USING (pos)", SCORED, 4)
def _(spark, sf_dir):
    s = reflectance(spark, sf_dir).select("vec_id", F.transform("bands", lambda x: x * 10000).alias("b"))
    both = s.select("vec_id", F.posexplode(F.arrays_zip(B.training_scale(F.col("b")).alias("v"), B.training_scale(F.col("b"), scores=True).alias("z"))).alias("pos", "p"))
    return both.select("vec_id", "pos", F.col("p.v").alias("value"), F.col("p.z").alias("scored"))


@register("b7_denormalize", "vec_id:i pos:i value:d", "SELECT vec_id, pos, CASE WHEN pos IN (0, 5, 6) OR gone THEN 0 ELSE x * s + m END AS value FROM dn JOIN means USING (pos)", SCORED)
def _(spark, sf_dir):
    s = reflectance(spark, sf_dir)
    return spread(s.select("vec_id", B.denormalize(F.col("bands"), F.col("vec_id") % 17 == 0).alias("b")), "b", "vec_id")


_NAMES = "cd AS (SELECT unnest(range(15)) AS k, unnest([" + ",".join(f"'{n}'" for n, _, _ in CLASSES) + "]) AS name, unnest([" + ",".join(f"'{p}'" for _, p, _ in CLASSES) + "]) AS polymer, unnest([" + ",".join(str(f).lower() for _, _, f in CLASSES) + "]) AS fp)"


@register("b10_class_names", "label:i name:s polymer:s is_fp:b n:i", "SELECT label, coalesce(name, 'Unclassified') AS name, coalesce(polymer, 'Unclassified') AS polymer, coalesce(fp, false) AS is_fp, n FROM (SELECT label * 2 AS label, count(*) AS n FROM embeddings GROUP BY 1) LEFT JOIN cd ON k = label", _NAMES)
def _(spark, sf_dir):
    e = S.table(spark, sf_dir, "embeddings").groupBy((F.col("label") * 2).alias("label")).agg(F.count("*").alias("n"))
    return e.withColumn("name", R.class_name(F.col("label"))).withColumns({"polymer": R.class_polymer(F.col("name")), "is_fp": R.class_is_false_positive(F.col("name"))})


@register("b11_feature_vector", "vec_id:i pos:i value:d", "SELECT vec_id, unnest(range(4)) AS pos, unnest([b[4], b[8], b[1], b[11]]) AS value FROM sp", SPECTRA)
def _(spark, sf_dir):
    return spread(S.spectra(spark, sf_dir).select("vec_id", B.features(F.col("bands"), ["B04", "B08", "none", "B12"]).alias("b")), "b", "vec_id")


@register("b12_label_remap", "raw:i gt:i n:i", "SELECT raw, CASE WHEN raw > 0 THEN raw - 1 END AS gt, count(*) AS n FROM (SELECT label AS raw FROM embeddings) GROUP BY ALL")
def _(spark, sf_dir):
    return S.table(spark, sf_dir, "embeddings").select(F.col("label").alias("raw")).groupBy("raw").agg(F.count("*").alias("n")).withColumn("gt", B.label_index(F.col("raw")))


def probabilities(spark, sf_dir):
    return S.logits(spark, sf_dir).select("vec_id", "label", B.softmax_boost(F.col("logits")).alias("probs"))


@register("b13_softmax_boost", "vec_id:i pos:i value:d", "SELECT vec_id, pos, p AS value FROM pr", SOFTMAX)
def _(spark, sf_dir):
    return spread(probabilities(spark, sf_dir), "probs", "vec_id")


@register("b14_debris_mask", "vec_id:i top:i debris:b strict:b", "SELECT vec_id, top, top = 0 AND p0 > 0.1 AS debris, top = 0 AND p0 > 0.25 AS strict FROM (SELECT vec_id, arg_max(pos, (p, -pos)) AS top, max(p) FILTER (WHERE pos = 0) AS p0 FROM pr GROUP BY 1)", SOFTMAX)
def _(spark, sf_dir):
    p = F.col("probs")
    return probabilities(spark, sf_dir).select("vec_id", B.top_class(p).alias("top"), B.is_debris(p, 0.1).alias("debris"), B.is_debris(p, 0.1, 0.25).alias("strict"))


@register("m1_score_tiles", "vec_id:i pos:i value:d", """SELECT vec_id, pos, e / sum(e) OVER (PARTITION BY vec_id) AS value
 FROM (SELECT vec_id, pos, exp(greatest(-30, least(30, (CASE WHEN pos < 11 THEN b[pos + 1] * (pos + 1) ELSE 0 END) + CASE WHEN pos = 0 THEN 0.5 ELSE 0 END))) AS e FROM (SELECT vec_id, b, unnest(range(15)) AS pos FROM sp))""", SPECTRA)
def _(spark, sf_dir):
    import numpy as np

    weights = np.zeros((11, 15))
    weights[np.arange(11), np.arange(11)] = np.arange(1, 12)
    return spread(rasters.score_tiles(S.spectra(spark, sf_dir), lambda x: x @ weights, ["vec_id"]), "probs", "vec_id")


@register("m2_signature_forest", "held:i right_share:d over_chance:b")
def _(spark, sf_dir):
    from ..operators.signatures import fit_and_score

    kinds = (R.ORGANIC, R.PE_PP, R.PET, R.MIXED, R.UNIDENTIFIED, R.UNCLASSIFIED)
    number = F.lit(0)
    for k, kind in enumerate(kinds):
        number = F.when(F.col("polymer_type") == kind, k).otherwise(number)
    return fit_and_score(ruled(spark, sf_dir).select("vec_id", "bands", number.alias("label")))
