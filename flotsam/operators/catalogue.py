"""Scene catalogues: search, assets, manifests, run tables and reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import geojson_features, write_csv  # noqa: F401  sinks of reports
from ..functions.geo import parse_box


def find_scenes(scenes: DataFrame, box: tuple[float, float, float, float], start: str, end: str, cloud_lt: float, limit: int = 1) -> DataFrame:
    """The newest scenes inside a box and between two dates with less than so much cloud."""
    x1, y1, x2, y2 = box
    hit = F.col("lon").between(x1, x2) & F.col("lat").between(y1, y2) & F.col("acquired").between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))) & (F.col("cloud_cover") < cloud_lt)
    return scenes.where(hit).orderBy(F.desc("acquired"), "scene_id").limit(limit)


def newest_per(scenes: DataFrame, key: str = "aoi", cloud_lt: float = 20.0) -> DataFrame:
    """The newest scene of each area with less than so much cloud; the smaller id on ties.  No area's rows are sorted."""
    best = F.max_by(F.struct(*scenes.columns), F.struct("acquired", -F.col("scene_id")))
    return scenes.where(F.col("cloud_cover") < cloud_lt).groupBy(F.col(key).alias("_key")).agg(best.alias("s")).select("s.*")


def resolve_assets(scenes: DataFrame, bands: list[str]) -> DataFrame:
    """(scene_id, band, href): for each band the first asset in order whose key has its name; bands without one have no row."""
    assets = scenes.select("scene_id", F.posexplode(F.map_entries("assets")).alias("pos", "e")).select("scene_id", "pos", F.lower("e.key").alias("key"), F.col("e.value").alias("href"))
    wanted = F.explode(F.filter(F.array(*map(F.lit, bands)), lambda b: F.col("key").contains(F.lower(b))))
    return assets.select("scene_id", "pos", "href", wanted.alias("band")).groupBy("scene_id", "band").agg(F.min_by("href", "pos").alias("href"))


def manifest(assets: DataFrame) -> DataFrame:
    """(scene_id, bands): the resolved bands of each scene as one JSON text, in band order."""
    l = F.array_sort(F.collect_list(F.struct("band", "href")))  # noqa: E741
    return assets.groupBy("scene_id").agg(F.to_json(l).alias("bands"))


def valid_runs(runs: DataFrame, column: str = "bbox") -> DataFrame:
    """The runs whose box is four numbers."""
    return runs.where(parse_box(F.col(column)).isNotNull())


def run_kpis(runs: DataFrame) -> DataFrame:
    """One row over runs (status): totals, and the success rate in whole percent, halves up."""
    n = lambda *s: F.sum(F.col("status").isin(*s).cast("long"))
    done = n("COMPLETED")
    rate = F.when(F.count("*") > 0, F.floor(100 * done / F.count("*") + 0.5)).otherwise(0)
    return runs.agg(F.count("*").alias("total"), done.alias("completed"), n("FAILED").alias("failed"), n("RUNNING", "PENDING").alias("running"), n("PENDING").alias("pending"), rate.cast("long").alias("success_rate"))


def cloud_buckets(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.least(F.floor(F.col("cloud_cover") / 20), F.lit(4)).cast("int").alias("bucket")).agg(F.count("*").alias("runs"))


def last_active_days(runs: DataFrame, days: int = 14) -> DataFrame:
    """(day, runs) of the last days that have runs, the oldest first."""
    daily = runs.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("runs"))
    return daily.orderBy(F.desc("day")).limit(days).orderBy("day")


def run_rollup(stages: DataFrame) -> DataFrame:
    """(run_id, stages_done, failures, status) from rows (run_id, stage, ok)."""
    out = stages.groupBy("run_id").agg(F.count_distinct(F.when(F.col("ok"), F.col("stage"))).alias("stages_done"), F.sum((~F.col("ok")).cast("long")).alias("failures"))
    return out.withColumn("status", F.when(F.col("failures") > 0, "FAILED").otherwise("COMPLETED"))


def with_duration(runs: DataFrame) -> DataFrame:
    return runs.withColumn("seconds", F.unix_timestamp("completed_at") - F.unix_timestamp("created_at"))


def stages_left(all_stages: Column, skipped: Column, done: Column) -> Column:
    return F.array_except(F.array_except(all_stages, skipped), done)


def report_join(detections: DataFrame, attributions: DataFrame, pick: str = "best") -> DataFrame:
    """detections with one attribution each: the best scored, or with ``pick="last"`` the last of the report's order."""
    w = Window.partitionBy("cluster_id").orderBy(F.asc("report_rank") if pick == "best" else F.desc("report_rank"))
    one = attributions.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("cluster_id", "source_type", "location_name", "country", "attribution_score")
    return detections.join(one, "cluster_id", "left")


def csv_rows(joined: DataFrame, scene_id: str) -> DataFrame:
    """The twelve columns of the flat report; sources that lack are empty, their score 0."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return joined.select(
        "cluster_id", F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"), F.col("area_m2").alias("area_sq_m"), text("polymer_type").alias("polymer_type"), F.col("mean_confidence").alias("confidence"),
        text("source_type").alias("top_source_type"), text("location_name").alias("top_source_location"), text("country").alias("top_source_country"), F.coalesce("attribution_score", F.lit(0.0)).alias("attribution_score"), text("detection_date").alias("detection_date"), F.lit(scene_id).alias("scene_id"),
    )


def executive_summary(detections: DataFrame) -> DataFrame:
    """One row: clusters, false positives, area in km2, mean confidence, dominant polymer, first known date."""
    top = detections.groupBy("polymer_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "polymer_type").limit(1).select(F.col("polymer_type").alias("dominant_polymer"))
    one = detections.agg(F.count("*").alias("clusters"), F.sum(F.coalesce("is_false_positive", F.lit(False)).cast("long")).alias("false_positives"), (F.sum("area_m2") / 1e6).alias("area_km2"), F.avg("mean_confidence").alias("mean_confidence"), F.min("detection_date").alias("detection_date"))
    return one.join(F.broadcast(top), on=F.lit(True), how="left")


def date_window(caller: Column, first_row: Column, days: int) -> tuple[Column, Column]:
    """(start, end) of the days up to the caller's date, else the first row's, else now; ISO texts with Z are read."""
    end = F.coalesce(F.try_to_timestamp(caller), F.try_to_timestamp(first_row), F.current_timestamp())
    return end - F.expr(f"interval {days} days"), end


def with_dates(detections: DataFrame, scenes: DataFrame) -> DataFrame:
    """detections (scene_id) with the scene's date as text; empty where the catalogue lacks the scene."""
    dates = scenes.groupBy("scene_id").agg(F.date_format(F.min("acquired"), "yyyy-MM-dd").alias("detection_date"))
    return detections.join(dates, "scene_id", "left").withColumn("detection_date", F.coalesce("detection_date", F.lit("")))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_pixels(pixels: DataFrame, path: str) -> None:
    """Per-pixel results, a folder for each scene."""
    pixels.write.mode("overwrite").partitionBy("scene_id").parquet(path)
