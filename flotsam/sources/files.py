"""Report files that appear whole or not at all: feature collections and flat CSV, written by Spark and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HEAD, FOOT = '{"type":"FeatureCollection","features":[', "]}"
#: Quotes are doubled and texts may hold line ends; null is an empty field, and empty text is quoted.
CSV = {"header": True, "escape": '"'}


def committed(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Lets ``write`` fill a folder beside ``path``, which then takes its place; if it fails, nothing is left of it.

    What stood at ``path`` stays until the new folder is whole.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    name = path.rstrip("/")
    target, fresh = hadoop.Path(name), hadoop.Path(f"{name}.writing-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(fresh.toString())
        if files.exists(target):
            old = hadoop.Path(f"{name}.old-{uuid.uuid4().hex}")
            files.rename(target, old)
            files.rename(fresh, target)
            files.delete(old, True)
        elif not files.rename(fresh, target):
            raise OSError(f"can't move what was written to {path}")
    except BaseException:
        files.delete(fresh, True)
        raise


def geojson_features(rows: DataFrame, lon: str, lat: str) -> DataFrame:
    """(value): one GeoJSON point feature a row, the other columns as properties."""
    props = [c for c in rows.columns if c not in (lon, lat)]
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*props).alias("properties"))).alias("value"))


def write_collections(features: DataFrame, path: str) -> None:
    """Features (value), one a line, as a folder of files that are each a whole FeatureCollection; one empty one for no features."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last feature has no comma, so one is held back
        for batch in batches:
            for value in batch.column("value").to_pylist():
                yield pa.RecordBatch.from_pydict({"value": [HEAD] if held is None else [held + ","]})
                held = value
        if held is not None:
            yield pa.RecordBatch.from_pydict({"value": [held, FOOT]})

    spark = features.sparkSession

    def write(folder: str) -> None:
        features.where("value IS NOT NULL").mapInArrow(framed, "value string").write.text(folder)
        if spark.read.text(folder).isEmpty():
            spark.createDataFrame([(HEAD,), (FOOT,)], "value string").coalesce(1).write.mode("overwrite").text(folder)

    committed(spark, path, write)


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """(value): the features of ``write_collections``."""
    lines = spark.read.text(path).where(~F.col("value").isin(HEAD, FOOT))
    return lines.select(F.regexp_replace("value", ",$", "").alias("value"))


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV files with a header each; the header alone for no rows."""
    spark = rows.sparkSession

    def write(folder: str) -> None:
        rows.write.options(**CSV, emptyValue='""').csv(folder)
        if spark.read.text(folder).isEmpty():
            header = spark.createDataFrame([(",".join(rows.columns),)], "value string")
            header.coalesce(1).write.mode("overwrite").text(folder)

    committed(spark, path, write)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of ``write_csv``, with the columns' types given."""
    return spark.read.schema(schema).options(**CSV, emptyValue="", nullValue="\0", multiLine=True, enforceSchema=False).csv(path)
