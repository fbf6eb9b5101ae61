"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import PARTITION_ROWS, Scratch, cut, new_folder  # noqa: F401  for the operators

#: Rows in one Arrow batch that goes to Python: whole texts can be long, so a batch holds few.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Whole texts cross to Python in batches of BATCH_ROWS rows at most; the session keeps that bound, or a smaller one of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: The counts from which a key is hot: over LEAST_HOT rows, and over one in HOT_KEYS of all, so that there are never more
#: than HOT_KEYS such keys.
LEAST_HOT, HOT_KEYS = 1000, 1000


def spread_join(rows: DataFrame, one_each: DataFrame, keys: list[str], by: list[str], total: int, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` (``total`` of them) joined with ``one_each``, which has one row a key, without a task for a hot key.

    The rows of a hot key are dealt over tasks by a hash of their columns ``by``, and its row in ``one_each`` is repeated
    for each.  The list of hot keys, at most HOT_KEYS rows, is broadcast.  ``sizes`` has the keys and their counts n, if
    these are known.
    """
    least = max(LEAST_HOT, total // HOT_KEYS)
    if total <= least:
        return rows.join(one_each, keys, how)
    hot = (rows.groupBy(*keys).agg(F.count("*").alias("n")) if sizes is None else sizes).where(F.col("n") > least)
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("n") / least).cast("long").alias("salts")))
    salt = F.pmod(F.xxhash64(*by), F.coalesce("salts", F.lit(1)))
    dealt = rows.join(hot, keys, "left").withColumn("salt", salt).drop("salts")
    salts = F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)
    repeated = one_each.join(hot, keys, "left").withColumn("salt", F.explode(salts)).drop("salts")
    return dealt.join(repeated, [*keys, "salt"], how).drop("salt")


def doc_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, data): the text as UTF-8 bytes; a null text has null data."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("data"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores where a column of df has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
