"""The corpus pipeline: language, line runs, near duplicates, repeated passages, packing.

Every stage takes the rows that the one before kept, with the columns of documents, whatever others a table has.  An empty
table stays empty.  Null texts go with the first stage; a stage that is given some keeps them, and packing gives them the
end id alone.  Texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flotsam.llm import langid_cnn, line_dedup, minhash_join, packing, suffix_dedup
from flotsam.llm.common import cut, table

#: Several stages are models or iterations, so there is no SQL for the whole.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells; null texts, texts without letters and doubtful ones go."""
    return langid_cnn.keep_identified(docs)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of line runs; a document that was such copies throughout goes.

    Rows that repeat a doc_id count as one document.
    """
    return line_dedup.remove_runs(docs)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each (doc_id, text); only rows whose doc_id stands more than once are compared."""
    again = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return docs
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    # which of them stays is told by their JSON, as maps have no order
    rest = F.struct(F.lit(0).alias("_"), *others)
    least = docs.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(rest, F.to_json(rest)).alias("least"))
    once = least.select(*(c if c in ("doc_id", "text") else F.col("least")[c].alias(c) for c in docs.columns))
    return docs.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies (five-word shingles, similarity 0.8).

    Of rows that repeat both doc_id and text one stays; rows that share a doc_id alone are parts of one document.
    """
    docs = one_of_each(docs)
    found = minhash_join.near_duplicates(docs)
    return docs.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages of over 50 words, or 400 bytes of fewer; a document of which no word is left goes."""
    return suffix_dedup.remove_passages(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens; repeated rows are packed as often as they stand."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_runs),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
