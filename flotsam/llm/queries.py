"""Queries over the operators of this folder, with production parameters, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import html_layout, langid_cnn, line_dedup, media_avi, minhash_join, packing, piece_codec, quality_em, spelling, suffix_dedup, token_files, url_graph, whitening
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.codec_digests(table(spark, sf_dir, "documents"))


def op3_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.filter_urls(table(spark, sf_dir, "pages"))


def op4_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_avi.media_digests(table(spark, sf_dir, "documents"))


def op5_langid_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_cnn.identify(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table(spark, sf_dir, "documents"))


def op8_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op9_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(table(spark, sf_dir, "pages"))


def op10_quality_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_em.judge(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.component_rows(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.noisy_words(table(spark, sf_dir, "documents")))


def queries() -> dict:
    found = (
        op2_piece_codec, op4_media_avi, op9_html_layout, op3_url_graph, op10_quality_em, op1_line_dedup, op5_langid_cnn, op7_suffix_dedup,
        op8_minhash_join, op6_best_fit_packing, op11_token_files, op12_whitening, op13_spelling,
    )
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_graph": url_graph.filter_sql(), "op10_quality_em": quality_em.judge_sql(), "op1_line_dedup": line_dedup.line_sql(),
        "op13_spelling": spelling.spelling_sql(),
    }
