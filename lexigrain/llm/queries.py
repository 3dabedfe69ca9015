"""Queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm import decontaminate, langid, lm_score, media, neardup, packing, secret_scan, suffix_dedup, url_filter, warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_docs(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_docs(spark, sf_dir))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_pages(spark, sf_dir))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' pages have no media, so each gets up to two figures whose payloads are rows of ``embeddings``; some have none there."""
    place = lambda k: F.concat(F.lit("https://media.example.org/"), k.cast("string"), F.lit(".bin"))
    figure = lambda k: F.concat(F.lit('<figure><img alt="vector" src="'), place(k), F.lit('"><figcaption>Vector '), k.cast("string"), F.lit("</figcaption></figure>"))
    page = F.col("page_id")
    figures = F.when(page % 3 == 0, F.lit("")).when(page % 3 == 1, figure(page)).otherwise(F.concat(figure(page), figure(page * 7)))
    pages = _pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit("</article>"), F.concat(figures, F.lit("</article>"))))
    stored = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.sha2(place(F.col("vec_id")), 256).alias("digest"), F.to_json("embedding").cast("binary").alias("payload"), F.lit("application/json").alias("mime"))
    return media.interleaved(pages, stored)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_docs(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_pages(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_docs(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_docs(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_lm_scoring, op2_decontamination, op3_language_id, op4_url_filter, op5_media_columns, op6_suffix_dedup, op7_warc, op8_packing, op9_near_dedup, op10_secret_scan, pipeline)
}

ORACLES: dict[str, str] = {
    "op4_url_filter": url_filter.oracle_sql(),
    "op7_warc": "SELECT page_id, url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n_bytes, md5(coalesce(html, '')) AS md5 FROM pages",
}
