"""The corpus pipeline: language ID, near-duplicate removal, decontamination, secret redaction and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's documents. No stage can be put into SQL as a whole (kernels, sketches, fingerprints,
lexing and least squares), so ``ORACLE_SQL`` is None and tests hold the stages against brute-force versions.

Defined cases: stages pass rows on as they are, with all their columns, whatever their names and with nulls in any of
them. A document whose text is null or empty goes with language ID; the later stages would keep it, and packing has no
place for it. A row without an id is kept like any other; of rows that share an id all stay or all go. Repeated rows are
near duplicates only if their ids differ. Texts of any length are read whole. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrain.llm import decontaminate, langid, neardup, packing, secret_scan, storage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language isn't identified, and so those without text."""
    return langid.keep_identified(spark, docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return neardup.drop_near_duplicates(spark, docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secret literals; every document stays."""
    return secret_scan.redact(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
