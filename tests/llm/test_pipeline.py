"""The stages' contract, and each stage against what its operator says of the stage's own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrain.llm import decontaminate, langid, neardup, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns and docs.dtypes == inputs[0].dtypes
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in inputs]
    rejected = {r.doc_id for r in langid.identify(inputs[0]).where("not accepted").collect()}
    assert ids[1] == ids[0] - rejected and len(rejected) <= 0.02 * len(ids[0])
    removed = {r.doc_id: r.keep_id for r in neardup.near_duplicates(inputs[1]).collect()}
    assert removed and ids[2] == ids[1] - set(removed) and set(removed.values()) <= ids[2]
    leaks = {r.doc_id for r in decontaminate.contaminated(inputs[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaks and ids[3] == ids[2] - leaks
    assert ids[4] == ids[3]
    assert not [1 for r in inputs[4].collect() if re.search(r'(?i)token = "[0-9a-f]{40}"', r.text)]
    assert {d for p in docs.collect() for d in p.doc_ids} == ids[4]


ODD = [(1, None), (2, ""), (3, "  \n\t"), (4, "one"), (5, "word " * 60_000), (6, "né à l'été 42"), (6, "né à l'été 42"), (None, "no id here"), (7, "tie tie tie"), (8, "tie tie tie"), (None, None)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows_and_empty_tables(spark, name):
    """Nulls in any column, empty and very long texts, ties, repeated rows, an empty table and clashing columns."""
    stage = dict(corpus_pipeline.STAGES)[name]
    full = spark.read.parquet(f"{SF}/documents.parquet")
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    for c in full.columns[2:]:
        docs = docs.withColumn(c, F.lit(None).cast(full.schema[c].dataType))
    clash = docs.withColumn("language", F.lit(1)).withColumn("keep_id", F.lit("x")).withColumn("item_id", F.lit(2)).withColumn("position", F.lit(0)).withColumn("slot", F.lit(None).cast("int"))
    left = {"language_id": set(), "near_dedup": {0, 1, 2, 3, 4, 5, 6, 7}, "decontamination": {0, *range(1, 9)}, "secret_scan": {0, *range(1, 9)}}
    for table in (docs, clash):
        got = stage(spark, table, SF)
        if name == "packing":
            held = {d for p in got.collect() for d in p.doc_ids}
            assert held == {None, 4, 5, 6, 7, 8}
        else:
            assert got.columns == table.columns and {r.doc_id or 0 for r in got.collect()} == left[name]
    assert stage(spark, full.limit(0), SF).count() == 0


def test_run_gives_the_packs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_every_operator_has_a_query(spark):
    assert [sum(n.startswith(f"op{k}_") for n in queries.QUERIES) for k in range(1, 11)] == [1] * 10 and "pipeline" in queries.QUERIES
