"""Readers, writers, streams and the contract of the entry module."""

import random

import pytest

import __spark_entry__ as entry_module
from lexigrain import refdata
from lexigrain.functions import urls
from lexigrain.operators import corpus, territories
from lexigrain.sources import files
from lexigrain.streaming import scalar


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"code": "de", "n": 1}\n\n{"code": "fr", "n": 2}\n')
    assert {r.code for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "code string, n int").where("code is not null").collect()} == {"de", "fr"}
    (tmp_path / "c.txt").write_text("a, b => Q1\nx => y, z => Q2\n\nbad\n")
    assert sorted((r.id, r.forms) for r in files.read_corpus(spark, str(tmp_path / "c.txt")).collect()) == [("Q1", ["a", "b"]), ("Q2", ["x => y", "z"])]
    df = spark.createDataFrame([("x\ty", 1), ('q"u,o', 2)], "s string, n int")
    for kind, read in (("tsv", files.read_tsv), ("csv", files.read_csv)):
        files.write(df, str(tmp_path / kind), kind)
        assert read(spark, str(tmp_path / kind), "s string, n int").count() == 2
    files.write(df, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_a_line_that_isnt_json_ends_the_job(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"n": 1}\n{"n": \n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "n int").collect()


def test_drop_subsets_equals_sets(spark):
    rng = random.Random(3)
    groups = {f"g{i}": {f"f{rng.randrange(6)}" for _ in range(rng.randrange(1, 6))} | ({"common"} if i % 2 else set()) for i in range(40)}
    mapping = spark.createDataFrame([(0, f, g, False, None, None) for g, fs in groups.items() for f in fs], corpus.SCHEMA)
    want = {g for g, fs in groups.items() if not any(g != o and fs <= os and (fs < os or g < o) for o, os in groups.items())}
    assert {r.group for r in corpus.drop_subsets(mapping).collect()} == want


def test_scalar_operators_on_a_stream(spark, tmp_path):
    source = spark.createDataFrame([("https://www.a.com/x",), ("b.com",), ("nope",)], "url string")
    source.write.parquet(str(tmp_path / "in"))
    stream = scalar.apply(scalar.read_stream(spark, str(tmp_path / "in"), source.schema), key=urls.clean_url_compare("url"))
    scalar.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    assert {r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"http://a.com/x", "http://b.com/", None}


def test_corpus_upkeep(spark):
    rows = [(1, "a", "Q1"), (2, "b", "Q1"), (3, "a", "Q2"), (4, "b", "Q2"), (5, "c", "Q2"), (6, "мир", "Q3"), (7, "mir", "Q3"), (8, "x", "Q4")]
    mapping = spark.createDataFrame([(*r, False, None, None) for r in rows], corpus.SCHEMA)
    assert {r.group for r in corpus.drop_subsets(mapping).collect()} == {"Q2", "Q3", "Q4"}
    assert [r.value for r in corpus.export_lines(mapping).collect()] == ["a, b, c => Q2"]
    blocked = corpus.block_groups(mapping, spark.createDataFrame([("Q2",)], "group string"))
    assert {r.group for r in blocked.where("skip").collect()} == {"Q2"}
    assert corpus.by_group(mapping, "Q1").count() == 2 and corpus.by_form(mapping, "a").count() == 2 and corpus.by_pattern(mapping, "^[ab]$").count() == 4
    assert {r.group: r.forms for r in corpus.group_forms(mapping).collect()}["Q1"] == ["a", "b"]


def test_territory_inheritance():
    index = {t["code"]: t for t in territories.resolved()}
    child = next(t for t in index.values() if t["parent"] and not t["is_ftm"])
    assert child["ftm_country"] is None or index[child["ftm_country"]]["is_ftm"]
    assert all(t["region"] for t in index.values() if t["parent"] in index and index[t["parent"]]["region"])
    assert "Q145" in index["gb"]["qids"] and "gbr" in index["gb"]["codes"]


def test_packaged_names_equal_a_rebuild():
    packaged = {r["name_norm"]: (r["code"], r["strength"]) for r in refdata.rows("territory_names")}
    assert packaged == territories.name_table()


def test_entry_contract(spark):
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 180 and set(queries) - set(oracles) <= {n for n in queries if n[:2] == "op" or n == "pipeline"}
    assert entry_module.entry(spark).count() > 0
