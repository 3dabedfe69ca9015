"""Queries over the driver's tables against their SQL in DuckDB."""

import datetime

import duckdb
import pytest

from pyspark.sql import functions as F

from lexigrain.operators import corpus
from lexigrain.plans import derived, tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()[:19]
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(tables.SQL))
def test_equals_sql(spark, duck, name):
    df = tables.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(tables.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(derived.CASES))
def test_columns_equal_sql(spark, duck, name):
    case = derived.CASES[name]
    got = {r["key"]: plain(r["result"]) for r in case.query(spark, SF).collect()}
    want = {k: plain(v) for k, v in duck.execute(case.sql()).fetchall()}
    assert got and got == want


@pytest.mark.parametrize("name", sorted(set(tables.QUERIES) - set(tables.SQL)))
def test_has_rows(spark, name):
    assert tables.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["distance_pairs", "name_compare_parts"])
def test_pairs_of_equal_names(spark, tmp_path, monkeypatch, name):
    """Pairs of parts are found by their names, whose keys may lie in several rows, in more than one task."""
    rows = [(k, ["red bolt", "red ring", "old bolt", "ring red", None][k % 5], "Brand#1", k % 2) for k in range(41)] + [(50, "red bolt", None, 1), (51, "red bolt", "Brand#2", 1)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(tables, "_KEYS_A_ROW", 3, raising=False)
    df = tables.QUERIES[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({tables.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert df.rdd.getNumPartitions() > 1


def test_pages_of_one_address(spark, tmp_path):
    """A page has as many rows as there are pages of its address."""
    rows = [(1, "https://www.a.example/x?b=2&a=1"), (2, "https://www.a.example/x?b=2&a=1"), (2, "https://www.a.example/x?b=2&a=1"), (3, "http://a.example/x?a=1&b=2"), (4, None)]
    spark.createDataFrame(rows, "page_id bigint, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = c.execute(f"SELECT page_id, url_key FROM ({tables.SQL['url_compare_keys']})").fetchall()
    got = sorted((r.page_id, r.url_key) for r in tables.QUERIES["url_compare_keys"](spark, str(tmp_path)).collect())
    assert got == sorted(want) and len(got) == 7


@pytest.mark.parametrize("name", ["text_is_stopword", "name_is_stopword", "text_is_nullword", "name_is_nullword", "text_is_nullplace", "name_is_generic_person"])
def test_word_lists_are_constants(spark, name):
    """No word of a list is normalized row by row: a plan's list holds literals only."""
    plan = derived.CASES[name].query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert " INSET " in plan and plan.count("foldCase") < 2


def test_subsets_without_broadcast(spark, tmp_path):
    """No task holds a table as large as the corpus; groups with forms of their own are no subsets."""
    rows = [("a", "x"), ("a", "y"), ("b", "x"), ("c", "x"), ("c", "y"), ("d", "x"), ("d", "z"), ("e", "y"), ("e", "w")]
    spark.createDataFrame(rows, "group string, form string").write.parquet(str(tmp_path / "forms"))
    kept = corpus.drop_subsets(spark.read.parquet(str(tmp_path / "forms")).withColumn("skip", F.lit(False)))
    assert sorted(map(tuple, kept.select("group", "form").collect())) == [("c", "x"), ("c", "y"), ("d", "x"), ("d", "z"), ("e", "w"), ("e", "y")]
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["name_candidate_pairs", "name_pair_symbols"])
def test_names_of_many_are_analysed_once(spark, tmp_path, monkeypatch, name):
    """Suppliers and customers of the same name share its analysis and its pairs."""
    spark.createDataFrame([(k, f"Supplier#{k % 3:09}") for k in range(9)] + [(9, None)], "s_suppkey bigint, s_name string").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(k, f"Customer#{k % 5:09}") for k in range(20)], "c_custkey bigint, c_name string").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    analyze, seen = tables.name_ops.analyze_names, []
    monkeypatch.setattr(tables.name_ops, "analyze_names", lambda df: seen.append(df) or analyze(df))
    df = tables.QUERIES[name](spark, str(tmp_path))
    c = duckdb.connect()
    for t in ("supplier", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({tables.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) == 36
    assert [x.where("names[0] is not null").count() for x in seen] == [3, 5]
