from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrain.llm import members, neardup, textkit

SF = "/root/testdata/sf0.001"


def brute(ids, texts, threshold=neardup.THRESHOLD):
    sets = textkit.shingle_sets(textkit.words(pa.array(texts, pa.string())), neardup.SHINGLE)
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    order = sorted(range(len(ids)), key=lambda i: ids[i])
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if len(sets[i]) and len(sets[j]):
                common = len(np.intersect1d(sets[i], sets[j]))
                if common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                    a, b = find(i), find(j)
                    low, high = sorted((a, b), key=lambda k: ids[k])
                    label[high] = low
    return {ids[i]: ids[find(i)] for i in range(len(ids)) if find(i) != i}


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = brute([r.doc_id for r in rows], [r.text for r in rows])
    got = {r.doc_id: r.keep_id for r in neardup.near_duplicates(docs).collect()}
    assert want and len(set(want) & set(got)) >= 0.9 * len(want)
    assert set(got) <= set(want)


def test_groups_of_copies_and_edge_cases(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base = [word() for _ in range(200)]
    near = list(base)
    near[50] = "changed"
    other = [word() for _ in range(200)]
    rows = [(k, " ".join(base)) for k in (7, 3, 9)] + [(20, " ".join(near)), (1, " ".join(other)), (30, None), (31, ""), (32, "  ..."), (40, "two words"), (41, "Two, WORDS!"), (None, " ".join(base)), (50, " ".join(other) + " x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep_id", F.lit(1)).withColumn("size", F.lit("x"))
    got = {r.doc_id: r.keep_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {7: 3, 9: 3, 20: 3, 41: 40, 50: 1}
    kept = neardup.drop_near_duplicates(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({r[0] for r in rows if r[0] is not None} - set(got))
    assert kept.where("doc_id is null").count() == 1


def test_rows_that_share_an_id_and_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "  \n\t"), (4, "one"), (5, long), (6, "né à l'été 42"), (6, "né à l'été 42"), (None, "no id here"), (7, "tie tie tie"), (8, "tie tie tie"), (9, "quite another text than all of these"), (9, long + " end"), (10, None), (10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep_id", F.lit(None).cast("string")).withColumn("band", F.lit(0))
    got = {r.doc_id: r.keep_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {8: 7, 9: 5}
    kept = [r.doc_id for r in neardup.drop_near_duplicates(spark, docs).collect()]
    assert sorted((x or 0) for x in kept) == [0, 1, 2, 3, 4, 5, 6, 6, 7, 10, 10]


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_merge_and_estimate():
    pool = textkit.mix64(np.arange(1, 3001, dtype=np.uint64))
    a, b = pool[:2000], pool[1000:]
    ra, rb = neardup.registers(a), neardup.registers(b)
    assert (neardup.merge(ra, rb) == neardup.registers(pool)).all()
    greater, smaller = np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()])
    got = neardup.estimate(greater, smaller, neardup.REGISTERS - greater - smaller, np.array([2000.0]), np.array([2000.0]))
    assert got[0] == pytest.approx(1 / 3, abs=0.08)


def test_components(spark):
    edges = [(5, 9), (9, 1), (1, 2), (20, 30), (30, 40), (40, 50), (50, 60), (7, 8)]
    got = {r.doc_id: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 9: 1, 20: 20, 30: 20, 40: 20, 50: 20, 60: 20, 7: 7, 8: 7}


def test_filter_never_loses_a_member(spark):
    ids = spark.range(0, 50_000, 7).toDF("doc_id")
    words = members.of(ids)
    held = members.may_hold(words, pa.array(range(50_000)))
    assert held[::7].all() and Counter(held.tolist())[True] < 15_000


def test_dense_and_chained_groups_match_brute_force(spark):
    """Copies edited independently of each other, and a chain in which only neighbours are alike."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    edit = lambda words, p: [word() if rng.random() < p else w for w in words]
    base = [word() for _ in range(150)]
    texts = [base] + [edit(base, 0.05) for _ in range(80)]
    link = [word() for _ in range(150)]
    for _ in range(12):
        texts.append(link)
        link = edit(link, 0.06)
    texts += [[word() for _ in range(100)] for _ in range(60)]
    order = rng.permutation(len(texts)).tolist()
    rows = [(order[i], " ".join(t)) for i, t in enumerate(texts)]
    want = brute([r[0] for r in rows], [r[1] for r in rows])
    got = {r.doc_id: r.keep_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 85 and sum(got.get(d) == k for d, k in want.items()) >= 0.9 * len(want) and set(got) <= set(want)
