"""Near-duplicate documents by SetSketch registers (operator 9).

Every document is the set of its word 3-shingles (``textkit``). A SetSketch of ``REGISTERS`` registers
holds, per hash function, the minimum of exponential variates over the set, put on the grid of powers of
``BASE`` and cut off at the grid's ends; the union of two sets has the register-wise maximum, so sketches
merge. Bands of ``ROWS`` register values give candidates; for these the similarity is estimated from the
numbers of greater, smaller and equal registers by maximum likelihood, together with the known set sizes;
pairs whose estimate isn't clearly below the threshold are then verified on their exact shingle sets.

Documents with equal shingle sets are grouped first, by a 128-bit digest, so thousands of copies cost as
much as one. In each band, documents are held against one of them first; only those that this leaves in
different components are paired with each other. Groups are the connected components of the verified pairs, and of each the document with the
smallest id stays. The components of the *estimated* pairs are found with min-label rounds over a table
in the shared folder; each is then verified by itself, where a union-find gives the same components as a
global one would.

Defined cases: a null or wordless text has an empty set and is in no group; a text under three words is
one shingle of all its words; a text of any length is read whole; rows that share a ``doc_id`` are one document, which
is in the group of each of its texts; of equal texts the smallest id stays; a row without an id is in no group and
stays; an empty table gives an empty result; columns of other names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrain.llm import members, storage, textkit

SHINGLE = 3
THRESHOLD = 0.6
ROWS = 7
BANDS = 80
REGISTERS = ROWS * BANDS
BASE = 1.001
RATE = 20.0
TOP = 65534
#: An estimate this many standard errors below the threshold still goes on to the exact test.
SLACK = 3.0

_LOG_BASE = np.log(BASE)
_FACTORS = textkit.mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(low, (shingles[at : at + 256, None] * _FACTORS).min(axis=0), out=low)
    uniform = (low.astype(np.float64) + 1.0) / 2.0**64
    smallest = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / _LOG_BASE), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def _part(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / _LOG_BASE


def estimate(greater: np.ndarray, smaller: np.ndarray, equal: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of largest likelihood, by golden-section search over its possible range."""
    u = size_a / (size_a + size_b)
    v = 1 - u

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = _part(np.maximum(u - v * j, 1e-12)), _part(np.maximum(v - u * j, 1e-12))
        return greater * np.log(up) + smaller * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(30):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        left = likelihood(a) > likelihood(b)
        high, low = np.where(left, b, high), np.where(left, low, a)
    return (low + high) / 2


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textkit.slices(batch):
            ids, sizes, keys, sketches = [], [], [], []
            for doc, s in zip(part.column("doc_id").to_pylist(), textkit.shingle_sets(textkit.words(part.column("text")), SHINGLE)):
                if len(s):
                    ids.append(doc)
                    sizes.append(len(s))
                    keys.append(s.sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(textkit.mix64(s)).tobytes())
                    sketches.append(registers(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())],
                names=["doc_id", "size", "digest", "sketch"],
            )


def _cut(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Smaller batches, for steps that widen each row."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        textkit.release()


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = textkit.mix64(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)
    for batch in _cut(batches):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        values = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(len(ids), BANDS, ROWS)
        keys = textkit.mix64((values.astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(ids, BANDS))], names=["band", "doc_id"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    margin = SLACK * np.sqrt(THRESHOLD * (1 - THRESHOLD) / REGISTERS)
    for batch in _cut(batches):
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("a_sketch", "b_sketch"))
        greater, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
        sizes = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("a_size", "b_size")]
        keep = pa.array(estimate(greater, smaller, REGISTERS - greater - smaller, *sizes) >= THRESHOLD - margin)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)


def _shingles(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(members.may_hold(wanted.value, batch.column("doc_id"))))
            for part in textkit.slices(batch):
                sets = textkit.shingle_sets(textkit.words(part.column("text")), SHINGLE)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"])

    return run


def _verified(group: pa.Table) -> pa.Table:
    """Union-find over the pairs of one component that pass the exact test. All pairs of the component are tested,
    until it is known to be one group. Rows that share an id are one document."""
    ids = group.column("doc_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    shingles = group.column("shingles").combine_chunks()
    sets = [np.frombuffer(shingles[i].as_buffer(), np.uint64) for i in order]
    n, sizes = len(ids), np.array([len(s) for s in sets])
    value, column = np.unique(np.concatenate(sets), return_inverse=True)
    column = column.astype(np.int32)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    by_value = np.argsort(column, kind="stable")
    begin = np.searchsorted(column[by_value], np.arange(len(value) + 1))
    cut = np.concatenate([[0], np.cumsum(sizes)])
    label = np.searchsorted(ids, ids)
    for i in range(n):
        if (label == label[0]).all():
            break
        mine = column[cut[i] : cut[i + 1]]
        lengths = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        common = np.bincount(owner[by_value[at]], minlength=n)
        near = common >= THRESHOLD * (sizes[i] + sizes - common)
        linked = np.unique(label[near])
        if len(linked) > 1:
            label[np.isin(label, linked)] = linked[0]
    textkit.release()
    return pa.table({"doc_id": ids, "group_id": ids[label]})


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component) of an edge table (a, b): alternating large-star and small-star rounds, each written to the shared folder."""
    spark = edges.sparkSession
    edges = storage.written(edges, "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(least, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b")).distinct()
        after = storage.written(small.where("a <> b"), "edges")
        # A set of stars, each around its smallest member, is the fixed point: no centre is also a leaf, and no leaf has two centres.
        leaves = after.groupBy("a").agg(F.count("*").alias("n"))
        unfinished = leaves.where("n > 1").select("a").unionByName(after.select("b").join(leaves.select(F.col("a").alias("b")), "b", "left_semi").select(F.col("b").alias("a")))
        more = bool(unfinished.take(1))
        storage.drop(spark, edges.lexigrain_path)
        edges = after
        if not more:
            break
    return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("doc_id"), F.col("b").alias("component")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id) of every document that isn't its group's first: ``keep_id`` is the one that stays."""
    spark = docs.sparkSession
    context = spark.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    sketched = storage.written(texts.mapInArrow(_sketches, "doc_id long, size long, digest binary, sketch binary"), "sketches")
    lowest = sketched.groupBy("digest", "size").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
    exact = storage.written(sketched.select("doc_id", "digest", "size").join(lowest, ["digest", "size"]).where("doc_id <> keep_id").select("doc_id", "keep_id").distinct(), "copies")
    # Copies take no part in the search.
    slim = sketched.select("doc_id", "size", "sketch")
    bands = members.without(slim.select("doc_id", "sketch"), exact, then=_bands, schema="band long, doc_id long")
    band = Window.partitionBy("band")
    center = F.min_by("doc_id", F.xxhash64("doc_id", "band")).over(band)
    shared = bands.select("band", "doc_id", F.min("doc_id").over(band).alias("low"), F.max("doc_id").over(band).alias("high"), center.alias("center")).where("low < high")
    shared = storage.written(shared.select("band", "doc_id", "center"), "bands")
    paired = context.broadcast(members.of(shared.select("doc_id").distinct()))
    heads = slim.mapInArrow(members.filtered(paired), slim.schema)

    def likely(pairs: DataFrame) -> DataFrame:
        side = lambda x: heads.select(F.col("doc_id").alias(x), F.col("size").alias(f"{x}_size"), F.col("sketch").alias(f"{x}_sketch")).hint("merge")
        return pairs.distinct().join(side("a"), "a").join(side("b"), "b").mapInArrow(_near, "a long, b long")

    # A band's members are first held against one of them only. Groups that this joins are one component whatever
    # their other pairs are, so only members of different components are paired, and thousands of copies cost no square.
    stars = shared.where("doc_id <> center").select(F.least("doc_id", "center").alias("a"), F.greatest("doc_id", "center").alias("b"))
    first = storage.written(components(likely(stars)), "components")
    labelled = shared.join(first, "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = labelled.withColumn("least", F.min("component").over(band)).withColumn("most", F.max("component").over(band)).where("least < most").select("band", "doc_id", "component")
    x, y = (mixed.select("band", F.col("doc_id").alias(d), F.col("component").alias(f"{d}_component")) for d in ("x", "y"))
    across = x.join(y, "band").where("x_component < y_component").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    joined = first.where("doc_id <> component").select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
    found = storage.written(components(joined.unionByName(likely(across))), "components")
    for done in (sketched, shared, first):
        storage.drop(spark, done.lexigrain_path)
    wanted = context.broadcast(members.of(found.select("doc_id")))
    sets = texts.mapInArrow(_shingles(wanted), "doc_id long, shingles binary").join(found.hint("merge"), "doc_id").select("component", "doc_id", "shingles")
    near = storage.written(sets.groupBy("component").applyInArrow(_verified, "doc_id long, group_id long").where("doc_id <> group_id"), "near")
    moved = exact.join(near.select(F.col("doc_id").alias("keep_id"), "group_id"), "keep_id", "left").select("doc_id", F.coalesce("group_id", "keep_id").alias("keep_id"))
    return moved.unionByName(near.select("doc_id", F.col("group_id").alias("keep_id"))).distinct()


def drop_near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without those that ``near_duplicates`` replaces by another; rows with a null id stay."""
    return members.without(docs, storage.written(near_duplicates(docs).select("doc_id"), "removed"))
