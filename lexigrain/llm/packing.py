"""Packing documents into sequences by non-negative least squares over length patterns (operator 8).

Lengths are subword counts. A document longer than ``SEQUENCE`` is cut into pieces of that length and a
rest, so nothing is lost. Lengths are put up to multiples of ``GRAIN``; a pattern is a multiset of at most
``PATTERN_PARTS`` such lengths that fills a sequence exactly. How often each pattern is used is fitted to
the histogram of all lengths by non-negative least squares, rounded down, and lowered where the histogram
doesn't hold so many; the lengths left over are packed best-fit, longest first, on their histogram.

Only the histogram (``SEQUENCE / GRAIN`` numbers) comes to the driver. A piece's sequence follows from its
rank among the pieces of its length by arithmetic over the runs of equal patterns. Ranks come from counts
per (length, shard) and a window within each shard, so that no task holds all pieces of a frequent length;
shards are as many as the pieces need (beyond ``MOST_SHARDS`` they grow, and windows spill).

Defined cases: null and empty texts have length 0 and are in no sequence; documents of a null id are packed
like any; ties are ordered by id; repeated rows are packed each; columns of other names don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrain.llm import storage, subwords, textkit

SEQUENCE = 2048
GRAIN = 16
PATTERN_PARTS = 3
#: Pieces of one length that a task ranks, about; more pieces make more shards.
SHARD_PIECES = 1 << 17
MOST_SHARDS = 1 << 12


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lawson and Hanson's active-set method: the x >= 0 of least ||ax - b||."""
    gram, right = a.T @ a, a.T @ b
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, np.abs(right).max(initial=0))
    for _ in range(3 * n):
        gradient = right - gram @ x
        gradient[passive] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= tolerance:
            break
        passive[best] = True
        while True:
            index = np.flatnonzero(passive)
            solved = np.linalg.lstsq(gram[np.ix_(index, index)], right[index], rcond=None)[0]
            if (solved > 0).all():
                x[:] = 0
                x[index] = solved
                break
            falling = index[solved <= 0]
            step = min(x[i] / (x[i] - s) if x[i] > s else 0.0 for i, s in zip(index, solved) if s <= 0)
            x[index] += step * (solved - x[index])
            passive[falling[x[falling] <= 1e-12]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def patterns(slots: int, parts: int = PATTERN_PARTS) -> list[tuple[int, ...]]:
    """All multisets of at most ``parts`` positive numbers that sum to ``slots``, each in falling order."""

    def grow(rest: int, most: int, left: int) -> Iterator[tuple[int, ...]]:
        if rest == 0:
            yield ()
        elif left:
            for first in range(min(most, rest), 0, -1):
                for tail in grow(rest - first, first, left - 1):
                    yield (first, *tail)

    return list(grow(slots, slots, parts))


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that hold every length of the histogram exactly once; index k of it counts length k + 1 in grains."""
    slots = len(histogram)
    left = histogram.astype(np.int64).copy()
    shapes = patterns(slots)
    matrix = np.zeros((slots, len(shapes)))
    for k, shape in enumerate(shapes):
        for part in shape:
            matrix[part - 1, k] += 1
    # Long lengths weigh more, as a missing one wastes more.
    weight = np.sqrt(np.arange(1, slots + 1))
    fitted = nnls(matrix * weight[:, None], histogram * weight)
    out = []
    for k in np.argsort(-fitted, kind="stable"):
        need = Counter(shapes[k])
        repeats = min(int(fitted[k] + 1e-6), *(int(left[p - 1]) // n for p, n in need.items()))
        if repeats > 0:
            out.append((shapes[k], repeats))
            for p, n in need.items():
                left[p - 1] -= n * repeats
    return out + _residuals(left)


def _residuals(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, of whole runs of equal lengths: open sequences are counted by their pattern."""
    slots = len(left)
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(slots + 1)]
    for length in range(slots, 0, -1):
        n = int(left[length - 1])
        while n:
            room = next((r for r in range(length, slots) if open_[r]), slots)
            if room == slots:
                # A new sequence takes as many of this length as it holds.
                each = slots // length
                times, over = divmod(n, each)
                if times:
                    shape = (length,) * each
                    open_[slots - each * length][shape] = open_[slots - each * length].get(shape, 0) + times
                if over:
                    shape = (length,) * over
                    open_[slots - over * length][shape] = open_[slots - over * length].get(shape, 0) + 1
                n = 0
            else:
                shape, times = next(iter(open_[room].items()))
                used = min(n, times)
                if used == times:
                    del open_[room][shape]
                else:
                    open_[room][shape] = times - used
                fuller = (*shape, length)
                open_[room - length][fuller] = open_[room - length].get(fuller, 0) + used
                n -= used
    return [(shape, times) for rooms in open_ for shape, times in sorted(rooms.items())]


def _pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.slices(batch):
                size = subwords.encoder(tokenizer).lengths(part.column("text"))
                n = -(-size // SEQUENCE)
                row = np.repeat(np.arange(len(size)), n)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                length = np.minimum(size[row] - nth * SEQUENCE, SEQUENCE)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(nth.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array((-(-length // GRAIN)).astype(np.int32))],
                    names=["doc_id", "piece", "n_tokens", "slot"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, piece int, n_tokens int, slot int")


def pack(docs: DataFrame, tokenizer: str = subwords.TOKENIZER) -> DataFrame:
    """(pack_id, doc_ids, pieces, lengths, n_tokens) of every sequence: its documents in order, which piece of each, and how many subwords."""
    spark: SparkSession = docs.sparkSession
    pieces = storage.written(_pieces(docs, subwords.shipped(spark, tokenizer)), "pieces")
    most = pieces.groupBy("slot").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    shards = min(MOST_SHARDS, 1 + most // SHARD_PIECES)
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(shards)).cast("int"))
    counts = pieces.groupBy("slot", "shard").agg(F.count("*").alias("n")).collect()
    histogram = np.zeros(SEQUENCE // GRAIN, np.int64)
    for r in counts:
        histogram[r["slot"] - 1] += r["n"]
    before, total = {}, Counter()
    for r in sorted(counts, key=lambda r: (r["slot"], r["shard"])):
        before[r["slot"], r["shard"]] = total[r["slot"]]
        total[r["slot"]] += r["n"]
    runs, first, used = [], 0, Counter()
    for shape, repeats in plan(histogram):
        at = 0
        for slot, each in Counter(shape).items():
            runs.append((slot, used[slot], used[slot] + each * repeats, first, each, at))
            used[slot] += each * repeats
            at += each
        first += repeats
    ranked = pieces.withColumn("nth", F.row_number().over(Window.partitionBy("slot", "shard").orderBy("doc_id", "piece", "n_tokens")) - 1)
    # Both small tables are bounded by the parameters: MOST_SHARDS x SEQUENCE / GRAIN rows, and the patterns in use.
    offsets = spark.createDataFrame([(k[0], k[1], n) for k, n in before.items()], "slot int, shard int, before long")
    table = spark.createDataFrame(runs, "slot int, low long, high long, first long, each int, at int")
    placed = (
        ranked.join(F.broadcast(offsets), ["slot", "shard"])
        .withColumn("rank", F.col("before") + F.col("nth"))
        .join(F.broadcast(table.withColumnRenamed("slot", "run_slot")), (F.col("slot") == F.col("run_slot")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .select((F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).alias("pack_id"), (F.col("at") + (F.col("rank") - F.col("low")) % F.col("each")).alias("place"), "doc_id", "piece", "n_tokens")
    )
    ordered = placed.groupBy("pack_id").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "piece", "n_tokens"))).alias("x"), F.sum("n_tokens").alias("n_tokens"))
    return ordered.select("pack_id", F.col("x.doc_id").alias("doc_ids"), F.col("x.piece").alias("pieces"), F.col("x.n_tokens").alias("lengths"), "n_tokens")
