"""Benchmark decontamination by SimHash windows (operator 2).

Documents and benchmark items are sequences of words (``textkit``). Wherever a document holds a word
3-shingle of an item, the window of the item's size that lines the two up is looked at; windows whose
weight of benchmark shingles is below ``THRESHOLD`` of their own can't pass the last test and are dropped
(this loses nothing). The rest get 64-bit SimHash fingerprints over their words, weighted by length. Four
16-bit blocks index the items' fingerprints; every block value within ``RADIUS // 4`` bits of the window's
is looked up, which by the pigeonhole principle finds all items within ``RADIUS`` bits. A found pair counts
when the exact weighted similarity of the two multisets of shingles, sum of minima over sum of maxima with
a shingle's bytes as its weight, reaches ``THRESHOLD``.

Items are broadcast up to ``WORDS_AT_ONCE`` words at a time; a larger benchmark takes several passes over the
documents, whose results are written to the shared folder one pass after the other, so neither driver nor workers
ever hold more than one pass's index.

Defined cases: items of fewer than ``SHINGLE`` words can't be told from ordinary text and match nothing; an empty
benchmark matches nothing; null and wordless texts match nothing; a text of any length is read whole; items with
text but without an id match like others, with a null ``item_id``; repeated items each match; repeated documents each
give their rows; of equally similar windows the first counts; columns of other names don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm import storage, textkit

SHINGLE = 3
THRESHOLD = 0.5
RADIUS = 20
BLOCKS = 4
BITS = 64 // BLOCKS
WORDS_AT_ONCE = 2_000_000
_TABLE_BITS = 22

_NEIGHBOURS = np.array(
    [sum(1 << b for b in bits) for r in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BITS), r)], np.uint32
)


def _shingles(w: textkit.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and weight of every shingle."""
    value, at = textkit.windows(w.hash, w.first, SHINGLE)
    bytes_ = np.concatenate([[0], np.cumsum(w.end - w.begin)])
    return value, at, bytes_[at + SHINGLE] - bytes_[at]


def fingerprints(value: np.ndarray, weight: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SimHash of runs of words: bit k is set when the words whose hash has it outweigh the others."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    cut = np.concatenate([[0], np.cumsum(size)[:-1]])
    index = np.repeat(begin - cut, size) + np.arange(size.sum())
    bits = np.unpackbits(textkit.mix64(value[index]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = np.add.reduceat((2 * bits.astype(np.int32) - 1) * weight[index, None].astype(np.int32), cut, axis=0)
    return np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64).ravel()


class Index:
    """The items of one pass: shingle postings and the block tables of their fingerprints."""

    def __init__(self, ids: list[int | None], texts: list[str]) -> None:
        w = textkit.words(pa.array(texts, pa.string()))
        size = np.diff(w.first)
        long = np.flatnonzero(size >= SHINGLE)
        self.ids, self.size = pa.array(ids, pa.int64()), size
        value, at, weight = _shingles(w)
        owner = np.searchsorted(w.first, at, "right") - 1
        order = np.argsort(value, kind="stable")
        self.value, self.item, self.offset = value[order], owner[order], (at - w.first[owner])[order]
        self.distinct, self.begin = np.unique(self.value, return_index=True)
        self.begin = np.append(self.begin, len(self.value))
        self.maybe = np.zeros(1 << _TABLE_BITS, bool)
        self.maybe[self.distinct >> np.uint64(64 - _TABLE_BITS)] = True
        cut = np.searchsorted(at, w.first)
        self.counts = [Counter(value[a:b].tolist()) for a, b in zip(cut, cut[1:])]
        self.weights = dict(zip(value.tolist(), weight.tolist()))
        self.prints = np.zeros(len(ids), np.uint64)
        self.prints[long] = fingerprints(w.hash, w.end - w.begin, w.first[:-1][long], size[long])
        self.blocks = []
        for k in range(BLOCKS):
            block = (self.prints[long] >> np.uint64(k * BITS)).astype(np.uint32) & np.uint32((1 << BITS) - 1)
            sort = np.argsort(block, kind="stable")
            self.blocks.append((long[sort], np.searchsorted(block[sort], np.arange((1 << BITS) + 1))))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a fingerprint and an item at most ``RADIUS`` bits apart."""
        left, right = [], []
        for k, (items, begin) in enumerate(self.blocks):
            block = (prints >> np.uint64(k * BITS)).astype(np.uint32) & np.uint32((1 << BITS) - 1)
            for at in range(0, len(prints), 512):
                near = (block[at : at + 512, None] ^ _NEIGHBOURS).ravel()
                n = begin[near + 1] - begin[near]
                hit = np.flatnonzero(n)
                n = n[hit]
                left.append(np.repeat(at + hit // len(_NEIGHBOURS), n))
                right.append(items[np.repeat(begin[near[hit]] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum())])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.unique(np.concatenate(left) * np.int64(len(self.ids)) + np.concatenate(right))
        a, b = pair // len(self.ids), pair % len(self.ids)
        close = np.bitwise_count(prints[a] ^ self.prints[b]) <= RADIUS
        return a[close], b[close]

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(row, item, first word, words, similarity): of each row and item the best window, the first of equal ones."""
        if not len(self.distinct):
            return []
        w = textkit.words(texts)
        value, at, weight = _shingles(w)
        hit = np.flatnonzero(self.maybe[value >> np.uint64(64 - _TABLE_BITS)])
        slot = np.minimum(np.searchsorted(self.distinct, value[hit]), len(self.distinct) - 1)
        same = self.distinct[slot] == value[hit]
        hit, slot = hit[same], slot[same]
        if not len(hit):
            return []
        known = np.zeros(len(value), np.int64)
        known[hit] = weight[hit]
        known, total = np.concatenate([[0], np.cumsum(known)]), np.concatenate([[0], np.cumsum(weight)])
        n = self.begin[slot + 1] - self.begin[slot]
        place = np.repeat(self.begin[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        word, item = np.repeat(at[hit], n), self.item[place]
        row = np.searchsorted(w.first, word, "right") - 1
        # A window that would leave the text is cut at its ends.
        begin = word - self.offset[place]
        end = np.minimum(begin + self.size[item], w.first[row + 1])
        begin = np.maximum(begin, w.first[row])
        a, b = np.searchsorted(at, begin), np.searchsorted(at, end - SHINGLE, "right")
        dense = (known[b] - known[a] >= THRESHOLD * (total[b] - total[a])) & (b > a)
        windows = np.unique(np.column_stack([begin[dense], end[dense]]), axis=0)
        if not len(windows):
            return []
        begin, end = windows.T
        prints = fingerprints(w.hash, w.end - w.begin, begin, end - begin)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for i, item in zip(*(x.tolist() for x in self.within(prints))):
            a, b = np.searchsorted(at, begin[i]), np.searchsorted(at, end[i] - SHINGLE, "right")
            similarity = self._similarity(value[a:b].tolist(), weight[a:b].tolist(), item)
            if similarity >= THRESHOLD:
                row = int(np.searchsorted(w.first, begin[i], "right") - 1)
                first = int(begin[i] - w.first[row])
                if (row, item) not in best or similarity > best[row, item][0]:
                    best[row, item] = similarity, first, int(end[i] - begin[i])
        return [(row, item, first, size, similarity) for (row, item), (similarity, first, size) in sorted(best.items())]

    def _similarity(self, values: list[int], weights: list[int], item: int) -> float:
        mine, theirs, of = Counter(values), self.counts[item], dict(zip(values, weights))
        low = sum(min(c, mine[v]) * self.weights[v] for v, c in theirs.items() if v in mine)
        total = sum(c * of[v] for v, c in mine.items()) + sum(c * self.weights[v] for v, c in theirs.items())
        return low / (total - low) if total > low else 1.0


def _passes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the benchmark's items, one pass's at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    ids, texts, words = [], [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        words += r["text"].count(" ") + 1
        if words >= WORDS_AT_ONCE:
            yield Index(ids, texts)
            ids, texts, words = [], [], 0
    if ids:
        yield Index(ids, texts)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity) of every document and item that match; no exchange of documents."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, first_word int, n_words int, similarity double"

    def one(index: Index) -> DataFrame:
        shared = context.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in textkit.slices(batch):
                    found = shared.value.matches(part.column("text"))
                    row, item, first, size, similarity = map(list, zip(*found)) if found else ([],) * 5
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(row, pa.int64())), shared.value.ids.take(pa.array(item, pa.int64())), pa.array(first, pa.int32()), pa.array(size, pa.int32()), pa.array(similarity, pa.float64())],
                        names=["doc_id", "item_id", "first_word", "n_words", "similarity"],
                    )

        return texts.mapInArrow(run, schema)

    out, last = None, None
    for index in _passes(benchmark):
        if last is not None:
            done = storage.written(last, "matches")
            out = done if out is None else out.unionByName(done)
        last = one(index)
    if last is None:
        return docs.sparkSession.createDataFrame([], schema)
    return last if out is None else out.unionByName(last)


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item; each pass filters what the one before it left."""
    done = None
    for index in _passes(benchmark):
        if done is not None:
            kept = storage.written(docs, "uncontaminated")
            if done is not True:
                storage.drop(spark, done)
            docs, done = kept, kept.lexigrain_path
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in textkit.slices(batch):
                    keep = np.ones(part.num_rows, bool)
                    keep[[m[0] for m in shared.value.matches(part.column("text"))]] = False
                    yield part.filter(pa.array(keep))

        docs, done = docs.mapInArrow(run, docs.schema), done or True
    return docs
