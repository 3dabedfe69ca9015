"""Passages that repeat across documents, by bucket-pointer refinement of word suffixes (operator 6).

Every word position of the corpus is a suffix; suffixes that agree on their first words share a bucket. Buckets
start as ``GRAM``-grams. A refinement sorts the suffixes on the pair of their own bucket and the bucket of the
suffix some words later: two suffixes with equal pairs agree on that many words more. The runs of equal pairs in
sorted order are the new buckets, numbered as they are met; suffixes whose bucket no other document shares drop
out, and the new numbers are what the next refinement looks up at the later offset. ``steps`` gives the offsets:
from ``GRAM`` the depth doubles until ``MIN_WORDS`` are reached. Suffixes that are left begin a passage of
``MIN_WORDS`` words that repeats.

A refinement has two exchanges: suffixes are sorted by pair where buckets are numbered, and by document where a
suffix's later bucket stands next to it. Both sides are read in sorted order as streams, so a bucket of any size
takes no memory. To keep most of the corpus out of them, each run of ``MIN_WORDS - Q + 1`` consecutive
``Q``-grams hands in its smallest hash (winnowing): two equal passages hand in the same one, so a suffix whose own
run handed in a Q-gram that no other document has can't begin a repeat. This loses nothing, and about one
position in thirteen is handed in.

The result is (doc_id, first_word, n_words): maximal stretches of words (``textkit``) covered by
repeating passages; positions count the document's words.

Defined cases: null, empty and short texts have no passage; texts of any length are read whole; a passage that
repeats only within one document isn't reported; rows that share an id are one document for that purpose, and
positions count each row's own words; rows without an id are left out; columns of other names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm import members, storage, textkit

MIN_WORDS = 50
#: Words of the grams that are handed in to find where refinement can succeed.
Q = 26
#: Words of the first buckets.
GRAM = 13
#: A position is the number of the row among those of its id, in the upper bits, and the word in the row.
_WORD = 32

_PAIRS = "b1 long, b2 long, doc_id long, position long"
_BUCKETS = "doc_id long, position long, bucket long"


def steps(depth: int = GRAM, goal: int = MIN_WORDS) -> list[int]:
    """How much deeper each refinement goes."""
    out = []
    while depth < goal:
        out.append(min(depth, goal - depth))
        depth += out[-1]
    return out


def _sliding(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """``of`` over every run of ``width`` values."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = of(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def selected(grams: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indexes of the Q-grams handed in: minima of a run of consecutive Q-grams of one text."""
    span = MIN_WORDS - Q + 1
    if len(grams) < span:
        return np.zeros(0, np.int64)
    low = _sliding(grams, span, np.minimum)
    inside = at[span - 1 :] - at[: len(low)] == span - 1
    row = np.searchsorted(first, at, "right")
    inside &= row[span - 1 :] == row[: len(low)]
    # A position is a minimum if the largest of the minima of the runs it lies in equals it.
    low = np.where(inside, low, np.uint64(0))
    padded = np.concatenate([np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)])
    most = _sliding(padded, span, np.maximum)
    return np.flatnonzero((grams == most) & (most > 0))


def _pairs(b1: np.ndarray, b2: np.ndarray, docs: pa.Array, position: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(b1.view(np.int64)), pa.array(b2.view(np.int64)), docs, pa.array(position.astype(np.int64))], names=["b1", "b2", "doc_id", "position"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textkit.slices(batch):
            w = textkit.words(part.column("text"))
            grams, at = textkit.windows(w.hash, w.first, Q)
            pick = selected(grams, at, w.first)
            row = np.searchsorted(w.first, at[pick], "right") - 1
            yield _pairs(grams[pick], np.zeros(len(pick), np.uint64), part.column("doc_id").take(pa.array(row)), at[pick] - w.first[row])


def starts(words: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Positions of a text whose run of Q-grams handed in one at ``hits``."""
    grams, _ = textkit.windows(words, np.array([0, len(words)]), Q)
    low = _sliding(grams, MIN_WORDS - Q + 1, np.minimum)
    return np.flatnonzero(np.isin(low, grams[hits[hits < len(grams)]]))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes that can begin a repeat, or are looked up by one that can, with their first buckets at both offsets."""
    reach = np.cumsum([0, *steps()[1:]])
    last, nth = None, 0
    for batch in batches:
        for part in textkit.slices(batch):
            w = textkit.words(part.column("text"))
            b1, b2, rows, positions = [], [], [], []
            for row, (doc, hits) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("positions"))):
                # Rows of one id come one after the other.
                last, nth = doc, nth + 1 if doc == last else 0
                words = w.hash[w.first[row] : w.first[row + 1]]
                begin = starts(words, hits.values.to_numpy(zero_copy_only=False).astype(np.int64))
                if not len(begin):
                    continue
                at = np.zeros(len(words), bool)
                # Offsets add up in any combination of the later refinements.
                for mask in range(1 << (len(reach) - 1)):
                    at[begin + sum(step for k, step in enumerate(steps()[1:]) if mask >> k & 1)] = True
                at = np.flatnonzero(at)
                grams, _ = textkit.windows(words, np.array([0, len(words)]), GRAM)
                b1.append(grams[at])
                b2.append(grams[at + steps()[0]])
                rows.append(np.full(len(at), row))
                positions.append(at + (nth << _WORD))
            if rows:
                yield _pairs(np.concatenate(b1), np.concatenate(b2), part.column("doc_id").take(pa.array(np.concatenate(rows))), np.concatenate(positions))


def refined(batches: Iterator[pa.RecordBatch], task: int = 0) -> Iterator[pa.RecordBatch]:
    """New buckets of suffixes sorted by pair and document; a bucket without a second document is left out."""
    number = task << 36
    key, held, shared = None, [], False
    for batch in batches:
        b1, b2, doc, position = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("b1", "b2", "doc_id", "position"))
        n = len(b1)
        if not n:
            continue
        change = np.flatnonzero((b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])) + 1
        begin = np.concatenate([[0], change]) if key == (b1[0], b2[0]) else np.concatenate([[0, 0], change])
        # The first bucket goes on from the batch before; it may have no row here.
        end = np.append(begin[1:], n)
        size = end - begin
        two = np.zeros(len(begin), bool)
        full = size > 0
        two[full] = doc[begin[full]] != doc[end[full] - 1]
        if held and full[0]:
            two[0] |= held[0][0][0] != doc[end[0] - 1]
        two[0] |= shared
        out = [(d, p, np.full(len(d), number)) for d, p in held] if two[0] else []
        if two[0] or len(begin) > 1:
            held = []
        # The last bucket isn't ended yet: its rows go out once it has two documents.
        keep = np.repeat(two, size)
        out.append((doc[keep], position[keep], np.repeat(np.arange(len(begin)) + number, size)[keep]))
        key, shared = (b1[-1], b2[-1]), bool(two[-1])
        if not shared:
            held.append((doc[begin[-1] :], position[begin[-1] :]))
        number += len(begin) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], names=["doc_id", "position", "bucket"])


def pointed(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """Of suffixes sorted by document and position: their bucket and the one ``step`` words later, where both are left."""
    tail = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        new = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "position", "bucket"))
        doc, position, bucket = (np.concatenate(x) for x in zip(tail, new))
        if not len(doc):
            continue
        row = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (position[1:] >> _WORD != position[:-1] >> _WORD))])
        place = (row << _WORD) | (position & ((1 << _WORD) - 1))
        later = np.minimum(np.searchsorted(place, place + step), len(place) - 1)
        # What lies within ``step`` of the end may have its later suffix in the next batch.
        done = (row < row[-1]) | (place + step <= place[-1])
        found = np.flatnonzero(done & (place[later] == place + step))
        yield _pairs(bucket[found], bucket[later[found]], pa.array(doc[found]), position[found])
        rest = int(np.flatnonzero(~done)[0]) if (~done).any() else len(done)
        tail = [doc[rest:], position[rest:], bucket[rest:]]


def _refine(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from refined(batches, TaskContext.get().partitionId())

    return pairs.repartition("b1", "b2").sortWithinPartitions("b1", "b2", "doc_id").mapInArrow(run, _BUCKETS)


def _point(buckets: DataFrame, step: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pointed(batches, step)

    return buckets.repartition("doc_id").sortWithinPartitions("doc_id", "position").mapInArrow(run, _PAIRS)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, first, size = [], [], []
        for doc, positions in zip(batch.column("doc_id").to_pylist(), batch.column("positions")):
            p = np.unique(positions.values.to_numpy(zero_copy_only=False))
            cut = np.flatnonzero(np.diff(p) > MIN_WORDS)
            begin, end = p[np.append(0, cut + 1)], p[np.append(cut, len(p) - 1)] + MIN_WORDS
            ids += [doc] * len(begin)
            first += begin.tolist()
            size += (end - begin).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first, pa.int32()), pa.array(size, pa.int32())], names=["doc_id", "first_word", "n_words"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, first_word, n_words) of every stretch of at least ``MIN_WORDS`` words that other documents have too."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    word = F.col("position").bitwiseAND(F.lit((1 << _WORD) - 1)).cast("int")
    positions = lambda rows: rows.groupBy("doc_id").agg(F.collect_set(word).alias("positions"))
    hits = storage.written(positions(_refine(texts.mapInArrow(_anchors, _PAIRS))), "repeating-grams")
    # Only texts with such a gram are exchanged.
    wanted = docs.sparkSession.sparkContext.broadcast(members.of(hits.select("doc_id")))
    near = texts.mapInArrow(members.filtered(wanted), texts.schema).join(hits.hint("merge"), "doc_id").select("doc_id", "text", "positions")
    buckets = _refine(near.mapInArrow(_suffixes, _PAIRS))
    for step in steps()[1:]:
        # Written, so that the exchanges behind it, of texts too, needn't be kept until the end.
        buckets = _refine(_point(storage.written(buckets, "buckets"), step))
    return positions(buckets).mapInArrow(_stretches, "doc_id long, first_word int, n_words int")
