"""A one-hash Bloom filter of ids, to keep rows that can't match out of an exchange.

Its size follows the number of ids up to ``MOST_BITS``; a larger set fills it up, so that it lets more rows
through, and the join behind it stays right at any size. Broadcast and driver hold at most that many bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm import textkit

BITS_PER_ID = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (textkit.mix64(ids.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def of(ids: DataFrame) -> np.ndarray:
    """The filter of a one-column table of non-null longs, as 64-bit words."""
    column = ids.columns[0]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_ID * max(1, ids.count()) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            slot = _slots(batch.column(0).to_numpy(zero_copy_only=False), bits)
            np.bitwise_or.at(words, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
        full = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(words[full].view(np.int64))], names=["at", "word"])

    out = np.zeros(bits // 64, np.uint64)
    for r in ids.select(column).mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).collect():
        out[r["at"]] = np.uint64(r["word"] & 0xFFFFFFFFFFFFFFFF)
    return out


def may_hold(words: np.ndarray, ids: pa.Array) -> np.ndarray:
    """False where an id is null or certainly not in the set."""
    slot = _slots(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), len(words) * 64)
    held = (words[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0
    return held & pc.is_valid(ids).to_numpy(zero_copy_only=False)


def filtered(shared: Broadcast, column: str = "doc_id", within: bool = True, then=None):
    """For mapInArrow: the rows whose id the filter may hold, or all others; ``then`` goes on with them in the same worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(shared.value, batch.column(column)) == within))

    return run if then is None else lambda batches: then(run(batches))


def without(df: DataFrame, ids: DataFrame, column: str = "doc_id", then=None, schema: str | None = None) -> DataFrame:
    """Anti-join in which only rows that the filter can't tell from a member are exchanged; a null id stays.

    ``then``, a function for mapInArrow, is applied to what is left, in the workers that filter, so that a task needs one.
    """
    shared = df.sparkSession.sparkContext.broadcast(of(ids.select(column)))
    unsure = df.mapInArrow(filtered(shared, column), df.schema).join(ids.select(column).hint("merge"), column, "left_anti").select(*df.columns)
    sure = df.mapInArrow(filtered(shared, column, False, then), schema or df.schema)
    return sure.unionByName(unsure if then is None else unsure.mapInArrow(then, schema))
