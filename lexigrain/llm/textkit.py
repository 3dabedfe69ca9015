"""Vectorised text primitives on Arrow buffers, shared by the operators of this subpackage.

A *word* is a maximal run of ASCII letters and digits or of any non-ASCII characters of the
lower-cased text; everything else separates words. Words are hashed to 64 bits with prefix sums
of a polynomial over their bytes, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_WORD_BYTES = np.array(
    [chr(b).isalnum() if b < 128 else True for b in range(256)], dtype=bool
)
_VISIBLE_BYTES = np.array([b not in b" \t\n\r\x0b\x0c" for b in range(256)], dtype=bool)


class _Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), SLICE_BYTES + 1)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of several texts: byte span, hash, and first word of each text (one more at the end)."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def release() -> None:
    """Gives memory that arrays no longer use back to the system; workers live long and share an executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch at rows so that a slice holds at most about ``limit`` bytes of text; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size, dtype=np.int64)
    begin = 0
    while begin < len(total):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end
    release()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each begins (one more at the end); a null is empty."""
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array, lower: bool = True, visible: bool = False) -> Words:
    """Splits texts into words. ``visible``: words are runs of anything but ASCII white space."""
    data, at = buffers(pc.utf8_lower(texts) if lower else texts)
    n = len(data)
    inside = (_VISIBLE_BYTES if visible else _WORD_BYTES)[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = at[:-1][np.diff(at) > 0]
    begins[starts] = inside[starts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[starts[1:] - 1] = inside[starts[1:] - 1] if len(starts) > 1 else ends[starts[1:] - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    value = mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return Words(data, begin, end, value, np.searchsorted(begin, at))


def windows(value: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words that lie in one text, and the index of their first word."""
    n = len(value)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value * up[:n], out=sums[1:])
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + width <= last)
    return mix64((sums[at + width] - sums[at]) * down[at]), at


def shingle_sets(w: Words, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``width`` words; a shorter text has one run, of all its words."""
    value, at = windows(w.hash, w.first, width)
    cut = np.searchsorted(at, w.first)
    out = []
    for row in range(len(w.first) - 1):
        a, b = w.first[row], w.first[row + 1]
        if a == b:
            out.append(np.zeros(0, np.uint64))
        elif b - a < width:
            out.append(windows(w.hash[a:b], np.array([0, b - a]), int(b - a))[0])
        else:
            out.append(np.unique(value[cut[row] : cut[row + 1]]))
    return out
