"""Subword ids from a public SentencePiece vocabulary, memoised by word.

Texts are split at ASCII white space and every word is encoded by itself (with the model's word-begin
mark), so each distinct word is encoded once per worker and the rest is array indexing. Ids fit 16 bits.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from lexigrain.llm import textkit

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Words that are kept, and slots for their hashes; the memo begins anew when full.
MEMO_WORDS = 1 << 20
MEMO_SLOTS = 1 << 21
PROBES = 16
_SHIFT = np.uint64(64 - 21)

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocabulary = self.model.get_piece_size()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(MEMO_SLOTS, np.uint64)
        self.where = np.zeros(MEMO_SLOTS, np.int32)
        self.flat = np.zeros(0, np.uint16)
        self.at = np.zeros(1, np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The memo entry of each key, -1 for unknown ones: open addressing, all keys probed together."""
        out = np.full(len(keys), -1, np.int64)
        left, slot = np.arange(len(keys)), (keys >> _SHIFT).astype(np.int64)
        for _ in range(PROBES):
            held = self.keys[slot]
            hit = held == keys[left]
            out[left[hit]] = self.where[slot[hit]]
            on = ~hit & (held != 0)
            if not on.any():
                break
            left, slot = left[on], (slot[on] + 1) & (MEMO_SLOTS - 1)
        return out

    def _keep(self, keys: np.ndarray, where: np.ndarray) -> None:
        """Puts new keys in free slots; one that finds none stays unknown."""
        slot = (keys >> _SHIFT).astype(np.int64)
        for _ in range(PROBES):
            free = self.keys[slot] == 0
            self.keys[slot[free]], self.where[slot[free]] = keys[free], where[free]
            # Of several that found the same slot free the last has it.
            done = self.keys[slot] == keys
            self.where[slot[done]] = where[done]
            keys, where, slot = keys[~done], where[~done], (slot[~done] + 1) & (MEMO_SLOTS - 1)
            if not len(keys):
                break

    def _place(self, w: textkit.Words) -> np.ndarray:
        """The memo entry of each word."""
        if len(self.at) > MEMO_WORDS:
            self.clear()
        hashes = np.maximum(w.hash, np.uint64(1))  # 0 marks a free slot
        place = self._find(hashes)
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            fresh, first, back = np.unique(hashes[unknown], return_index=True, return_inverse=True)
            raw, new = w.data.tobytes(), unknown[first]
            # No word holds a line's end, so all are decoded at once.
            text = b"\n".join([raw[a:b] for a, b in zip(w.begin[new].tolist(), w.end[new].tolist())]).decode("utf-8", "replace")
            ids = self.model.encode(text.split("\n"), num_threads=1)
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            where = len(self.at) - 1 + np.arange(len(ids))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint16, int(length.sum()))])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(length)])
            self._keep(fresh, where)
            place[unknown] = where[back]
        return place

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of subwords of each text."""
        w = textkit.words(texts, lower=False, visible=True)
        if not len(w.begin):
            return np.zeros(len(w.first) - 1, np.int64)
        place = self._place(w)
        total = np.concatenate([[0], np.cumsum(self.at[place + 1] - self.at[place])])
        return total[w.first[1:]] - total[w.first[:-1]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins (one more at the end)."""
        w = textkit.words(texts, lower=False, visible=True)
        if not len(w.begin):
            return np.zeros(0, np.uint16), np.zeros(len(w.first), np.int64)
        place = self._place(w)
        size = self.at[place + 1] - self.at[place]
        total = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(self.at[place] - total[:-1], size) + np.arange(total[-1])
        return self.flat[source], total[w.first]


def shipped(spark: SparkSession, path: str = TOKENIZER) -> str:
    """Sends the vocabulary file to all executors; the same path, for use in their tasks."""
    spark.sparkContext.addFile(path)
    return path


def encoder(path: str = TOKENIZER) -> Encoder:
    """The worker's encoder for a vocabulary file, from its path or, where the machine hasn't that, as it was sent."""
    if not os.path.exists(path):
        path = SparkFiles.get(os.path.basename(path))
    key = f"{path}:{os.path.getmtime(path)}"
    if key not in _encoders:
        _encoders[key] = Encoder(path)
    return _encoders[key]
