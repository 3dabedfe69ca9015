"""Language identification with a string kernel (operator 3).

A text is cut into pieces of ``PIECE_BYTES`` bytes of its lower-cased UTF-8 form; each piece is the set of
its byte n-grams of one to three bytes (the blended spectrum, presence only). The kernel of two pieces is
the number of n-grams they share over the root of the product of their set sizes, both taken over the
n-grams that occur in any landmark. Landmarks are labelled pieces; a Nyström map through them and
one-versus-rest kernel ridge regression give one score per language. A text's score is the mean over all
its pieces, weighted by their sizes; it is the language of the largest score. The K goals of a piece sum to
2 - K, and so do the scores of any text: its largest is (2 - K) / K at least, whatever its language. The
confidence of a text is how far its largest score lies from that towards the goal, 1. A text is rejected
when confidence and share of trigrams known from the landmarks are low together: both are low in a language
without labels, while a short text of a known language has low scores but known trigrams, and one full of
numbers and keys the reverse.

The classifier is fitted on at most ``SAMPLE_PER_LANGUAGE`` labelled documents a language, those with the
smallest hash of id and text, and only so many of their pieces; scoring covers every piece of every document.
``MIN_SURE`` was chosen on sf0.1, one language left out of fitting at a time: of that language's rows 97 to 99 %
are rejected, of held-out rows of the others about 0.2 %. A close relative of a labelled language can still pass.

Defined cases: a null, empty or white-space text has no language and is rejected; a text of any length is scored
whole; rows without a label aren't used in fitting, those without an id are like any other; a language whose labelled rows are all equal is fitted on them;
with no labelled row at all every document is rejected; ties go to the language
that sorts first; with a single language its score says nothing, and ``LONE_CONFIDENCE`` stands in; repeated rows and columns of other names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrain.llm import textkit

SAMPLE_PER_LANGUAGE = 200
PIECES_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 32
PIECE_BYTES = 2048
RIDGE = 1e-2
#: Text whose presence matrix is held at once.
SLICE_BYTES = 1 << 18
MIN_KNOWN = 0.25
#: Least sum of a text's confidence and its share of known trigrams.
MIN_SURE = 1.05
LONE_CONFIDENCE = 0.25

_SPAN = (0, 1 << 8, (1 << 8) + (1 << 16))


def _codes(data: np.ndarray) -> list[np.ndarray]:
    """Codes of the 1-, 2- and 3-grams that begin at each byte."""
    one = data.astype(np.int32)
    two = one[:-1] | (one[1:] << 8)
    three = two[:-1] | (one[2:] << 16)
    return [one, two, three]


def _pieces(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces begin (one more at the end) and the row of each; no piece crosses a text."""
    size = np.diff(at)
    n = -(-size // PIECE_BYTES)
    row = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    # Pieces of a text are of nearly equal size, so that no short rest is left.
    begin = at[:-1][row] + nth * size[row] // np.maximum(n[row], 1)
    return np.append(begin, at[-1]), row


@dataclass
class Grams:
    """The column of each known n-gram, ``width`` for others. Trigrams are looked up by their first two bytes and then
    the third, so the tables are small enough for a core's cache."""

    width: int
    short: np.ndarray
    block: np.ndarray
    cells: np.ndarray

    @staticmethod
    def of(features: np.ndarray) -> Grams:
        kind = np.uint32 if len(features) >= 65535 else np.uint16
        short = np.full(_SPAN[2], len(features), kind)
        few = features < _SPAN[2]
        column = np.arange(len(features))
        short[features[few]] = column[few]
        codes = features[~few] - _SPAN[2]
        begins, at = np.unique(codes & 0xFFFF, return_inverse=True)
        block = np.zeros(1 << 16, np.int32)
        block[begins] = np.arange(1, len(begins) + 1)
        cells = np.full((len(begins) + 1, 256), len(features), kind)
        cells[at + 1, codes >> 16] = column[~few]
        return Grams(len(features), short, block, cells)

    def columns(self, n: int, codes: np.ndarray) -> np.ndarray:
        if n < 3:
            return self.short[_SPAN[n - 1] + codes]
        return self.cells.reshape(-1)[(self.block[codes & 0xFFFF] << 8) + (codes >> 16)]


@dataclass
class Model:
    languages: list[str]
    grams: Grams
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray | None = None

    def presence(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The presence matrix of pieces over known n-grams, and each piece's share of known trigrams."""
        pieces, width = len(begin) - 1, self.landmarks.shape[0]
        out = np.zeros((pieces, width + 1), np.uint8)
        owner = np.repeat(np.arange(pieces), np.diff(begin))
        known = np.ones(pieces)
        for n, codes in enumerate(_codes(data), 1):
            if not len(codes):
                continue
            # An n-gram belongs to the piece where it begins, but must not cross into another text's piece.
            column = self.grams.columns(n, codes)
            mine = owner[: len(codes)]
            inside = mine == owner[n - 1 :] if n > 1 else np.ones(len(codes), bool)
            mine, column = mine[inside], column[inside]
            out.reshape(-1)[mine * np.int64(width + 1) + column] = 1
            if n == 3:
                total = np.bincount(mine, minlength=pieces)
                known = np.where(total > 0, np.bincount(mine, column < width, minlength=pieces) / np.maximum(total, 1), 1.0)
        return out[:, :width], known

    def score(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen, known = self.presence(data, begin)
        dense = seen.astype(np.float32)
        size = np.sqrt(np.maximum(dense.sum(axis=1, keepdims=True), 1))
        return (dense @ self.landmarks / size) @ self.weights, known


def fit(texts: list[str], labels: list[str]) -> Model | None:
    """Fits the classifier on labelled texts, in the order given."""
    languages = sorted(set(labels))
    data, at = textkit.buffers(pa.array([t.lower() for t in texts], pa.string()))
    begin, row = _pieces(at)
    target = np.array([languages.index(x) for x in labels], np.int64)[row]
    picked = np.concatenate([_spread(np.flatnonzero(target == k), PIECES_PER_LANGUAGE) for k in range(len(languages))] or [np.zeros(0, np.int64)]).astype(np.int64)
    if not len(picked):
        return None
    marks = np.concatenate([_spread(picked[target[picked] == k], LANDMARKS_PER_LANGUAGE) for k in range(len(languages))])
    sets = [np.unique(np.concatenate([_SPAN[n] + c for n, c in enumerate(_codes(data[begin[i] : begin[i + 1]]))])) for i in marks]
    features = np.unique(np.concatenate(sets))
    landmarks = np.zeros((len(features), len(marks)), np.float32)
    for k, own in enumerate(sets):
        landmarks[np.searchsorted(features, own), k] = 1 / np.sqrt(len(own))
    model = Model(languages, Grams.of(features), landmarks, np.eye(len(marks), dtype=np.float32))
    spectrum, vectors = np.linalg.eigh((landmarks.T @ landmarks).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(spectrum, 1e-6))
    rows = [model.score(data[begin[i] : begin[i + 1]], np.array([0, begin[i + 1] - begin[i]]))[0] for i in picked]
    mapped = np.column_stack([np.concatenate(rows) @ root, np.ones(len(picked))])
    goal = np.where(np.arange(len(languages)) == target[picked][:, None], 1.0, -1.0)
    solved = np.linalg.solve(mapped.T @ mapped + RIDGE * np.eye(mapped.shape[1]), mapped.T @ goal)
    model.weights = (root @ solved[:-1]).astype(np.float32)
    model.bias = solved[-1].astype(np.float32)
    return model


def _spread(rows: np.ndarray, n: int) -> np.ndarray:
    return rows if len(rows) <= n else rows[np.arange(n) * len(rows) // n]


def _confidence(top: np.ndarray, languages: int) -> np.ndarray:
    """Where a text's largest score lies between the least it can be (0) and its goal (1)."""
    if languages == 1:
        return np.full(len(top), LONE_CONFIDENCE)
    least = (2 - languages) / languages
    return (top - least) / (1 - least)


def classify(model: Model | None, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, share of known trigrams and acceptance of each text."""
    data, at = textkit.buffers(pc.utf8_lower(pc.fill_null(texts, "")))
    rows = len(at) - 1
    filled = ~np.isin(data, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
    content = np.concatenate([[0], np.cumsum(filled)])[at]
    has = np.diff(content) > 0
    if model is None or not len(data):
        return [None] * rows, np.full(rows, np.nan), np.zeros(rows), np.zeros(rows, bool)
    begin, row = _pieces(at)
    score, known = model.score(data, begin)
    weight = np.diff(begin).astype(np.float64)
    total = np.maximum(np.bincount(row, weight, rows), 1)
    mean = np.column_stack([np.bincount(row, weight * (score[:, k] + model.bias[k]), rows) / total for k in range(len(model.languages))])
    share = np.bincount(row, weight * known, rows) / total
    best = mean.argmax(axis=1)
    top = mean[np.arange(rows), best]
    return [model.languages[k] if h else None for k, h in zip(best, has)], np.where(has, top, np.nan), np.where(has, share, 0.0), has & (share >= MIN_KNOWN) & (_confidence(top, len(model.languages)) + share >= MIN_SURE)


def fit_on(docs: DataFrame) -> Model | None:
    """Fits on the bounded sample of labelled rows; the hash order makes it the same for any partitioning."""
    counts = {r["lang"]: r["n"] for r in docs.where("lang is not null").groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # Only hashes that can be among a language's smallest are ranked, so the exchange holds few texts.
    share = {k: 4 * SAMPLE_PER_LANGUAGE / n for k, n in counts.items()}
    limit = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(2**63 - 1 if v >= 1 else int(-(2**63) + v * 2**64)))])
    labelled = docs.where("lang is not null and text is not null and length(trim(text)) > 0").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("pick"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("pick", "text"))
    sample = lambda some: some.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_PER_LANGUAGE).select("lang", "text", "rank").collect()
    rows = sample(labelled.where(F.col("pick") <= limit[F.col("lang")]))
    # Where very many rows are equal, none may lie below the limit.
    missed = sorted(set(counts) - {r["lang"] for r in rows})
    if missed:
        rows += sample(labelled.where(F.col("lang").isin(missed)))
    rows.sort(key=lambda r: (r["lang"], r["rank"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, language, score, known, accepted) of every row."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or fit_on(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.slices(batch, limit=SLICE_BYTES):
                language, score, known, accepted = classify(shared.value, part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(language, pa.string()), pa.array(score, pa.float64(), from_pandas=True), pa.array(known, pa.float64()), pa.array(accepted)],
                    names=["doc_id", "language", "score", "known", "accepted"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, language string, score double, known double, accepted boolean")


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents whose language is identified; the rest goes. One pass: each batch is classified and filtered as it is."""
    shared = spark.sparkContext.broadcast(fit_on(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.slices(batch, limit=SLICE_BYTES):
                yield part.filter(pa.array(classify(shared.value, part.column("text"))[3]))

    return docs.mapInArrow(run, docs.schema)
