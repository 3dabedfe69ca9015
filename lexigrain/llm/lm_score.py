"""Document scores from a causal self-attention model trained in numpy (operator 1).

Texts become subword ids of a public vocabulary. One layer of causal self-attention with a learned bias per
distance and a residual connection gives a hidden vector, and a two-step softmax over it the next id:
P(class | context) times P(id | class, context). Classes are cuts of the vocabulary by frequency, so frequent
ids have few rivals. The second softmax begins at the ids' counts over all documents, and learns from there.

Training is data-parallel and covers every document once. The corpus is cut into shards of about ``SHARD_IDS``
ids by the hash of (doc_id, text), and each shard into ``ROUNDS`` parts. In a round every shard starts from the
same weights, takes Adam steps over its part in the order of that hash, and the results are averaged, weighted by
the number of ids. What a shard holds and in which order it is read follows from the rows alone, so neither
partitioning nor lost executors change the model beyond rounding, and more data means more shards of the same size.

Training windows of ``WINDOW`` ids don't overlap, so that each id is learned from once. Scoring windows
overlap by ``WINDOW - STRIDE``: an id is predicted with all of its window before it, and scored in the first
window that predicts it, so each is scored once. Windows of many documents go through masked attention in one batch.

The result is (doc_id, n_tokens, log_prob, nll, perplexity); log_prob in nats, nll per id.

Defined cases: a null, empty or white-space text has no ids: 0 tokens, log_prob 0, nll and perplexity null;
with no id at all in the corpus there is nothing to train and all rows are such; a table of any other size, one
row too, trains; rows without an id take part by their text; a text of any length is read whole, a block of windows
at a time; equal texts have equal scores; repeated rows are each trained on and scored; columns of other names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm import storage, subwords, textkit

WINDOW = 32
STRIDE = 24
WIDTH = 16
CLASSES = 32
#: Rows of the embedding: the most frequent ids have their own, the others share by remainder.
OWN_ROWS = 2048
SHARED_ROWS = 512
ROUNDS = 3
LEARNING_RATE = 0.02
MEMBER_RATE = 0.1
BATCH = 128
#: Windows of a batch whose gradient is taken at once, so that what it needs stays near a core.
PART = 64
#: Windows scored at once: their attention fits a core's cache.
SCORE_BATCH = 64
#: Windows held at once; the softmax within classes takes a block's ids class by class.
BLOCK = 2048
SHARD_IDS = 1 << 22
#: Tasks of a round hold one shard each, or several one after the other; this changes no result.
MOST_TASKS = 1 << 14
_ROWS = OWN_ROWS + SHARED_ROWS + 1
_START = _ROWS - 1
#: Where a flat embedding, taken as pairs of numbers, has each row. A sum of complex numbers adds two at a time.
_ROW_PAIRS = np.arange(_ROWS * WIDTH // 2).reshape(_ROWS, WIDTH // 2)
#: Logits of ids within a class that one step of training takes.
_CELLS = 1 << 18
#: Logits that are held at once, so that they stay near a core; this changes no result.
NEAR_CELLS = 1 << 17

_SHAPES = {"e": (_ROWS, WIDTH), "m": (WIDTH, WIDTH), "r": (WINDOW,), "v": (WIDTH, WIDTH), "c": (CLASSES, WIDTH), "b": (CLASSES,)}
#: Weights of attention and of the softmax over classes. Those within classes, WIDTH + 1 an id, follow them.
SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())
_ENDS = np.cumsum([int(np.prod(s)) for s in _SHAPES.values()]).tolist()
_SPANS = [(name, shape, a, b) for (name, shape), a, b in zip(_SHAPES.items(), [0, *_ENDS], _ENDS)]
#: Added to what attends to a later position: its weight is then 0.
_LATER = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
_ONES = np.ones(_CELLS, np.float32)
#: Exponents are kept in this range, which makes a maximum per row needless.
_RANGE = 60.0
#: How many positions of a window the one before has scored.
_AGAIN = WINDOW - STRIDE
_DISTANCE = np.maximum(np.arange(WINDOW)[:, None] - np.arange(WINDOW), 0)


def split(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of a weight vector: ``o`` and ``u`` are the ids' output vectors and biases, ids in the order of ``Vocabulary.place``."""
    out = {name: flat[a:b].reshape(shape) for name, shape, a, b in _SPANS}
    ids = (len(flat) - SIZE) // (WIDTH + 1)
    out["o"] = flat[SIZE : SIZE + ids * WIDTH].reshape(ids, WIDTH)
    out["u"] = flat[SIZE + ids * WIDTH :]
    return out


def initial(vocabulary: Vocabulary) -> np.ndarray:
    rng = np.random.default_rng(20)
    flat = np.zeros(SIZE + len(vocabulary.place) * (WIDTH + 1), np.float32)
    flat[:SIZE] = rng.standard_normal(SIZE) * 0.1
    w = split(flat)
    w["m"] += np.eye(WIDTH, dtype=np.float32) * 0.1
    w["r"][:] = -0.1 * np.arange(WINDOW)
    w["b"][:] = 0
    w["u"][:] = vocabulary.inside
    return flat


@dataclass
class Vocabulary:
    """What the counts of all documents say of each id: its class, place among all ids ordered by class, and embedding row.

    ``begin`` has the place where each class begins (one more at the end), ``inside`` log P(id | class) by place.
    """

    kind: np.ndarray
    place: np.ndarray
    row: np.ndarray
    begin: np.ndarray
    inside: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Vocabulary:
        smooth = counts + 0.5
        order = np.lexsort((np.arange(len(counts)), -counts))
        # Cuts of equal root frequency: frequent ids get classes of few members.
        mass = np.cumsum(np.sqrt(smooth[order]))
        kind = np.empty(len(counts), np.int64)
        kind[order] = np.minimum((mass / mass[-1] * CLASSES).astype(np.int64), CLASSES - 1)
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        # Classes are runs of ranks, so an id's rank is its place.
        begin = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        inside = np.log(smooth[order]) - np.log(np.maximum(np.bincount(kind, smooth, CLASSES), 0.5))[kind[order]]
        return Vocabulary(kind, rank, np.where(rank < OWN_ROWS, rank, OWN_ROWS + rank % SHARED_ROWS).astype(np.int32), begin, inside.astype(np.float32))


def windows(at: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose ids begin at ``at``: text, first target, number of targets and of those already scored, per window."""
    size = np.diff(at)
    n = np.where(size > 0, 1 + np.maximum(-(-(size - WINDOW) // stride), 0), 0)
    text = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = nth * stride
    return text, at[:-1][text] + begin, np.minimum(size[text] - begin, WINDOW), np.where(nth > 0, WINDOW - stride, 0)


def blocks(vocabulary: Vocabulary, ids: np.ndarray, at: np.ndarray, stride: int = STRIDE) -> Iterator[tuple[np.ndarray, ...]]:
    """Up to ``BLOCK`` windows at a time: input rows and target ids (windows, WINDOW), mask of targets to score, text of each window."""
    text, first, length, seen = windows(at, stride)
    offset = np.arange(WINDOW)
    for b in range(0, len(text), BLOCK):
        part = slice(b, b + BLOCK)
        target = np.minimum(first[part, None] + offset, len(ids) - 1)
        inputs = vocabulary.row[ids[np.maximum(target - 1, 0)]]
        inputs[:, 0] = np.where(first[part] == at[:-1][text[part]], _START, inputs[:, 0])
        yield inputs, ids[target], (offset >= seen[part, None]) & (offset < length[part, None]), text[part]


def attend(
    w: dict[str, np.ndarray], inputs: np.ndarray, begin: int = 0, room: np.ndarray | None = None, hidden: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """Masked attention of a batch of windows, for positions from ``begin`` on: embeddings, queries, exponents over all positions and
    their sums, attended vectors, and hidden vectors. Exponents go into ``room`` and hidden vectors into ``hidden`` where these are given."""
    x = w["e"].take(inputs, axis=0)
    own = np.ascontiguousarray(x[:, begin:])
    y = (own.reshape(-1, WIDTH) @ w["m"]).reshape(own.shape)
    n = x.shape[1]
    a = np.matmul(y, x.transpose(0, 2, 1), out=room)
    a += (w["r"][_DISTANCE] + _LATER)[begin:n, :n]
    if not a.max() <= _RANGE:
        np.clip(a, -1e30, _RANGE, out=a)
    np.exp(a, out=a)
    total = np.maximum(a @ _ONES[:n], 1e-30)[:, :, None]
    z = a @ x
    z /= total
    if hidden is None:
        hidden = np.empty_like(z)
    np.matmul(z.reshape(-1, WIDTH), w["v"], out=hidden.reshape(-1, WIDTH))
    hidden += own
    return x, y, a, total, z, hidden


def _exponents(hidden: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(hidden @ vectors.T), and what multiplies each column of it, exp(bias). Where a logit would leave the range, it is kept in it."""
    out = hidden @ vectors.T
    if out.size:
        low, high = out.min(), out.max()
        if not (-_RANGE <= min(low, low + bias.min()) and max(high, high + bias.max()) <= _RANGE):
            out += bias
            np.clip(out, -_RANGE, _RANGE, out=out)
            bias = np.zeros_like(bias)
    return np.exp(out, out=out), np.exp(bias)


def _log_share(p: np.ndarray, scale: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """Of each row of exponents, log of the share that what was picked has in the sum of all, times ``scale``."""
    return np.log(picked / (p @ scale))


def class_log_probs(w: dict[str, np.ndarray], hidden: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """log P(class | hidden): the first of the two steps of ``log_probs`` by itself."""
    p, scale = _exponents(hidden, w["c"], w["b"])
    return _log_share(p, scale, p[np.arange(len(p)), kind] * scale[kind])


def _by_class(vocabulary: Vocabulary, ids: np.ndarray, cells: int, others: int = 0) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """A class, the places where it begins and ends, and which of the ids are of it, few enough for their logits, and ``others`` beside
    them, to be at most ``cells``."""
    kind = vocabulary.kind[ids].astype(np.int16)
    order = np.argsort(kind, kind="stable")
    cut = np.searchsorted(kind[order], np.arange(CLASSES + 1))
    for k in range(CLASSES):
        low, high = int(vocabulary.begin[k]), int(vocabulary.begin[k + 1])
        step = max(1, cells // max(high - low + others, 1))
        for b in range(cut[k], cut[k + 1], step):
            yield k, low, high, order[b : min(b + step, cut[k + 1])]


def _joined(w: dict[str, np.ndarray], vocabulary: Vocabulary) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each class, output vectors and biases of all classes followed by those of its ids."""
    spans = zip(vocabulary.begin, vocabulary.begin[1:])
    return [(np.concatenate([w["c"], w["o"][low:high]]), np.concatenate([w["b"], w["u"][low:high]])) for low, high in spans]


def log_probs(joined: list[tuple[np.ndarray, np.ndarray]], vocabulary: Vocabulary, hidden: np.ndarray, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """log P(id | hidden) of ids whose hidden vectors are the rows ``at``. Both softmaxes of an id come from one product."""
    out = np.zeros(len(ids), np.float32)
    place = vocabulary.place[ids]
    for k, low, _, mine in _by_class(vocabulary, ids, NEAR_CELLS, CLASSES):
        p, scale = _exponents(hidden.take(at[mine], axis=0), *joined[k])
        column = place[mine] + (CLASSES - low)
        picked = p.reshape(-1).take(np.arange(0, p.size, len(scale)) + column) * scale.take(column)
        out[mine] = _log_share(p[:, :CLASSES], scale[:CLASSES], p[:, k] * scale[k]) + _log_share(p[:, CLASSES:], scale[CLASSES:], picked)
    return out


def _hidden(w: dict[str, np.ndarray], inputs: np.ndarray, scored: np.ndarray) -> np.ndarray:
    """Hidden vectors of all positions, of which those that an earlier window scores are only looked back at and have none."""
    out = np.empty((*inputs.shape, WIDTH), np.float32)
    for b in range(0, len(inputs), SCORE_BATCH):
        out[b : b + SCORE_BATCH, _AGAIN:] = attend(w, inputs[b : b + SCORE_BATCH], _AGAIN)[-1]
    first = np.flatnonzero(scored[:, 0])
    for b in range(0, len(first), SCORE_BATCH):
        mine = first[b : b + SCORE_BATCH]
        out[mine, :_AGAIN] = attend(w, inputs[mine, :_AGAIN])[-1]
    return out.reshape(-1, WIDTH)


def score(flat: np.ndarray, vocabulary: Vocabulary, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of log probabilities of each text's ids."""
    out = np.zeros(len(at) - 1)
    w = split(flat)
    joined = _joined(w, vocabulary)
    for inputs, target, scored, text in blocks(vocabulary, ids, at):
        sums = log_probs(joined, vocabulary, _hidden(w, inputs, scored), np.flatnonzero(scored), target[scored])
        low = text[0]
        add = np.bincount(np.repeat(text - low, scored.sum(axis=1)), sums)
        out[low : low + len(add)] += add
    return out


def gradient(w: dict[str, np.ndarray], inputs: np.ndarray, kind: np.ndarray, mask: np.ndarray, hidden: np.ndarray | None = None) -> tuple[np.ndarray, float | None, np.ndarray]:
    """Gradient of the mean class loss over the masked targets, that loss, and the hidden vectors. Where an array is given for these they go
    there, and the loss, which training doesn't need, is left out."""
    n = max(int(np.count_nonzero(mask)), 1)
    flat = np.zeros(SIZE, np.float32)
    g, loss, wanted = split(flat), 0.0, hidden is None
    hidden, dx = np.empty((*inputs.shape, WIDTH), np.float32) if wanted else hidden, np.empty((*inputs.shape, WIDTH), np.float32)
    for b in range(0, len(inputs), PART):
        part = slice(b, b + PART)
        loss += _part_gradient(w, g, inputs[part], kind[part].ravel(), mask[part].ravel(), n, hidden[part], dx[part], wanted)
    np.add.at(g["e"].reshape(-1).view(np.complex64), _ROW_PAIRS.take(inputs.ravel(), axis=0).ravel(), dx.reshape(-1).view(np.complex64))
    return flat, loss / n if wanted else None, hidden.reshape(-1, WIDTH)


def _part_gradient(
    w: dict[str, np.ndarray], g: dict[str, np.ndarray], inputs: np.ndarray, k: np.ndarray, m: np.ndarray, n: int, hidden: np.ndarray, dx: np.ndarray, wanted: bool
) -> float:
    """Adds a part of a batch of ``n`` targets to all of the gradient but the embedding's, whose rows' gradients go into ``dx``; its loss, where wanted."""
    flat = lambda a: a.reshape(-1, WIDTH)
    # Exponents above their logits' gradients, and above queries what the exponents meet: one product sums what keys get from both.
    both, meets = np.empty((len(inputs), 2 * WINDOW, WINDOW), np.float32), np.empty((len(inputs), 2 * WINDOW, WIDTH), np.float32)
    a, ds, d = both[:, :WINDOW], both[:, WINDOW:], meets[:, :WINDOW]
    x, y, _, sums, z, _ = attend(w, inputs, 0, a, hidden)
    h2 = flat(hidden)
    p, scale = _exponents(h2, w["c"], w["b"])
    total = p @ scale
    cell = np.arange(0, p.size, CLASSES) + k
    flat_p = p.reshape(-1)
    whole = total / scale.take(k)
    loss = -float(np.log(np.maximum(flat_p.take(cell) / whole, 1e-30))[m].sum()) if wanted else 0.0
    flat_p[cell] -= whole
    # Times ``scale``, which the small matrices below take in, this is the gradient of the logits.
    p *= (m * np.float32(1 / n) / total)[:, None]
    g["c"] += (p.T @ h2) * scale[:, None]
    g["b"] += (_ONES[: len(p)] @ p) * scale
    dh = p @ (w["c"] * scale[:, None])
    g["v"] += flat(z).T @ dh
    dz = (dh @ w["v"].T).reshape(z.shape)
    # Weights are ``a / sums``, and dividing what they meet is less work.
    np.divide(dz, sums, out=d)
    meets[:, WINDOW:] = y
    np.matmul(d, x.transpose(0, 2, 1), out=ds)
    # Sum over keys of weight times its gradient is the gradient times the attended vector.
    ds -= (flat(d * z) @ _ONES[:WIDTH]).reshape(sums.shape)
    ds *= a
    np.matmul(both.transpose(0, 2, 1), meets, out=dx)
    dy = flat(ds @ x)
    by_distance = _ONES[: len(x)] @ both.reshape(len(x), -1)[:, WINDOW * WINDOW :]
    g["r"] += np.bincount(_DISTANCE.ravel(), by_distance, WINDOW)
    g["m"] += flat(x).T @ dy
    dx += dh.reshape(dx.shape)
    dx += (dy @ w["m"].T).reshape(dx.shape)
    return loss


def _learn_members(w: dict[str, np.ndarray], power: dict[str, np.ndarray], vocabulary: Vocabulary, hidden: np.ndarray, at: np.ndarray, ids: np.ndarray, rate: float) -> None:
    """One Adagrad step of the softmax within every class that the ids have, on their mean loss; their hidden vectors are the rows ``at``."""
    place = vocabulary.place[ids]
    for _, low, high, mine in _by_class(vocabulary, ids, _CELLS):
        o, u = np.zeros((high - low, WIDTH), np.float32), np.zeros(high - low, np.float32)
        step = max(256, NEAR_CELLS // (high - low))
        for b in range(0, len(mine), step):
            part = mine[b : b + step]
            h = hidden.take(at[part], axis=0)
            p, scale = _exponents(h, w["o"][low:high], w["u"][low:high])
            total = p @ scale
            column = place[part] - low
            p.reshape(-1)[np.arange(0, p.size, high - low) + column] -= total / scale.take(column)
            p *= (1 / total)[:, None]
            scale /= len(mine)
            o += (p.T @ h) * scale[:, None]
            u += (_ONES[: len(p)] @ p) * scale
        for name, g in (("o", o), ("u", u)):
            power[name][low:high] += g * g
            w[name][low:high] -= rate * g / (np.sqrt(power[name][low:high]) + 1e-5)


def _filled(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same windows in blocks of ``BLOCK``, however they were cut before."""
    held, n = [], 0
    for part in parts:
        held.append(part[:3])
        n += len(part[0])
        while n >= BLOCK:
            whole = [np.concatenate(x) for x in zip(*held)]
            yield tuple(x[:BLOCK] for x in whole)
            held, n = [tuple(x[BLOCK:] for x in whole)], n - BLOCK
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def train(flat: np.ndarray, vocabulary: Vocabulary, documents: Iterator[tuple[np.ndarray, np.ndarray]], rate: float = 1.0) -> tuple[np.ndarray, int]:
    """Steps over the windows of some documents; the new weights and the number of targets seen."""
    flat = flat.copy()
    w, own = split(flat), flat[:SIZE]
    first, second, step, seen = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0, 0
    power, scratch = {n: np.zeros_like(w[n]) for n in ("o", "u")}, np.empty(SIZE, np.float32)
    for inputs, target, mask in _filled(b for ids, at in documents if len(ids) for b in blocks(vocabulary, ids, at, WINDOW)):
        order = np.random.default_rng(seen).permutation(len(inputs))
        mixed, kind, told = inputs[order], vocabulary.kind[target[order]], mask[order]
        hidden = np.empty((*inputs.shape, WIDTH), np.float32)
        for b in range(0, len(order), BATCH):
            part = slice(b, b + BATCH)
            g = gradient(w, mixed[part], kind[part], told[part], hidden[part])[0]
            step += 1
            # Moments are kept at 10 and 100 times their size, which saves scaling what is added.
            first *= 0.9
            first += g
            second *= 0.99
            g *= g
            second += g
            np.sqrt(second, out=scratch)
            scratch += 1e-5 * (1 - 0.99**step) ** 0.5
            np.divide(first, scratch, out=scratch)
            scratch *= rate * LEARNING_RATE * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
            own -= scratch
        at = (np.argsort(order)[:, None] * WINDOW + np.arange(WINDOW))[mask]
        _learn_members(w, power, vocabulary, hidden.reshape(-1, WIDTH), at, target[mask], rate * MEMBER_RATE)
        seen += int(np.count_nonzero(mask))
    return flat, seen


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.slices(batch):
                ids, at = subwords.encoder(tokenizer).encode(part.column("text"))
                raw = pa.py_buffer(np.ascontiguousarray(ids))
                blobs = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 2).astype(np.int32)), raw])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), blobs], names=["doc_id", "key", "ids"])

    return run


def encoded(docs: DataFrame, tokenizer: str = subwords.TOKENIZER) -> DataFrame:
    """(doc_id, key, ids): ``key`` is a hash of id and text, which places a row in training; ids are 16-bit numbers."""
    path = subwords.shipped(docs.sparkSession, tokenizer)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.withColumn("key", F.xxhash64("doc_id", "text")).mapInArrow(_encode(path), "doc_id long, key long, ids binary")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in textkit.slices(batch, "ids"):
            column = part.column("ids")
            size = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            data = column.buffers()[2]
            ids = np.frombuffer(data, np.uint16)[size[0] // 2 : size[-1] // 2] if data is not None else np.zeros(0, np.uint16)
            yield part, ids, (size - size[0]) // 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for _, ids, _ in _documents(batches):
        total += np.bincount(ids, minlength=1 << 16)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shard, ids and beginnings of runs of rows of one shard."""
    for part, ids, at in _documents(batches):
        shard = part.column("shard").to_numpy(zero_copy_only=False)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        for a, b in zip(cut, cut[1:]):
            yield int(shard[a]), ids[at[a] : at[b]], at[a : b + 1] - at[a]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of weighted steps, and of their weights."""
    total, n = None, 0
    for batch in batches:
        for blob, seen in zip(batch.column("x"), batch.column("n").to_pylist()):
            x = np.frombuffer(blob.as_buffer(), np.float32)
            total = x.astype(np.float64) if total is None else total + x
            n += seen
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary()), pa.array([n])], names=["x", "n"])


def fit(rows: DataFrame, size: int) -> tuple[np.ndarray, Vocabulary] | None:
    """Counts over all documents of ``encoded``, then rounds of training by shard and averaging."""
    context = rows.sparkSession.sparkContext
    counts = np.zeros(size, np.int64)
    for r in rows.mapInArrow(_count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    if not counts.any():
        return None
    vocabulary = Vocabulary.of(counts)
    flat = initial(vocabulary)
    n = -(-int(counts.sum()) // SHARD_IDS)
    tasks = min(n, MOST_TASKS)
    placed = rows.select("ids", "key", F.pmod("key", F.lit(n)).alias("shard"), F.pmod(F.xxhash64("key"), F.lit(ROUNDS)).alias("round"))
    for r in range(ROUNDS):
        shared = context.broadcast((flat, vocabulary, 1 / (1 + r)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            start, words, rate = shared.value
            total, n = np.zeros(len(start)), 0
            for _, group in groupby(_shards(batches), lambda x: x[0]):
                new, seen = train(start, words, ((ids, at) for _, ids, at in group), rate)
                total += (new - start).astype(np.float64) * seen
                n += seen
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary()), pa.array([n])], names=["x", "n"])

        mine = placed.where(F.col("round") == r).select("ids", "key", "shard").repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int"))
        steps = mine.sortWithinPartitions("shard", "key").mapInArrow(run, "x binary, n long")
        # One vector a task; few tasks add them up, so the driver holds few.
        sums = steps.repartition(min(tasks, 8)).mapInArrow(_summed, "x binary, n long").collect()
        seen = sum(s["n"] for s in sums)
        if seen:
            flat = flat + (sum(np.frombuffer(s["x"], np.float32).astype(np.float64) for s in sums) / seen).astype(np.float32)
        shared.unpersist()
    return flat, vocabulary


def score_documents(docs: DataFrame, tokenizer: str = subwords.TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, log_prob, nll, perplexity) of every row."""
    spark: SparkSession = docs.sparkSession
    rows = storage.written(encoded(docs, tokenizer), "subwords")
    shared = spark.sparkContext.broadcast(fit(rows, subwords.encoder(tokenizer).vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, at in _documents(batches):
            log_prob = score(*shared.value, ids, at) if len(ids) else np.zeros(len(at) - 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(log_prob)], names=["doc_id", "n_tokens", "log_prob"])

    scored = rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, log_prob double")
    nll = F.when(F.col("n_tokens") > 0, -F.col("log_prob") / F.col("n_tokens"))
    return scored.withColumn("nll", nll).withColumn("perplexity", F.exp("nll"))
