"""Part comparison of many pairs of names at once: the same results as ``names.compare_parts``, pair by pair.

Edit costs are filled in along anti-diagonals for all pairs of a block, so that every cell is one of three sums
in any order of evaluation, and the cheapest edits are walked back for all pairs together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from lexigrain.kernels.names import MAX_LENGTH, CompareConfig, edit_cost

#: Cells of a block's tables: they fit a core's cache.
_CELLS = 1 << 18
_INSERT, _DELETE, _KEEP, _SWAP = range(4)

Cluster = tuple[list[int], list[int], float]


def _coded(texts: list[str], width: int) -> np.ndarray:
    """Code points, one text a row, filled up with zeros."""
    out = np.zeros((len(texts), width), np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _moves(swap: np.ndarray, base: np.ndarray, drop: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The last cheapest edit of every pair of beginnings (length, length, pair). Of equally cheap ones an insertion is
    taken before a deletion, that before keeping or replacing, whichever ``base`` has. All pairs of an anti-diagonal's
    cells are one slice of steps, with the pairs side by side in memory."""
    a, b, n = swap.shape
    moves = np.empty(((a + 1) * (b + 1), n), np.int8)
    table = moves.reshape(a + 1, b + 1, n)
    table[0], table[1:, 0] = _INSERT, _DELETE
    first_q, first_r = (np.concatenate([np.zeros((1, n)), np.cumsum(x, axis=0)]) for x in (drop, add))
    swap, base = swap.reshape(a * b, n), base.reshape(a * b, n)
    # Costs by the length on the left side, of this anti-diagonal and the two before.
    two, one, now = (np.zeros((a + 1, n)) for _ in range(3))
    for d in range(a + b + 1):
        if d <= b:
            now[0] = first_r[d]
        if d <= a:
            now[d] = first_q[d]
        low, high = max(d - b, 1), min(a, d - 1)
        if high >= low:
            begin, step = (low - 1) * b + d - low - 1, max(b - 1, 1)
            cells = slice(begin, begin + (high - low) * step + 1, step)
            best = two[low - 1 : high] + swap[cells]
            cost = one[low - 1 : high] + drop[low - 1 : high]
            move = np.where(cost <= best, np.int8(_DELETE), base[cells])
            np.minimum(best, cost, out=best)
            np.add(one[low : high + 1], add[d - high - 1 : d - low][::-1], out=cost)
            np.copyto(move, np.int8(_INSERT), where=cost <= best)
            np.minimum(best, cost, out=now[low : high + 1])
            begin = low * (b + 1) + d - low
            moves[begin : begin + (high - low) * b + 1 : b] = move
        two, one, now = one, now, two
    return table


def _parts(codes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which part each character is of; a separator belongs to the part before it."""
    before = np.cumsum(codes == 32, axis=1) - (codes == 32)
    return np.minimum(before, count[:, None] - 1)


def _block(cfg: CompareConfig, left: list[Sequence[str]], right: list[Sequence[str]]) -> list[list[Cluster]]:
    n = len(left)
    texts = [[" ".join(x)[:MAX_LENGTH] for x in side] for side in (left, right)]
    size_q, size_r = (np.fromiter(map(len, t), np.int64, n) for t in texts)
    count_q, count_r = (np.fromiter(map(len, side), np.int64, n) for side in (left, right))
    q, r = _coded(texts[0], int(size_q.max())), _coded(texts[1], int(size_r.max()))
    # Costs by the few characters there are.
    letters, coded = np.unique(np.concatenate([q.ravel(), r.ravel()]), return_inverse=True)
    cq, cr = coded[: q.size].reshape(q.shape), coded[q.size :].reshape(r.shape)
    chars = [chr(c) for c in letters]
    dropped, added = (np.array([edit_cost(cfg, *((c, None) if k else (None, c))) for c in chars]) for k in (1, 0))
    swapped = np.array([[edit_cost(cfg, a, b) for b in chars] for a in chars])
    # Keeping a character costs nothing.
    keep = np.arange(len(chars))
    swapped[keep, keep] = 0.0
    kinds = np.full(swapped.shape, _SWAP, np.int8)
    kinds[keep, keep] = _KEEP
    cell = cq.T[:, None, :] * len(chars) + cr.T[None, :, :]
    drop, add, swap = dropped[cq], added[cr], swapped.ravel().take(cell)
    moves = _moves(swap, kinds.ravel().take(cell), np.ascontiguousarray(drop.T), np.ascontiguousarray(add.T))
    part_q, part_r = _parts(q, count_q), _parts(r, count_r)
    rows, i, j = np.arange(n), size_q.copy(), size_r.copy()
    # What each step back costs each side, and where.
    steps: list[tuple[np.ndarray, ...]] = []
    while len(rows):
        move = moves[i, j, rows]
        at_q, at_r = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        cost = np.choose(move, [add[rows, at_r], drop[rows, at_q], 0.0, swap[at_q, at_r, rows]])
        steps.append((rows, move, at_q, at_r, cost))
        i, j = i - (move != _INSERT), j - (move != _DELETE)
        going = (i > 0) | (j > 0)
        rows, i, j = rows[going], i[going], j[going]
    row, move, at_q, at_r, cost = (np.concatenate(x) for x in zip(*steps[::-1])) if steps else (np.zeros(0, np.int64),) * 5
    most_q, most_r = int(count_q.max(initial=1)), int(count_r.max(initial=1))
    pq, pr = row * most_q + part_q[row, at_q], row * most_r + part_r[row, at_r]
    uses_q, uses_r = move != _INSERT, move != _DELETE
    sum_q, n_q = np.bincount(pq[uses_q], cost[uses_q], n * most_q), np.bincount(pq[uses_q], minlength=n * most_q)
    sum_r, n_r = np.bincount(pr[uses_r], cost[uses_r], n * most_r), np.bincount(pr[uses_r], minlength=n * most_r)
    # A part that no character was left for counts as one lost character.
    sum_q, n_q, sum_r, n_r = np.where(n_q, sum_q, 1.0), np.maximum(n_q, 1), np.where(n_r, sum_r, 1.0), np.maximum(n_r, 1)
    kept = np.flatnonzero((move == _KEEP) & (q[row, at_q] != 32))
    pair, overlap = np.unique(pq[kept] * most_r + part_r[row[kept], at_r[kept]], return_counts=True)
    of, eq, er = pair // (most_q * most_r), pair // most_r % most_q, pair % most_r
    sums_q, sums_r, lens_q, lens_r = (x.tolist() for x in (sum_q, sum_r, n_q, n_r))
    budgets = [math.log(max(k - cfg.budget_short_floor, 1.0), cfg.budget_log_base) * cfg.budget_tolerance for k in range(2 * MAX_LENGTH + 130)]

    def side(total: float, length: int) -> float:
        if total == 0:
            return 1.0
        return 0.0 if total > budgets[length] else 1 - total / length

    edges: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, a, b, shared in zip(of.tolist(), eq.tolist(), er.tolist(), overlap.tolist()):
        shorter = min(len(left[k][a]), len(right[k][b]))
        if shorter and shared / shorter > cfg.cluster_overlap_min:
            edges[k].append((a, b))
    out = []
    for k in range(n):
        clusters: list[tuple[list[int], list[int]]] = []
        of_q: dict[int, int] = {}
        of_r: dict[int, int] = {}
        for a, b in edges[k]:
            c = of_q.get(a, of_r.get(b))
            if c is None:
                c = len(clusters)
                clusters.append(([], []))
            for members, index in zip(clusters[c], (a, b)):
                if index not in members:
                    members.append(index)
            of_q[a] = of_r[b] = c
        found: list[Cluster] = []
        for qs, rs in clusters:
            x, y = ([k * most_q + a for a in qs], [k * most_r + b for b in rs])
            score = side(sum(sums_q[a] for a in x), sum(lens_q[a] for a in x)) * side(sum(sums_r[b] for b in y), sum(lens_r[b] for b in y))
            found.append((qs, rs, score))
        found += [([a], [], 0.0) for a in range(len(left[k])) if a not in of_q]
        found += [([], [b], 0.0) for b in range(len(right[k])) if b not in of_r]
        out.append(found)
    return out


def compare_parts(left: list[Sequence[str]], right: list[Sequence[str]], cfg: CompareConfig = CompareConfig()) -> list[list[Cluster]]:
    """Of every pair of lists of comparable forms: the clusters of parts, left and right, and their scores. Equal pairs are compared once."""
    place: dict[tuple[tuple[str, ...], tuple[str, ...]], int] = {}
    where = [place.setdefault((tuple(a), tuple(b)), len(place)) for a, b in zip(left, right)]
    pairs = list(place)
    done: list[list[Cluster]] = [[] for _ in pairs]
    size = [(min(sum(map(len, a)) + len(a), MAX_LENGTH), min(sum(map(len, b)) + len(b), MAX_LENGTH)) for a, b in pairs]
    # Pairs of like lengths share a block, so little is filled up.
    order = sorted((k for k, (a, b) in enumerate(pairs) if a and b), key=lambda k: size[k])
    begin = 0
    while begin < len(order):
        end, a, b = begin, 1, 1
        while end < len(order):
            a, b = max(a, size[order[end]][0]), max(b, size[order[end]][1])
            if end > begin and (end - begin + 1) * (a + 1) * (b + 1) > _CELLS:
                break
            end += 1
        block = order[begin:end]
        for k, found in zip(block, _block(cfg, [pairs[k][0] for k in block], [pairs[k][1] for k in block])):
            done[k] = found
        begin = end
    for k, (a, b) in enumerate(pairs):
        if not (a and b):
            done[k] = [([i], [], 0.0) for i in range(len(a))] + [([], [i], 0.0) for i in range(len(b))]
    return [done[k] for k in where]
