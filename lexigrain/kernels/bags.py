"""Choices among several names of one entity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping
from itertools import combinations
from math import fsum

from lexigrain.kernels import unicode
from lexigrain.kernels.distance import levenshtein

MAX_LENGTH = 384
_SHARE = {"Latin": 1.0, "Cyrillic": 0.3, "Greek": 0.3}


def latin_share(text: str) -> float:
    letters = [c for c in text if c.isalpha()]
    return sum(_SHARE.get(unicode.char_script(c), 0.0) for c in letters) / len(letters) if letters else 0.0


def case_error_score(text: str) -> float:
    errors, fresh = 0, True
    for c in text:
        errors += 1
        if not c.isalpha():
            fresh = True
        elif fresh:
            errors += 0 if c.isupper() else 2
            fresh = False
        elif c.isupper():
            errors += 1
    return errors / len(text) if text else 0.0


def pick_case(names: list[str]) -> str | None:
    return min(names, key=lambda n: (case_error_score(n), len(n), n.encode())) if names else None


def reduce_names(names: list[str]) -> list[str]:
    if len(names) < 2:
        return list(names)
    groups: dict[str, list[str]] = {}
    for n in names:
        groups.setdefault(n.casefold(), []).append(n)
    return [pick_case(g) for g in groups.values()]


def pick_name(names: Iterable[str | None] | Mapping[str, int]) -> str | None:
    """The most central of the names, each given as often as it occurs or with its count: forms are weighed by how often
    and how Latin they are written, and the form that is most like all others wins, in its best spelling."""
    counts = Counter({n: k for n, k in names.items() if n is not None} if isinstance(names, Mapping) else (n for n in names if n is not None))
    spelled = {n: n.strip().casefold() for n in sorted(counts, key=str.encode)}
    mixed = len({s for n in spelled for s in unicode.scripts_in_order(n)}) > 1
    weights: Counter[str] = Counter()
    spellings: dict[str, list[str]] = {}
    for name, form in spelled.items():
        if not form:
            continue
        forms = [form]
        if mixed and unicode.should_ascii(form) and len(plain := unicode.maybe_ascii(form)) > 2:
            forms.append(plain)
        for f in forms:
            weights[f] += counts[name] * (1 + latin_share(name))
        for f in dict.fromkeys(forms):
            spellings.setdefault(f, []).append(name)
    latin = [n for n, form in spelled.items() if form and latin_share(n) > 0.85]
    if sum(counts[n] for n in latin) == 1:
        return latin[0]
    alike: dict[str, list[float]] = {f: [] for f in weights}
    for a, b in combinations(weights, 2):
        x, y = a[:MAX_LENGTH], b[:MAX_LENGTH]
        share = 1 - levenshtein(x, y) / max(len(x), len(y), 1)
        alike[a].append(share * weights[a])
        alike[b].append(share * weights[b])
    best = max(weights, key=lambda f: fsum(alike[f]), default=None)
    return None if best is None else min(spellings[best], key=lambda n: (-latin_share(n), case_error_score(n), len(n), n.encode()))


def representative_names(names: list[str], limit: int, threshold: float = 0.3) -> list[str]:
    if limit <= 0 or not names:
        return []
    reduced = reduce_names(names)
    if len(reduced) <= limit:
        return reduced
    plain = {n: p for n in reduced if (p := " ".join(n.casefold().split()))}
    center = pick_name(reduced)
    if center not in plain:
        return []

    def apart(a: str, b: str) -> float:
        x, y = plain[a], plain[b]
        return (0 if x == y else levenshtein(x[:MAX_LENGTH], y[:MAX_LENGTH])) / max(len(x), len(y), 1)

    seeds = [center]
    while len(seeds) < limit:
        far = {n: min(apart(n, s) for s in seeds) for n in reduced if n in plain and n not in seeds}
        best = max(far, key=far.get, default=None)
        if best is None or far[best] <= threshold:
            break
        seeds.append(best)
    if len(seeds) == 1:
        return seeds
    clusters = {s: [s] for s in seeds}
    for n in reduced:
        if n in plain and n not in seeds:
            clusters[min(seeds, key=lambda s: apart(n, s))].append(n)
    return [r for c in clusters.values() if (r := pick_name(c)) is not None]


def pick_lang_name(names: list[tuple[str, str | None]], preferred: str, order: list[str]) -> str | None:
    """From names in the preferred language, else in the preferred ones, else from all."""
    for wanted in ({preferred}, set(order)):
        if (best := pick_name([n for n, lang in names if lang in wanted])) is not None:
            return best
    return pick_name([n for n, _ in names])


def list_intersection(a: list[str], b: list[str]) -> list[str]:
    """Common values, each as often as both have it, in the order of the first."""
    left, out = list(b), []
    for x in a:
        if x in left:
            left.remove(x)
            out.append(x)
    return out
