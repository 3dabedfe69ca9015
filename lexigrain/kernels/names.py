"""Names as objects: parts with tags, spans with symbols; analysis of an entity's names; evidence for pairs."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import cache, lru_cache
from itertools import product

from lexigrain import refdata
from lexigrain.kernels import bags, normal, org_types, phonetics, unicode
from lexigrain.kernels.distance import damerau
from lexigrain.kernels.needles import Needles

MAX_LENGTH, MAX_PARTS = 384, 64
TAG_ORDER = ["HONORIFIC", "TITLE", "GIVEN", "MIDDLE", "NICK", "PATRONYMIC", "MATRONYMIC", "UNSET", "AMBIGUOUS", "FAMILY", "TRIBAL", "NUM", "SUFFIX", "LEGAL"]
CATEGORIES = ["ORGCLS", "SYMBOL", "DOMAIN", "INITIAL", "NAME", "NICK", "NUM", "LOC", "PHON"]
_WILD = {"UNSET", "AMBIGUOUS", "STOP"}
_GIVEN = {"GIVEN", "MIDDLE", "PATRONYMIC", "MATRONYMIC", "HONORIFIC", "STOP", "NICK"}
_FAMILY = {"PATRONYMIC", "MATRONYMIC", "FAMILY", "SUFFIX", "TRIBAL", "HONORIFIC", "NUM", "STOP"}
_INITIAL = {"GIVEN", "MIDDLE", "PATRONYMIC", "MATRONYMIC"}
TAGGER_FLAGS = normal.CASEFOLD | normal.NAME


def can_match(a: str, b: str) -> bool:
    """Whether parts of these tags may stand for each other."""
    if a in _WILD or b in _WILD or a == b:
        return True
    return not (a in _GIVEN and b not in _GIVEN) and not (a in _FAMILY and b not in _FAMILY)


def tag_rank(tag: str) -> int:
    return TAG_ORDER.index("UNSET" if tag == "STOP" else tag)


def tag_sort(parts: Sequence[Part]) -> list[Part]:
    return sorted(parts, key=lambda p: tag_rank(p.tag))


@dataclass
class Part:
    form: str
    index: int = 0
    tag: str = "UNSET"
    phonetics: bool = True
    numeric: bool = field(init=False)
    latinize: bool = field(init=False)
    integer: int | None = field(init=False)
    ascii: str | None = field(init=False)
    comparable: str = field(init=False)
    metaphone: str | None = field(init=False)

    def __post_init__(self) -> None:
        self.numeric, self.latinize, self.integer, self.ascii, self.comparable, sound = _derived(self.form)
        self.metaphone = sound if self.phonetics else None

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Part) and (self.index, self.form) == (other.index, other.form)

    def __hash__(self) -> int:
        return hash((self.index, self.form))


@lru_cache(1 << 16)
def _derived(form: str) -> tuple:
    numeric = bool(form) and all(unicodedata.category(c)[0] == "N" for c in form)
    latinize = unicode.should_ascii(form)
    integer = None
    if numeric:
        value = unicode.string_number(form)
        integer = int(value) if value is not None and value == int(value) and abs(value) < 2**63 else None
        if form.isascii():
            integer = int(form) if int(form) < 2**63 else None
    if numeric:
        plain = None if integer is None else str(integer)
        return numeric, latinize, integer, plain, plain or form.lstrip("0") or "0", None
    plain = re.sub(r"[\W_]", "", unicode.maybe_ascii(form)) or None if latinize else None
    sound = phonetics.metaphone(plain) if plain and len(plain) > 2 and plain.isascii() else None
    return numeric, latinize, integer, plain, (plain or form) if latinize else form, sound


@dataclass
class Span:
    parts: list[Part]
    category: str
    id: str

    @property
    def comparable(self) -> str:
        return " ".join(p.comparable for p in self.parts)

    def __len__(self) -> int:
        return sum(len(p.form) for p in self.parts)


class Name:
    def __init__(self, original: str, form: str | None = None, tag: str = "UNK", phonetics: bool = True) -> None:
        self.original, self.form, self.tag = original, original.casefold() if form is None else form, tag
        self.parts = [Part(t, i, "UNSET", phonetics) for i, t in enumerate(normal.tokens(self.form))]
        self.spans: list[Span] = []

    @property
    def norm_form(self) -> str:
        return " ".join(p.form for p in self.parts)

    @property
    def comparable(self) -> str:
        return " ".join(p.comparable for p in self.parts)

    @property
    def symbols(self) -> set[tuple[str, str]]:
        return {(s.category, s.id) for s in self.spans}

    def _walks(self, tokens: Sequence[str]) -> Iterable[list[Part]]:
        """Runs of parts that spell the tokens in order; other parts may lie in between."""
        run: list[Part] = []
        for part in self.parts:
            if part.form == tokens[len(run)]:
                run.append(part)
            if len(run) == len(tokens):
                yield run
                run = []

    def tag_text(self, text: str, tag: str, max_matches: int = 1) -> None:
        tokens = normal.tokens(text)
        if not tokens:
            return
        for n, run in enumerate(self._walks(tokens), 1):
            for part in run:
                if part.tag == "UNSET":
                    part.tag = tag
                elif not can_match(part.tag, tag):
                    part.tag = "AMBIGUOUS"
            if n >= max_matches:
                return

    def apply_phrase(self, phrase: str, category: str, id: str) -> None:
        if not any((s.category, s.id) == (category, id) and " ".join(p.form for p in s.parts) == phrase for s in self.spans):
            self.spans += [Span(run, category, id) for run in self._walks(phrase.split(" "))]

    def apply_part(self, part: Part, category: str, id: str) -> None:
        if not any((s.category, s.id) == (category, id) and len(s.parts) == 1 and s.parts[0].index == part.index for s in self.spans):
            self.spans.append(Span([part], category, id))

    def contains(self, other: Name) -> bool:
        if self.form == other.form or self.tag == "UNK" or len(self.parts) < len(other.parts):
            return False
        if self.tag == "PER":
            theirs = [p.comparable for p in other.parts]
            common = len(bags.list_intersection([p.comparable for p in self.parts], theirs))
            common += sum(s.category == "INITIAL" and bool(s.parts) and len(s.parts[0].form) <= 1 and (s.category, s.id) in self.symbols for s in other.spans)
            if common == len(theirs):
                return True
        return other.norm_form in self.norm_form


def consolidate(names: Sequence[Name]) -> list[Name]:
    """Names that no other of them contains; one that is dropped drops no others after that."""
    kept = dict.fromkeys(range(len(names)))
    for i, a in enumerate(names):
        if i in kept:
            for j, b in enumerate(names):
                if i != j and a.contains(b):
                    kept.pop(j, None)
    return [names[i] for i in kept]


# Taggers


def _dictionary(entries: Iterable[tuple[str | None, str, str]]) -> Needles:
    table: dict[str, dict[tuple[str, str], None]] = {}
    for alias, category, id in entries:
        if alias and (key := normal.normalize(alias, TAGGER_FLAGS)):
            table.setdefault(key, {})[category, id] = None
    return Needles((k, tuple(v)) for k, v in table.items())


def _ordinals() -> Iterable[tuple[str, str, str]]:
    return ((f, "NUM", str(n)) for n, forms in refdata.ordinals().items() for f in forms)


def _symbols(kind: str, category: str) -> Iterable[tuple[str, str, str]]:
    return ((f, category, r["id"].upper()) for r in refdata.rows("symbols") if r["kind"] == kind for f in r["forms"])


@cache
def org_tagger() -> Needles:
    entries = [*_ordinals(), *_symbols("org_symbols", "SYMBOL"), *_symbols("org_domains", "DOMAIN")]
    for t in refdata.rows("territories"):
        entries += [(n, "LOC", t["code"]) for n in (t["name"], t["full_name"], *t["names_strong"])]
    for spec in refdata.rows("org_types"):
        if spec["generic"]:
            entries += [(a, "ORGCLS", spec["generic"]) for a in (spec["display"], spec["compare"], *spec["aliases"])]
    return _dictionary(entries)


def read_corpus(lines: Iterable[str]) -> list[tuple[tuple[str, ...], str]]:
    """Records of lines ``form, form => id``; those of fewer than two different forms are left out."""
    out = []
    for line in lines:
        forms, sep, id = line.strip().rpartition(" => ")
        keys = sorted({k for f in forms.split(", ") if (k := normal.normalize(f, TAGGER_FLAGS))})
        if sep and len(keys) > 1:
            out.append((tuple(keys), id))
    return out


@lru_cache(4)
def person_tagger(corpus: tuple[tuple[tuple[str, ...], str], ...] = ()) -> Needles:
    entries = [*_ordinals(), *_symbols("person_symbols", "SYMBOL"), *_symbols("person_name_parts", "NAME"), *_symbols("person_nick", "NICK")]
    return _dictionary([*entries, *((f, "NAME", id) for forms, id in corpus for f in forms)])


def tag(tagger: Needles, text: str) -> list[tuple[str, str, str]]:
    """Different (phrase, category, id) found in a normalised name."""
    return list(dict.fromkeys((text[a:b], *s) for a, b, symbols in tagger.overlapping(text) for s in symbols))


# Prefixes


@cache
def _prefix(name: str) -> re.Pattern:
    return re.compile(rf"^\W*((?:{'|'.join(map(re.escape, refdata.words(name)))})\.?\s+)*", re.I)


def remove_prefix(text: str, kind: str) -> str:
    return _prefix(f"{kind}_name_prefixes").sub("", text, count=1)


@cache
def _stopwords() -> frozenset[str]:
    return frozenset(k for w in refdata.words("stopwords") if (k := normal.normalize(w, normal.CASEFOLD | normal.NAME)))


def analyze(
    type_tag: str, names: Sequence[str | None], part_tags: Sequence[tuple[str, Sequence[str]]] = (), infer_initials: bool = False, symbols: bool = True, phonetics: bool = True, numerics: bool = True,
    consolidated: bool = True, rewrite: bool = True, corpus: tuple = (),
) -> list[Name]:
    """The different names of an entity, with tagged parts and symbols, in order of first appearance."""
    built: dict[str, Name] = {}
    for raw in names:
        if raw is None:
            continue
        working = remove_prefix(raw, "person") if rewrite and type_tag == "PER" else raw
        form = working.casefold()
        if rewrite and type_tag in ("ORG", "ENT"):
            form = remove_prefix(org_types.replace_compare(form, normal.CASEFOLD), "org")
        elif rewrite and type_tag == "OBJ":
            form = remove_prefix(form, "obj")
        if not form or form in built:
            continue
        name = built[form] = Name(working, form, type_tag, phonetics)
        for label, values in part_tags:
            for value in values:
                name.tag_text(value.casefold(), label)
        if symbols:
            _apply_symbols(name, infer_initials, corpus)
        _infer_tags(name, symbols and numerics)
    return consolidate(list(built.values())) if consolidated else list(built.values())


def _apply_symbols(name: Name, infer_initials: bool, corpus: tuple) -> None:
    text = name.norm_form
    if name.tag == "PER":
        for part in name.parts:
            if part.latinize and part.comparable and (infer_initials and len(part.form) == 1 or part.tag in _INITIAL):
                name.apply_part(part, "INITIAL", part.comparable[0])
    if name.tag in ("ORG", "ENT"):
        for hit in tag(org_tagger(), text):
            name.apply_phrase(*hit)
        if name.tag == "ENT" and any(s.category == "ORGCLS" and len(s) >= 3 for s in name.spans):
            name.tag = "ORG"
            return
    if name.tag in ("PER", "ENT"):
        for hit in tag(person_tagger(corpus), text):
            name.apply_phrase(*hit)


def _infer_tags(name: Name, numerics: bool) -> None:
    counted = {p.index for s in name.spans if s.category == "NUM" for p in s.parts}
    for s in name.spans:
        if s.category == "ORGCLS":
            for p in s.parts:
                if p.tag == "UNSET":
                    p.tag = "LEGAL"
    for p in name.parts:
        if p.tag != "UNSET":
            continue
        if p.numeric:
            p.tag = "NUM"
            if numerics and p.index not in counted and p.integer is not None:
                name.apply_part(p, "NUM", str(p.integer))
        elif p.form in _stopwords():
            p.tag = "STOP"


# Evidence for pairs


@dataclass(frozen=True)
class CompareConfig:
    cost_sep_drop: float = 0.2
    cost_confusable: float = 0.7
    cost_digit: float = 1.5
    budget_log_base: float = 2.35
    budget_short_floor: float = 2.0
    budget_tolerance: float = 1.0
    cluster_overlap_min: float = 0.51


@dataclass
class Alignment:
    qps: list[Part]
    rps: list[Part]
    symbol: tuple[str, str] | None = None
    score: float = 0.0
    weight: float = 1.0

    @property
    def qstr(self) -> str:
        return " ".join(p.comparable for p in self.qps)

    @property
    def rstr(self) -> str:
        return " ".join(p.comparable for p in self.rps)


@cache
def _confusable() -> frozenset[tuple[str, str]]:
    return frozenset((r["a"], r["b"]) for r in refdata.rows("confusable"))


def _numeric(c: str | None) -> bool:
    return c is not None and unicodedata.category(c)[0] == "N"


def edit_cost(cfg: CompareConfig, q: str | None, r: str | None) -> float:
    """Of replacing, dropping (no ``r``) or adding (no ``q``) a character."""
    if (q == " " and r is None) or (r == " " and q is None):
        return cfg.cost_sep_drop
    if (q, r) in _confusable():
        return cfg.cost_confusable
    return cfg.cost_digit if _numeric(q) or _numeric(r) else 1.0


def _steps(cfg: CompareConfig, q: str, r: str) -> list[tuple[str | None, str | None, float]]:
    """The cheapest edits, as (character, character, cost). Of equally cheap last steps an insertion is taken
    before a deletion, that before keeping, and replacing comes last."""
    drop = {c: edit_cost(cfg, c, None) for c in set(q)}
    add = {c: edit_cost(cfg, None, c) for c in set(r)}
    swap = {(a, b): edit_cost(cfg, a, b) for a in set(q) for b in set(r)}
    above = [0.0]
    for c in r:
        above.append(above[-1] + add[c])
    moves = ["I" * (len(r) + 1)]
    for a in q:
        row, line = [above[0] + drop[a]], ["D"]
        for j, b in enumerate(r):
            best, move = above[j] + swap[a, b], "S"
            if a == b and above[j] <= best:
                best, move = above[j], "M"
            if (cost := above[j + 1] + drop[a]) <= best:
                best, move = cost, "D"
            if (cost := row[j] + add[b]) <= best:
                best, move = cost, "I"
            row.append(best)
            line.append(move)
        above = row
        moves.append("".join(line))
    out, i, j = [], len(q), len(r)
    while i or j:
        move = moves[i][j]
        if move == "I":
            j -= 1
            out.append((None, r[j], add[r[j]]))
        elif move == "D":
            i -= 1
            out.append((q[i], None, drop[q[i]]))
        else:
            i, j = i - 1, j - 1
            out.append((q[i], r[j], 0.0 if move == "M" else swap[q[i], r[j]]))
    return out[::-1]


def _side(cfg: CompareConfig, costs: Sequence[float]) -> float:
    total = sum(costs)
    if not costs:
        return 0.0
    if total == 0:
        return 1.0
    budget = math.log(max(len(costs) - cfg.budget_short_floor, 1.0), cfg.budget_log_base) * cfg.budget_tolerance
    return 0.0 if total > budget else 1 - total / len(costs)


def compare_parts(qry: Sequence[Part], res: Sequence[Part], cfg: CompareConfig = CompareConfig()) -> list[Alignment]:
    """Alignments in which every part of either side appears once; unmatched parts come last, alone."""
    costs_q: list[list[float]] = [[] for _ in qry]
    costs_r: list[list[float]] = [[] for _ in res]
    overlap: Counter[tuple[int, int]] = Counter()
    if qry and res:
        at_q = at_r = 0
        for q, r, cost in _steps(cfg, " ".join(p.comparable for p in qry)[:MAX_LENGTH], " ".join(p.comparable for p in res)[:MAX_LENGTH]):
            if q is not None and q == r and q != " ":
                overlap[at_q, at_r] += 1
            if q is not None:
                costs_q[at_q].append(cost)
                at_q += q == " " and at_q + 1 < len(qry)
            if r is not None:
                costs_r[at_r].append(cost)
                at_r += r == " " and at_r + 1 < len(res)
    clusters: list[tuple[list[int], list[int]]] = []
    of_q: dict[int, int] = {}
    of_r: dict[int, int] = {}
    for (q, r), n in sorted(overlap.items()):
        shorter = min(len(qry[q].comparable), len(res[r].comparable))
        if not shorter or n / shorter <= cfg.cluster_overlap_min:
            continue
        k = of_q.get(q, of_r.get(r))
        if k is None:
            k = len(clusters)
            clusters.append(([], []))
        for side, index in zip(clusters[k], (q, r)):
            if index not in side:
                side.append(index)
        of_q[q] = of_r[r] = k
    clusters += [([q], []) for q in range(len(qry)) if q not in of_q] + [([], [r]) for r in range(len(res)) if r not in of_r]

    def score(qs: list[int], rs: list[int]) -> float:
        if not qs or not rs:
            return 0.0
        return _side(cfg, [c for q in qs for c in costs_q[q] or [1.0]]) * _side(cfg, [c for r in rs for c in costs_r[r] or [1.0]])

    return [Alignment([qry[q] for q in qs], [res[r] for r in rs], None, score(qs, rs)) for qs, rs in clusters]


def _likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    a, b = a[:MAX_LENGTH], b[:MAX_LENGTH]
    longest = max(len(a), len(b))
    d = damerau(a, b)
    s = 1 - d / longest
    return 0.0 if d > longest * 7 // 10 or s < 0.3 else s


def align_person_name_order(left: Sequence[Part], right: Sequence[Part]) -> tuple[list[Part], list[Part]]:
    """Both sides put in an order in which their best-matching parts stand at the same places."""
    if not left:
        return [], tag_sort(right)

    def joined(parts: Sequence[Part]) -> str:
        return "".join(p.comparable for p in parts)

    def packed(anchor: Part, seed: Part, options: Sequence[Part]) -> list[Part]:
        """Short parts that together spell a longer one."""
        pack = [seed]
        for option in options:
            if option in pack or not can_match(anchor.tag, option.tag):
                continue
            if len(joined(pack)) >= len(anchor.form):
                break
            best, chosen = _likeness(anchor.comparable, joined(pack)), pack
            for i in range(len(pack) + 1):
                trial = [*pack[:i], option, *pack[i:]]
                if (s := _likeness(anchor.comparable, joined(trial))) > best:
                    best, chosen = s, trial
            pack = chosen
        return pack

    rest_l, rest_r = (sorted(side, key=lambda p: -len(p.form)) for side in (left, right))
    out_l: list[Part] = []
    out_r: list[Part] = []

    def best_pair() -> tuple[float, list[Part], list[Part]]:
        top: tuple[float, list[Part], list[Part]] = (0.0, [], [])
        for a, b in product(rest_l, rest_r):
            if not can_match(a.tag, b.tag):
                continue
            if a.comparable == b.comparable:
                return 1.0, [a], [b]
            s = _likeness(a.comparable, b.comparable)
            if s <= top[0]:
                continue
            mine, theirs = [a], [b]
            if len(a.form) > len(b.form):
                theirs = packed(a, b, [p for p in rest_r if p is not b])
            elif len(b.form) > len(a.form):
                mine = packed(b, a, [p for p in rest_l if p is not a])
            s = _likeness(joined(mine), joined(theirs))
            if s > top[0]:
                top = s, mine, theirs
        return top

    while rest_l and rest_r:
        s, mine, theirs = best_pair()
        if not s:
            break
        rest_l = [p for p in rest_l if p not in mine]
        rest_r = [p for p in rest_r if p not in theirs]
        out_l += mine
        out_r += theirs
    if not out_l:
        return tag_sort(left), tag_sort(right)
    return out_l + rest_l, out_r + rest_r


MAX_EDGES, MAX_PAIRINGS, MAX_ALTERNATIVES, SEARCH_BUDGET = 64, 32, 8, 4096


@dataclass(frozen=True, order=True)
class _Edge:
    q: int
    r: int
    category: int
    id: str


def _mask(span: Span) -> int:
    return sum(1 << i for i in {p.index for p in span.parts})


def _pairable(a: Span, b: Span) -> bool:
    if a.category == "INITIAL":
        return not (len(a.parts[0].form) > 1 and len(b.parts[0].form) > 1)
    if a.category in ("NAME", "NICK"):
        return all(can_match(x.tag, y.tag) for x in a.parts for y in b.parts)
    return True


def _edges(query: Name, result: Name) -> list[_Edge]:
    sides = []
    for name in (query, result):
        spans: dict[tuple[str, str], list[Span]] = defaultdict(list)
        for s in sorted(name.spans, key=lambda s: min(p.index for p in s.parts)):
            spans[s.category, s.id].append(s)
        sides.append({k: sorted(v, key=lambda s: -_mask(s).bit_count()) for k, v in spans.items()})
    found = []
    for symbol in sides[0].keys() & sides[1].keys():
        free = list(sides[1][symbol])
        for a in sides[0][symbol]:
            b = next((b for b in free if _pairable(a, b)), None)
            if b is not None:
                free = [x for x in free if x is not b]
                found.append(_Edge(_mask(a), _mask(b), CATEGORIES.index(symbol[0]), symbol[1]))
    # An edge strictly within another of its category adds nothing.
    inside = lambda e, o: e.category == o.category and e.q != o.q and e.r != o.r and e.q | o.q == o.q and e.r | o.r == o.r
    found = [e for e in found if not any(inside(e, o) for o in found)]
    least: dict[tuple[int, int, int], _Edge] = {}
    for e in sorted(found):
        least.setdefault((e.q, e.r, e.category), e)
    chosen = list(least.values())
    if len(chosen) > MAX_EDGES:
        chosen = sorted(chosen, key=lambda e: (-(e.q.bit_count() + e.r.bit_count()), e))[:MAX_EDGES]
    return sorted(chosen)


def _bits(mask: int) -> list[int]:
    return [i for i in range(mask.bit_length()) if mask >> i & 1]


def _cover(edges: list[_Edge], chosen: int) -> tuple[int, int, tuple[int, ...]]:
    q = r = 0
    for i in _bits(chosen):
        q |= edges[i].q
        r |= edges[i].r
    return q, r, tuple(sorted(edges[i].category for i in _bits(chosen)))


def _maximal(edges: list[_Edge], compatible: list[int], members: int) -> list[int]:
    """Maximal sets of edges of a component that exclude each other nowhere, best coverage first."""
    if members.bit_count() == 1:
        return [members]
    sets: list[int] = []
    steps = 0

    def grow(r: int, p: int, x: int) -> bool:
        nonlocal steps
        steps += 1
        if steps > SEARCH_BUDGET:
            return False
        if not p and not x:
            sets.append(r)
            return True
        pivot = max(_bits(p | x), key=lambda u: (p & compatible[u] & members).bit_count())
        for v in _bits(p & ~(compatible[pivot] & members)):
            near = compatible[v] & members
            if not grow(r | 1 << v, p & near, x & near):
                return False
            p &= ~(1 << v)
            x |= 1 << v
        return True

    if not grow(0, members, 0):
        q = r = taken = 0
        for i in _bits(members):
            if not edges[i].q & q and not edges[i].r & r:
                taken, q, r = taken | 1 << i, q | edges[i].q, r | edges[i].r
        return [taken]
    ranked = sorted((-(c[0].bit_count() + c[1].bit_count()), *c, s) for s in sets for c in [_cover(edges, s)])
    return list({k[1:4]: k[4] for k in reversed(ranked)}.values())[::-1][:MAX_ALTERNATIVES]


def pair_symbols(query: Name, result: Name) -> list[list[Alignment]]:
    """Sets of alignments by shared symbols that cover most and don't conflict; one empty set when nothing is shared."""
    if max(len(query.parts), len(result.parts)) > MAX_PARTS or not query.spans or not result.spans:
        return [[]]
    edges = _edges(query, result)
    if not edges:
        return [[]]
    n = len(edges)
    compatible = [sum(1 << j for j in range(n) if j != i and not edges[i].q & edges[j].q and not edges[i].r & edges[j].r) for i in range(n)]
    alternatives, seen = [], 0
    for start in range(n):
        if seen >> start & 1:
            continue
        members, fresh = 1 << start, 1 << start
        while fresh:
            reach = 0
            for v in _bits(fresh):
                reach |= ((1 << n) - 1) & ~compatible[v] & ~(1 << v)
            fresh = reach & ~members
            members |= fresh
        seen |= members
        alternatives.append(_maximal(edges, compatible, members))
    pairings: dict[tuple, int] = {}
    for step, parts in enumerate(product(*alternatives)):
        if step >= SEARCH_BUDGET or len(pairings) >= MAX_PAIRINGS:
            break
        chosen = sum(parts)
        pairings.setdefault(_cover(edges, chosen), chosen)
    pick = lambda name, mask: [name.parts[i] for i in _bits(mask)]
    return [[Alignment(pick(query, edges[i].q), pick(result, edges[i].r), (CATEGORIES[edges[i].category], edges[i].id), 1.0) for i in _bits(s)] for s in pairings.values()]
