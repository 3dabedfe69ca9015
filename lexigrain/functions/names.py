"""Name predicates, prefixes, legal forms, parts and bag choices as Columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrain import refdata
from lexigrain.functions import text as T
from lexigrain.kernels import bags, names, normal, org_types
from lexigrain.kernels.udf import ColumnLike, col, kernel

# JVM-side


def _quoted(words: list[str]) -> str:
    return "|".join(r"\Q" + w + r"\E" for w in words)


def _remove_prefixes(c: ColumnLike, kind: str) -> Column:
    return F.regexp_replace(col(c), rf"(?iU)^\W*((?:{_quoted(refdata.words(f'{kind}_name_prefixes'))})\.?\s+)*", "")


def remove_person_prefixes(c: ColumnLike) -> Column:
    return _remove_prefixes(c, "person")


def remove_org_prefixes(c: ColumnLike) -> Column:
    return _remove_prefixes(c, "org")


def remove_obj_prefixes(c: ColumnLike) -> Column:
    return _remove_prefixes(c, "obj")


def contains_split_phrase(c: ColumnLike) -> Column:
    return col(c).rlike(rf"(?iU)\b({_quoted(refdata.words('name_split_phrases'))})\b")


def is_name(c: ColumnLike) -> Column:
    return col(c).rlike(r"\p{L}")


def is_generic_person_name(c: ColumnLike, normalizer: Callable = T.normalize_name, normalize: bool = False) -> Column:
    return T.member(col(c), refdata.words("generic_person_names"), normalizer, normalize)


def is_stopword(c: ColumnLike, normalize: bool = False) -> Column:
    return T.is_stopword(c, T.normalize_name, normalize)


def is_nullword(c: ColumnLike, normalize: bool = False) -> Column:
    return T.is_nullword(c, T.normalize_name, normalize)


def case_error_score(c: ColumnLike) -> Column:
    """Mistakes in letter case per character."""
    c = col(c)
    inner = r"(?<=\p{IsAlphabetic})\p{IsUppercase}"
    start = r"(?<!\p{IsAlphabetic})[\p{IsAlphabetic}&&[^\p{IsUppercase}]]"
    n = F.length(c)
    return F.when(n == 0, 0.0).otherwise((n + 2 * F.regexp_count(c, F.lit(start)) + F.regexp_count(c, F.lit(inner))) / n)


def latin_share(c: ColumnLike) -> Column:
    c = col(c)
    count = lambda p: F.regexp_count(c, F.lit(p))
    letters = count(r"\p{IsAlphabetic}")
    score = count(r"[\p{IsAlphabetic}&&\p{IsLatin}]") + 0.3 * count(r"[\p{IsAlphabetic}&&[\p{IsCyrillic}\p{IsGreek}]]")
    return F.when(letters == 0, 0.0).otherwise(score / letters)


def tag_can_match(a: ColumnLike, b: ColumnLike) -> Column:
    """Whether name parts of these tags may stand for each other: a table of the tags, as a literal."""
    tags = sorted({*names.TAG_ORDER, "STOP"})
    allowed = F.array(*[F.lit(f"{x} {y}") for x in tags for y in tags if names.can_match(x, y)])
    return F.array_contains(allowed, F.concat_ws(" ", col(a), col(b)))


def list_intersection(a: ColumnLike, b: ColumnLike) -> Column:
    """Multiset intersection in the order of the first array."""
    a, b = col(a), col(b)
    equal = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.filter(a, lambda x, i: equal(F.slice(a, 1, i + 1), x) <= equal(b, x))


# Kernels over distinct values


def replace_org_types_compare(c: ColumnLike, flags: int = normal.CASEFOLD, cleanup: int = 0, generic: bool = False) -> Column:
    return kernel(lambda x: org_types.replace_compare(x, flags, cleanup, generic), "string", c)


def replace_org_types_display(c: ColumnLike, flags: int = normal.CASEFOLD | normal.SQUASH, cleanup: int = 0) -> Column:
    return kernel(lambda x: org_types.replace_display(x, flags, cleanup), "string", c)


def remove_org_types(c: ColumnLike, replacement: str = "", flags: int = normal.CASEFOLD, cleanup: int = 0) -> Column:
    return kernel(lambda x: org_types.remove(x, replacement, flags, cleanup), "string", c)


def extract_org_types(c: ColumnLike, flags: int = normal.CASEFOLD, cleanup: int = 0, generic: bool = False) -> Column:
    """array<struct<matched, target>>; ``explode`` gives rows."""
    found = lambda x: [{"matched": m, "target": t} for m, t in org_types.extract(x, flags, cleanup, generic)]
    return kernel(found, "array<struct<matched:string,target:string>>", c)


PART = "struct<index:int,form:string,tag:string,latinize:boolean,numeric:boolean,ascii:string,integer:bigint,comparable:string,metaphone:string>"
SPAN = "struct<part_idx:array<int>,category:string,id:string,comparable:string>"
NAME = f"struct<original:string,form:string,tag:string,norm_form:string,comparable:string,parts:array<{PART}>,spans:array<{SPAN}>>"


def part_record(p: names.Part) -> dict:
    return {k: getattr(p, k) for k in ("index", "form", "tag", "latinize", "numeric", "ascii", "integer", "comparable", "metaphone")}


def name_record(n: names.Name) -> dict:
    spans = [{"part_idx": [p.index for p in s.parts], "category": s.category, "id": s.id, "comparable": s.comparable} for s in n.spans]
    return {"original": n.original, "form": n.form, "tag": n.tag, "norm_form": n.norm_form, "comparable": n.comparable, "parts": list(map(part_record, n.parts)), "spans": spans}


def name_from(record: dict) -> names.Name:
    """A name of its record."""
    out = names.Name(record["original"], record["form"], record["tag"])
    for p, r in zip(out.parts, record["parts"]):
        p.tag = r["tag"]
    out.spans = [names.Span([out.parts[i] for i in s["part_idx"]], s["category"], s["id"]) for s in record["spans"]]
    return out


def name_part(c: ColumnLike) -> Column:
    """The derived fields of a token."""
    return F.get(kernel(lambda x: [part_record(names.Part(x))], f"array<{PART}>", c), 0)


def name_object(c: ColumnLike, tag: str = "UNK") -> Column:
    return F.get(kernel(lambda x: [name_record(names.Name(x, tag=tag))], f"array<{NAME}>", c), 0)


def name_contains(a: ColumnLike, b: ColumnLike, tag: str = "ORG") -> Column:
    """Whether a name contains another of its kind: by substring, or a person's by its words in any order. Kernel."""
    return kernel(lambda x, y: names.Name(x, tag=tag).contains(names.Name(y, tag=tag)), "boolean", a, b)


def tag_order(c: ColumnLike) -> Column:
    """Where a tag stands among the parts of a sorted name, as a literal table; array_sort by it sorts parts."""
    table = F.create_map(*[F.lit(x) for t in (*names.TAG_ORDER, "STOP") for x in (t, names.tag_rank(t))])
    return F.element_at(table, col(c))


def tag_phrases(c: ColumnLike, kind: str = "org") -> Column:
    """array<struct<phrase, category, id>> that a tagger finds in a normalised name."""
    tagger = names.org_tagger if kind == "org" else names.person_tagger
    found = lambda x: [dict(zip(("phrase", "category", "id"), hit)) for hit in names.tag(tagger(), x)]
    return kernel(found, "array<struct<phrase:string,category:string,id:string>>", c)


# Bags: arrays of the names of one entity


def _bag(function: Callable, returns: str, c: ColumnLike) -> Column:
    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else function([x for x in v if x is not None]) for v in values], dtype=object)

    return run(col(c))


def pick_name(c: ColumnLike) -> Column:
    return _bag(bags.pick_name, "string", c)


def pick_case(c: ColumnLike) -> Column:
    """JVM-side: least case errors, then shortest, then first."""
    ranked = F.array_sort(F.transform(col(c), lambda n: F.struct(case_error_score(n).alias("e"), F.length(n).alias("n"), n.alias("name"))))
    return F.get(ranked, 0)["name"]


def reduce_names(c: ColumnLike) -> Column:
    return _bag(bags.reduce_names, "array<string>", c)


def representative_names(c: ColumnLike, limit: int, cluster_threshold: float = 0.3) -> Column:
    return _bag(lambda v: bags.representative_names(v, limit, cluster_threshold), "array<string>", c)


def pick_lang_name(c: ColumnLike, preferred: str = "eng", order: list[str] | None = None) -> Column:
    """Of an array of (text, lang) structs."""
    from lexigrain.functions.misc import PREFERRED_LIST

    return _bag(lambda v: bags.pick_lang_name([(x["text"], x["lang"]) for x in v], preferred, order or PREFERRED_LIST), "string", c)
