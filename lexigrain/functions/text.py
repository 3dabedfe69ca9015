"""Text normalisation, cleaning, scripts, distances and phonetics as Columns.

Everything is JVM-side except where a docstring says kernel. Case folding and normal forms call ICU
through ``java_method``, which is exact for all of Unicode; ``lower`` isn't.
"""

from __future__ import annotations

from collections.abc import Callable
from enum import IntEnum, IntFlag
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lexigrain import refdata
from lexigrain.kernels import distance, phonetics, unicode
from lexigrain.kernels.needles import Needles
from lexigrain.kernels.udf import ColumnLike, col, kernel

MAX_NAME_LENGTH = 384
MAX_EDITS = 4
MAX_PERCENT = 0.2


class Normalize(IntFlag):
    STRIP = 1
    SQUASH_SPACES = 2
    CASEFOLD = 4
    NFC = 8
    NFKC = 16
    NFKD = 32
    NAME = 64


class Cleanup(IntEnum):
    Noop = 0
    Strong = 1
    Slug = 2


_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_INVISIBLE = r"[\x{200b}-\x{200d}\x{feff}\x{ad}\x{2060}-\x{2064}]"
_SEPARATORS = r"\p{Z}\p{Pc}\p{Pd}\p{Ps}\p{Pe}\p{Pi}\p{Pf}\p{Po}\p{Sm}\p{So}"
_DROPPED = r"\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Me}\p{No}\p{Sc}\p{Sk}"
_KEPT_MARKS = r"\x{30fc}\x{ff70}\x{3005}"
_SKIPPED = r"[.'\x{2018}\x{2019}\x{2bc}\x{2b9}`\x{b4}]"


def _sub(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: ColumnLike) -> Column:
    """Unicode trim."""
    return _sub(col(c), r"(?U)^\s+|\s+$")


def casefold(c: ColumnLike) -> Column:
    """Full Unicode case folding; ASCII text takes the codegen path."""
    c = col(c)
    return F.when(c.rlike(r"^\p{ASCII}*$"), F.lower(c)).when(c.isNotNull(), F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True)))


def normal_form(c: ColumnLike, form: str) -> Column:
    """NFC, NFKC, NFD or NFKD."""
    c = col(c)
    done = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose" if form.endswith("C") else "decompose"), c, F.lit("K" in form))
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).when(c.isNotNull(), done)


def squash_spaces(c: ColumnLike) -> Column:
    """Drops invisible characters, makes runs of white space one space, and trims."""
    return F.trim(_sub(_sub(col(c), _INVISIBLE), _SPACE + "+", " "))


def category_replace(c: ColumnLike, cleanup: Cleanup) -> Column:
    c = col(c)
    if cleanup == Cleanup.Strong:
        return _sub(_sub(c, rf"[{_DROPPED}\p{{Lm}}\p{{Mn}}]"), rf"[\p{{Cc}}\p{{Mc}}{_SEPARATORS}]", " ")
    if cleanup == Cleanup.Slug:
        return _sub(_sub(c, rf"[{_DROPPED}\p{{Cc}}]"), rf"[\p{{Mc}}{_SEPARATORS}]", " ")
    return c


def tokenize_name(c: ColumnLike, min_length: int = 1) -> Column:
    """Tokens of a name."""
    c = _sub(col(c), _SKIPPED)
    c = _sub(c, rf"[\p{{Cf}}\p{{Co}}\p{{Cn}}\p{{Mn}}\p{{Me}}\p{{No}}\p{{Sc}}\p{{Sk}}[\p{{Lm}}&&[^{_KEPT_MARKS}]]]")
    c = _sub(c, rf"[\p{{Cc}}{_SEPARATORS}]", " ")
    return F.filter(F.split(c, " +"), lambda t: F.length(t) >= max(min_length, 1))


def normalize(c: ColumnLike, flags: int = 0, cleanup: int = 0) -> Column:
    """The flags' steps in their fixed order; an empty result is null."""
    c, flags = col(c), Normalize(flags)
    if Normalize.STRIP in flags:
        c = strip(c)
    for flag, form in ((Normalize.NFKD, "NFKD"), (Normalize.NFKC, "NFKC"), (Normalize.NFC, "NFC")):
        if flag in flags:
            c = normal_form(c, form)
            break
    if Normalize.CASEFOLD in flags:
        c = casefold(c)
    c = category_replace(c, Cleanup(cleanup))
    if Normalize.SQUASH_SPACES in flags:
        c = squash_spaces(c)
    if Normalize.NAME in flags:
        c = F.array_join(tokenize_name(c), " ")
    return empty_to_null(c)


def noop_normalizer(c: ColumnLike) -> Column:
    return empty_to_null(strip(c))


def normalize_text(c: ColumnLike) -> Column:
    return normalize(c, Normalize.CASEFOLD | Normalize.SQUASH_SPACES, Cleanup.Slug)


def normalize_name(c: ColumnLike) -> Column:
    return normalize(c, Normalize.CASEFOLD | Normalize.NAME)


_EMOJI = r"[\x{1f600}-\x{1f67f}\x{fe0e}\x{fe0f}\x{2190}-\x{21ff}\x{2200}-\x{22ff}\x{2300}-\x{245f}\x{2500}-\x{27bf}\x{2a00}-\x{2bff}\x{1f000}-\x{1f0ff}\x{1f1e0}-\x{1f1ff}\x{1f300}-\x{1f5ff}\x{1f680}-\x{1f7ff}\x{1f900}-\x{1f9ff}\x{1cf00}-\x{1cfcf}\x{1d000}-\x{1d24f}\x{1fb00}-\x{1fbff}\x{1bc00}-\x{1bc9f}\x{fff0}-\x{ffff}]+"


def remove_emoji(c: ColumnLike) -> Column:
    return _sub(col(c), _EMOJI)


def remove_bracketed_text(c: ColumnLike) -> Column:
    """Innermost bracketed groups become a space; one pass."""
    return _sub(col(c), r"\([^()]*\)|\[[^\[\]]*\]|\x{ff08}[^()]*\x{ff09}", " ")


def text_hash(c: ColumnLike) -> Column:
    """SHA-1 of the letters and digits of the lower-cased NFKD form."""
    c = _sub(F.lower(col(c)), r"[\p{Cs}\p{Co}\p{Cn}\p{Cf}]")
    return F.sha1(_sub(normal_form(c, "NFKD"), r"[^\p{L}\p{N}]"))


Normalizer = Callable[[ColumnLike], Column]


@lru_cache(64)
def _prepared(words: tuple[str, ...], normalizer: Normalizer) -> tuple[str, ...]:
    """The normal forms of a list's words, found by a small query of their own. The optimizer can't fold them all, as folding of
    what isn't ASCII counts as undetermined: in the list they would be normalized again for every row."""
    listed = SparkSession.builder.getOrCreate().range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, words))).alias("word"))
    return tuple(dict.fromkeys(r[0] for r in listed.select(normalizer(F.col("word"))).collect() if r[0] is not None))


def member(c: Column, words: list[str], normalizer: Normalizer, normalize: bool, plain: bool = False) -> Column:
    """Membership in a list that goes through the normalizer, too, once."""
    prepared = _prepared(tuple(words), noop_normalizer if plain else normalizer)
    return F.coalesce((normalizer(c) if normalize else c).isin(*prepared), F.lit(False))


def is_stopword(c: ColumnLike, normalizer: Normalizer = normalize_text, normalize: bool = False) -> Column:
    return member(col(c), refdata.words("stopwords"), normalizer, normalize)


def is_nullword(c: ColumnLike, normalizer: Normalizer = normalize_text, normalize: bool = False) -> Column:
    """Without ``normalize`` the list is only stripped."""
    return member(col(c), refdata.words("nullwords"), normalizer, normalize, plain=not normalize)


def is_nullplace(c: ColumnLike, normalizer: Normalizer = normalize_text, normalize: bool = False) -> Column:
    return member(col(c), refdata.words("nullplaces"), normalizer, normalize)


# Scripts


def codepoint_script(c: ColumnLike) -> Column:
    """Script of a code point; null for unassigned ones and surrogates. Kernel."""
    return kernel(unicode.codepoint_script, "string", col(c).cast("int"))


def text_scripts(c: ColumnLike) -> Column:
    """Sorted real scripts of the letters and numbers. Kernel."""
    return kernel(unicode.text_scripts, "array<string>", c)


def common_scripts(a: ColumnLike, b: ColumnLike) -> Column:
    return F.array_intersect(text_scripts(a), text_scripts(b))


def _only(c: Column, scripts: tuple[str, ...]) -> Column:
    allowed = "".join(rf"\p{{Is{s}}}" for s in (*scripts, "Common", "Inherited"))
    return ~c.rlike(rf"[[\p{{L}}\p{{N}}]&&[^{allowed}]]")


def can_latinize(c: ColumnLike) -> Column:
    return _only(col(c), unicode.LATINIZED)


should_ascii = can_latinize


def is_modern_alphabet(c: ColumnLike) -> Column:
    return _only(col(c), ("Latin", "Greek", "Armenian", "Cyrillic", "Georgian"))


def is_latin(c: ColumnLike) -> Column:
    return _only(col(c), ("Latin",))


def is_dense_script(c: ColumnLike) -> Column:
    return col(c).rlike(r"[[\p{L}\p{N}]&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]]")


def maybe_ascii(c: ColumnLike, drop: bool = False) -> Column:
    """Transliteration of the six scripts to ASCII; other text stays, or is dropped. Kernel for text that isn't ASCII."""
    c = col(c)
    wide = F.when(~c.rlike(r"^\p{ASCII}*$"), c)
    return F.coalesce(kernel(unicode.drop_or_ascii if drop else unicode.maybe_ascii, "string", wide), c)


def string_number(c: ColumnLike) -> Column:
    """The number that a text of digits or numerals stands for. Kernel."""
    return kernel(unicode.string_number, "double", c)


# Distances


def raw_levenshtein(a: ColumnLike, b: ColumnLike) -> Column:
    return F.levenshtein(col(a), col(b))


def raw_levenshtein_cutoff(a: ColumnLike, b: ColumnLike, most: int | Column) -> Column:
    """The distance, or ``most + 1`` above it."""
    if isinstance(most, int):
        d = F.levenshtein(col(a), col(b), most)
        return F.when(d < 0, most + 1).otherwise(d)
    d = F.levenshtein(col(a), col(b))
    return F.least(d, most + 1)


def levenshtein(a: ColumnLike, b: ColumnLike, max_length: int = MAX_NAME_LENGTH, max_edits: int | Column | None = None) -> Column:
    a, b = col(a), col(b)
    x, y = F.substring(a, 1, max_length), F.substring(b, 1, max_length)
    return F.when(a == b, F.lit(0)).otherwise(raw_levenshtein(x, y) if max_edits is None else raw_levenshtein_cutoff(x, y, max_edits))


def _budget(shorter: Column, max_edits: int | None, max_percent: float) -> Column:
    share = F.ceil(shorter * F.lit(max_percent)).cast("int")
    return share if max_edits is None else F.least(F.lit(max_edits), share)


def levenshtein_similarity(a: ColumnLike, b: ColumnLike, max_edits: int | None = MAX_EDITS, max_percent: float = MAX_PERCENT, max_length: int = MAX_NAME_LENGTH) -> Column:
    a, b = col(a), col(b)
    n, m = F.length(a), F.length(b)
    budget = _budget(F.least(n, m), max_edits, max_percent)
    d = levenshtein(a, b, max_length, budget)
    return F.when((n == 0) | (m == 0) | (F.abs(n - m) > budget), 0.0).when(d > budget, 0.0).otherwise(1.0 - d / F.greatest(n, m))


def is_levenshtein_plausible(a: ColumnLike, b: ColumnLike, max_edits: int | None = MAX_EDITS, max_percent: float = MAX_PERCENT, max_length: int = MAX_NAME_LENGTH) -> Column:
    a, b = F.substring(col(a), 1, max_length), F.substring(col(b), 1, max_length)
    budget = _budget(F.least(F.length(a), F.length(b)), max_edits, max_percent)
    return levenshtein(a, b, max_length, budget) <= budget


def raw_jaro(a: ColumnLike, b: ColumnLike) -> Column:
    """Kernel."""
    return kernel(distance.jaro, "double", a, b)


def raw_jaro_winkler(a: ColumnLike, b: ColumnLike) -> Column:
    """Kernel."""
    return kernel(distance.jaro_winkler, "double", a, b)


def jaro_winkler(a: ColumnLike, b: ColumnLike, max_length: int = MAX_NAME_LENGTH) -> Column:
    """Similarity, 0 up to 0.6. Kernel."""
    s = raw_jaro_winkler(F.substring(col(a), 1, max_length), F.substring(col(b), 1, max_length))
    return F.when(s > 0.6, s).otherwise(F.when(s.isNotNull(), 0.0))


def damerau_levenshtein_cutoff(a: ColumnLike, b: ColumnLike, most: int) -> Column:
    """Unrestricted edit distance with swaps, or ``most + 1`` above it. Kernel."""
    return F.least(kernel(distance.damerau, "int", a, b), F.lit(most + 1))


def metaphone(c: ColumnLike) -> Column:
    """Empty for text that isn't ASCII. Kernel."""
    return kernel(phonetics.metaphone, "string", c)


def soundex(c: ColumnLike) -> Column:
    """Empty for text that isn't ASCII or has no letter."""
    c = col(c)
    letters = _sub(c, "[^A-Za-z]")
    return F.when(c.isNull(), None).when(c.rlike(r"^\p{ASCII}*$") & (letters != ""), F.soundex(letters)).otherwise("")


def find_needles(c: ColumnLike, needles: dict[str, str], overlapping: bool = False) -> Column:
    """array<struct<begin, end, payload>> of the phrases of a dictionary in a text: from the left and without overlaps, the
    longest at each place, or all of them. A hit touches no word character on either side. Kernel; one automaton a worker."""
    entries = tuple(needles.items())

    def found(text: str) -> list[dict]:
        machine = _machine(entries)
        hits = machine.overlapping(text) if overlapping else machine.found(text)
        return [{"begin": a, "end": b, "payload": x} for a, b, x in hits]

    return kernel(found, "array<struct<begin:int,end:int,payload:string>>", c)


@lru_cache(8)
def _machine(entries: tuple[tuple[str, str], ...]) -> Needles:
    return Needles(entries)
