"""Dates, booleans, units, languages, MIME types and file names as Columns."""

from __future__ import annotations

import mimetypes
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrain import refdata
from lexigrain.functions import text as T
from lexigrain.kernels.udf import ColumnLike, col, kernel


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


# Dates. Invalid values are null; with strict=True they raise.

_ZONE = r"(?:Z|[+-]\d{2}(?::?\d{2})?)"
_SECOND = r"[12]\d{3}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
_FORMATS = (
    (r"^[12]\d{3}$", "yyyy", "interval 1 year"),
    (r"^[12]\d{3}-\d{2}$", "yyyy-MM", "interval 1 month"),
    (r"^[12]\d{3}-\d{2}-\d{2}$", "yyyy-MM-dd", "interval 1 day"),
    (r"^[12]\d{3}-\d{2}-\d{2}T\d{2}$", "yyyy-MM-dd'T'HH", "interval 1 hour"),
    (r"^[12]\d{3}-\d{2}-\d{2}T\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm", "interval 1 minute"),
)


def _strict(c: Column, value: Column, what: str, strict: bool) -> Column:
    return F.when(c.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"invalid {what}: "), c))).otherwise(value) if strict else value


def parse_utc(c: ColumnLike, strict: bool = False) -> Column:
    """An exact timestamp; an offset is applied, none means UTC."""
    c = col(c)
    zone = F.regexp_extract(c, rf"({_ZONE})$", 1)
    plain = F.substring(c, 1, 19)
    offset = F.when(zone.isin("", "Z"), "+00:00").otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.coalesce(F.nullif(F.regexp_extract(zone, r"^.{3}:?(\d{2})$", 1), F.lit("")), F.lit("00"))))
    value = F.when(c.rlike(rf"^{_SECOND}{_ZONE}?$"), F.try_to_timestamp(F.concat(plain, offset), F.lit("yyyy-MM-dd'T'HH:mm:ssxxx")))
    return _strict(c, value, "timestamp", strict)


def prefix_interval(c: ColumnLike, strict: bool = False) -> Column:
    """struct<start, end>: the half-open interval of a date of any precision from years to seconds."""
    c = col(c)
    exact = parse_utc(c)
    start, end = F.when(exact.isNotNull(), exact), F.when(exact.isNotNull(), exact + F.expr("interval 1 second"))
    for pattern, form, step in _FORMATS:
        at = F.try_to_timestamp(c, F.lit(form))
        start, end = start.when(c.rlike(pattern), at), end.when(c.rlike(pattern), at + F.expr(step))
    value = F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end")))
    return _strict(c, value, "prefix date", strict)


def interval_ended_before(interval: ColumnLike, reference: ColumnLike) -> Column:
    return col(interval)["end"] <= col(reference)


def interval_starts_after(interval: ColumnLike, reference: ColumnLike) -> Column:
    return col(interval)["start"] > col(reference)


def ended_before(c: ColumnLike, reference: ColumnLike) -> Column:
    return interval_ended_before(prefix_interval(c), reference)


def starts_after(c: ColumnLike, reference: ColumnLike) -> Column:
    return interval_starts_after(prefix_interval(c), reference)


def utc_now() -> Column:
    return F.current_timestamp()


def naive_now() -> Column:
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")


def utc_date() -> Column:
    return F.to_date(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))


def iso_datetime(c: ColumnLike, strict: bool = False) -> Column:
    c = F.nullif(col(c), F.lit(""))
    value = F.try_to_timestamp(F.concat(F.replace(F.substring(c, 1, 19), F.lit(" "), F.lit("T")), F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    return _strict(c, value, "timestamp", strict)


def datetime_iso(c: ColumnLike) -> Column:
    """ISO text in seconds with the UTC offset; the session's zone is UTC."""
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


# Booleans and units


def bool_text(c: ColumnLike) -> Column:
    c = col(c)
    return F.when(c, "t").when(~c, "f")


def text_bool(c: ColumnLike) -> Column:
    c = F.lower(F.nullif(col(c), F.lit("")))
    return c.startswith("t") | c.startswith("y") | c.startswith("1")


def normalize_unit(c: ColumnLike) -> Column:
    c = col(c)
    units = {r["key"]: r["value"] for r in refdata.rows("units")}
    return F.coalesce(F.element_at(_map(units), F.lower(c)), c)


# Languages

NON_LANGUAGES = ("mis", "mul", "und", "zxx", "xzz")
PREFERRED = "eng"
PREFERRED_LIST = "eng spa fra por deu nld ita tur pol ron ces srp hrv dan nor rus ukr ara fas urd zho".split()
SYNONYMS = [
    x.split()
    for x in (
        "srp hbs hrv bos|sqi alb|slk slo|ron rum|nld dut|mya bur|msa may|mkd mac|kat geo|isl ice|fre fra|fas per|eus baq|ell gre|ger deu|wel cym|"
        "chi_sim chi_tra chi zho|ces cze|bod tib|aze_cyrl aze|fil tgl|nep npi"
    ).split("|")
]
_tables: dict[str, dict] = {}


def _languages() -> tuple[dict, set, dict]:
    if not _tables:
        _tables["names"] = {r["name"]: r["alpha3"] for r in refdata.rows("language_names")}
        _tables["two"] = {r["alpha3"]: r["alpha2"] for r in refdata.rows("languages") if r["alpha2"]}
        _tables["all"] = {r["alpha3"] for r in refdata.rows("languages")}
    return _tables["names"], _tables["all"], _tables["two"]


def alpha3(code: str) -> str | None:
    """ISO 639-3 code of one value."""
    names, known, _ = _languages()
    norm = str(code).casefold().strip()
    if not norm:
        return None
    found = names.get(norm, norm)
    if found in known and found not in NON_LANGUAGES:
        return found
    return next((alpha3(norm.split(sep, 1)[0]) for sep in "-_" if sep in norm), None)


def _expanded(codes: list[str], synonyms: bool) -> list[str]:
    _, known, _ = _languages()
    out = set()
    for code in filter(None, map(alpha3, (c for c in codes if c is not None))):
        out.add(code)
        if synonyms:
            out |= {s for s in next((g for g in SYNONYMS if code in g), []) if s in known and s not in NON_LANGUAGES}
    return sorted(out)


def normalize_code(c: ColumnLike) -> Column:
    return T.empty_to_null(T.strip(T.casefold(c)))


def iso_639_alpha3(c: ColumnLike) -> Column:
    """Kernel over distinct codes; 8,800 names are too many for a literal."""
    return kernel(alpha3, "string", c)


def iso_639_alpha2(c: ColumnLike) -> Column:
    return kernel(lambda x: _languages()[2].get(alpha3(x)), "string", c)


def list_to_alpha3(c: ColumnLike, synonyms: bool = True) -> Column:
    """Sorted codes of an array of codes."""
    joined = F.array_join(col(c), "\x1f")
    return kernel(lambda x: _expanded(x.split("\x1f"), synonyms), "array<string>", joined)


def expand_synonyms(c: ColumnLike) -> Column:
    """The codes of the first group of synonyms that holds the code, or the code alone."""
    c = col(c)
    table = {}
    for group in SYNONYMS:
        for code in group:
            table.setdefault(code, group)
    groups = F.create_map(*[x for k, g in table.items() for x in (F.lit(k), F.array(*map(F.lit, g)))])
    return F.coalesce(F.element_at(groups, c), F.when(c.isNotNull(), F.array(c)))


def is_lang_better(candidate: ColumnLike, baseline: ColumnLike) -> Column:
    order = F.array(*map(F.lit, PREFERRED_LIST))

    def rank(c: ColumnLike) -> Column:
        at = F.array_position(order, col(c))
        return F.when(at > 0, at).otherwise(len(PREFERRED_LIST) + 2)

    return rank(candidate) < rank(baseline)


# MIME types and file names

MAX_FILE_NAME = 254
DEFAULT_MIME, PLAIN_MIME = "application/octet-stream", "text/plain"


def parse_mimetype(c: ColumnLike, default: str = DEFAULT_MIME) -> Column:
    """struct<family, subtype, name, normalized, params>."""
    c = T.strip(col(c))
    head = F.substring_index(c, ";", 1)
    good = (F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit(""))) == 1) & head.rlike(r"^\s*[^\s/;]+\s*/\s*[^\s/;]+\s*$")
    name = F.when(good, F.lower(F.regexp_replace(head, r"\s+", ""))).otherwise(F.lit(default.lower()))
    fields = F.filter(F.transform(F.split(F.regexp_extract(c, r"(?s);(.*)$", 1), r"\s*;\s*"), lambda x: T.strip(x)), lambda x: x.rlike("^[^=]+=."))
    entries = F.transform(fields, lambda x: F.struct(F.lower(T.strip(F.substring_index(x, "=", 1))).alias("key"), F.regexp_replace(T.strip(F.regexp_replace(x, "^[^=]*=", "")), '^"|"$', "").alias("value")))
    # Of a parameter that is given more than once the first counts.
    keys = F.transform(entries, lambda x: x["key"])
    params = F.map_from_entries(F.filter(entries, lambda x, i: F.array_position(keys, x["key"]) == i + 1))
    replaced = {r["key"]: r["value"] for r in refdata.rows("mime_replace")}
    return F.struct(
        F.substring_index(name, "/", 1).alias("family"),
        F.substring_index(name, "/", -1).alias("subtype"),
        name.alias("name"),
        F.coalesce(F.element_at(_map(replaced), name), name).alias("normalized"),
        F.coalesce(F.when(good, params), F.create_map().cast("map<string,string>")).alias("params"),
    )


def normalize_mimetype(c: ColumnLike, default: str = DEFAULT_MIME) -> Column:
    return F.coalesce(parse_mimetype(F.coalesce(col(c), F.lit("")), default)["normalized"], F.lit(default))


def useful_mimetype(c: ColumnLike) -> Column:
    return ~normalize_mimetype(c).isin(DEFAULT_MIME, PLAIN_MIME)


def mimetype_label(c: ColumnLike) -> Column:
    parsed = parse_mimetype(F.coalesce(col(c), F.lit("")))
    labels = {r["key"]: r["value"] for r in refdata.rows("mime_labels")}
    tidy = T.strip(F.translate(F.regexp_replace(parsed["subtype"], "^x+", ""), "-.", "  "))
    return F.coalesce(F.element_at(_map(labels), parsed["normalized"]), tidy)


def tidy_encoding(name: str) -> str:
    """A known codec's name, in lower case; UTF-8 for an unknown one."""
    import codecs

    name = name.strip().lower()
    try:
        codecs.lookup(name)
    except LookupError:
        return "utf-8"
    return name


def mimetype_charset(c: ColumnLike) -> Column:
    """Kernel for the codec lookup."""
    return kernel(tidy_encoding, "string", F.element_at(parse_mimetype(c)["params"], "charset"))


def normalize_extension(c: ColumnLike) -> Column:
    c = F.regexp_replace(col(c), r"^\.", "")
    last = F.when(c.contains("."), F.substring_index(c, ".", -1)).otherwise(c)
    return T.empty_to_null(F.regexp_replace(F.lower(T.maybe_ascii(last)), "[^a-z0-9]", ""))


def mimetype_extension(c: ColumnLike) -> Column:
    """From the platform's MIME table, at plan time."""
    names = sorted({*mimetypes.types_map.values(), *mimetypes.common_types.values()})
    table = {n: e.lstrip(".") for n in names if (e := mimetypes.guess_extension(n))}
    name = normalize_mimetype(c)
    return F.when(name != DEFAULT_MIME, F.element_at(_map(table), name))


def file_name(c: ColumnLike) -> Column:
    """struct<base, extension, has_extension>."""
    c = col(c)
    dotted = c.rlike(r"[^./][^/]*\.[^./]*$")
    suffix = F.when(dotted, F.regexp_extract(c, r"(\.[^./]*)$", 1)).otherwise("")
    extension = normalize_extension(suffix)
    return F.struct(F.when(dotted, F.regexp_replace(c, r"\.[^./]*$", "")).otherwise(c).alias("base"), extension.alias("extension"), extension.isNotNull().alias("has_extension"))


def safe_file_name(c: ColumnLike, extension: str | None = None) -> Column:
    """A name of ASCII letters, digits, dashes, dots and underscores, with the extension; as long as file systems take, ``MAX_FILE_NAME``."""
    c = col(c)
    parts = file_name(c)
    ext = F.lit(extension) if extension else parts["extension"]
    base = F.regexp_replace(T.maybe_ascii(T.strip(F.regexp_replace(parts["base"], "^.*/", ""))), r"[^A-Za-z0-9_.\-]+", "_")
    base = F.regexp_replace(base, r"^[_.]+|[_.]+$", "")
    base = F.when(base.isNull() | (base == ""), "data").otherwise(base)
    tail = F.when(ext.isNotNull(), F.concat(F.lit("."), ext)).otherwise("")
    return F.concat(F.substring(base, F.lit(1), F.greatest(F.lit(1), MAX_FILE_NAME - F.length(tail))), tail)
