"""URL cleaning and comparison, JVM-side: the URL is taken apart with the pattern of RFC 3986."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrain.kernels.udf import ColumnLike, col

SCHEMES = ("http", "https", "ftp", "mailto", "file", "s3", "gs")
_PARTS = r"^(?s)(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

_BRACKETS = r"^(?:[^@]*@)?\[(?:[vV][0-9A-Fa-f]+\..+|[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(?:%[^\]\[]+)?)\](?::[^\[\]]*)?$"


def split_url(c: ColumnLike) -> dict[str, Column]:
    c = F.regexp_replace(F.regexp_replace(col(c), r"^[\x{0}-\x{20}]+|[\x{0}-\x{20}]+$", ""), r"[\t\r\n]", "")
    return {name: F.regexp_extract(c, _PARTS, k) for k, name in enumerate(("scheme", "netloc", "path", "query", "fragment"), 1)}


def _parts(c: Column) -> tuple[Column, dict[str, Column]]:
    """Whether the URL can be used, and its parts with a scheme, a host and a path."""
    first = split_url(c)
    bare = (first["netloc"] == "") & first["path"].contains(".") & ~c.startswith("//")
    parts = split_url(F.when(bare, F.concat(F.lit("//"), c)).otherwise(c))
    parts["scheme"] = F.when(parts["scheme"] == "", "http").otherwise(F.lower(parts["scheme"]))
    path = F.regexp_replace(parts["path"], r"(?U)^\s+|\s+$", "")
    parts["path"] = F.when(path == "", "/").when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    # Brackets hold an IP address, and nothing else has them.
    plain = ~parts["netloc"].rlike(r"[\[\]]") | parts["netloc"].rlike(_BRACKETS)
    return (parts["netloc"] != "") & parts["scheme"].isin(*SCHEMES) & plain, parts


def _join(p: dict[str, Column]) -> Column:
    tail = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), c)).otherwise("")
    return F.concat(p["scheme"], F.lit("://"), p["netloc"], p["path"], tail("?", p["query"]), tail("#", p["fragment"]))


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _pairs(query: Column, blanks: bool) -> Column:
    """Decoded (key, value) structs of a query."""
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    fields = F.filter(F.split(query, "&"), lambda x: (x != "") & (F.lit(True) if blanks else x.rlike("(?s)^[^=]*=.")))
    return F.transform(fields, lambda x: F.struct(decode(F.substring_index(x, "=", 1)).alias("k"), decode(F.regexp_replace(x, "(?s)^[^=]*=?", "")).alias("v")))


def _query(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")


def clean_url(c: ColumnLike) -> Column:
    """The URL with a scheme and a path, or null."""
    good, p = _parts(col(c))
    return F.when(good, _join(p))


def clean_url_compare(c: ColumnLike) -> Column:
    """A key for comparing: one scheme for both HTTPs, no ``www.``, no fragment, sorted query without blanks."""
    good, p = _parts(col(c))
    p["scheme"] = F.when(p["scheme"] == "https", "http").otherwise(p["scheme"])
    p["netloc"] = F.replace(F.lower(p["netloc"]), F.lit("www."), F.lit(""))
    p["query"] = _query(F.array_sort(_pairs(p["query"], blanks=False)))
    p["fragment"] = F.lit("")
    return F.when(good, _join(p))


def compare_urls(a: ColumnLike, b: ColumnLike) -> Column:
    """1.0 for URLs of the same key, else 0.0; two columns join on ``clean_url_compare``."""
    return F.coalesce((clean_url_compare(a) == clean_url_compare(b)).cast("double"), F.lit(0.0))


def build_url(c: ColumnLike, params: Mapping[str, object] | Iterable[tuple[str, object]] | None = None) -> Column:
    """The URL with sorted parameters added to its query."""
    p = split_url(c)
    pairs = _pairs(p["query"], blanks=True)
    if params:
        extra = sorted(params.items() if isinstance(params, Mapping) else params)
        pairs = F.concat(pairs, F.array(*[F.struct(F.lit(str(k)).alias("k"), F.lit(str(v)).alias("v")) for k, v in extra]))
    p["query"] = _query(pairs)
    tail = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), c)).otherwise("")
    head = F.when(p["scheme"] != "", F.concat(F.lower(p["scheme"]), F.lit(":"))).otherwise("")
    host = F.when(p["netloc"] != "", F.concat(F.lit("//"), p["netloc"])).otherwise("")
    return F.concat(head, host, p["path"], tail("?", p["query"]), tail("#", p["fragment"]))


def host(c: ColumnLike) -> Column:
    return F.lower(split_url(c)["netloc"])
