"""Addresses as Columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrain.functions import text as T
from lexigrain.kernels import addresses
from lexigrain.kernels.udf import ColumnLike, col, kernel


def clean_address(c: ColumnLike) -> Column:
    """JVM-side: one space or comma in place of a run of them, none at the ends."""
    # A comma takes the spaces and commas before it; of several spaces after it one stays.
    c = F.regexp_replace(F.regexp_replace(col(c), r"(?U)[\s,]*,\s{2,}", ", "), r"(?U)[\s,]*,(\s?)", ",$1")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s{2,}", " "), r"(?U)^[\s,]+|[\s,]+$", "")


def normalize_address(c: ColumnLike, latinize: bool = False, min_length: int = 4) -> Column:
    """JVM-side unless tokens are to be latinized."""
    if latinize:
        return kernel(lambda x: addresses.normalize(x, True, min_length), "string", c)
    keep = r"&№"
    drop = rf"[[\p{{Cf}}\p{{Co}}\p{{Cn}}\p{{Lm}}\p{{Mn}}\p{{Me}}\p{{No}}\p{{Sc}}\p{{Sk}}]&&[^{keep}]]"
    gap = rf"[[\p{{Cc}}\p{{Mc}}\p{{Z}}\p{{P}}\p{{Sm}}\p{{So}}]&&[^{keep}]]+"
    c = F.trim(F.regexp_replace(F.regexp_replace(T.casefold(c), drop, ""), gap, " "))
    return F.when(F.length(c) >= min_length, c)


def shorten_address_keywords(c: ColumnLike, latinize: bool = False) -> Column:
    """Kernel."""
    return kernel(lambda x: addresses.replace_keywords(x, latinize), "string", c)


def remove_address_keywords(c: ColumnLike, latinize: bool = False, replacement: str = " ") -> Column:
    """Kernel."""
    return kernel(lambda x: addresses.replace_keywords(x, latinize, replacement), "string", c)


def format_address(parts: ColumnLike, country: ColumnLike) -> Column:
    """Lines of an address from a map of its parts. Kernel."""
    return kernel(lambda p, c: addresses.format_address(json.loads(p), c or None), "string", F.to_json(col(parts)), F.coalesce(col(country), F.lit("")))


def format_address_line(parts: ColumnLike, country: ColumnLike) -> Column:
    """Kernel."""
    return kernel(lambda p, c: addresses.format_line(json.loads(p), c or None), "string", F.to_json(col(parts)), F.coalesce(col(country), F.lit("")))
