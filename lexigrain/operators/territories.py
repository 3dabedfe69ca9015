"""Territories: the dimension, lookups by code and name, and intersection with hierarchy and claims."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain import refdata
from lexigrain.kernels import normal, unicode
from lexigrain.kernels.udf import ColumnLike, col, kernel

_SKIPPED = set(".()[],;:_-/ʻ'’")


def clean_code(c: ColumnLike) -> Column:
    return F.regexp_replace(F.translate(F.lower(col(c)), "_", "-"), r"(?U)^\s+|\s+$", "")


def clean_codes(c: ColumnLike) -> Column:
    return F.filter(F.transform(col(c), clean_code), lambda x: F.length(x) > 1)


def normal_name(name: str) -> str:
    """The form in which names are looked up."""
    folded = unicodedata.normalize("NFKD", name).casefold()
    plain = "".join(c if c.isalnum() else " " for c in folded if c not in _SKIPPED)
    if unicode.should_ascii(plain):
        plain = unicode.latinize_text(plain)
    return normal.squash(unicodedata.normalize("NFKC", plain))


def normalize_territory_name(c: ColumnLike) -> Column:
    """Kernel."""
    return kernel(normal_name, "string", c)


@cache
def resolved() -> list[dict]:
    """All territories with what they inherit from their parents, sorted by code."""
    index = {t["code"]: t for t in refdata.rows("territories")}

    def up(t: dict, key: str):
        while t is not None and not t[key]:
            t = index.get(t["parent"])
        return t[key] if t else None

    out = []
    for code in sorted(index):
        t = index[code]
        node = t
        while node is not None and not node["is_ftm"]:
            node = index.get(node["parent"])
        out.append(
            t
            | {
                "region": up(t, "region"), "subregion": up(t, "subregion"), "langs": up(t, "langs") or [], "in_sentence": t["in_sentence"] or t["name"], "ftm_country": node["code"] if node else None,
                "qids": sorted({t["qid"], *t["other_qids"]} - {None}), "codes": sorted({t["code"], t["alpha3"], *t["other_codes"]} - {None}),
            }
        )
    return out


_COLUMNS = "code string, name string, full_name string, alpha3 string, qid string, qids array<string>, codes array<string>, parent string, region string, subregion string, in_sentence string, is_country boolean, is_ftm boolean, ftm_country string, is_jurisdiction boolean, is_historical boolean, successors array<string>, claims array<string>, see array<string>, langs array<string>"


def territories(spark: SparkSession) -> DataFrame:
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(t[n] for n in names) for t in resolved()], _COLUMNS)


def ftm_countries(spark: SparkSession) -> DataFrame:
    return territories(spark).where("is_ftm")


def to_json(df: DataFrame) -> DataFrame:
    return df.select("code", F.to_json(F.struct(*df.columns)).alias("json"))


def identifiers(spark: SparkSession) -> DataFrame:
    """(identifier, code): codes, three-letter codes, other codes and QIDs, cleaned."""
    table = {}
    for t in sorted(refdata.rows("territories"), key=lambda t: t["code"]):
        for x in (t["code"], t["alpha3"], *t["other_codes"], t["qid"], *t["other_qids"]):
            if x:
                table[x.lower().replace("_", "-").strip()] = t["code"]
    return spark.createDataFrame(sorted(table.items()), "identifier string, code string")


def name_table() -> dict[str, tuple[str, str]]:
    """Normal name to (code, strength); a strong name beats a weak one, the last of equals wins. ``tools/`` packages it."""
    strong: dict[str, str] = {}
    weak: dict[str, str] = {}
    rows = sorted(refdata.rows("territories"), key=lambda t: t["code"])
    for t in rows:
        for n in (*t["names_strong"], t["name"], t["full_name"]):
            strong[normal_name(n)] = t["code"]
    for t in rows:
        for n in t["names_weak"]:
            if (key := normal_name(n)) not in strong:
                weak[key] = t["code"]
    return {k: (v, "strong") for k, v in strong.items()} | {k: (v, "weak") for k, v in weak.items()}


def names(spark: SparkSession) -> DataFrame:
    """(name_norm, code, strength, ord): each normal name once, in the order in which fuzzy ties are broken."""
    return refdata.frame(spark, "territory_names")


def lookup_by_identifier(df: DataFrame, column: str) -> DataFrame:
    """Adds or replaces ``territory``, by a join with the broadcast identifiers, of which there are a few thousand."""
    ids = F.broadcast(identifiers(df.sparkSession).withColumnsRenamed({"identifier": "_id", "code": "_found"}))
    keyed = df.withColumn("_key", clean_code(column))
    return keyed.join(ids, F.col("_key") == F.col("_id"), "left").withColumn("territory", F.col("_found")).drop("_key", "_id", "_found")


def territory_by_qid(df: DataFrame, column: str) -> DataFrame:
    """Adds or replaces ``territory``: of an exact Wikidata item only, main or other."""
    qids = df.sparkSession.createDataFrame([(q, t["code"]) for t in resolved() for q in t["qids"]], "_qid string, _found string").groupBy("_qid").agg(F.max("_found").alias("_found"))
    return df.join(F.broadcast(qids), F.col(column) == F.col("_qid"), "left").withColumn("territory", F.col("_found")).drop("_qid", "_found")


def lookup_territory(df: DataFrame, column: str, fuzzy: bool = False) -> DataFrame:
    """Adds or replaces ``territory``: by identifier, then by name, then, if asked, by the nearest name. Work is done on distinct values, joined back."""
    spark = df.sparkSession
    keyed = df.withColumn("_lookup", F.col(column))
    values = keyed.select("_lookup").where("_lookup is not null").distinct()
    found = lookup_by_identifier(values, "_lookup").withColumnRenamed("territory", "_by_id").withColumn("_norm", normalize_territory_name("_lookup"))
    dim = names(spark)
    known = F.broadcast(dim.select(F.col("name_norm").alias("_name"), F.col("code").alias("_by_name")))
    found = found.join(known, F.col("_norm") == F.col("_name"), "left").select("_lookup", "_norm", F.coalesce("_by_id", "_by_name").alias("_code"))
    if fuzzy:
        found = _nearest(found, dim)
    found = found.select("_lookup", "_code")
    return keyed.join(found, "_lookup", "left").withColumn("territory", F.col("_code")).select(*df.columns, *([] if "territory" in df.columns else ["territory"]))


def _nearest(found: DataFrame, dim: DataFrame) -> DataFrame:
    """``_code`` of what has none yet: the nearest name within three tenths of the length; of equally near ones the first.
    A value meets only names of a length that can be near enough, by an equi join with the broadcast names."""
    cutoff = F.floor(F.length("_norm") * 0.3).cast("int")
    lengths = F.when(F.col("_code").isNull() & (F.length("_norm") > 0), F.sequence(F.length("_norm") - cutoff, F.length("_norm") + cutoff))
    close = F.broadcast(dim.where("length(name_norm) > 4").select("name_norm", "ord", F.col("code").alias("_near"), F.length("name_norm").alias("_size")))
    pairs = found.withColumn("_size", F.explode_outer(lengths)).join(close, "_size", "left").withColumn("_d", F.levenshtein("_norm", "name_norm"))
    best = F.min(F.when(F.col("_d") <= cutoff, F.struct("_d", "ord", "_near")))["_near"]
    return pairs.groupBy("_lookup", "_code").agg(best.alias("_best")).select("_lookup", F.coalesce("_code", "_best").alias("_code"))


def territories_intersect(left: ColumnLike, right: ColumnLike) -> Column:
    """Sorted common codes of two arrays, the narrower of a child and its parent or claimant."""
    related, canonical = {}, {}
    for t in resolved():
        canonical |= dict.fromkeys(t["codes"], t["code"])
        if up := sorted({t["parent"], *t["claims"]} - {None}):
            related[t["code"]] = up
    canonical |= {t["code"]: t["code"] for t in resolved()}
    table = F.create_map(*[x for k, v in related.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    codes = F.create_map(*[F.lit(x) for pair in canonical.items() for x in pair])

    def narrow(mine: Column, theirs: Column) -> Column:
        return F.filter(mine, lambda c: (F.array_contains(theirs, c) | F.arrays_overlap(F.coalesce(F.element_at(table, c), F.array().cast("array<string>")), theirs)))

    known = lambda xs: F.filter(F.transform(col(xs), lambda x: F.element_at(codes, x)), lambda x: x.isNotNull())
    left, right = known(left), known(right)
    return F.array_sort(F.array_distinct(F.concat(narrow(left, right), narrow(right, left))))
