"""Upkeep of a corpus of name forms: a table (id, form, group, skip, first_seen, last_seen), unique by form and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions import names as N
from lexigrain.functions import text as T
from lexigrain.kernels import unicode
from lexigrain.kernels.udf import ColumnLike, col, kernel

SCHEMA = "id bigint, form string, group string, skip boolean, first_seen timestamp, last_seen timestamp"


def upsert(mapping: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of ``fresh`` (form, group, seen) added; known ones get a later ``last_seen``."""
    added = fresh.select(F.xxhash64("form", "group").alias("id"), "form", "group", F.lit(False).alias("skip"), F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"))
    return mapping.unionByName(added).groupBy("form", "group").agg(F.min("id").alias("id"), F.max("skip").alias("skip"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).select("id", "form", "group", "skip", "first_seen", "last_seen")


def skip(mapping: DataFrame, condition: Column) -> DataFrame:
    return mapping.withColumn("skip", F.col("skip") | condition)


def block_groups(mapping: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the groups in a table (group) are skipped."""
    marked = groups.select("group").distinct().withColumn("_hit", F.lit(True))
    return mapping.join(marked, "group", "left").withColumn("skip", F.col("skip") | F.coalesce("_hit", F.lit(False))).select(*mapping.columns)


def block_phrases(mapping: DataFrame, contains: list[str] = (), prefixes: list[str] = (), suffixes: list[str] = ()) -> DataFrame:
    """Rows whose form has one of the phrases, in either case, are skipped."""
    tests = [F.col("form").ilike(p) for p in (*(f"%{x}%" for x in contains), *(f"{x}%" for x in prefixes), *(f"%{x}" for x in suffixes))]
    condition = F.lit(False)
    for t in tests:
        condition = condition | t
    return skip(mapping, condition)


def by_group(mapping: DataFrame, group: str) -> DataFrame:
    return mapping.where(F.col("group") == group)


def by_form(mapping: DataFrame, form: str) -> DataFrame:
    return mapping.where(F.col("form") == form)


def by_pattern(mapping: DataFrame, pattern: str) -> DataFrame:
    return mapping.where(F.col("form").rlike(pattern))


def group_forms(mapping: DataFrame) -> DataFrame:
    """(group, forms) of what isn't skipped."""
    return mapping.where("not skip").groupBy("group").agg(F.sort_array(F.collect_set("form")).alias("forms"))


def longest_forms(mapping: DataFrame, n: int = 1000) -> DataFrame:
    return mapping.select("form").distinct().orderBy(F.length("form").desc(), "form").limit(n)


def frequent_forms(mapping: DataFrame, n: int = 50) -> DataFrame:
    return mapping.groupBy("form").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "form").limit(n)


def drop_subsets(mapping: DataFrame) -> DataFrame:
    """Groups without those whose forms another has all; of equal groups the last stays.

    A group can only lie within groups that have its rarest form, so only these are looked at: a form that very many
    groups share makes no square of them, and a group with a form of its own isn't looked at further.
    """
    # Tasks are of a number, and no side is broadcast: a task would hold several tables as large as the corpus.
    tasks = 4 * mapping.sparkSession.sparkContext.defaultParallelism
    rows = mapping.where("not skip").select("group", "form").repartition(tasks, "group").distinct()
    by_form = rows.repartition(tasks, "form")
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"))
    spread = by_form.groupBy("form").agg(F.count("*").alias("groups"))
    rarest = by_form.join(spread.hint("merge"), "form").groupBy("group").agg(F.min(F.struct("groups", "form")).alias("x"), F.count("*").alias("n_a"))
    smaller = rarest.where("x.groups > 1").select(F.col("group").alias("a"), "x.form", "n_a")
    maybe = smaller.join(by_form.select(F.col("group").alias("b"), "form").hint("merge"), "form").where("a <> b").select("a", "b", "n_a")
    maybe = maybe.join(sizes.select(F.col("group").alias("b"), F.col("n").alias("n_b")).hint("merge"), "b").where("n_a < n_b or (n_a = n_b and a < b)").select("a", "b", "n_a")
    wanted = maybe.join(rows.select(F.col("group").alias("a"), "form").hint("merge"), "a")
    common = wanted.join(rows.select(F.col("group").alias("b"), "form").hint("merge"), ["b", "form"]).groupBy("a", "b", "n_a").agg(F.count("*").alias("common"))
    inside = common.where("common = n_a").select(F.col("a").alias("group")).distinct()
    return rows.join(inside.hint("merge"), "group", "left_anti")


def bridged(forms: ColumnLike) -> Column:
    """Whether transliteration makes all forms of an array the same. Kernel."""

    def same(joined: str) -> bool:
        values = joined.split("\x1f")
        return all(map(unicode.should_ascii, values)) and len({unicode.ascii_text(v) for v in values}) == 1

    return kernel(same, "boolean", F.array_join(col(forms), "\x1f"))


def export_lines(mapping: DataFrame) -> DataFrame:
    """(value) lines ``form, form => group`` of groups of two forms or more that transliteration doesn't bridge."""
    groups = drop_subsets(mapping).groupBy("group").agg(F.sort_array(F.collect_set("form")).alias("forms")).where("size(forms) > 1")
    return groups.where(~bridged("forms")).select(F.concat(F.array_join("forms", ", "), F.lit(" => "), F.col("group")).alias("value"))


def clean_form(c: ColumnLike) -> Column:
    """A form without brackets, emoji and invisible characters in lower case; null when it is no name."""
    c = T.normal_form(F.lower(T.strip(T.remove_emoji(T.remove_bracketed_text(c)))), "NFC")
    c = F.regexp_replace(c, r"[\p{Cf}\p{Cs}\p{Co}\p{Cn}]", "")
    good = N.is_name(c) & (F.length(c) <= 40) & ~(T.is_modern_alphabet(c) & (F.length(c) < 2))
    return F.when(good, c)


def top_tokens(df: DataFrame, column: str, n: int = 100) -> DataFrame:
    """(token, n): the most frequent tokens of a text column."""
    tokens = df.select(F.explode(T.tokenize_name(T.casefold(column))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(n)
