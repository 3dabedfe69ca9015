"""Analysis of entities' names, candidate pairs by blocking, and evidence for pairs, as DataFrame operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lexigrain.functions import text as T
from lexigrain.functions.names import NAME, SPAN, case_error_score, name_from, name_record
from lexigrain.kernels import bags, names
from lexigrain.kernels import pairs as pairs_kernel

ALIGN = "struct<qps:array<int>,rps:array<int>,category:string,id:string,score:double,weight:double,qstr:string,rstr:string>"


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(ddl))


def _map(df: DataFrame, function, ddl: str) -> DataFrame:
    """``function`` of each row's dictionary, giving rows; no exchange."""

    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield pa.RecordBatch.from_pylist([r for row in batch.slice(at, 1024).to_pylist() for r in function(row)], schema)

    return df.mapInArrow(run, ddl)


def analyze_names(entities: DataFrame, infer_initials: bool = False, symbols: bool = True, phonetics: bool = True, numerics: bool = True, consolidate: bool = True, rewrite: bool = True, corpus: list[str] | None = None) -> DataFrame:
    """(entity_id, name) from (entity_id, type_tag, names array[, part_tags array<struct<tag, values>>]).

    ``corpus`` holds lines ``form, form => id`` of person names, sent with the plan: a larger one belongs in a
    table, by which ``tag_names`` adds the same spans.
    """
    records = tuple(names.read_corpus(corpus or ()))
    if "part_tags" not in entities.columns:
        entities = entities.withColumn("part_tags", F.array().cast("array<struct<tag:string,values:array<string>>>"))

    def one(r: dict) -> list[dict]:
        tags = [(t["tag"], t["values"] or []) for t in r["part_tags"] or []]
        found = names.analyze(r["type_tag"] or "UNK", r["names"] or [], tags, infer_initials, symbols, phonetics, numerics, consolidate, rewrite, records)
        return [{"entity_id": r["entity_id"], "name": name_record(n)} for n in found]

    return _map(entities.select(F.col("entity_id").cast("string"), "type_tag", "names", "part_tags"), one, f"entity_id string, name {NAME}")


def tag_by_join(tokens: DataFrame, needles: DataFrame, longest: int | None = None) -> DataFrame:
    """(entity_id, phrase, category, id) of phrases of ``needles`` (phrase, category, id) in arrays of tokens (entity_id, tokens): n-gram
    explode and join, for dictionaries of any size. N-grams are as long as the longest phrase, which is counted first unless given."""
    if longest is None:
        longest = needles.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.size("tokens") >= n, F.transform(F.sequence(F.lit(1), F.size("tokens") - n + 1), lambda i: F.array_join(F.slice("tokens", i, n), " "))).otherwise(F.array().cast("array<string>"))))
    exploded = tokens.select("entity_id", F.explode(F.array_distinct(grams)).alias("phrase"))
    return exploded.join(needles, "phrase")


def tag_names(named: DataFrame, needles: DataFrame, longest: int | None = None) -> DataFrame:
    """The names (entity_id, name) with a span more for each phrase of ``needles`` (phrase, category, id) among their parts.

    This is how a table of person names of any size tags names: phrases are joined, not sent with the plan. A phrase
    stands for parts in a row; one that occurs again, or again in ``needles``, gives one span a place.
    """
    if longest is None:
        longest = needles.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1
    keyed = named.withColumn("_row", F.xxhash64("entity_id", F.to_json("name"))).withColumn("_row2", F.md5(F.to_json("name")))
    forms, size = F.transform("name.parts", lambda p: p["form"]), F.size("name.parts")
    runs = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), size - i + 1)), lambda n: F.struct(i.alias("i"), n.alias("n"), F.array_join(F.slice(forms, i, n), " ").alias("phrase"))))),
        lambda x: x["phrase"] != "",
    )
    found = keyed.where(size > 0).select("_row", "_row2", F.col("name.parts").alias("_parts"), F.explode(runs).alias("x")).select("_row", "_row2", "_parts", "x.i", "x.n", "x.phrase")
    found = found.join(needles.select("phrase", "category", "id").distinct(), "phrase")
    span = F.struct(
        F.transform(F.sequence(F.col("i") - 1, F.col("i") + F.col("n") - 2), lambda k: k.cast("int")).alias("part_idx"),
        F.col("category").cast("string").alias("category"),
        F.col("id").cast("string").alias("id"),
        F.array_join(F.transform(F.slice("_parts", F.col("i"), F.col("n")), lambda p: p["comparable"]), " ").alias("comparable"),
    )
    spans = found.groupBy("_row", "_row2").agg(F.sort_array(F.collect_set(span)).alias("_spans"))
    joined = keyed.join(spans, ["_row", "_row2"], "left")
    both = F.concat("name.spans", F.coalesce(F.array_except("_spans", "name.spans"), F.array().cast(f"array<{SPAN}>")))
    return joined.withColumn("name", F.col("name").withField("spans", both)).select(*named.columns)


def blocking_keys(named: DataFrame, initials: bool = False) -> DataFrame:
    """(entity_id, key): symbols, comparables and sounds of a name's parts. Initials stand in too many names to block by."""
    spans = F.filter("name.spans", lambda s: F.lit(initials) | (s["category"] != "INITIAL"))
    keys = F.concat(
        F.transform(spans, lambda s: F.concat(s["category"], F.lit(":"), s["id"])),
        F.transform(F.filter("name.parts", lambda p: F.length(p["comparable"]) > 1), lambda p: F.concat(F.lit("="), p["comparable"])),
        F.transform(F.filter("name.parts", lambda p: p["metaphone"].isNotNull()), lambda p: F.concat(F.lit("~"), p["metaphone"])),
    )
    return named.select("entity_id", F.explode(F.array_distinct(keys)).alias("key"))


def frequent_keys(named: DataFrame, most: int, initials: bool = False) -> DataFrame:
    """(key, n) of blocking keys that more than ``most`` entities have: such a key alone makes the square of ``n`` pairs."""
    return blocking_keys(named, initials).groupBy("key").agg(F.countDistinct("entity_id").alias("n")).where(F.col("n") > most)


def candidate_pairs(left: DataFrame, right: DataFrame, initials: bool = False, without: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id) of entities that share a key; an equi join, which AQE splits where a key is frequent.

    All sharing pairs are found, so a key that n entities have gives n squared. ``without`` (key) names keys that don't
    count, as ``frequent_keys`` reports them; entities that share others are still found.
    """
    a = blocking_keys(left, initials).select(F.col("entity_id").alias("left_id"), "key").distinct()
    b = blocking_keys(right, initials).select(F.col("entity_id").alias("right_id"), "key").distinct()
    if without is not None:
        a = a.join(without.select("key").distinct(), "key", "left_anti")
    return a.join(b, "key").select("left_id", "right_id").distinct()


def _alignment(a: names.Alignment) -> dict:
    category, id = a.symbol or (None, None)
    return {"qps": [p.index for p in a.qps], "rps": [p.index for p in a.rps], "category": category, "id": id, "score": a.score, "weight": a.weight, "qstr": a.qstr, "rstr": a.rstr}


def _pairwise(pairs: DataFrame, function, returns: str) -> DataFrame:
    """``pairs`` has columns left and right (names) besides its keys; adds ``result``. A name of a batch is made once, however many pairs it is in."""
    keys = [f.name for f in pairs.schema.fields if f.name not in ("left", "right")]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name in keys)
    schema = _schema(f"result {returns}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sides = []
                for side in ("left", "right"):
                    text = [repr(x) for x in zip(*(_flat(part.column(side), c) for c in ("original", "form", "tag")), _tags(part.column(side)))]
                    place: dict[str, int] = {}
                    where = [place.setdefault(t, i) for i, t in enumerate(text)]
                    made = {i: name_from(r) for i, r in zip(place.values(), part.column(side).take(pa.array(list(place.values()), pa.int64())).to_pylist())}
                    sides.append([made[i] for i in where])
                results = pa.array([function(a, b) for a, b in zip(*sides)], schema.field("result").type)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), results], names=[*keys, "result"])

    return pairs.select(*keys, "left", "right").mapInArrow(run, f"{ddl}, result {returns}")


def _flat(column: pa.StructArray, field: str) -> list:
    return pc.struct_field(column, [field]).to_pylist()


def _lists(column: pa.StructArray, field: str, inner: str) -> list[list]:
    """A field of the structs in a list field, row by row."""
    lists = pc.struct_field(column, [field])
    values, at = pc.struct_field(lists.flatten(), [inner]).to_pylist(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).tolist()
    return [values[a:b] for a, b in zip(at, at[1:])]


def _tags(column: pa.StructArray) -> list[tuple]:
    """What tells names of one form apart: tags of parts, and symbols of spans with where they stand."""
    return list(zip(_lists(column, "parts", "tag"), _lists(column, "spans", "category"), _lists(column, "spans", "id"), _lists(column, "spans", "part_idx")))


def pair_symbols(pairs: DataFrame) -> DataFrame:
    return _pairwise(pairs, lambda a, b: [[_alignment(x) for x in s] for s in names.pair_symbols(a, b)], f"array<array<{ALIGN}>>")


def compare_parts(pairs: DataFrame, config: names.CompareConfig = names.CompareConfig()) -> DataFrame:
    """Adds ``result``: the clusters of parts that stand for each other, with scores. Whole batches of pairs are compared
    at once, on the columns of their parts; no name is made."""
    keys = [f.name for f in pairs.schema.fields if f.name not in ("left", "right")]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name in keys)
    item = _schema(f"result array<{ALIGN}>").field("result").type.value_type
    kind = [item.field(i).type for i in range(item.num_fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [_lists(batch.column(side), "parts", "comparable") for side in ("left", "right")]
            index = [_lists(batch.column(side), "parts", "index") for side in ("left", "right")]
            found = pairs_kernel.compare_parts(*sides, config)
            flat = [(k, *c) for k, clusters in enumerate(found) for c in clusters]
            texts = [[" ".join(side[k][i] for i in c[at]) for k, *c in flat] for at, side in enumerate(sides)]
            nothing = pa.nulls(len(flat), pa.string())
            items = pa.StructArray.from_arrays(
                [
                    *(pa.array([[ix[k][i] for i in c[at]] for k, *c in flat], kind[at]) for at, ix in enumerate(index)),
                    nothing, nothing, pa.array([c[3] for c in flat], pa.float64()), pa.array([1.0] * len(flat), pa.float64()), *(pa.array(t, pa.string()) for t in texts),
                ],
                fields=[item.field(i) for i in range(item.num_fields)],
            )
            at = np.concatenate([[0], np.cumsum([len(c) for c in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.ListArray.from_arrays(pa.array(at), items)], names=[*keys, "result"])

    slim = lambda side: F.struct(F.transform(f"{side}.parts", lambda p: F.struct(p["index"].alias("index"), p["comparable"].alias("comparable"))).alias("parts")).alias(side)
    return pairs.select(*keys, slim("left"), slim("right")).mapInArrow(run, f"{ddl}, result array<{ALIGN}>")


def align_person_name_order(pairs: DataFrame) -> DataFrame:
    def order(a: names.Name, b: names.Name) -> dict:
        left, right = names.align_person_name_order(a.parts, b.parts)
        return {"left": [p.index for p in left], "right": [p.index for p in right]}

    return _pairwise(pairs, order, "struct<left:array<int>,right:array<int>>")


# Bags as aggregations


def pick_case(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name) with the best-cased name of each group; a partial aggregate, no list of the group is made."""
    c = F.col(name)
    return df.where(c.isNotNull()).groupBy(*keys).agg(F.min_by(c, F.struct(case_error_score(c), F.length(c), c)).alias(name))


def reduce_names(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row a group and case-folded form, with its best-cased name."""
    c = F.col(name)
    return df.where(c.isNotNull()).groupBy(*keys, T.casefold(c).alias("form")).agg(F.min_by(c, F.struct(case_error_score(c), F.length(c), c)).alias(name))


def _bags(df: DataFrame, keys: list[str], name: str, function, returns: str) -> DataFrame:
    """(keys, name): ``function`` of the distinct names of each group, sorted, with their numbers of times."""

    def one(r: dict) -> list[dict]:
        chosen = function({x["name"]: x["n"] for x in r["bag"]})
        return [{k: r[k] for k in keys} | {name: chosen}]

    counted = df.where(F.col(name).isNotNull()).groupBy(*keys, F.col(name).alias("_name")).agg(F.count("*").alias("_n"))
    grouped = counted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("_name").alias("name"), F.col("_n").alias("n")))).alias("bag"))
    ddl = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return _map(grouped, one, f"{ddl}, {name} {returns}")


def pick_name(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): each distinct name of a group goes through the choice once, weighed by its number of times."""
    return _bags(df, keys, name, bags.pick_name, "string")


def representative_names(df: DataFrame, keys: list[str], name: str, limit: int, cluster_threshold: float = 0.3) -> DataFrame:
    """(keys, name array): at most ``limit`` names that stand for all distinct names of each group."""
    return _bags(df, keys, name, lambda bag: bags.representative_names(list(bag), limit, cluster_threshold), "array<string>")


def pick_lang_name(df: DataFrame, keys: list[str], name: str, lang: str, preferred: str = "eng", order: list[str] | None = None) -> DataFrame:
    """(keys, name): the choice among a group's names in the preferred language, else in the preferred ones, else among all."""
    from lexigrain.functions.misc import PREFERRED_LIST

    tier = F.when(F.col(lang) == preferred, 0).when(F.col(lang).isin(order or PREFERRED_LIST), 1).otherwise(2)
    ranked = df.where(F.length(F.trim(name)) > 0).withColumn("_tier", tier)
    first = ranked.groupBy(*keys).agg(F.min("_tier").alias("_first"))
    # The second choice takes in the first, the last all.
    return pick_name(ranked.join(first, keys).where("_tier = _first"), keys, name)


def consolidate_names(df: DataFrame, key: str, position: str, name: str, person: bool = False) -> DataFrame:
    """Names that no other name of their entity contains, by substring of the normalised form; of equal ones the first stays.

    A person's name also contains one whose words it has all, each as often, in any order.
    """
    form = T.normalize_name(F.col(name))
    forms = df.withColumn("_form", form).where("_form is not null").groupBy(key, "_form").agg(F.min(F.struct(position, name)).alias("_x")).select(key, "_form", f"_x.{position}", f"_x.{name}")
    outer = forms.select(F.col(key).alias("_outer_key"), F.col("_form").alias("_outer_form"))
    within: Column = F.col("_outer_form").contains(F.col("_form"))
    if person:
        mine, theirs = F.split("_form", " "), F.split("_outer_form", " ")
        times = lambda words, x: F.size(F.filter(words, lambda y: y == x))
        # Of two names with the same words in another order the first in sorting stays.
        subset = F.forall(mine, lambda x: times(theirs, x) >= times(mine, x)) & ((F.size(theirs) > F.size(mine)) | (F.col("_outer_form") < F.col("_form")))
        within = within | subset
    inside: Column = (F.col(key) == F.col("_outer_key")) & (F.col("_form") != F.col("_outer_form")) & within
    return forms.join(outer, inside, "left_anti").drop("_form")
