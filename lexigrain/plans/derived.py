"""Operators over whole columns of the driver's tables, each beside its own SQL.

Inputs are SQL expressions that mean the same in Spark and DuckDB, so both sides read the same values; what is
expected of them is SQL of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.functions import addresses, ids, misc, names, text, urls
from lexigrain.operators import corpus, territories

_DUCK = {"string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "array<string>": "VARCHAR[]"}
_KEYS = {"part": "p_partkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "pages": "page_id", "nation": "n_nationkey"}


@dataclass
class Derived:
    """``operator`` of the ``inputs`` of every row of ``table``; ``let`` names expressions that later ones use."""

    table: str
    inputs: Sequence[str]
    operator: Callable[..., Column]
    expect: str
    returns: str = "string"
    let: Sequence[tuple[str, str]] = ()
    where: str = "TRUE"

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet").where(self.where)
        for name, e in self.let:
            df = df.withColumn(name, F.expr(e))
        for i, e in enumerate(self.inputs):
            df = df.withColumn(f"arg{i}", F.expr(e))
        result = self.operator(*[F.col(f"arg{i}") for i in range(len(self.inputs))])
        return df.select(F.col(_KEYS[self.table]).cast("bigint").alias("key"), result.cast(self.returns).alias("result"))

    def sql(self) -> str:
        return self._sql().replace("array(", "list_value(").replace("regexp_like(", "regexp_matches(")

    def _sql(self) -> str:
        source = f"SELECT * FROM {self.table} WHERE {self.where}"
        for name, e in self.let:
            source = f"SELECT *, {e} AS {name} FROM ({source})"
        for i, e in enumerate(self.inputs):
            source = f"SELECT *, {e} AS arg{i} FROM ({source})"
        return f"SELECT CAST({_KEYS[self.table]} AS BIGINT) AS key, CAST({self.expect} AS {_DUCK[self.returns]}) AS result FROM ({source})"


def _digit(s: str, i: int) -> str:
    return f"CAST(substr({s}, {i}, 1) AS INT)"


def _weighted(s: str, weights: Sequence[int], first: int = 1) -> str:
    return "(" + " + ".join(f"{w} * {_digit(s, first + i)}" for i, w in enumerate(weights)) + ")"


def _doubled(s: str, positions: Sequence[int], all_: Sequence[int]) -> str:
    """Luhn's sum of digits, those at ``positions`` doubled."""
    return "(" + " + ".join(f"(CASE WHEN {_digit(s, i)} > 4 THEN 2 * {_digit(s, i)} - 9 ELSE 2 * {_digit(s, i)} END)" if i in positions else _digit(s, i) for i in all_) + ")"


def _padded(key: str, size: int, times: int = 7919, plus: int = 0) -> str:
    return f"lpad(CAST(({key} * {times} + {plus}) % {10**size} AS STRING), {size}, '0')"


def _format(name: str, what: str) -> Callable[[Column], Column]:
    f = ids.get_identifier_format(name)
    return {"valid": f.is_valid, "normalize": f.normalize, "format": f.format}[what]


def _identifier(name: str, table: str, let: list[tuple[str, str]], good: str, bad: str, shown: str | None = None, noise: str = "concat(' ', x, ' ')", normal: str = "x") -> dict[str, Derived]:
    """Every second row has a right control digit, the others a wrong one."""
    key = _KEYS[table]
    let = [*let, ("x", f"CASE WHEN {key} % 2 = 0 THEN {good} ELSE {bad} END")]
    out = {
        f"id_{name}_valid": Derived(table, ["x"], _format(name, "valid"), f"{key} % 2 = 0", "boolean", let),
        f"id_{name}_normalize": Derived(table, [noise], _format(name, "normalize"), f"CASE WHEN {key} % 2 = 0 THEN {normal} END", "string", let),
    }
    if shown:
        out[f"id_{name}_format"] = Derived(table, ["x"], _format(name, "format"), shown, "string", let, f"{key} % 2 = 0")
    return out


def _mod97(parts: list[tuple[str, int]]) -> list[tuple[str, str]]:
    """Steps that give the remainder of a number by 97, from pieces of so many digits."""
    steps, last = [], "0"
    for k, (piece, size) in enumerate(parts):
        steps.append((f"m{k}", f"(CAST({last} AS BIGINT) * {10**size} + CAST({piece} AS BIGINT)) % 97"))
        last = f"m{k}"
    return steps


_two = lambda e: f"lpad(CAST({e} AS STRING), 2, '0')"
_next = lambda e, m=10: f"(({e}) + 1) % {m}"
_text = lambda e: f"CAST({e} AS STRING)"

_IDS: dict[str, Derived] = {
    **_identifier("npi", "customer", [("s", f"concat('1', {_padded('c_custkey', 8)})"), ("d", f"(10 - (24 + {_doubled('s', (1, 3, 5, 7, 9), range(1, 10))}) % 10) % 10")], f"concat(s, {_text('d')})", f"concat(s, {_text(_next('d'))})", noise="concat('NPI: ', x)"),
    **_identifier("isin", "customer", [("s", _padded("c_custkey", 9)), ("t", "concat('3028', s)"), ("d", f"(10 - {_doubled('t', range(1, 14, 2), range(1, 14))} % 10) % 10")], f"concat('US', s, {_text('d')})", f"concat('US', s, {_text(_next('d'))})", shown="x", noise="concat(' ', lower(x))"),
    **_identifier("iban", "orders", [("s", f"concat({_padded('o_orderkey', 9)}, {_padded('o_orderkey', 9, 104729)})"), *_mod97([("substr(s, 1, 9)", 9), ("substr(s, 10, 9)", 9), ("'131400'", 6)])], f"concat('DE', {_two('98 - m2')}, s)", f"concat('DE', {_two('(98 - m2) % 97 + 1')}, s)",
                  shown="concat_ws(' ', substr(x, 1, 4), substr(x, 5, 4), substr(x, 9, 4), substr(x, 13, 4), substr(x, 17, 4), substr(x, 21, 2))", noise="lower(concat(substr(x, 1, 4), ' ', substr(x, 5, 4), '-', substr(x, 9)))"),
    **_identifier("lei", "orders", [("s", f"concat({_padded('o_orderkey', 9)}, {_padded('o_orderkey', 9, 104729)})"), *_mod97([("substr(s, 1, 9)", 9), ("substr(s, 10, 9)", 9), ("'00'", 2)])], f"concat(s, {_two('98 - m2')})", f"concat(s, {_two('(98 - m2) % 97 + 1')})"),
    **_identifier("figi", "customer", [("s", _padded("c_custkey", 8)), ("d", "(10 - (13 + " + " + ".join(f"({_digit('s', i)} * 2) % 10 + (CASE WHEN {_digit('s', i)} > 4 THEN 1 ELSE 0 END)" if i % 2 else _digit("s", i) for i in range(1, 9)) + ") % 10) % 10")], f"concat('BBG', s, {_text('d')})", f"concat('BBG', s, {_text(_next('d'))})", noise="lower(x)"),
    **_identifier("inn", "customer", [("s", _padded("c_custkey", 9)), ("d", f"{_weighted('s', [2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10")], f"concat(s, {_text('d')})", f"concat(s, {_text(_next('d'))})"),
    **_identifier("ogrn", "orders", [("s", f"concat('1', {_padded('o_orderkey', 11)})"), ("d", "CAST(s AS BIGINT) % 11 % 10")], f"concat(s, {_text('d')})", f"concat(s, {_text(_next('d'))})", noise="concat('ogrn ', x, '.')"),
    **_identifier("cpf", "customer", [("s", _padded("c_custkey", 9, plus=1)), ("d", f"(11 - {_weighted('s', range(10, 1, -1))} % 11) % 11 % 10"), ("t", f"concat(s, {_text('d')})"), ("e", f"(11 - {_weighted('t', range(11, 1, -1))} % 11) % 11 % 10")], f"concat(t, {_text('e')})", f"concat(t, {_text(_next('e'))})",
                  shown="concat(substr(x, 1, 3), '.', substr(x, 4, 3), '.', substr(x, 7, 3), '-', substr(x, 10, 2))", noise="concat(substr(x, 1, 3), '.', substr(x, 4, 6), '-', substr(x, 10, 2))"),
    **_identifier("cnpj", "customer", [("s", f"concat({_padded('c_custkey', 8, plus=1)}, '0001')"), ("d", f"(11 - {_weighted('s', [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} % 11) % 11 % 10"), ("t", f"concat(s, {_text('d')})"), ("e", f"(11 - {_weighted('t', [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} % 11) % 11 % 10")], f"concat(t, {_text('e')})", f"concat(t, {_text(_next('e'))})",
                  shown="concat(substr(x, 1, 2), '.', substr(x, 3, 3), '.', substr(x, 6, 3), '/', substr(x, 9, 4), '-', substr(x, 13, 2))", noise="concat(substr(x, 1, 8), '/', substr(x, 9))"),
    **_identifier("uscc", "customer", [("s", f"concat('1', {_padded('c_custkey', 8)}, {_padded('c_custkey', 8, 104729)})"), ("d", f"(31 - {_weighted('s', [pow(3, i, 31) for i in range(17)])} % 31) % 31")], "concat(s, substr('0123456789ABCDEFGHJKLMNPQRTUWXY', d + 1, 1))", f"concat(s, substr('0123456789ABCDEFGHJKLMNPQRTUWXY', {_next('d', 31)} + 1, 1))", noise="concat(' ', lower(x))"),
    **_identifier("ssn", "customer", [("s", _padded("c_custkey", 4, plus=1)), ("g", "CASE WHEN c_custkey % 2 = 0 THEN '45' ELSE '00' END")], "concat('123-', g, '-', CASE WHEN s = '0000' THEN '0001' ELSE s END)", "concat('123-', g, '-', s)", shown="x", normal="replace(x, '-', '')"),
    **_identifier("wikidata", "part", [], "concat('Q', CAST(p_partkey AS STRING))", "concat('W', CAST(p_partkey AS STRING))", noise="concat('https://www.wikidata.org/wiki/', lower(x))"),
    **_identifier("strict", "part", [], "p_name", "substr(p_name, 1, 2)", noise="concat(x, '-')", normal="replace(upper(x), ' ', '')") ,
    **_identifier("generic", "part", [], "p_name", "'  '"),
    **_identifier("uei", "customer", [("s", _padded("c_custkey", 11))], "concat('F', s)", "concat('0', s)", noise="concat('uei ', lower(x))"),
    **_identifier("bic", "customer", [("s", _padded("c_custkey", 3))], "concat('DEUTDEFF', s)", "concat('DEUT', s, 'FF', s)", noise="lower(x)", normal="substr(x, 1, 8)"),
}
# Two letters are no strict identifier, but have a normal form.
_IDS["id_strict_normalize"].expect = "replace(upper(x), ' ', '')"

_IMO = [("s", _padded("c_custkey", 6, 7919, 12345)), ("v", f"{_weighted('s', [7, 6, 5, 4, 3, 2])} % 10"), ("k", f"(11 - {_weighted('s', [8, 6, 4, 2, 9, 7])} % 11) % 10"), ("x", f"concat(s, {_text('CASE c_custkey % 3 WHEN 0 THEN v WHEN 1 THEN k ELSE (v + 1) % 10 END')})"), ("c", _digit("x", 7))]
_NAMES = "concat(upper(substr(p_name, 1, 1)), substr(p_name, 2))"
_FORMS = [("aktiengesellschaft", "ag", "AG"), ("limited liability company", "llc", "LLC"), ("gmbh", "gmbh", "GmbH"), ("banana", "banana", "banana")]
_pick = lambda key, values: f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
_quote = lambda values: ["'" + v.replace("'", "''") + "'" for v in values]

_TEXT: dict[str, Derived] = {
    "text_strip": Derived("part", ["concat('  ', p_name, chr(9), chr(10))"], lambda c: text.normalize(c, 1), "p_name"),
    "text_casefold": Derived("part", ["concat(upper(p_name), ' Straße ΣΑΣ')"], text.casefold, "concat(p_name, ' strasse σασ')"),
    "text_squash_spaces": Derived("part", ["concat(' ', replace(p_name, ' ', '   '), chr(9), chr(10), p_type)"], lambda c: text.normalize(c, 2), "concat(p_name, ' ', p_type)"),
    "text_nfc": Derived("documents", ["substr(text, 1, 300)"], lambda c: text.normalize(c, 8), "nfc_normalize(arg0)", where="length(trim(text)) > 0"),
    "text_nfkc": Derived("part", ["concat('ﬁ①', p_name)"], lambda c: text.normalize(c, 16), "concat('fi1', p_name)"),
    "text_nfkd": Derived("part", ["concat('é', p_name)"], lambda c: text.normalize(c, 32), "concat('e', chr(769), p_name)"),
    "text_cleanup_strong": Derived("part", ["concat(p_name, '-', p_type, '_$', p_brand, '+')"], lambda c: text.normalize(c, 2, 1), "concat(p_name, ' ', p_type, ' ', replace(p_brand, '#', ' '))"),
    "text_cleanup_slug": Derived("part", ["concat(p_name, '-', p_type, '_$x+')"], lambda c: text.normalize(c, 2, 2), "concat(p_name, ' ', p_type, ' x')"),
    "text_flag_name": Derived("part", ["concat(p_brand, '-', p_name, ', U.S.A.')"], lambda c: text.normalize(c, 4 | 64), "concat(replace(lower(p_brand), '#', ' '), ' ', p_name, ' usa')"),
    "text_noop_normalizer": Derived("part", [f"concat(' ', {_pick('p_partkey', ['p_name', chr(39) * 2])}, ' ')"], text.noop_normalizer, "CASE WHEN p_partkey % 2 = 0 THEN p_name END"),
    "text_normalize_text": Derived("part", ["concat(upper(p_name), '/', p_brand)"], text.normalize_text, "concat(p_name, ' ', replace(lower(p_brand), '#', ' '))"),
    "text_remove_emoji": Derived("part", ["replace(p_name, ' ', '😀')"], text.remove_emoji, "replace(p_name, ' ', '')"),
    "text_remove_bracketed": Derived("part", ["concat(p_name, ' (', p_brand, ') [', p_type, '] end')"], lambda c: F.regexp_replace(text.remove_bracketed_text(c), " +", " "), "concat(p_name, ' end')"),
    "text_hash": Derived("part", ["concat(upper(p_name), ', ', p_brand, '!')"], text.text_hash, "sha1(replace(concat(replace(p_name, ' ', ''), lower(p_brand)), '#', ''))"),
    "text_is_stopword": Derived("part", [_pick("p_partkey", ["split_part(p_name, ' ', 1)", "'the'", "'and'"])], text.is_stopword, "arg0 IN ('the', 'and')", "boolean"),
    "text_is_nullword": Derived("part", [_pick("p_partkey", ["p_name", "'N/A'", "'Unknown'"])], lambda c: text.is_nullword(c, normalize=True), "p_partkey % 3 <> 0", "boolean"),
    "text_is_nullplace": Derived("nation", [_pick("n_nationkey", ["n_name", "'Overseas'"])], lambda c: text.is_nullplace(c, normalize=True), "n_nationkey % 2 = 1", "boolean"),
    "text_scripts": Derived("part", [_pick("p_partkey", ["p_name", "concat(p_name, ' мир 1')", "concat('中', p_name, ' мир')", "'12 #'"])], text.text_scripts, _pick("p_partkey", ["['Latin']", "['Cyrillic', 'Latin']", "['Cyrillic', 'Han', 'Latin']", "[]"]), "array<string>"),
    "text_codepoint_script": Derived("part", ["CAST(p_partkey % 1000 AS INT)"], text.codepoint_script, "CASE WHEN arg0 BETWEEN 65 AND 90 OR arg0 BETWEEN 97 AND 122 OR arg0 IN (170, 186) OR (arg0 BETWEEN 192 AND 696 AND arg0 NOT IN (215, 247)) OR arg0 BETWEEN 736 AND 740 THEN 'Latin' WHEN arg0 BETWEEN 768 AND 879 THEN 'Inherited' WHEN arg0 IN (746, 747) THEN 'Bopomofo' WHEN (arg0 BETWEEN 880 AND 993 OR arg0 > 993) AND arg0 NOT IN (884, 888, 889, 894, 896, 897, 898, 899, 901, 903, 907, 909, 930) AND NOT arg0 BETWEEN 994 AND 1007 THEN 'Greek' WHEN arg0 BETWEEN 994 AND 1007 THEN 'Coptic' WHEN arg0 IN (888, 889, 896, 897, 898, 899, 907, 909, 930) THEN NULL ELSE 'Common' END", where="p_partkey % 1000 < 880"),
    "text_common_scripts": Derived("part", [_pick("p_partkey", ["p_name", "concat(p_name, ' мир')", "'мир'"]), "concat(p_type, ' мир')"], text.common_scripts, _pick("p_partkey", ["['Latin']", "['Cyrillic', 'Latin']", "['Cyrillic']"]), "array<string>"),
    "text_can_latinize": Derived("part", [_pick("p_partkey", ["p_name", "concat(p_name, ' мир')", "concat(p_name, ' 東京')"])], text.can_latinize, "p_partkey % 3 < 2", "boolean"),
    "text_is_modern_alphabet": Derived("part", [_pick("p_partkey", ["p_name", "concat(p_name, ' мир')", "concat(p_name, ' 김')"])], text.is_modern_alphabet, "p_partkey % 3 < 2", "boolean"),
    "text_is_latin": Derived("part", [_pick("p_partkey", ["p_name", "concat(p_name, ' é')", "concat(p_name, ' мир')"])], text.is_latin, "p_partkey % 3 < 2", "boolean"),
    "text_is_dense_script": Derived("part", [_pick("p_partkey", ["p_name", "concat(p_name, ' 中')"])], text.is_dense_script, "p_partkey % 2 = 1", "boolean"),
    "text_maybe_ascii": Derived("documents", ["substr(text, 1, 400)"], text.maybe_ascii, "replace(strip_accents(arg0), 'ß', 'ss')", where="length(text) > 0 AND regexp_like(text, '^[A-Za-z0-9 .,äöüßÄÖÜéèêçñáíóúÉÈÊÇÑÁÍÓÚ]*$')"),
    "text_maybe_ascii_drop": Derived("part", [_pick("p_partkey", ["concat(p_name, 'é')", "concat(p_name, '中')"])], lambda c: text.maybe_ascii(c, drop=True), "CASE WHEN p_partkey % 2 = 0 THEN concat(p_name, 'e') ELSE '' END"),
    "text_string_number": Derived("part", [_pick("p_partkey", ["CAST(p_size AS STRING)", "translate(CAST(p_size AS STRING), '0123456789', '٠١٢٣٤٥٦٧٨٩')", "p_name"])], text.string_number, "CASE WHEN p_partkey % 3 < 2 THEN p_size END", "double"),
    "text_levenshtein": Derived("part", ["p_name", "concat(substr(p_name, 2), 'x')"], text.levenshtein, "levenshtein(arg0, arg1)", "int"),
    "text_levenshtein_cutoff": Derived("part", ["p_name", "lower(p_type)"], lambda a, b: text.raw_levenshtein_cutoff(a, b, 7), "least(levenshtein(arg0, arg1), 8)", "int"),
    "text_levenshtein_plausible": Derived("part", ["p_name", _pick("p_partkey", ["p_name", "concat(substr(p_name, 1, length(p_name) - 1), '#')", "reverse(concat(p_name, p_type))"])], text.is_levenshtein_plausible, "p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND floor(least(length(arg0), length(arg1)) * 0.2) >= 1)", "boolean"),
    "text_levenshtein_similarity": Derived("part", ["p_name", _pick("p_partkey", ["p_name", "concat(substr(p_name, 1, length(p_name) - 1), '#')", "p_type"])], lambda a, b: F.round(text.levenshtein_similarity(a, b), 9), "round(CASE WHEN p_partkey % 3 = 0 THEN 1.0 WHEN p_partkey % 3 = 1 AND floor(length(arg0) * 0.2) >= 1 THEN 1.0 - 1.0 / length(arg0) ELSE 0.0 END, 9)", "double"),
    "text_damerau": Derived("part", ["p_name", "concat(substr(p_name, 2, 1), substr(p_name, 1, 1), substr(p_name, 3))"], lambda a, b: text.damerau_levenshtein_cutoff(a, b, 5), "damerau_levenshtein(arg0, arg1)", "int"),
    "text_soundex": Derived("part", [_pick("p_partkey", _quote(["Robert", "Rupert", "Tymczak", "Pfister", "Honeyman"]))], text.soundex, _pick("p_partkey", _quote(["R163", "R163", "T522", "P236", "H555"]))),
    "text_tokenize_name": Derived("part", ["concat(p_brand, '-', p_name)"], text.tokenize_name, "string_split(replace(replace(arg0, '#', ' '), '-', ' '), ' ')", "array<string>"),
    "text_tokenize_name_min3": Derived("part", ["concat(p_brand, '-', p_name)"], lambda c: text.tokenize_name(c, 3), "list_filter(string_split(replace(replace(arg0, '#', ' '), '-', ' '), ' '), lambda x: length(x) >= 3)", "array<string>"),
}

_NAMED: dict[str, Derived] = {
    "name_remove_person_prefixes": Derived("part", [f"concat({_pick('p_partkey', _quote(['Mr. ', 'Dr ', 'Mrs. Dr. ', '']))}, {_NAMES})"], names.remove_person_prefixes, _NAMES),
    "name_remove_org_prefixes": Derived("part", [f"concat({_pick('p_partkey', _quote(['The ', 'the ', '']))}, {_NAMES})"], names.remove_org_prefixes, _NAMES),
    "name_remove_obj_prefixes": Derived("part", [f"concat({_pick('p_partkey', _quote(['M/V ', '']))}, {_NAMES})"], names.remove_obj_prefixes, _NAMES),
    "name_contains_split_phrase": Derived("part", [f"concat(p_name, {_pick('p_partkey', _quote([' also known as ', ' a.k.a. ', ' and ']))}, p_type)"], names.contains_split_phrase, "p_partkey % 3 < 2", "boolean"),
    "name_is_name": Derived("part", [_pick("p_partkey", ["p_name", "CAST(p_size AS STRING)", "concat('#', CAST(p_size AS STRING))", "'中'"])], names.is_name, "p_partkey % 4 IN (0, 3)", "boolean"),
    "name_is_stopword": Derived("part", [_pick("p_partkey", ["p_name", "'The'"])], lambda c: names.is_stopword(c, normalize=True), "p_partkey % 2 = 1", "boolean"),
    "name_is_nullword": Derived("part", [_pick("p_partkey", ["p_name", "'Unknown'"])], lambda c: names.is_nullword(c, normalize=True), "p_partkey % 2 = 1", "boolean"),
    "org_replace_compare": Derived("part", [f"concat(p_name, ' ', {_pick('p_partkey', _quote([f[0] for f in _FORMS]))})"], names.replace_org_types_compare, f"concat(p_name, ' ', {_pick('p_partkey', _quote([f[1] for f in _FORMS]))})"),
    "org_replace_display": Derived("part", [f"concat({_NAMES}, ' ', {_pick('p_partkey', _quote([f[0] for f in _FORMS]))})"], names.replace_org_types_display, f"concat({_NAMES}, ' ', {_pick('p_partkey', _quote([f[2] for f in _FORMS]))})"),
    "org_remove": Derived("part", [f"concat(p_name, ' ', {_pick('p_partkey', _quote([f[0] for f in _FORMS]))})"], lambda c: F.trim(names.remove_org_types(c)), "CASE WHEN p_partkey % 4 = 3 THEN arg0 ELSE p_name END"),
    "org_extract": Derived("part", [f"concat(p_name, ' ', {_pick('p_partkey', _quote([f[0] for f in _FORMS]))})"], lambda c: F.transform(names.extract_org_types(c), lambda x: x["target"]), "CASE WHEN p_partkey % 4 = 3 THEN [] ELSE [" + _pick("p_partkey", _quote([f[1] for f in _FORMS])) + "] END", "array<string>"),
    "bag_pick_case": Derived("part", [f"array(p_name, upper(p_name), {_NAMES})"], names.pick_case, _NAMES),
    "bag_reduce_names": Derived("part", [f"array(upper(p_name), p_brand, {_NAMES})"], names.reduce_names, f"[{_NAMES}, p_brand]", "array<string>"),
    "bag_pick_name": Derived("part", [f"array(upper(p_name), {_NAMES}, {_NAMES})"], names.pick_name, _NAMES),
    "bag_representative_names": Derived("part", [f"array(upper(p_name), {_NAMES})"], lambda c: names.representative_names(c, 2), f"[{_NAMES}]", "array<string>"),
    "bag_list_intersection": Derived("part", ["array(p_name, p_brand, p_name, p_type)", "array(p_type, p_name, p_name)"], names.list_intersection, "[p_name, p_name, p_type]", "array<string>"),
    "bag_latin_share": Derived("part", [_pick("p_partkey", ["p_name", "'мир'", "'中'", "CAST(p_size AS STRING)"])], names.latin_share, "CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.3 ELSE 0.0 END", "double"),
    "bag_case_error_score": Derived("part", ["split_part(p_name, ' ', 1)"], names.case_error_score, "(length(arg0) + 2.0) / length(arg0)", "double"),
    "part_comparable": Derived("part", [_pick("p_partkey", ["split_part(p_name, ' ', 1)", "concat('00', CAST(p_size AS STRING))", "'münchen'"])], lambda c: names.name_part(c)["comparable"], "CASE p_partkey % 3 WHEN 0 THEN arg0 WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE 'munchen' END"),
    "part_ascii": Derived("part", [_pick("p_partkey", ["split_part(p_name, ' ', 1)", "'中国'"])], lambda c: names.name_part(c)["ascii"], "CASE WHEN p_partkey % 2 = 0 THEN arg0 END"),
    "part_integer": Derived("part", [_pick("p_partkey", ["split_part(p_name, ' ', 1)", "CAST(p_partkey AS STRING)"])], lambda c: names.name_part(c)["integer"], "CASE WHEN p_partkey % 2 = 1 THEN p_partkey END", "bigint"),
    "part_tag_can_match": Derived("part", [_pick("p_partkey", _quote(["UNSET", "GIVEN", "FAMILY", "MIDDLE", "NUM"])), _pick("p_size", _quote(["GIVEN", "FAMILY", "UNSET", "NUM"]))], names.tag_can_match,
                                  "arg0 = 'UNSET' OR arg1 = 'UNSET' OR arg0 = arg1 OR (arg0 IN ('GIVEN', 'MIDDLE') AND arg1 IN ('GIVEN', 'MIDDLE')) OR (arg0 IN ('FAMILY', 'NUM') AND arg1 IN ('FAMILY', 'NUM'))", "boolean"),
    "name_object_norm_form": Derived("part", ["concat(p_brand, '-', upper(p_name))"], lambda c: names.name_object(c)["norm_form"], "concat(replace(lower(p_brand), '#', ' '), ' ', p_name)"),
    "name_tagger_org": Derived("part", [f"concat(p_name, ' ', {_pick('p_partkey', _quote([f[0] for f in _FORMS]))})"], lambda c: F.array_distinct(F.transform(F.filter(names.tag_phrases(c), lambda x: x["category"] == "ORGCLS"), lambda x: x["id"])), _pick("p_partkey", ["['JSC']", "['LLC']", "['LLC']", "[]"]), "array<string>"),
    "corpus_clean_form": Derived("part", [_pick("p_partkey", ["concat(upper(p_name), ' (x)')", "CAST(p_size AS STRING)", "repeat(p_name, 9)"])], corpus.clean_form, "CASE WHEN p_partkey % 3 = 0 THEN p_name END"),
    "territory_clean_code": Derived("nation", ["concat(' ', n_name, ' ')"], territories.clean_code, "replace(lower(n_name), '_', '-')"),
    "territory_clean_codes": Derived("nation", ["array(n_name, 'x', concat(' ', lower(n_name)))"], territories.clean_codes, "[replace(lower(n_name), '_', '-'), replace(lower(n_name), '_', '-')]", "array<string>"),
    "territory_normal_name": Derived("part", ["concat(upper(p_name), ', U.S.-', p_type)"], territories.normalize_territory_name, "concat(p_name, ' us', lower(p_type))"),
    "territory_intersect": Derived("part", [f"array({_pick('p_partkey', _quote(['us', 'de', 'fr', 'cn-hk']))})", f"array({_pick('p_size', _quote(['us', 'de', 'us-ca', 'hk']))}, 'xx')"], territories.territories_intersect, "CASE WHEN p_partkey % 4 = 0 AND p_size % 4 = 0 THEN ['us'] WHEN p_partkey % 4 = 1 AND p_size % 4 = 1 THEN ['de'] WHEN p_partkey % 4 = 0 AND p_size % 4 = 2 THEN ['us-ca'] WHEN p_partkey % 4 = 3 AND p_size % 4 = 3 THEN ['hk'] ELSE [] END", "array<string>"),
    "address_clean": Derived("part", ["concat(', ', p_name, '  ,', p_brand, ',, ', p_type, chr(10), ' ,')"], addresses.clean_address, "concat(p_name, ',', p_brand, ', ', p_type)"),
    "address_normalize": Derived("part", [_pick("p_partkey", ["concat(upper(p_name), ' Str. ', CAST(p_size AS STRING), ', ', p_type)", "'a b'"])], addresses.normalize_address, "CASE WHEN p_partkey % 2 = 0 THEN concat(p_name, ' str ', CAST(p_size AS VARCHAR), ' ', lower(p_type)) END"),
    "address_normalize_latinize": Derived("part", ["concat(upper(p_name), ' Straße ', CAST(p_size AS STRING), ', é')"], lambda c: addresses.normalize_address(c, latinize=True), "concat(p_name, ' strasse ', CAST(p_size AS VARCHAR), ' e')"),
    "address_shorten": Derived("part", ["concat(CAST(p_size + 100 AS STRING), ' ', split_part(p_name, ' ', 2), ' street')"], addresses.shorten_address_keywords, "concat(CAST(p_size + 100 AS VARCHAR), ' ', split_part(p_name, ' ', 2), ' st')", where="p_size > 1"),
    "address_remove": Derived("part", ["concat(CAST(p_size + 100 AS STRING), ' ', split_part(p_name, ' ', 2), ' street')"], lambda c: F.trim(addresses.remove_address_keywords(c)), "concat(CAST(p_size + 100 AS VARCHAR), ' ', split_part(p_name, ' ', 2))", where="p_size > 1"),
    "address_format": Derived("part", ["concat('road=', p_name, ' Str.|house_number=', CAST(p_size AS STRING), '|postcode=86150|city=', p_type)", "'DE'"], lambda p, c: addresses.format_address(F.str_to_map(p, F.lit("[|]"), F.lit("=")), c), "concat(p_name, ' Str. ', CAST(p_size AS VARCHAR), chr(10), '86150 ', p_type)"),
    "address_format_line": Derived("part", ["concat('road=', p_name, ' Str.|house_number=', CAST(p_size AS STRING), '|postcode=86150|city=', p_type)", "'DE'"], lambda p, c: addresses.format_address_line(F.str_to_map(p, F.lit("[|]"), F.lit("=")), c), "concat(p_name, ' Str. ', CAST(p_size AS VARCHAR), ', 86150 ', p_type)"),
}

_DAY = "concat(CAST(1990 + o_orderkey % 40 AS STRING), '-', lpad(CAST(1 + o_orderkey % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'))"
_stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
_shown = lambda e: f"strftime({e}, '%Y-%m-%d %H:%M:%S')"

_MISC: dict[str, Derived] = {
    "url_clean": Derived("pages", [_pick("page_id", ["url", "concat(' ', replace(url, 'https://', 'HTTPS://'))", "replace(replace(url, 'https://', ''), 'http://', '')", "'banana'"])], urls.clean_url, _pick("page_id", ["y", "y", "replace(y, 'https://', 'http://')", "NULL"]), let=[("y", "CASE WHEN length(url) - length(replace(url, '/', '')) = 2 THEN concat(url, '/') ELSE url END")], where="url IS NOT NULL AND url LIKE 'http%://%/%'"),
    "url_compare": Derived("pages", ["url", _pick("page_id", ["replace(url, 'https://', 'http://')", "concat(url, 'x1')"])], urls.compare_urls, "CASE WHEN page_id % 2 = 0 THEN 1.0 ELSE 0.0 END", "double", where="url LIKE 'http%' AND url NOT LIKE '%#%'"),
    "url_build": Derived("pages", ["url"], lambda c: urls.build_url(c, {"q": "bla"}), "concat(url, '?q=bla')", where="url LIKE 'http%' AND url NOT LIKE '%?%' AND url NOT LIKE '%#%'"),
    "date_prefix_start": Derived("orders", [_DAY], lambda c: _stamp(misc.prefix_interval(c)["start"]), _shown("CAST(arg0 AS TIMESTAMP)")),
    "date_prefix_end": Derived("orders", [_DAY], lambda c: _stamp(misc.prefix_interval(c)["end"]), _shown("CAST(arg0 AS TIMESTAMP) + INTERVAL 1 DAY")),
    "date_prefix_year": Derived("orders", [f"substr({_DAY}, 1, 4)"], lambda c: _stamp(misc.prefix_interval(c)["end"]), "concat(CAST(CAST(arg0 AS INTEGER) + 1 AS VARCHAR), '-01-01 00:00:00')"),
    "date_parse_utc": Derived("orders", [f"concat({_DAY}, 'T12:30:00', {_pick('o_orderkey', _quote(['', 'Z', '-04', '+0130']))})"], lambda c: _stamp(misc.parse_utc(c)), _shown(f"CAST(replace(substr(arg0, 1, 19), 'T', ' ') AS TIMESTAMP) + {_pick('o_orderkey', ['INTERVAL 0 MINUTE', 'INTERVAL 0 MINUTE', 'INTERVAL 240 MINUTE', 'INTERVAL (-90) MINUTE'])}")),
    "date_ended_before": Derived("orders", [_DAY], lambda c: misc.ended_before(c, F.lit("2005-03-05 00:00:00").cast("timestamp")), "CAST(arg0 AS TIMESTAMP) + INTERVAL 1 DAY <= TIMESTAMP '2005-03-05 00:00:00'", "boolean"),
    "date_starts_after": Derived("orders", [_DAY], lambda c: misc.starts_after(c, F.lit("2005-03-05 00:00:00").cast("timestamp")), "CAST(arg0 AS TIMESTAMP) > TIMESTAMP '2005-03-05 00:00:00'", "boolean"),
    "date_iso_datetime": Derived("orders", [_pick("o_orderkey", [f"concat({_DAY}, ' 12:00:00.123')", "'x'"])], lambda c: misc.datetime_iso(misc.iso_datetime(c)), "CASE WHEN o_orderkey % 2 = 0 THEN concat(substr(arg0, 1, 10), 'T12:00:00+00:00') END"),
    "bool_text": Derived("events", ["CASE WHEN event_id % 3 = 0 THEN NULL ELSE value > 50 END"], misc.bool_text, "CASE WHEN event_id % 3 <> 0 THEN CASE WHEN value > 50 THEN 't' ELSE 'f' END END"),
    "text_bool": Derived("events", [_pick("event_id", _quote(["Yes", "t", "no", "0", ""]))], misc.text_bool, _pick("event_id", ["TRUE", "TRUE", "FALSE", "FALSE", "NULL"]), "boolean"),
    "unit_normalize": Derived("part", [_pick("p_partkey", ["'centimetres'", "'Penny'", "p_type"])], misc.normalize_unit, _pick("p_partkey", ["'cm'", "'p'", "arg0"])),
    "lang_alpha3": Derived("documents", [_pick("doc_id", ["lang", "concat(upper(lang), ' ')", "concat(lang, '_XX')", "'banana'"])], misc.iso_639_alpha3, "CASE WHEN doc_id % 4 < 3 THEN CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' END END", where="lang IN ('en', 'de', 'fr', 'es')"),
    "lang_alpha2": Derived("documents", [_pick("lang_no", _quote(["eng", "DEU ", "fra"]))], misc.iso_639_alpha2, _pick("lang_no", _quote(["en", "de", "fr"])), let=[("lang_no", "doc_id % 3")]),
    "lang_list": Derived("documents", ["array(lang, 'xx', lang)"], misc.list_to_alpha3, "CASE lang WHEN 'en' THEN ['eng'] WHEN 'de' THEN ['deu'] WHEN 'fr' THEN ['fra'] ELSE ['spa'] END", "array<string>", where="lang IN ('en', 'de', 'fr', 'es')"),
    "lang_normalize_code": Derived("documents", [_pick("doc_id", ["concat(' ', upper(lang), ' ')", "'  '"])], misc.normalize_code, "CASE WHEN doc_id % 2 = 0 THEN lang END", where="lang IS NOT NULL"),
    "mime_normalize": Derived("part", [_pick("p_partkey", ["concat('TEXT/ ', upper(replace(p_name, ' ', '-')), '; a=b')", "p_name", "'text/xml; charset=x; charset=y'"])], misc.normalize_mimetype, _pick("p_partkey", ["concat('text/', replace(p_name, ' ', '-'))", "'application/octet-stream'", "'application/xml'"])),
    "mime_useful": Derived("part", [_pick("p_partkey", ["concat('image/', split_part(p_name, ' ', 1))", "'text/plain'", "p_name"])], misc.useful_mimetype, "p_partkey % 3 = 0", "boolean"),
    "mime_label": Derived("part", ["concat('application/x-', replace(p_name, ' ', '-'))"], misc.mimetype_label, "p_name"),
    "mime_charset": Derived("part", [_pick("p_partkey", ["'text/plain; charset=CP1251; charset=x'", "concat('text/plain; charset=', split_part(p_name, ' ', 2))", "'text/plain'"])], misc.mimetype_charset, _pick("p_partkey", ["'cp1251'", "'utf-8'", "NULL"])),
    "mime_parse_name": Derived("part", ["concat('Image/', upper(split_part(p_name, ' ', 1)), ' ; q=1')"], lambda c: misc.parse_mimetype(c)["name"], "concat('image/', split_part(p_name, ' ', 1))"),
    "file_extension": Derived("part", [f"concat(p_name, {_pick('p_partkey', _quote(['.DOC', '..Txt', '.x y']))})"], misc.normalize_extension, _pick("p_partkey", _quote(["doc", "txt", "xy"]))),
    "file_name_extension": Derived("part", [f"concat(p_name, {_pick('p_partkey', _quote(['.DOC', '']))})"], lambda c: misc.file_name(c)["extension"], "CASE WHEN p_partkey % 2 = 0 THEN 'doc' END"),
    "file_name_safe": Derived("part", ["concat(p_name, ' ', p_brand, '.pdf')"], misc.safe_file_name, "concat(replace(replace(concat(p_name, ' ', p_brand), ' ', '_'), '#', '_'), '.pdf')"),
    "id_imo_valid": Derived("customer", ["concat('IMO ', x)"], _format("imo", "valid"), "(c = v OR c = k) AND x <> '0000000'", "boolean", _IMO),
    "id_imo_normalize": Derived("customer", ["concat('no. ', x, ' of ship')"], _format("imo", "normalize"), "CASE WHEN (c = v OR c = k) AND x <> '0000000' THEN concat('IMO', x) END", "string", _IMO),
    "id_imo_vessel": Derived("customer", ["concat('IMO ', x)"], ids.is_valid_vessel, "c = v AND x <> '0000000'", "boolean", _IMO),
    "id_imo_company": Derived("customer", ["concat('IMO ', x)"], ids.is_valid_company, "c = k AND x <> '0000000'", "boolean", _IMO),
    "id_ogrn_control_digit": Derived("orders", [f"concat('1', {_padded('o_orderkey', 11)}, '0')"], ids.ogrn_control_digit, "CAST(substr(arg0, 1, 12) AS BIGINT) % 11 % 10", "int"),
}

_MORE: dict[str, Derived] = {
    "text_normalize_name": Derived("part", ["concat(p_brand, '-', upper(p_name))"], text.normalize_name, "concat(replace(lower(p_brand), '#', ' '), ' ', p_name)"),
    "text_metaphone": Derived("part", [_pick("p_partkey", _quote(["Robert", "Philadelphia", "Knight", "Smith"]))], text.metaphone, _pick("p_partkey", _quote(["RBRT", "FLTLF", "NT", "SM0"]))),
    "part_metaphone": Derived("part", [_pick("p_partkey", ["'robert'", "'li'", "CAST(p_size AS STRING)"])], lambda c: names.name_part(c)["metaphone"], _pick("p_partkey", ["'RBRT'", "NULL", "NULL"])),
    "text_jaro_winkler_floor": Derived("part", ["p_name", _pick("p_partkey", ["p_name", "'###'"])], text.jaro_winkler, "CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END", "double"),
    "name_is_generic_person": Derived("part", [_pick("p_partkey", ["'abdul aziz'", "p_name"])], names.is_generic_person_name, "p_partkey % 2 = 0", "boolean"),
    "org_replace_generic": Derived("part", [f"concat(p_name, ' ', {_pick('p_partkey', _quote(['ag', 'gmbh', 'banana']))})"], lambda c: names.replace_org_types_compare(c, generic=True), f"concat(p_name, ' ', {_pick('p_partkey', _quote(['jsc', 'llc', 'banana']))})"),
    "bag_pick_lang_name": Derived("part", ["array(concat(p_name, '@deu'), concat(p_type, '@eng'))"], lambda c: names.pick_lang_name(F.transform(c, lambda x: F.struct(F.substring_index(x, "@", 1).alias("text"), F.substring_index(x, "@", -1).alias("lang")))), "p_type"),
    "lang_is_better": Derived("part", [_pick("p_partkey", _quote(["eng", "fra", "xxx"])), _pick("p_size", _quote(["deu", "eng"]))], misc.is_lang_better, "(p_partkey % 3 = 0 AND p_size % 2 = 0)", "boolean", where="p_partkey % 3 <> 1 OR p_size % 2 = 1"),
    "lang_expand_synonyms": Derived("part", [_pick("p_partkey", _quote(["eng", "sqi"]))], misc.expand_synonyms, "CASE WHEN p_partkey % 2 = 0 THEN ['eng'] ELSE ['sqi', 'alb'] END", "array<string>"),
    "mime_extension": Derived("part", [_pick("p_partkey", ["'application/pdf'", "p_name", "'IMAGE/PNG; a=b'"])], misc.mimetype_extension, _pick("p_partkey", ["'pdf'", "NULL", "'png'"])),
    "id_imo_format": Derived("customer", ["x"], _format("imo", "format"), "concat('IMO', x)", "string", _IMO, "c_custkey % 3 < 2"),
    "url_clean_compare": Derived("pages", ["concat(replace(url, 'http://', 'https://www.'), '?')"], urls.clean_url_compare, "replace(CASE WHEN length(url) - length(replace(url, '/', '')) = 2 THEN concat(url, '/') ELSE url END, 'www.', '')", where="url LIKE 'http://%' AND url NOT LIKE '%?%' AND url NOT LIKE '%#%' AND lower(url) = url"),
}

_COLOURS = {"red": "R", "red ring": "RR", "ring": "G", "old": "O", "gear": "E", "small bolt": "SB", "bolt": "B"}
_MORE |= {
    "needles_find": Derived("part", ["concat(upper(p_name), ' ', p_brand)"], lambda c: F.transform(text.find_needles(c, _COLOURS), lambda x: F.concat_ws(":", x["begin"], x["payload"])),
                            "list_filter([CASE WHEN p_name = 'red ring' THEN '0:RR' WHEN p_name = 'small bolt' THEN '0:SB' WHEN p_name LIKE 'red %' THEN '0:R' WHEN p_name LIKE 'old %' THEN '0:O' END, CASE WHEN p_name LIKE '% ring' AND p_name <> 'red ring' THEN concat(position(' ' IN p_name), ':G') WHEN p_name LIKE '% gear' THEN concat(position(' ' IN p_name), ':E') WHEN p_name LIKE '% bolt' AND p_name <> 'small bolt' THEN concat(position(' ' IN p_name), ':B') END], lambda x: x IS NOT NULL)", "array<string>"),
    "needles_overlapping": Derived("part", ["p_name"], lambda c: F.array_sort(F.transform(text.find_needles(c, _COLOURS, overlapping=True), lambda x: x["payload"])),
                                   "list_sort(list_filter([CASE WHEN p_name = 'red ring' THEN 'RR' END, CASE WHEN p_name = 'small bolt' THEN 'SB' END, CASE WHEN p_name LIKE 'red %' THEN 'R' END, CASE WHEN p_name LIKE 'old %' THEN 'O' END, CASE WHEN p_name LIKE '% ring' THEN 'G' END, CASE WHEN p_name LIKE '% gear' THEN 'E' END, CASE WHEN p_name LIKE '% bolt' THEN 'B' END], lambda x: x IS NOT NULL))", "array<string>"),
    "name_contains_org": Derived("part", ["concat(p_name, ' ', p_type)", _pick("p_partkey", ["upper(p_name)", "p_brand", "concat(p_name, ' ', p_type)"])], names.name_contains, "p_partkey % 3 = 0", "boolean"),
    "name_contains_person": Derived("part", ["concat(p_name, ' ', p_type)", "concat(p_type, ' ', split_part(p_name, ' ', 1))"], lambda a, b: names.name_contains(a, b, "PER"), "TRUE", "boolean"),
    "part_tag_order": Derived("part", [f"array({_pick('p_partkey', _quote(['FAMILY', 'SUFFIX', 'NUM']))}, 'GIVEN', 'LEGAL', 'HONORIFIC')"], lambda c: F.transform(F.array_sort(F.transform(c, lambda t: F.struct(names.tag_order(t).alias("k"), t.alias("t")))), lambda x: x["t"]), f"['HONORIFIC', 'GIVEN', {_pick('p_partkey', _quote(['FAMILY', 'SUFFIX', 'NUM']))}, 'LEGAL']", "array<string>"),
    "date_utc_now": Derived("supplier", ["s_name"], lambda c: F.when(c.isNotNull(), (F.abs(F.unix_timestamp(misc.utc_now()) - F.unix_timestamp(F.current_timestamp())) < 2) & (F.abs(F.datediff(misc.utc_date(), F.current_date())) <= 1) & misc.naive_now().isNotNull()), "TRUE", "boolean"),
}

CASES: dict[str, Derived] = {**_IDS, **_TEXT, **_NAMED, **_MISC, **_MORE}
