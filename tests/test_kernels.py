"""Kernels against models, invariants of name analysis and comparison, and property tests of native expressions."""

import itertools
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrain.functions import addresses as A
from lexigrain.functions import ids, misc, urls
from lexigrain.functions import names as NF
from lexigrain.functions import text as T
from lexigrain.kernels import addresses, bags, distance, names, normal, org_types, pairs, unicode
from lexigrain.kernels.needles import Needles
from lexigrain.kernels.phonetics import metaphone
from lexigrain.operators import names as ops
from lexigrain.operators import territories

SAMPLES = ["", " ", "Bashar al-Assad", "O’Brien  (jr.)", "Straße №5", "中国 ー々", "a﷽b", "ǅ x", "¼ ½ x²", "$100 €5", "x­​y", "Ä̈́", "क्षि ab", "\x1c\x1d tab\t", "İ İ", "ʹʼ ʰ", "１２ ⅫⅣ", "mixed🎉emoji", "no line", "_under_score"]


def model(text, flags, cleanup):
    return normal.normalize(text, flags, cleanup)


@pytest.mark.parametrize("flags,cleanup", [(1, 0), (2, 0), (4, 0), (32, 0), (16, 0), (8, 0), (6, 1), (6, 2), (4 | 64, 0), (1 | 2 | 4 | 32, 1)])
def test_native_normalisation_equals_the_model(spark, flags, cleanup):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    got = [r[0] for r in df.select(T.normalize("s", flags, cleanup)).collect()]
    assert got == [model(s, flags, cleanup) for s in SAMPLES]


# Java's character classes are of Unicode 13; newer letters differ.
@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x7FF, exclude_categories=["Cs", "Cn"], exclude_characters="\x00"), max_size=20), min_size=1, max_size=20))
def test_tokens_equal_the_model(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    assert [r[0] for r in df.select(T.tokenize_name("s")).collect()] == [list(normal.tokens(v)) for v in values]


def test_clean_address_is_where_no_rule_applies_any_more(spark):
    """Against rewriting one place at a time."""
    rules = [(r"\s\s+", " "), (r"\s,", ","), (r",,+", ","), (r"\A[,\s]", ""), (r"[,\s]\Z", "")]

    def rewritten(text):
        while True:
            after = next((new for rule, by in rules if (new := re.sub(rule, by, text, count=1)) != text), text)
            if after == text:
                return text
            text = after

    parts = ["a", " ", ",", ",,", "  ", "b", " ,", "\n", ", "]
    values = ["".join(p) for n in range(1, 5) for p in itertools.product(parts, repeat=n)][:6000]
    assert [addresses.clean(v) for v in values] == [rewritten(v) for v in values]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    assert [r[0] for r in df.select(A.clean_address("s")).collect()] == [addresses.clean(v) for v in values]


def test_pairs_compared_in_batches_equal_one_by_one(spark):
    rng = np.random.default_rng(4)
    words = "john mary o'brien smith johnson petrov ivanov garcia müller schmidt acme trading limited holdings 12 2024 b".split()

    def name():
        tokens = ["".join(c if rng.random() > 0.1 else str(rng.choice(list("abo01l "))) for c in words[k]) for k in rng.integers(0, len(words), rng.integers(0, 6))]
        return names.Name(" ".join(tokens))

    left, right = [name() for _ in range(600)], [name() for _ in range(600)]
    right[::3] = [names.Name(a.original.replace("o", "0", 1)[:-1] + " x") for a in left[::3]]
    long = names.Name(" ".join(f"part{i}" for i in range(120)))
    left[0], right[0], right[1] = long, long, long
    for config in (names.CompareConfig(), names.CompareConfig(cost_confusable=0.3, budget_tolerance=2.0, cluster_overlap_min=0.2)):
        got = pairs.compare_parts([[p.comparable for p in a.parts] for a in left], [[p.comparable for p in b.parts] for b in right], config)
        for a, b, found in zip(left, right, got):
            want = names.compare_parts(a.parts, b.parts, config)
            assert [([p.index for p in x.qps], [p.index for p in x.rps]) for x in want] == [c[:2] for c in found]
            assert [x.score for x in want] == pytest.approx([c[2] for c in found], abs=1e-12)
    record = NF.name_record
    df = spark.createDataFrame([(i, record(a), record(b)) for i, (a, b) in enumerate(zip(left[:200], right[:200]))], f"k long, left {NF.NAME}, right {NF.NAME}")
    for r in ops.compare_parts(df).collect():
        want = names.compare_parts(left[r.k].parts, right[r.k].parts)
        assert [(x.qps, x.rps, x.category, x.qstr, x.rstr) for x in r.result] == [([p.index for p in x.qps], [p.index for p in x.rps], None, x.qstr, x.rstr) for x in want]


def test_metaphone_equals_the_jvm_class(spark):
    jvm = spark.sparkContext._jvm.org.apache.commons.codec.language.Metaphone()
    jvm.setMaxCodeLen(64)
    words = "Knight Gnome Wright Whale Xavier Thumb Science Church School Dodge Laugh Night Sign Signed Ghost Nation Match Judge Aebersold McDonald Ague Phone Sheep Vision Bough Eringnt Accident Hugh Pneumatic Wychwood Zzyzx Czech".split()
    assert [metaphone(w) for w in words] == [jvm.metaphone(w) for w in words]


def test_latin_letters_become_ascii():
    blocks = (*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07))
    left = [c for c in map(chr, blocks) if unicode.char_script(c) == "Latin" and unicodedata.category(c)[0] == "L" and not unicode.maybe_ascii(c).isascii()]
    assert not left


def test_distances():
    words = ["", "a", "ab", "ba", "abc", "acb", "cab", "banana", "bandana"]

    def slow(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(slow(a[1:], b) + 1, slow(a, b[1:]) + 1, slow(a[1:], b[1:]) + (a[0] != b[0]))

    for a, b in itertools.product(words[:7], repeat=2):
        d = slow(a, b)
        assert distance.levenshtein(a, b) == d
        assert distance.levenshtein(a, b, 1) == min(d, 2)
        assert distance.damerau(a, b) <= d and distance.damerau(a, b) == distance.damerau(b, a)
        assert distance.jaro(a, b) == pytest.approx(distance.jaro(b, a))


def test_needles_stand_alone_and_longest_win():
    n = Needles([("new york", 1), ("york", 2), ("new", 3), ("", 4), ("york", 5)])
    assert [(a, b, p) for a, b, p in n.found("New York, yorkshire york")] == [(0, 8, 1), (20, 24, 5)]
    assert sorted(p for _, _, p in n.overlapping("new york")) == [1, 3, 5]
    assert n.found("стyork newé") == []


def test_org_types():
    assert org_types.replace_display("SIEMENS AKTIENGESELLSCHAFT") == "SIEMENS AG"
    assert org_types.replace_compare("") == ""
    assert org_types.extract("acme limited liability company") and not org_types.extract("acmelimited")


def analyzed(kind, *values, **options):
    return names.analyze(kind, values, **options)


def test_part_tags_first_writer_wins():
    (n,) = analyzed("PER", "Jean Claude Juncker", part_tags=[("GIVEN", ["Jean Claude"]), ("FAMILY", ["Juncker"])])
    assert [p.tag for p in n.parts] == ["GIVEN", "GIVEN", "FAMILY"]
    (n,) = analyzed("PER", "Don Camillo", part_tags=[("HONORIFIC", ["Don"]), ("FAMILY", ["Don"])])
    assert n.parts[0].tag in ("HONORIFIC", "AMBIGUOUS")


def test_analysis_of_organisations():
    (n,) = analyzed("ORG", "Siemens Aktiengesellschaft")
    assert n.form == "siemens ag" and ("ORGCLS", "JSC") in n.symbols and n.parts[1].tag == "LEGAL"
    (n,) = analyzed("ENT", "Acme Limited Liability Partnership")
    assert n.tag == "ORG"
    (n,) = analyzed("ENT", "Vladimir Putin")
    assert n.tag == "ENT"
    (n,) = analyzed("ORG", "The 5th Bank", symbols=False)
    assert not n.spans


def test_corpus_symbols():
    corpus = tuple(names.read_corpus(["vladimir, wladimir => Q1", "solo => Q2", "bad line", "putin, poutine => Q3"]))
    assert [id for _, id in corpus] == ["Q1", "Q3"]
    (n,) = analyzed("PER", "Wladimir Poutine", corpus=corpus)
    assert {("NAME", "Q1"), ("NAME", "Q3")} <= n.symbols
    (m,) = analyzed("PER", "Vladimir Putin", corpus=corpus)
    pairings = names.pair_symbols(m, n)
    assert len(pairings) == 1 and {a.symbol for a in pairings[0]} >= {("NAME", "Q1")}


def test_greedy_walk_leaves_gaps():
    n = names.Name("a x b")
    n.apply_phrase("a b", "SYMBOL", "AB")
    assert [[p.index for p in s.parts] for s in n.spans] == [[0, 2]]


def test_consolidation_keeps_one_of_each():
    got = analyzed("PER", "John Smith", "John Fitzgerald Smith", "JOHN SMITH")
    assert [n.form for n in got] == ["john fitzgerald smith"]


def parts(text):
    return names.Name(text).parts


@pytest.mark.parametrize("q,r", [("vladimir putin", "putin vladimir"), ("john doe", "jon do"), ("a b c", "abc"), ("x", ""), ("acme 5", "acme 6"), ("ab cd ef gh", "abcd efgh")])
def test_comparison_invariants(q, r):
    found = names.compare_parts(parts(q), parts(r))
    assert sorted(p.index for a in found for p in a.qps) == list(range(len(parts(q))))
    assert sorted(p.index for a in found for p in a.rps) == list(range(len(parts(r))))
    assert all(0 <= a.score <= 1 for a in found)
    assert [(a.qstr, a.rstr, a.score) for a in found] == [(a.qstr, a.rstr, a.score) for a in names.compare_parts(parts(q), parts(r))]


def test_comparison_scores():
    score = lambda q, r, **k: max(a.score for a in names.compare_parts(parts(q), parts(r), names.CompareConfig(**k)))
    assert score("vladimir", "vladimir") == 1 and 0.6 < score("vladimir", "vladimer") < 1
    assert score("contr0l", "control") > score("contrxl", "control")
    assert score("abcdefghij", "zzcdefghzz", budget_tolerance=0.5) == 0 < score("abcdefghij", "zzcdefghzz", budget_tolerance=3.0)


def test_order_alignment():
    left, right = names.align_person_name_order(parts("john doe"), parts("doe john"))
    assert [p.form for p in left] == [p.form for p in right]
    left, right = names.align_person_name_order(parts("vandamme jean"), parts("jean van damme"))
    assert "".join(p.form for p in left) == "".join(p.form for p in right)
    assert names.align_person_name_order([], parts("a b")) == ([], parts("a b"))


@pytest.mark.parametrize(
    ("left", "right", "want_left", "want_right"),
    [
        ("John Dow", "Doe, John", "john dow", "john doe"), ("John Richard Smith", "Smith, John", "smith john richard", None), ("John Richard Smyth", "Smith, John", "john smyth richard", "john smith"),
        ("Vladimir Vladimirovitch Putin", "Vladimir Pudin", "vladimir putin vladimirovitch", None), ("Ali Al-Sabah", "Alsabah, Ali", "ali al sabah", "ali alsabah"), ("RamiMakhlouf", "Maklouf, Ramy", None, "ramy maklouf"),
        ("Usmanov Alisher", "AlisherUsmanov", "alisher usmanov", None),
    ],
)
def test_order_of_pairs(left, right, want_left, want_right):
    got = [" ".join(p.form for p in side) for side in names.align_person_name_order(parts(left), parts(right))]
    assert want_left in (None, got[0]) and want_right in (None, got[1])


def test_tag_sort_is_stable():
    ps = [names.Part(c, i, t) for i, (c, t) in enumerate([("a", "UNSET"), ("b", "STOP"), ("c", "GIVEN"), ("d", "LEGAL")])]
    assert [p.form for p in names.tag_sort(ps)] == ["c", "a", "b", "d"]


def test_name_records_round_trip(spark):
    rows = spark.createDataFrame([("1", "ORG", ["Siemens AG", "Siemens Aktiengesellschaft", None]), ("2", "PER", ["Dr. John Smith"]), ("3", None, None)], "entity_id string, type_tag string, names array<string>")
    got = ops.analyze_names(rows).collect()
    assert {(r.entity_id, r.name.form) for r in got} == {("1", "siemens ag"), ("2", "john smith")}
    again = NF.name_from(got[0].name.asDict(recursive=True))
    assert NF.name_record(again) == got[0].name.asDict(recursive=True)


def test_tagging_by_join_finds_what_the_automaton_finds(spark):
    texts = ["bank of russia limited", "acme bank", "nothing here"]
    tokens = spark.createDataFrame([(t, t.split()) for t in texts], "entity_id string, tokens array<string>")
    needles = spark.createDataFrame([("bank", "DOMAIN", "BANK"), ("russia", "LOC", "ru"), ("limited", "ORGCLS", "LLC")], "phrase string, category string, id string")
    got = {(r.entity_id, r.phrase) for r in ops.tag_by_join(tokens, needles).collect()}
    assert got == {(t, w) for t in texts for w in t.split() if w in ("bank", "russia", "limited")}


def test_grouped_choices_equal_the_kernels(spark):
    rows = [("a", "JOHN"), ("a", "John"), ("b", "Владимир"), ("b", "Vladimir"), ("b", "VLADIMIR"), ("b", None)]
    df = spark.createDataFrame(rows, "k string, n string")
    bag = lambda k: [n for x, n in rows if x == k and n]
    assert {r.k: r.n for r in ops.pick_case(df, ["k"], "n").collect()} == {k: bags.pick_case(bag(k)) for k in "ab"}
    assert {r.k: r.n for r in ops.pick_name(df, ["k"], "n").collect()} == {k: bags.pick_name(bag(k)) for k in "ab"}
    assert {(r.k, r.n) for r in ops.reduce_names(df, ["k"], "n").collect()} == {(k, n) for k in "ab" for n in bags.reduce_names(bag(k))}


def test_grouped_choices_count_names(spark):
    rows = [("a", "John Smith", "eng")] * 50 + [("a", "Jon Smyth", "deu"), ("a", "Johann Schmidt", "deu"), ("b", "Zed", "xxx"), ("b", None, "eng")]
    df = spark.createDataFrame(rows, "k string, n string, lang string")
    bag = lambda k: [n for x, n, _ in rows if x == k and n]
    assert {r.k: r.n for r in ops.pick_name(df, ["k"], "n").collect()} == {k: bags.pick_name(bag(k)) for k in "ab"}
    assert {r.k: r.n for r in ops.representative_names(df, ["k"], "n", 2).collect()} == {k: bags.representative_names(sorted(set(bag(k))), 2) for k in "ab"}
    assert {r.k: r.n for r in ops.pick_lang_name(df, ["k"], "n", "lang").collect()} == {k: bags.pick_lang_name([(n, lang) for x, n, lang in rows if x == k and n], "eng", misc.PREFERRED_LIST) for k in "ab"}


def test_consolidation_of_persons_takes_words_in_any_order(spark):
    rows = [("a", 1, "John Smith"), ("a", 2, "Smith Peter John"), ("a", 3, "John John"), ("b", 1, "Ann Lee"), ("b", 2, "Lee Ann")]
    df = spark.createDataFrame(rows, "k string, i int, n string")
    kept = lambda person: {(r.k, r.i) for r in ops.consolidate_names(df, "k", "i", "n", person).collect()}
    assert kept(True) == {("a", 2), ("a", 3), ("b", 1)} and len(kept(False)) == 5


def test_frequent_keys_can_be_left_out(spark):
    rows = [(f"e{i}", "ORG", [f"Acme Holding {w}"]) for i, w in enumerate("alpha beta gamma alpha".split())]
    named = ops.analyze_names(spark.createDataFrame(rows, "entity_id string, type_tag string, names array<string>"))
    every = ops.candidate_pairs(named, named).where("left_id < right_id")
    frequent = ops.frequent_keys(named, 3)
    some = ops.candidate_pairs(named, named, without=frequent).where("left_id < right_id")
    assert every.count() == 6 and frequent.count() >= 1 and {tuple(r) for r in some.collect()} == {("e0", "e3")}


def test_names_tagged_by_a_table_equal_those_tagged_by_lines(spark):
    lines = ["john, jon => Q1", "maria, mary => Q2", "van der berg, vanderberg => Q3", "smith, schmidt => Q4"]
    people = [("a", ["John Smith"]), ("b", ["Mary van der Berg", "Berg Mary"]), ("c", ["Nobody Here"]), ("c", ["Nobody Here"]), ("d", ["John John"]), ("e", [])]
    entities = spark.createDataFrame([(i, "PER", n) for i, n in people], "entity_id string, type_tag string, names array<string>")
    needles = spark.createDataFrame([(form, "NAME", line.split(" => ")[1]) for line in lines for form in line.split(" => ")[0].split(", ")], "phrase string, category string, id string")
    spans = lambda df: sorted((r.entity_id, r.name.norm_form, sorted((s.category, s.id, tuple(s.part_idx), s.comparable) for s in r.name.spans)) for r in df.collect())
    plain = ops.analyze_names(entities, symbols=True)
    got = ops.tag_names(plain, needles)
    assert got.columns == plain.columns and spans(got) == spans(ops.analyze_names(entities, symbols=True, corpus=lines))
    assert ops.tag_names(plain, needles.limit(0)).count() == plain.count()


def test_phrases_of_any_length_match(spark):
    phrase = "one two three four five six seven eight nine ten"
    tokens = spark.createDataFrame([("x", f"so {phrase} it is".split())], "entity_id string, tokens array<string>")
    needles = spark.createDataFrame([(phrase, "NAME", "Q1"), ("so", "NAME", "Q2")], "phrase string, category string, id string")
    assert {r.id for r in ops.tag_by_join(tokens, needles).collect()} == {"Q1", "Q2"}


def test_mime_types_and_urls_that_are_malformed(spark):
    values = ["text/html; charset=a; charset=b", "text/html; " + "; ".join(f"p{i}={i}" for i in range(300)), "text/html", None]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r[0] for r in df.select(misc.parse_mimetype("s")["params"]).collect()]
    assert got[0] == {"charset": "a"} and len(got[1]) == 300 and got[2] == {}
    assert [r[0] for r in df.select(misc.mimetype_charset("s")).collect()][0] == "utf-8"
    hosts = [("http://[::1", None), ("http://::1]/", None), ("http://[::1]/a", "http://[::1]/a"), ("http://u@[fe80::1%25eth0]:80/", "http://u@[fe80::1%25eth0]:80/"), ("http://a[b]c/", None), ("http://a.com/[x]", "http://a.com/[x]")]
    df = spark.createDataFrame(hosts, "s string, want string")
    assert [tuple(r) for r in df.select("want", urls.clean_url("s")).collect()] == [(w, w) for _, w in hosts]
    df = spark.createDataFrame([("x" * 400 + ".pdf",)], "s string")
    assert len(df.select(misc.safe_file_name("s")).first()[0]) == 254


def test_lookups_replace_a_column_of_their_name(spark):
    df = spark.createDataFrame([("Germany", "old"), ("Frannce", "x"), (None, "y"), ("Q145", "z")], "v string, territory string")
    for fuzzy, want in ((False, {"Germany": "de", "Frannce": None, None: None, "Q145": "gb"}), (True, {"Germany": "de", "Frannce": "fr", None: None, "Q145": "gb"})):
        found = territories.lookup_territory(df, "v", fuzzy)
        assert found.columns == ["v", "territory"] and {r.v: r.territory for r in found.collect()} == want
        assert "NestedLoop" not in found._jdf.queryExecution().toString()
    own = territories.lookup_territory(df.select(F.col("v").alias("territory")), "territory")
    assert own.columns == ["territory"] and {r.territory for r in own.collect()} == {"de", None, "gb"}
    assert {r.v: r.territory for r in territories.territory_by_qid(df, "v").collect()} == {"Germany": None, "Frannce": None, None: None, "Q145": "gb"}
    assert {r.v: r.territory for r in territories.lookup_by_identifier(df, "v").collect()}["Q145"] == "gb"


def test_prefixes_equal_the_kernel(spark):
    values = ["Mr. Dr John Smith", "-- The Bank", "M/V Ship", "Lady", "Sir  Elton"]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    for kind, f in (("person", NF.remove_person_prefixes), ("org", NF.remove_org_prefixes), ("obj", NF.remove_obj_prefixes)):
        assert [r[0] for r in df.select(f("s")).collect()] == [names.remove_prefix(v, kind) for v in values]


def test_plain_python_regex_of_emoji(spark):
    df = spark.createDataFrame([("a😀⬛b",), ("→x",)], "s string")
    assert [r[0] for r in df.select(T.remove_emoji("s")).collect()] == ["ab", "x"]
    assert re.sub("x", "", "x") == "" and F is not None


def test_imo_format_of_zeros(spark):
    """What is no valid number gets the prefix, too, once."""
    rows = spark.createDataFrame([("0000000",), ("imo 0000000",), (" 9126819 ",), ("IMO 9126819",), (None,)], "x string")
    assert [r[0] for r in rows.select(ids.get_identifier_format("imo").format("x")).collect()] == ["IMO0000000", "IMO0000000", "IMO9126819", "IMO9126819", None]
