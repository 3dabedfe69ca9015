"""Pinned cases of name, territory and address operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrain.functions import addresses, names
from lexigrain.operators import corpus, territories
from cases import Case

_PUTIN = ["Vladimir Vladimirovich Putin", "Vladimir Vladimirovich PUTIN", "Vladimir Vladimirovich PUTIN"]

CASES: dict[str, Case] = {
    "name_remove_person_prefixes": Case(names.remove_person_prefixes, [("Mr. Dr John Smith", "John Smith"), ("  - Mrs Doe", "Doe"), ("John", "John"), ("Mrs", "Mrs")]),
    "name_remove_org_prefixes": Case(names.remove_org_prefixes, [("The Bank", "Bank"), ("Bank", "Bank")]),
    "name_remove_obj_prefixes": Case(names.remove_obj_prefixes, [("M/V Ever Given", "Ever Given"), ("The Titanic", "Titanic")]),
    "name_contains_split_phrase": Case(names.contains_split_phrase, [("John also known as Jack", True), ("John a.k.a. Jack", True), ("Akabane", False)], "boolean"),
    "name_is_name": Case(names.is_name, [("a1", True), ("12", False), ("中", True)], "boolean"),
    "name_is_generic_person": Case(names.is_generic_person_name, [("abdul aziz", True), ("banana", False)], "boolean"),
    "name_is_stopword": Case(lambda c: names.is_stopword(c, normalize=True), [("The", True), ("banana", False)], "boolean"),
    "name_is_nullword": Case(lambda c: names.is_nullword(c, normalize=True), [("unknown", True), ("banana", False)], "boolean"),
    "org_replace_compare": Case(names.replace_org_types_compare, [("siemens aktiengesellschaft", "siemens ag"), ("faberlic europe sp. z o.o.", "faberlic europe spzoo"), ("banana", "banana"), ("ооо газпром", "ooo газпром"), ("к.д. company", " company")]),
    "org_replace_generic": Case(lambda c: names.replace_org_types_compare(c, generic=True), [("siemens ag", "siemens jsc"), ("ооо газпром", "llc газпром"), ("к.д. company", "lp company")]),
    "org_replace_display": Case(names.replace_org_types_display, [("Siemens Aktiengesellschaft", "Siemens AG"), ("GMBH", "GMBH"), ("banana", "banana")]),
    "org_remove": Case(names.remove_org_types, [("siemens g.m.b.h", "siemens ")]),
    "org_extract": Case(lambda c: F.transform(names.extract_org_types(c), lambda x: F.concat_ws("=", x["matched"], x["target"])), [("siemens g.m.b.h", ["g.m.b.h=gmbh"]), ("banana", []), ("招商银行 有限公司", ["有限公司=ltd"]), ("samsung", [])], "array<string>"),
    "bag_pick_name": Case(names.pick_name, [(_PUTIN, "Vladimir Vladimirovich Putin"), (["Vladimir Putin", "Владимир Путин", "Владимир Путин"], "Vladimir Putin"), (["Putin"], "Putin"), (["Banana", "banana", "nanana", "Batman"], "Banana"), (["Robert Smith", "Rob Smith", "Robert SMITH"], "Robert Smith"), (["", "PETER", "Peter"], "Peter"), ([""], None)], inputs="array<string>"),
    "bag_pick_case": Case(names.pick_case, [(["JOHN", "John", "john"], "John"), (["b", "a"], "a")], inputs="array<string>"),
    "bag_reduce_names": Case(names.reduce_names, [(["JOHN", "Jane", "John"], ["John", "Jane"]), (["x"], ["x"])], "array<string>", inputs="array<string>"),
    "bag_representative_names": Case(lambda c: names.representative_names(c, 2), [(["John Smith", "Jon Smith", "Barack Obama", "JOHN SMITH"], ["John Smith", "Barack Obama"]), (["a", "b"], ["a", "b"])], "array<string>", inputs="array<string>"),
    "bag_pick_lang_name": Case(lambda c: names.pick_lang_name(F.transform(c, lambda x: F.struct(F.substring_index(x, "@", 1).alias("text"), F.substring_index(x, "@", -1).alias("lang")))), [(["Moskau@deu", "Moscow@eng"], "Moscow"), (["Moskau@deu", "Москва@bel"], "Moskau")], inputs="array<string>"),
    "bag_list_intersection": Case(names.list_intersection, [(["a", "b", "a"], ["a", "a", "c"], ["a", "a"]), (["a", "a"], ["a"], ["a"])], "array<string>", inputs="array<string>,array<string>"),
    "bag_latin_share": Case(names.latin_share, [("abc", 1.0), ("мир", 0.3), ("中", 0.0), ("12", 0.0)], "double"),
    "bag_case_error_score": Case(names.case_error_score, [("John", 1.0), ("john", 1.5), ("", 0.0)], "double"),
    "part_comparable": Case(lambda c: names.name_part(c)["comparable"], [("münchen", "munchen"), ("007", "7"), ("中国", "中国"), ("o-x", "ox")]),
    "part_ascii": Case(lambda c: names.name_part(c)["ascii"], [("münchen", "munchen"), ("中国", None)]),
    "part_integer": Case(lambda c: names.name_part(c)["integer"], [("42", 42), ("x", None), ("٤٢", 42)], "bigint"),
    "part_metaphone": Case(lambda c: names.name_part(c)["metaphone"], [("john", "JN"), ("li", None), ("中国", None)]),
    "part_tag_can_match": Case(names.tag_can_match, [("UNSET", "GIVEN", True), ("GIVEN", "FAMILY", False), ("PATRONYMIC", "GIVEN", False), ("GIVEN", "MIDDLE", True), ("FAMILY", "FAMILY", True)], "boolean"),
    "name_object_norm_form": Case(lambda c: names.name_object(c)["norm_form"], [("Bashar al-Assad", "bashar al assad")]),
    "name_tagger_org": Case(lambda c: F.array_sort(F.transform(names.tag_phrases(c), lambda x: F.concat_ws(":", x["category"], x["id"]))), [("siemens aktiengesellschaft", ["ORGCLS:JSC"]), ("bank of russia", ["DOMAIN:BANK", "LOC:ru"])], "array<string>"),
    "name_tagger_person": Case(lambda c: F.array_sort(F.transform(names.tag_phrases(c, "person"), lambda x: F.concat_ws(":", x["category"], x["id"]))), [("john smith jr", ["NICK:JACK", "SYMBOL:JR"])], "array<string>"),
    "corpus_clean_form": Case(corpus.clean_form, [("John (x)", "john"), ("12", None), ("a", None), ("é" * 41, None)]),
    "territory_clean_code": Case(territories.clean_code, [("US_CA ", "us-ca"), ("GB", "gb")]),
    "territory_clean_codes": Case(territories.clean_codes, [(["US_CA", "x", " de "], ["us-ca", "de"])], "array<string>", inputs="array<string>"),
    "territory_normal_name": Case(territories.normalize_territory_name, [("U.S.A.", "usa"), ("  Côte d’Ivoire ", "co te divoire"), ("Ísland", "i sland")]),
    "territory_intersect": Case(territories.territories_intersect, [(["us"], ["us-ca", "us-tx"], ["us-ca", "us-tx"]), (["cn-hk"], ["hk"], ["hk"]), (["de"], ["fr"], []), (["xx"], ["xx"], []), (["us", "ca"], ["mx", "ca", "us"], ["ca", "us"]), (["ru"], ["ua-cri"], ["ua-cri"]), (["ua-cri"], ["ua"], ["ua-cri"]), (["ge"], ["x-so"], ["x-so"]), (["cn"], ["hk"], ["hk"]), (["md"], ["md-pmr"], ["md-pmr"]), ([], ["fr"], [])], "array<string>", inputs="array<string>,array<string>"),
    "address_clean": Case(addresses.clean_address, [("New York, NY", "New York, NY"), ("New York , NY", "New York, NY"), ("New York , NY,,", "New York, NY"), ("New York  \n   , NY,,", "New York, NY")]),
    "address_normalize": Case(addresses.normalize_address, [("Bahnhofstr. 10, 86150 Augsburg, Germany", "bahnhofstr 10 86150 augsburg germany"), ("160 Broad` St, Birmingham B15 1DT", "160 broad st birmingham b15 1dt"), ("hey", None), ("Д.127, АМУРСКАЯ, АМУРСКАЯ, 675000", "д 127 амурская амурская 675000")]),
    "address_normalize_latinize": Case(lambda c: addresses.normalize_address(c, latinize=True), [("Д.127, АМУРСКАЯ, АМУРСКАЯ, 675000", "d 127 amurskaa amurskaa 675000")]),
    "address_shorten": Case(addresses.shorten_address_keywords, [("new york street new york ny 10001", "ny st ny 10001"), ("islamic republic of iran", "ir"), ("iran", "ir"), ("united arab emirates", "ae"), ("160 broad street birmingham b15 1dt", "160 broad st birmingham b15 1dt")]),
    "address_remove": Case(lambda c: F.regexp_replace(addresses.remove_address_keywords(c), " +", " "), [("160 broad street birmingham b15 1dt", "160 broad birmingham b15 1dt")]),
    "address_format": Case(lambda p, c: addresses.format_address(F.str_to_map(p, F.lit("[|]"), F.lit("=")), c), [("road=Bahnhofstr.|house_number=10|postcode=86150|city=Augsburg|state=Bayern|country=Germany", "DE", "Bahnhofstr. 10\n86150 Augsburg\nGermany"), ("road=Pall Mall|house=Marlborough House|city=London|postcode=SW1Y 5HX", "GB", "Marlborough House\nPall Mall\nLondon SW1Y 5HX")]),
    "address_format_line": Case(lambda p, c: addresses.format_address_line(F.str_to_map(p, F.lit("[|]"), F.lit("=")), c), [("road=Sesame Street|house_number=16|state=Dubai", "AE-DU", "16 Sesame Street, Dubai"), ("road=Sesame Street|country=Fantastan", "XX", "Sesame Street, Fantastan"), ("road=Main Street|house_number=16|city=Guerntown", "GG", "16 Main Street, Guerntown, Guernsey, Channel Islands")]),
}
