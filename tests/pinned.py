"""Pinned cases of scalar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrain.functions import ids, misc, text, urls
from cases import Case


def _id(name: str, what: str):
    f = ids.get_identifier_format(name)
    return {"valid": f.is_valid, "normal": f.normalize, "format": f.format}[what]


def _ids(name: str, valid: list = (), invalid: list = (), normal: list = (), shown: list = ()) -> dict[str, Case]:
    out = {f"id_{name}_valid": Case(_id(name, "valid"), [(v, True) for v in valid] + [(v, False) for v in invalid], "boolean")}
    if normal:
        out[f"id_{name}_normalize"] = Case(_id(name, "normal"), list(normal))
    if shown:
        out[f"id_{name}_format"] = Case(_id(name, "format"), list(shown))
    return out


CASES: dict[str, Case] = {
    # text
    "text_strip": Case(lambda c: text.normalize(c, 1), [("  a b 　", "a b"), ("   ", None), ("", None)]),
    "text_casefold": Case(text.casefold, [("Straße", "strasse"), ("ΣΊΣΥΦΟΣ", "σίσυφοσ"), ("ABC", "abc"), ("İ", "i̇")]),
    "text_squash_spaces": Case(lambda c: text.normalize(c, 2), [("a   b\t c", "a b c"), ("Gm­bH", "GmbH"), ("\x1c\x1f", None)]),
    "text_nfc": Case(lambda c: text.normalize(c, 8), [("é", "é"), ("abc", "abc")]),
    "text_nfkc": Case(lambda c: text.normalize(c, 16), [("ﬁ", "fi"), ("①", "1")]),
    "text_nfkd": Case(lambda c: text.normalize(c, 32), [("é", "é")]),
    "text_cleanup_strong": Case(lambda c: text.normalize(c, 2, 1), [("a-b_c", "a b c"), ("a$b", "ab"), ("é", "e"), ("xʰ", "x")]),
    "text_cleanup_slug": Case(lambda c: text.normalize(c, 2, 2), [("a-b_c", "a b c"), ("é", "é"), ("xʰ", "xʰ")]),
    "text_flag_name": Case(lambda c: text.normalize(c, 4 | 64), [("Bashar al-Assad", "bashar al assad"), ("U.S.A.", "usa"), ("...", None)]),
    "text_noop_normalizer": Case(text.noop_normalizer, [(" a ", "a"), (" ", None)]),
    "text_normalize_text": Case(text.normalize_text, [("The", "the"), ("N/A", "n a"), ("", None)]),
    "text_remove_emoji": Case(text.remove_emoji, [("a😀b", "ab"), ("x → y", "x  y"), ("plain", "plain")]),
    "text_remove_bracketed": Case(text.remove_bracketed_text, [("Turtle (Seychelles) Ltd.", "Turtle   Ltd."), ("a [b (c)] d", "a   d"), ("x", "x")]),
    "text_hash": Case(text.text_hash, [("Hello, World!", "6adfb183a4a2c94a2f92dab5ade762a47889a5a1"), ("hello world", "6adfb183a4a2c94a2f92dab5ade762a47889a5a1")]),
    "text_is_stopword": Case(text.is_stopword, [("the", True), ("The", False), ("banana", False)], "boolean"),
    "text_is_nullword": Case(lambda c: text.is_nullword(c, normalize=True), [("N/A", True), ("unknown", True), ("banana", False)], "boolean"),
    "text_is_nullplace": Case(lambda c: text.is_nullplace(c, normalize=True), [("Banana", False), ("overseas", True)], "boolean"),
    "text_scripts": Case(text.text_scripts, [("Hello, мир! 中文 123", ["Cyrillic", "Han", "Latin"]), ("123", [])], "array<string>"),
    "text_codepoint_script": Case(text.codepoint_script, [(0x41, "Latin"), (0x20, "Common"), (0x301, "Inherited"), (0x410, "Cyrillic"), (0x4E2D, "Han"), (0xAC00, "Hangul"), (0xD800, None)], inputs="int"),
    "text_common_scripts": Case(text.common_scripts, [("мир abc", "xyz", ["Latin"]), ("мир", "xyz", [])], "array<string>"),
    "text_can_latinize": Case(text.can_latinize, [("мир", True), ("中国", False), ("Tokyo 東京", False), ("123", True), ("김", True)], "boolean"),
    "text_is_modern_alphabet": Case(text.is_modern_alphabet, [("мир", True), ("김", False), ("abc", True)], "boolean"),
    "text_is_latin": Case(text.is_latin, [("abc é", True), ("мир", False), ("12", True)], "boolean"),
    "text_is_dense_script": Case(text.is_dense_script, [("中国", True), ("김", True), ("abc", False)], "boolean"),
    "text_maybe_ascii": Case(text.maybe_ascii, [("café", "cafe"), ("weißbier", "weissbier"), ("Lars Løkke", "Lars Lokke"), ("中国", "中国"), ("Владимир Путин", "Vladimir Putin"), ("ALAĸSANDRAVIC", "ALAqSANDRAVIC")]),
    "text_maybe_ascii_drop": Case(lambda c: text.maybe_ascii(c, drop=True), [("中国", ""), ("Tokyo 東京", ""), ("café", "cafe")]),
    "text_string_number": Case(text.string_number, [("42", 42.0), ("٤٢", 42.0), ("五", 5.0), ("½", 0.5), ("3½", None), ("Ⅻ", 12.0), ("12.5", 12.5), ("x", None), ("", None)], "double"),
    "text_levenshtein": Case(text.levenshtein, [("bar", "bra", 2), ("café", "cafe", 1), ("a", "a", 0)], "int"),
    "text_levenshtein_cutoff": Case(lambda a, b: text.raw_levenshtein_cutoff(a, b, 2), [("foo", "xxxxxxx", 3), ("foo", "fop", 1)], "int"),
    "text_levenshtein_similarity": Case(text.levenshtein_similarity, [("banana bread", "banana bone", 0.0), ("", "a", 0.0), ("abc", "abc", 1.0)], "double"),
    "text_levenshtein_plausible": Case(text.is_levenshtein_plausible, [("Rotenberg", "Rothenburg", True), ("Oleg", "Olga", False), ("", "", True)], "boolean"),
    "text_jaro_winkler_floor": Case(text.jaro_winkler, [("abc", "xyz", 0.0), ("same", "same", 1.0)], "double"),
    "text_damerau": Case(lambda a, b: text.damerau_levenshtein_cutoff(a, b, 5), [("bar", "bra", 1), ("CA", "ABC", 2)], "int"),
    "text_metaphone": Case(text.metaphone, [("John Doe", "JNT"), ("Robert", "RBRT"), ("Philadelphia", "FLTLF"), ("Müller", ""), ("", "")]),
    "text_soundex": Case(text.soundex, [("John Doe", "J530"), ("Robert", "R163"), ("Ashcraft", "A261"), ("Müller", ""), ("", "")]),
    "text_tokenize_name": Case(text.tokenize_name, [("Bashar al-Assad", ["Bashar", "al", "Assad"]), ("U.S.A.", ["USA"]), ("$100", ["100"]), ("O’Brien ー", ["OBrien", "ー"])], "array<string>"),
    "text_tokenize_name_min3": Case(lambda c: text.tokenize_name(c, 3), [("Bashar al-Assad", ["Bashar", "Assad"])], "array<string>"),
    "text_normalize_name": Case(text.normalize_name, [("O'Brien, J.", "obrien j"), ("--", None)]),
    # URLs
    "url_clean": Case(urls.clean_url, [("", None), ("!!@@@@", None), ("banana", None), ("gopher://xxxx.com", None), ("google.com", "http://google.com/"), ("https://www.google.com", "https://www.google.com/"), ("https://www.google.com/ ", "https://www.google.com/"), ("https://www.google.com/?q=foo&bar=baz", "https://www.google.com/?q=foo&bar=baz"), ("mailto:a@b.com", "http://mailto:a@b.com/")]),
    "url_clean_compare": Case(urls.clean_url_compare, [("", None), ("banana", None), ("//google.com", "http://google.com/"), ("https://www.google.com/?q=foo&bar=baz", "http://google.com/?bar=baz&q=foo"), ("https://www.google.com/a?b=&c=d e#x", "http://google.com/a?c=d+e")]),
    "url_compare": Case(urls.compare_urls, [("https://www.a.com", "http://a.com/", 1.0), ("a.com", "b.com", 0.0), ("", "", 0.0)], "double"),
    "url_build": Case(lambda c: urls.build_url(c, {"q": "bla"}), [("http://example.org", "http://example.org?q=bla"), ("http://example.org/x?a=", "http://example.org/x?a=&q=bla")]),
    # dates
    "date_prefix_start": Case(lambda c: F.date_format(misc.prefix_interval(c)["start"], "yyyy-MM-dd HH:mm:ss"), [("2026", "2026-01-01 00:00:00"), ("2026-06", "2026-06-01 00:00:00"), ("2026-07-17T12:30:00+0130", "2026-07-17 11:00:00"), ("2026-7", None), ("2026-02-29", None), ("2026Z", None)]),
    "date_prefix_end": Case(lambda c: F.date_format(misc.prefix_interval(c)["end"], "yyyy-MM-dd HH:mm:ss"), [("2026", "2027-01-01 00:00:00"), ("2026-06", "2026-07-01 00:00:00"), ("2026-12-31", "2027-01-01 00:00:00"), ("2026-07-17T12", "2026-07-17 13:00:00"), ("2026-07-17T12:30", "2026-07-17 12:31:00"), ("2026-07-17T12:30:59Z", "2026-07-17 12:31:00")]),
    "date_parse_utc": Case(lambda c: F.date_format(misc.parse_utc(c), "yyyy-MM-dd HH:mm:ss"), [("2026-07-17T12:30:00", "2026-07-17 12:30:00"), ("2026-07-17T12:30:00-04", "2026-07-17 16:30:00"), ("2026-07-17", None)]),
    "date_ended_before": Case(lambda a, b: misc.ended_before(a, F.to_timestamp(b)), [("2026", "2027-01-01 00:00:00", True), ("2026", "2026-12-31 23:59:59", False)], "boolean"),
    "date_starts_after": Case(lambda a, b: misc.starts_after(a, F.to_timestamp(b)), [("2026", "2025-12-31 23:59:59", True), ("2026", "2026-01-01 00:00:00", False)], "boolean"),
    "date_iso_datetime": Case(lambda c: misc.datetime_iso(misc.iso_datetime(c)), [("2023-10-01 12:00:00.123", "2023-10-01T12:00:00+00:00"), ("", None), ("x", None)]),
    # booleans, units
    "bool_text": Case(lambda c: misc.bool_text(c.cast("boolean")), [("true", "t"), ("false", "f"), (None, None)]),
    "text_bool": Case(misc.text_bool, [("Yes", True), ("t", True), ("1", True), ("no", False), ("", None)], "boolean"),
    "unit_normalize": Case(misc.normalize_unit, [("centimetres", "cm"), ("banana", "banana"), ("Penny", "p")]),
    # languages
    "lang_alpha3": Case(misc.iso_639_alpha3, [("en", "eng"), ("ENG ", "eng"), ("zh-Hans", "zho"), ("mul", None), ("banana", None), ("pt_BR", "por"), ("German", "deu")]),
    "lang_alpha2": Case(misc.iso_639_alpha2, [("ENG ", "en"), ("deu", "de"), ("xx", None)]),
    "lang_list": Case(misc.list_to_alpha3, [(["en", "de", "xx"], ["deu", "eng"]), (["srp"], ["bos", "hbs", "hrv", "srp"])], "array<string>", inputs="array<string>"),
    "lang_expand_synonyms": Case(misc.expand_synonyms, [("eng", ["eng"]), ("sqi", ["sqi", "alb"])], "array<string>"),
    "lang_is_better": Case(misc.is_lang_better, [("eng", "deu", True), ("fra", "eng", False), ("xxx", "zho", False), ("zho", "xxx", True)], "boolean"),
    "lang_normalize_code": Case(misc.normalize_code, [(" EN ", "en"), ("", None)]),
    # MIME
    "mime_normalize": Case(misc.normalize_mimetype, [("TEXT/ PLAIN", "text/plain"), ("TEXT/", "application/octet-stream"), ("1", "application/octet-stream"), (None, "application/octet-stream"), ("text/xml; charset=x", "application/xml")]),
    "mime_useful": Case(misc.useful_mimetype, [(None, False), ("application/octet-stream", False), ("text/plain", False), ("image/png", True)], "boolean"),
    "mime_label": Case(misc.mimetype_label, [("application/x-foo-banana", "foo banana"), ("text/plain", "Plain text")]),
    "mime_charset": Case(misc.mimetype_charset, [("text/plain; charset=cp1251", "cp1251"), ("text/plain; charset=banana", "utf-8"), ("text/plain", None)]),
    "mime_parse_name": Case(lambda c: misc.parse_mimetype(c)["name"], [("Text/HTML; a=b", "text/html"), ("x", "application/octet-stream")]),
    "mime_extension": Case(misc.mimetype_extension, [("application/pdf", "pdf"), ("bla", None), (None, None)]),
    "file_extension": Case(misc.normalize_extension, [(".doc", "doc"), (None, None), ("", None), ("bla.DO C", "doc"), (".HTM,L", "html"), ("foo..TXT", "txt")]),
    "file_name_extension": Case(lambda c: misc.file_name(c)["extension"], [("testing .doc", "doc"), ("testing xxx", None), (None, None)]),
    "file_name_safe": Case(misc.safe_file_name, [("testing .doc", "testing.doc"), ("testing xxx", "testing_xxx"), (None, "data")]),
    # identifiers
    **_ids("generic", ["x"], [" ", ""], [(" a ", "a"), (" ", None)]),
    **_ids("strict", ["FOO"], ["F", "FO"], [("FäOO", "FAOO"), ("a-b c", "ABC"), ("!", None)]),
    **_ids("wikidata", ["Q7747"], ["7747", "Q"], [("https://www.wikidata.org/wiki/Q7747", "Q7747"), ("q7747", "Q7747"), ("banana", None)]),
    **_ids("ogrn", ["1027739552642", "1137847171846"], ["1027739552643", "", "11677"], [("1027739552642", "1027739552642")]),
    **_ids("imo", ["IMO 9126819", "9126819", "912681", "IMO 6459297", "IMO 2041999", "IMO 1865817"], ["IMO 9126", "9126", "", "IMO 64592971", "IMO 6459298", "0", "0000000"],
           [("IMO number: 9126819", "IMO9126819"), ("912681", "IMO0912681"), ("91268191", None), ("9289519 / 9126819", "IMO9126819"), ("1234567 IMO 9126819", "IMO9126819"), ("Flag 12, IMO 9289518", "IMO9289518"), ("MMSI 373817000, 912681", "IMO0912681"), ("12343", "IMO0012343")], [("9126819", "IMO9126819")]),
    "id_imo_vessel": Case(ids.is_valid_vessel, [("IMO 9126819", True), ("IMO 6459297", False), ("344771", False), ("", False)], "boolean"),
    "id_imo_company": Case(ids.is_valid_company, [("IMO 6459297", True), ("IMO 9126819", False), ("344771", True), ("0000000", False)], "boolean"),
    **_ids("npi", ["1073106373"], ["1073106374", "9999999999", ""], [("NPI: 1073106373", "1073106373")]),
    **_ids("uei", ["F5L4T8CUYC68"], ["05L4T8CUYC68", "F5L4"], [("UEI F5L4T8Cuyc68", "F5L4T8CUYC68")]),
    **_ids("isin", ["US0378331005"], ["0378331005", "XX0378331005", "US037833100", ""], [("us0378331005", "US0378331005"), ("banana", None)], [("us0378331005", "US0378331005")]),
    **_ids("iban", ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"], ["DE89 3704 0044 0532 0130 0", ""], [("DE89 3704 0044 0532 0130 00", "DE89370400440532013000"), ("banana", None)], [("de89370400440532013000", "DE89 3704 0044 0532 0130 00")]),
    **_ids("figi", ["BBG000B9XRY4"], ["BBG000B9XRY", "BBG000B9XRY44", ""], [("bbg000b9xry4", "BBG000B9XRY4"), ("banana", None)]),
    **_ids("bic", ["DEUTDEFF"], ["DEUT22FF", "DEUTDE", "DEUTDEFF1", ""], [("ARMJAM22XXX", "ARMJAM22"), ("armjam22", "ARMJAM22"), ("ARMJ", None)]),
    **_ids("inn", ["7707083893"], ["770708389", "77070838933", ""], [("7707083893", "7707083893"), ("770708389", None)]),
    **_ids("lei", ["1595VL9OPPQ5THEK2X30"], ["1595VL9OPPQ5THEK2X", "1595VL9OPPQ5THAK2X30", ""], [("1595vl9OPPQ5THEK2X30", "1595VL9OPPQ5THEK2X30")]),
    **_ids("ssn", ["123-45-6789"], ["000-45-6789", "SOCIAL"], [("123-45-6789  ", "123456789"), ("SOCIAL", None)], [("123456789", "123-45-6789")]),
    **_ids("cpf", ["04485847608"], ["334", "33467854", ""], [("044.858.476-08", "04485847608"), ("1114447773", None)], [("33467854390", "334.678.543-90")]),
    **_ids("cnpj", ["00000000000191"], ["0000000000191", "111447355", ""], [("00.000.000/0001-91", "00000000000191"), ("0000000000019", None)], [("00000000000191", "00.000.000/0001-91")]),
    **_ids("uscc", ["111000000000116154"], ["111000000000116156", "11100000000", ""], [("71310106424845496e", "71310106424845496E"), ("123-45-6789", None)]),
    "id_ogrn_control_digit": Case(ids.ogrn_control_digit, [("1027739552642", 2)], "int"),
}
