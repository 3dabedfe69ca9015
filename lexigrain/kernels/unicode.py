"""Scripts, transliteration and numerals of single values."""

from __future__ import annotations

import math
import re
import unicodedata
from functools import cache, lru_cache

import regex

from lexigrain import refdata

LATINIZED = ("Latin", "Cyrillic", "Greek", "Armenian", "Georgian", "Hangul")
_SCRIPTS = """Common Latin Greek Cyrillic Armenian Hebrew Arabic Syriac Thaana Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam
Sinhala Thai Lao Tibetan Myanmar Georgian Hangul Ethiopic Cherokee Canadian_Aboriginal Ogham Runic Khmer Mongolian Hiragana Katakana Bopomofo Han Yi Old_Italic
Gothic Deseret Inherited Tagalog Hanunoo Buhid Tagbanwa Limbu Tai_Le Linear_B Ugaritic Shavian Osmanya Cypriot Braille Buginese Coptic New_Tai_Lue Glagolitic
Tifinagh Syloti_Nagri Old_Persian Kharoshthi Balinese Cuneiform Phoenician Phags_Pa Nko Sundanese Lepcha Ol_Chiki Vai Saurashtra Kayah_Li Rejang Lycian Carian
Lydian Cham Tai_Tham Tai_Viet Avestan Egyptian_Hieroglyphs Samaritan Lisu Bamum Javanese Meetei_Mayek Imperial_Aramaic Old_South_Arabian Inscriptional_Parthian
Inscriptional_Pahlavi Old_Turkic Kaithi Batak Brahmi Mandaic Chakma Meroitic_Cursive Meroitic_Hieroglyphs Miao Sharada Sora_Sompeng Takri Caucasian_Albanian
Bassa_Vah Duployan Elbasan Grantha Pahawh_Hmong Khojki Linear_A Mahajani Manichaean Mende_Kikakui Modi Mro Old_North_Arabian Nabataean Palmyrene Pau_Cin_Hau
Old_Permic Psalter_Pahlavi Siddham Khudawadi Tirhuta Warang_Citi Ahom Anatolian_Hieroglyphs Hatran Multani Old_Hungarian SignWriting Adlam Bhaiksuki Marchen
Newa Osage Tangut Masaram_Gondi Nushu Soyombo Zanabazar_Square Dogra Gunjala_Gondi Hanifi_Rohingya Makasar Medefaidrin Old_Sogdian Sogdian Elymaic Nandinagari
Nyiakeng_Puachue_Hmong Wancho Chorasmian Dives_Akuru Khitan_Small_Script Yezidi Cypro_Minoan Old_Uyghur Tangsa Toto Vithkuqi Kawi Nag_Mundari""".split()


@cache
def _patterns() -> list[tuple[str, regex.Pattern]]:
    out = []
    for name in _SCRIPTS:
        try:
            out.append((name, regex.compile(rf"\p{{Script={name}}}")))
        except regex.error:
            continue
    return out


@lru_cache(1 << 17)
def char_script(c: str) -> str | None:
    return next((name for name, p in _patterns() if p.match(c)), None)


def codepoint_script(code: int) -> str | None:
    return None if 0xD800 <= code < 0xE000 or not 0 <= code < 0x110000 else char_script(chr(code))


def scripts_in_order(text: str) -> list[str]:
    """Real scripts of the letters and numbers, by first appearance."""
    out: dict[str, None] = {}
    for c in text:
        if unicodedata.category(c)[0] in "LN" and (s := char_script(c)) not in (None, "Common", "Inherited"):
            out.setdefault(s)
    return list(out)


def text_scripts(text: str) -> list[str]:
    return sorted(scripts_in_order(text))


@lru_cache(1 << 16)
def should_ascii(text: str) -> bool:
    return text.isascii() or all(s in LATINIZED for s in scripts_in_order(text))


@cache
def _fallback() -> dict[int, str]:
    return {ord(r["char"]): r["ascii"] for r in refdata.rows("fallback")}


@lru_cache(1 << 16)
def _ascii(text: str) -> str:
    text = unicodedata.normalize("NFC", text).translate(refdata.chars("ascii"))
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")
    return text.translate(refdata.chars("ascii")).translate(_fallback())


def maybe_ascii(text: str) -> str:
    return text if text.isascii() or not should_ascii(text) else _ascii(text)


def drop_or_ascii(text: str) -> str:
    return text if text.isascii() else _ascii(text) if should_ascii(text) else ""


@lru_cache(1 << 16)
def latinize_text(text: str) -> str:
    """Any script to Latin letters, marks kept as they come."""
    return text if text.isascii() else unicodedata.normalize("NFC", text).translate(refdata.chars("latin"))


@lru_cache(1 << 16)
def ascii_text(text: str) -> str:
    """Any script to ASCII; what has no counterpart is dropped."""
    if text.isascii():
        return text
    text = "".join(c for c in unicodedata.normalize("NFKD", latinize_text(text)) if unicodedata.category(c) != "Mn")
    text = text.translate(refdata.chars("ascii")).translate(_fallback())
    return text.encode("ascii", "ignore").decode()


_NUMERALS = dict(zip("〇一壹二貳贰三參叁四肆五伍六陸陆七柒八捌九玖十拾廿卅百佰千仟萬万億亿兆", [0, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 5, 5, 6, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 20, 30, 100, 100, 1000, 1000, 1e4, 1e4, 1e8, 1e8, 1e12], strict=True))
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", re.A)


def _digit_value(c: str) -> float | None:
    if c in _NUMERALS:
        return float(_NUMERALS[c])
    if unicodedata.category(c) == "Nd":
        return float(unicodedata.decimal(c))
    if "⅐" <= c <= "ↈ" or c in "¼½¾":
        value = unicodedata.numeric(c, None)
        return None if value is None or c in "⅟ↄ" else value
    return None


def string_number(text: str) -> float | None:
    if not text:
        return None
    if _NUMBER.fullmatch(text):
        value = float(text)
    else:
        values = [_digit_value(c) for c in text]
        if None in values:
            return None
        if len(values) == 1:
            value = values[0]
        elif all(v == int(v) and 0 <= v < 10 for v in values):
            value = 0.0
            for v in values:
                value = value * 10 + v
        else:
            return None
    return value if math.isfinite(value) else None
