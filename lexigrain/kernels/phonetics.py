"""Metaphone of one value, after the public algorithm as Commons Codec has it; tested against that class."""

from __future__ import annotations

_VOWELS, _FRONT, _SILENT_H = "AEIOU", "EIY", "CSPTG"


def metaphone(text: str) -> str:
    if not text or not text.isascii():
        return ""
    word = text.upper()
    if len(word) == 1:
        return word
    first, rest = word[0], word[1:]
    if first in "KGP" and word[1] == "N":
        word = rest
    elif first == "A" and word[1] == "E":
        word = rest
    elif first == "W":
        if word[1] == "R":
            word = rest
        elif word[1] == "H":
            word = "W" + word[2:]
    elif first == "X":
        word = "S" + rest
    n, code, i = len(word), "", 0

    def at(k: int) -> str:
        return word[k] if 0 <= k < n else ""

    def vowel(k: int) -> bool:
        return at(k) != "" and at(k) in _VOWELS

    while len(code) < 64 and i < n:
        c = word[i]
        if c != "C" and i > 0 and at(i - 1) == c:
            i += 1
            continue
        nxt, end = at(i + 1), i + 1 == n
        if c in _VOWELS:
            if i == 0:
                code += c
        elif c == "B":
            if not (at(i - 1) == "M" and end):
                code += "B"
        elif c == "C":
            if at(i - 1) == "S" and not end and nxt in _FRONT:
                pass
            elif word.startswith("CIA", i):
                code += "X"
            elif not end and nxt in _FRONT:
                code += "S"
            elif at(i - 1) == "S" and nxt == "H":
                code += "K"
            elif nxt == "H":
                code += "K" if i == 0 and n >= 3 and vowel(2) else "X"
            else:
                code += "K"
        elif c == "D":
            if nxt == "G" and i + 2 < n and at(i + 2) in _FRONT:
                code += "J"
                i += 2
            else:
                code += "T"
        elif c == "G":
            if nxt == "H" and i + 2 == n:
                pass
            elif nxt == "H" and i + 2 < n and not vowel(i + 2):
                pass
            elif i > 0 and word.startswith("GN", i):
                pass
            else:
                hard = at(i - 1) == "G"
                code += "J" if not end and nxt in _FRONT and not hard else "K"
        elif c == "H":
            if not end and not (i > 0 and at(i - 1) in _SILENT_H) and vowel(i + 1):
                code += "H"
        elif c in "FJLMNR":
            code += c
        elif c == "K":
            if i == 0 or at(i - 1) != "C":
                code += "K"
        elif c == "P":
            code += "F" if nxt == "H" else "P"
        elif c == "Q":
            code += "K"
        elif c == "S":
            code += "X" if word.startswith("SH", i) or word.startswith("SIO", i) or word.startswith("SIA", i) else "S"
        elif c == "T":
            if word.startswith("TIA", i) or word.startswith("TIO", i):
                code += "X"
            elif word.startswith("TCH", i):
                pass
            elif word.startswith("TH", i):
                code += "0"
            else:
                code += "T"
        elif c == "V":
            code += "F"
        elif c in "WY":
            if not end and vowel(i + 1):
                code += c
        elif c == "X":
            code += "KS"
        elif c == "Z":
            code += "S"
        i += 1
    return code[:64]
