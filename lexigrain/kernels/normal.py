"""The normalisation of ``functions.text`` for single values, for kernels and for building dictionaries."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

STRIP, SQUASH, CASEFOLD, NFC, NFKC, NFKD, NAME = 1, 2, 4, 8, 16, 32, 64
_SKIP = set(".'‘’ʼʹ`´")
_KEEP = set("ーｰ々")
_WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in "\x1c\x1d\x1e\x1f")
_SPACES = set("\x1c\x1d\x1e\x1f")
_INVISIBLE = set("​‌‍﻿­⁠⁡⁢⁣⁤")
_GAP = {"Zs", "Zl", "Zp", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "So"}
_DROP = {"Cf", "Cs", "Co", "Cn", "Me", "No", "Sc", "Sk"}


def _table(gap: set[str], drop: set[str]):
    @lru_cache(1 << 16)
    def action(c: str) -> str:
        kind = unicodedata.category(c)
        return " " if kind in gap else "" if kind in drop else c

    return action


_STRONG = _table(_GAP | {"Cc", "Mc"}, _DROP | {"Lm", "Mn"})
_SLUG = _table(_GAP | {"Mc"}, _DROP | {"Cc"})
_TOKEN = _table(_GAP | {"Cc"}, (_DROP - {"Cs"}) | {"Lm", "Mn"})
_ADDRESS = _table(_GAP | {"Cc", "Mc"}, (_DROP - {"Cs"}) | {"Lm", "Mn"})


def squash(text: str) -> str:
    return " ".join("".join(" " if c in _SPACES else c for c in text if c not in _INVISIBLE).split())


@lru_cache(1 << 16)
def tokens(text: str, least: int = 1) -> tuple[str, ...]:
    spaced = "".join(c if c in _KEEP else "" if c in _SKIP else _TOKEN(c) for c in text)
    return tuple(t for t in spaced.split() if len(t) >= least)


def address_tokens(text: str) -> list[str]:
    return "".join(c if c in "&№" or (c.isascii() and c.isalnum()) else _ADDRESS(c) for c in text.casefold()).split(" ")


@lru_cache(1 << 16)
def normalize(text: str, flags: int = 0, cleanup: int = 0) -> str | None:
    if flags & STRIP:
        text = text.strip(_WHITE)
    form = "NFKD" if flags & NFKD else "NFKC" if flags & NFKC else "NFC" if flags & NFC else None
    if form:
        text = unicodedata.normalize(form, text)
    if flags & CASEFOLD:
        text = text.casefold()
    if cleanup:
        text = "".join(map(_STRONG if cleanup == 1 else _SLUG, text))
    if flags & SQUASH:
        text = squash(text)
    if flags & NAME:
        text = " ".join(tokens(text))
    return text or None
