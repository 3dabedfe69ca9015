"""Legal forms in names: replaced by a form to compare, a generic class or a display form; removed; listed."""

from __future__ import annotations

from functools import cache

from lexigrain import refdata
from lexigrain.kernels import normal
from lexigrain.kernels.needles import Needles


@cache
def needles(kind: str, flags: int, cleanup: int) -> Needles:
    norm = lambda s: None if s is None else normal.normalize(s, flags, cleanup)
    table: dict[str, str] = {}
    if kind == "display":
        plain = lambda s: normal.normalize(s, normal.STRIP | normal.SQUASH)
        targets: dict[str, set[str]] = {}
        for spec in refdata.rows("org_types"):
            shown = spec["display"] and plain(spec["display"])
            if not shown or not norm(spec["display"]):
                continue
            for alias in spec["aliases"]:
                key = norm(alias)
                if key and plain(alias) != shown:
                    targets.setdefault(key, set()).add(shown)
                    table[key] = shown
        return Needles((k, v) for k, v in table.items() if len(targets[k]) == 1)
    own: dict[str, str] = {}
    for spec in refdata.rows("org_types"):
        shown = norm(spec["display"])
        if kind == "generic":
            goal = norm(spec["generic"])
        else:
            goal = shown if spec["compare"] is None else "" if spec["compare"] == "" else norm(spec["compare"])
        if goal is None:
            continue
        for alias in spec["aliases"]:
            if key := norm(alias):
                table[key] = goal
        # A display form is a key of its own where no alias claims it before.
        if shown and shown not in table:
            table[shown] = goal
        own.setdefault(shown or "", goal)
    return Needles(table.items())


def _replaced(text: str, found: list, by=None) -> str:
    out, at = [], 0
    for a, b, payload in found:
        out += [text[at:a], payload if by is None else by]
        at = b
    return "".join([*out, text[at:]])


def replace_compare(text: str, flags: int = normal.CASEFOLD, cleanup: int = 0, generic: bool = False) -> str:
    return _replaced(text, needles("generic" if generic else "compare", flags, cleanup).found(text)) or text


def remove(text: str, replacement: str = "", flags: int = normal.CASEFOLD, cleanup: int = 0) -> str:
    return _replaced(text, needles("compare", flags, cleanup).found(text), replacement)


def extract(text: str, flags: int = normal.CASEFOLD, cleanup: int = 0, generic: bool = False) -> list[tuple[str, str]]:
    return [(text[a:b], payload) for a, b, payload in needles("generic" if generic else "compare", flags, cleanup).found(text)]


def _mapped(text: str, flags: int) -> tuple[str, list[int]]:
    """The text as the dictionary is written, and where in the original each of its characters comes from."""
    out, source, gap = [], [], True
    for i, c in enumerate(text):
        if flags & normal.SQUASH:
            if c in normal._INVISIBLE:
                continue
            if c.isspace() or c in normal._SPACES:
                if not gap:
                    out.append(" ")
                    source.append(i)
                    gap = True
                continue
            gap = False
        for x in c.casefold() if flags & normal.CASEFOLD else c:
            out.append(x)
            source.append(i)
    if flags & normal.SQUASH and out and out[-1] == " ":
        out.pop()
        source.pop()
    return "".join(out), source


def replace_display(text: str, flags: int = normal.CASEFOLD | normal.SQUASH, cleanup: int = 0) -> str:
    table = needles("display", flags, cleanup)
    if cleanup or flags & (normal.NFC | normal.NFKC | normal.NFKD | normal.NAME):
        plain = normal.normalize(text, flags, cleanup)
        out = text if plain is None else _replaced(plain, table.found(plain)) or plain
    else:
        hay, source = _mapped(text, flags)
        parts, at = [], 0
        for a, b, payload in table.found(hay):
            if source[a] >= at:
                parts += [text[at : source[a]], payload]
                at = source[b - 1] + 1
        out = "".join([*parts, text[at:]])
    return out.upper() if text.isupper() else out
