"""Dictionaries of phrases, searched in one walk; a hit must not touch a word character on either side."""

from __future__ import annotations

from collections.abc import Iterable


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Needles:
    """Phrase to payload; the last of equal phrases wins, ASCII letters match in either case."""

    def __init__(self, entries: Iterable[tuple[str, object]]) -> None:
        import ahocorasick

        self.machine, self.size = ahocorasick.Automaton(), 0
        for key, payload in entries:
            if key:
                self.machine.add_word(_fold(key), (len(key), payload))
                self.size += 1
        if self.size:
            self.machine.make_automaton()

    def overlapping(self, text: str) -> list[tuple[int, int, object]]:
        """All hits: begin, end, payload, by end and then from the longest."""
        if not self.size:
            return []
        out = []
        for last, (n, payload) in self.machine.iter(_fold(text)):
            a, b = last + 1 - n, last + 1
            if not (a and _word(text[a - 1])) and not (b < len(text) and _word(text[b])):
                out.append((a, b, payload))
        return out

    def found(self, text: str) -> list[tuple[int, int, object]]:
        """Hits from the left that don't overlap, the longest at each place."""
        out, end = [], 0
        for a, b, payload in sorted(self.overlapping(text), key=lambda h: (h[0], -h[1])):
            if a >= end:
                out.append((a, b, payload))
                end = b
        return out


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _fold(text: str) -> str:
    return text.translate(_ASCII_LOWER)
