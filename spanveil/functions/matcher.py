"""Dictionary matching: all terms of a dictionary in one pass over a text.

Terms that are ASCII are compared without case and with l read as i in runs of four letters or more, and must stand on the edges of
words; a single word may carry a plural s or es. Other terms are compared as they are, anywhere.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

#: Shortest run of letters in which l and i are one, and the endings that a single word may carry.
FOLD_RUN, PLURALS = 4, ("s", "es")
_RUNS = re.compile("[a-z]{%d,}" % FOLD_RUN)


def fold(text: str) -> str:
    """Lower-case ASCII letters, with l as i in long runs; as long as the text."""
    return _RUNS.sub(lambda m: m[0].replace("l", "i"), lower(text))


_LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text: str) -> str:
    """A-Z in lower case alone, so that no character changes its length."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _word(c: str) -> bool:
    return c.isascii() and c.isalnum()


def word_span(text: str, s: int, e: int) -> tuple[int, int] | None:
    """The span of an ASCII match on the edges of words, or None: both ends must be such edges, but a single word may go on as a plural."""
    if s and _word(text[s]) and _word(text[s - 1]):
        return None
    if e < len(text) and _word(text[e - 1]) and _word(text[e]):
        end = e
        while end < len(text) and _word(text[end]):
            end += 1
        if not all(_word(c) for c in text[s:e]) or lower(text[e:end]) not in PLURALS:
            return None
        e = end
    return s, e


@dataclass(frozen=True)
class Match:
    s: int
    e: int
    term: str
    payload: Any


@dataclass
class Matcher:
    """Two automata: of folded ASCII terms and of the others. Equal folded terms keep all their payloads."""

    ascii: Any = None
    exact: Any = None
    size: int = field(default=0)

    @classmethod
    def of(cls, terms: Iterable[tuple[str, Any]]) -> Matcher:
        import ahocorasick

        rough, exact = {}, {}
        for term, payload in terms:
            if term:
                if term.isascii():
                    rough.setdefault(_rough(term), []).append((term, fold(term), payload))
                else:
                    exact.setdefault(term, []).append((term, None, payload))
        made = []
        for table in (rough, exact):
            automaton = ahocorasick.Automaton() if table else None
            for key, entries in table.items():
                automaton.add_word(key, (len(key), tuple(entries)))
            if automaton is not None:
                automaton.make_automaton()
            made.append(automaton)
        return cls(made[0], made[1], len(rough) + len(exact))

    def find(self, text: str) -> Iterator[Match]:
        """Matches in the order of their ends. The automaton reads l as i everywhere, which C does fast; what it proposes is compared by the
        rule."""
        if self.ascii is not None:
            rough, size = _rough(text), len(text)
            for last, (n, entries) in self.ascii.iter(rough):
                s, e = last - n + 1, last + 1
                # Most proposals lie within a word; those that begin in one, or go on by more than a plural, are out.
                if s and rough[s - 1] in _WORD and rough[s] in _WORD:
                    continue
                if e < size and rough[e] in _WORD and rough[last] in _WORD and rough[e] not in "es":
                    continue
                span = word_span(text, s, e)
                if span:
                    seen = fold(text[s:e])
                    for term, folded, payload in entries:
                        if folded == seen:
                            yield Match(*span, term, payload)
        if self.exact is not None:
            for last, (n, entries) in self.exact.iter(text):
                for term, _, payload in entries:
                    yield Match(last - n + 1, last + 1, term, payload)


def _rough(text: str) -> str:
    return lower(text).replace("l", "i")


def longest(spans: list) -> list:
    """Of matches, the longest first and the first of equally long ones, without overlap; in text order."""
    starts: list[int] = []
    out: list = []
    for x in sorted(spans, key=lambda x: (x.s - x.e, x.s)):
        k = bisect_left(starts, x.s)
        if (k == 0 or out[k - 1].e <= x.s) and (k == len(out) or x.e <= out[k].s):
            starts.insert(k, x.s)
            out.insert(k, x)
    return out
