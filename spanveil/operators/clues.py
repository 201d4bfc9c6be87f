"""Clues: what a dictionary or lexicon says about stretches of a text, and which of them stand.

Plain functions over one text; the same rules as plans over tables of clues are in ``operators.joins``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, replace

from spanveil.functions import lexicons as lex
from spanveil.functions.matcher import Matcher, longest
from spanveil.functions.tokens import CJK, HARD_BREAKS, INLINE_GAP, OCR_BREAK

WEAK, SOFT, HARD = 0, 1, 2
BREAK = re.compile(rf"[{HARD_BREAKS}]|(?:\r?\n){{2,}}|{OCR_BREAK}")
UNIT = re.compile(rf"{INLINE_GAP}|{OCR_BREAK}| |[{CJK}]|[A-Za-z][A-Za-z0-9]*|[0-9]+[A-Za-z][A-Za-z0-9]*|[0-9]+(?:[ -]?[0-9]+)*|(?s:.)")
COPULA = re.compile(r"[ \t]*(?:是|is\b)", re.IGNORECASE)
GAP = rf"[ \t]*(?:[:：]|$|\n|{OCR_BREAK}|{INLINE_GAP})|[ \t]{{2,}}"
RIGHT_BREAK = re.compile(GAP)
#: Farthest places at which a label still boosts a value, and from which on by one step only.
FAR, NEAR = 6, 3


@dataclass(frozen=True)
class Clue:
    """``role``: label, start, inspire, value, key, suffix, family, given, full, alias, negative."""

    s: int
    e: int
    family: str
    role: str
    attr: str
    strength: int
    text: str
    component: tuple[str, ...] = ()
    canonical: str = ""
    source: str = "lexicon"

    @property
    def seed(self) -> bool:
        return self.role in ("label", "start")


class Units:
    """The units of a text, made once: from characters to units and back by bisection."""

    def __init__(self, text: str):
        self.starts = [m.start() for m in UNIT.finditer(text)]
        self.size = len(text)

    def at(self, char: int) -> int:
        """Number of the unit that holds a character; the unit after the last one for the text's end."""
        return bisect_right(self.starts, char) - 1 if char < self.size else len(self.starts)

    def span(self, s: int, e: int) -> tuple[int, int]:
        """First and last unit of a stretch of characters."""
        return self.at(s), self.at(max(s, e - 1))

    def chars(self, first: int, last: int) -> tuple[int, int]:
        return self.starts[first], self.starts[last + 1] if last + 1 < len(self.starts) else self.size

    def after(self, char: int) -> int:
        """The first unit that starts at or after a character."""
        return bisect_left(self.starts, char)


def distance(text: str, s: int, e: int, most: int) -> int | None:
    """Units between two places, or None if there are more than ``most`` or a break is among them."""
    n, at = 0, s
    while at < e:
        m = UNIT.match(text, at, e)
        n, at = n + 1, m.end()
        if n > most or BREAK.fullmatch(m[0]):
            return None
    return n


def by_length(text: str) -> int:
    """Strength of a dictionary term that states none: by its letters, digits and ideographs."""
    n = sum(c.isalnum() for c in text)
    return WEAK if n <= 1 else SOFT if n <= 3 else HARD


def segments(size: int, cuts: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """What cuts (s, e) leave of a text."""
    out, at = [], 0
    for s, e in sorted(cuts):
        if s > at:
            out.append((at, s))
        at = max(at, e)
    if at < size:
        out.append((at, size))
    return out


def scan(text: str, matcher: Matcher) -> list[Clue]:
    """Clues of every term, each once (D-1). Codes of up to four capitals must stand as they are; lexicon names in Latin letters must
    have a capital."""
    out: dict[tuple, Clue] = {}
    labels = []
    for m in matcher.find(text):
        t, got = m.payload, text[m.s : m.e]
        if t.family == "label":
            labels.append((m, t))
            continue
        if t.source == "lexicon":
            if t.role in ("value", "family", "given") and got[0].isascii() and not got[0].isupper():
                continue
            if t.component in ("province", "country") and m.term.isascii() and m.term.isupper() and len(m.term) <= 4 and got != m.term:
                continue
        elif t.strength < 0:
            t = replace(t, strength=by_length(m.term))
        c = Clue(m.s, m.e, t.family, "negative" if t.family == "negative" else t.role, t.role if t.family == "negative" else t.attr_type, t.strength, got, (t.component,) if t.component else (), t.canonical, t.source)
        key = (c.s, c.e, c.family, c.role, c.attr, c.component, c.canonical, c.source)
        out.setdefault(key, c)
    chosen = {(m.s, m.e) for m in longest([m for m, _ in labels])}
    out |= {("label", m.s, m.e, t.attr): Clue(m.s, m.e, "label", "label", t.attr_type, HARD, text[m.s : m.e]) for m, t in labels if (m.s, m.e) in chosen}
    return sorted(out.values(), key=lambda c: (c.s, c.e, c.family, c.role))


def inside_active(clues: list[Clue], active: list[tuple[int, int]]) -> list[Clue]:
    """Clues that don't start inside an active stretch (structured entities, breaks); postal codes may (R-2)."""
    starts, ends, top = [], [], -1
    for s, e in sorted(active):
        top = max(top, e)
        starts.append(s)
        ends.append(top)
    out = []
    for c in clues:
        i = bisect_right(starts, c.s) - 1
        if i < 0 or ends[i] <= c.s or "postal_code" in c.component:
            out.append(c)
    return out


def seeded(text: str, clues: list[Clue]) -> list[Clue]:
    """Labels become starts before a copula, stay labels before a break, colon or gap, or around another clue, and otherwise inspire."""
    plain = sorted((c.s, c.e) for c in clues if c.family not in ("label", "negative"))
    out = []
    for c in clues:
        if c.role == "label":
            inside = plain[bisect_left(plain, (c.s, -1)) : bisect_left(plain, (c.e, -1))]
            if COPULA.match(text, c.e):
                c = replace(c, role="start", e=COPULA.match(text, c.e).end())
            elif not (RIGHT_BREAK.match(text, c.e) or any(e <= c.e for _, e in inside)):
                c = replace(c, role="inspire")
        out.append(c)
    return out


def same_attr(clues: list[Clue]) -> list[Clue]:
    """Of overlapping clues of a type (R-3): the stronger; an equal span and strength of the same role unites its levels; no alias before
    another; the container, then the longer one, then the later."""
    out: list[Clue] = []
    for c in clues:
        keep = True
        while out and keep:
            o = next((o for o in reversed(out[-8:]) if o.attr == c.attr and o.s < c.e and c.s < o.e and (o.role == "key") == (c.role == "key")), None)
            if o is None:
                break
            if (o.s, o.e, o.strength, o.role) == (c.s, c.e, c.strength, c.role):
                c = replace(c, component=tuple(dict.fromkeys(o.component + c.component)), canonical=c.canonical or o.canonical)
                out.remove(o)
                continue
            if c.family == "name" and {o.role, c.role} == {"family", "given"} and (o.e <= c.s or (o.s, o.e) == (c.s, c.e)):
                break
            rank = lambda x, y: (x.strength, x.role != "alias", x.s <= y.s and y.e <= x.e, x.e - x.s)
            if rank(c, o) >= rank(o, c):
                out.remove(o)
            else:
                keep = False
        if keep:
            out.append(c)
    return out


def seed_groups(seeds: list[Clue]) -> list[Clue]:
    """Of connected labels and starts (R-4) the container; of partly overlapping ones the later start."""
    out: list[Clue] = []
    for c in sorted(seeds, key=lambda c: (c.s, -c.e)):
        if out and c.s < out[-1].e:
            o = out[-1]
            if c.e <= o.e:
                continue
            out[-1] = c
        else:
            out.append(c)
    return out


def resolve(text: str, clues: list[Clue], active: list[tuple[int, int]]) -> list[Clue]:
    """The sweep (R-1): active stretches, seeds, overlaps by type, and what seeds cover but hard dictionary clues (R-5)."""
    clues = seeded(text, inside_active(clues, active))
    seeds = seed_groups([c for c in clues if c.seed])
    negatives = [c for c in clues if c.role == "negative"]
    groups: dict[str, list[Clue]] = {}
    for c in clues:
        if not c.seed and c.role not in ("negative", "inspire"):
            groups.setdefault(c.family, []).append(c)
    ordinary = [c for g in groups.values() for c in same_attr(g)]
    starts = [x.s for x in seeds]  # disjoint
    covered = lambda c: (k := bisect_right(starts, c.s)) and c.e <= seeds[k - 1].e
    ordinary = [c for c in ordinary if (c.source != "lexicon" and c.strength == HARD) or not covered(c)]
    return sorted([*seeds, *negatives, *ordinary, *(c for c in clues if c.role == "inspire")], key=lambda c: (c.s, c.e))


def boosted(text: str, clues: list[Clue]) -> list[Clue]:
    """A label that only inspires raises the next clue of its type within FAR units by two steps, beyond NEAR by one (P-7); never addresses."""
    inspires = [c for c in clues if c.role == "inspire"]
    if not inspires:
        return clues
    out, ends = [], {}
    for i in sorted(inspires, key=lambda i: i.e):
        ends.setdefault(i.attr, []).append(i.e)
    for c in clues:
        if c.family in ("name", "organization") and not c.seed:
            mine = ends.get(c.attr, [])
            near = [distance(text, e, c.s, FAR) for e in mine[:bisect_right(mine, c.s)][-1:]]  # the nearest on the left
            best = min((d for d in near if d is not None), default=None)
            if best is not None:
                c = replace(c, strength=min(HARD, c.strength + (2 if best <= NEAR else 1)))
        out.append(c)
    return out


def negative_effect(s: int, e: int, strength: int, negatives: list[tuple[int, int]]) -> int | None:
    """Strength of a candidate under negative words (S-5), or None if it falls: a larger negative around it rejects; one inside or equal takes a
    step unless the candidate is hard; a partial overlap takes a step."""
    inside = partial = False
    for a, b in negatives:
        if b <= s or e <= a:
            continue
        if a <= s and e <= b and (a, b) != (s, e):
            return None
        if s <= a and b <= e:
            inside = True
        else:
            partial = True
    if partial:
        strength -= 1
    elif inside and strength < HARD:
        strength -= 1
    return strength if strength >= WEAK else None


def next_negative(clues: list[Clue], at: int) -> int | None:
    """Start of the first negative at or right of a place."""
    return min((c.s for c in clues if c.role == "negative" and c.s >= at), default=None)


def unit_index(units: Units, clues: list[Clue]) -> dict[int, dict]:
    """By unit: the clues that start there by family, those that cover it, the inspiring labels, the families that may start, and scopes of
    negatives (W-2)."""
    out: dict[int, dict] = {}
    new = lambda: {"starts": {}, "covers": [], "inspires": [], "families": set(), "negative": set()}
    for c in clues:
        first, last = units.span(c.s, c.e)
        for u in range(first, last + 1):
            b = out.setdefault(u, new())
            if c.role == "negative":
                b["negative"].add(c.attr)
            else:
                b["covers"].append(c)
        b = out.setdefault(first, new())
        if c.role == "inspire":
            b["inspires"].append(c)
        elif c.role != "negative":
            b["starts"].setdefault(c.family, []).append(c)
            b["families"].add(c.attr if c.seed else c.family)
    return out
