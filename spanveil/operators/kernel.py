"""Names, organizations, addresses and plates: from clues to runs, from runs to spans, a text at a time in Arrow batches.

One pass finds the terms of lexicon and dictionaries (``functions.matcher``); a sweep decides which clues stand (``operators.clues``); each
family builds runs around its clues; overlapping runs are decided pair by pair, and a loser may keep what is left of it. Only the
surroundings of clues are looked at, so a text without any costs one pass of the automaton. Needs no Spark but for ``detect``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions import lexicons as lex
from spanveil.functions.matcher import Matcher
from spanveil.functions.spans import plain
from spanveil.operators import address as adr
from spanveil.operators.clues import BREAK, HARD, SOFT, WEAK, Clue, boosted, distance, negative_effect, resolve, scan
from spanveil.sources.lexicon import Term, builtin

# Least strength by protection level, for names and for the rest.
NEEDED = {"strong": (SOFT, SOFT), "balanced": (HARD, HARD), "weak": (HARD, HARD)}
# How far an organization reaches to the left of its suffix, to the right of a label, and from a known name to a suffix, in ideographs and words.
ORG_HAN, ORG_WORDS, ORG_SUFFIX_UNITS, VALUE_HAN, VALUE_WORDS = 6, 4, 10, 6, 2
#: Fixed value: longest English name, in characters.
NAME_CHARS = 80
# Priority of families, and what a score adds for evidence.
PRIORITY = {"license_plate": 40, "address": 30, "name": 20, "organization": 10}
SCORE_HARD, SCORE_DICTIONARY, SCORE_LABEL = 0.4, 0.25, 0.08
LOCALES = ("zh_cn", "en_us", "mixed")
HAN = re.compile("[㐀-䶿一-鿿]")
CAPITALS = re.compile(r"[A-Z][A-Za-z]*")
JOINER = re.compile(r" |['’-]|\. ")
ORG_JOINER = re.compile(r",? |\. | & |-")
PLATE = re.compile(rf"[{lex.ZH_PLATES}][A-Za-z][ ·]?[A-Za-z0-9]{{5,6}}(?![A-Za-z0-9])")
SEPARATOR = re.compile(r"[ \t:：\-]*")
VALUE_END = re.compile(r"[\n,，;；。！？!?]")
LINE_END = re.compile(r"[\n;；。！？!?]")
STOP_WORDS = frozenset((*lex.NOT_NAMES, *lex.DETERMINERS, *lex.COPULAS, *lex.EN_KEYS["poi"], *lex.EN_KEYS["road"][:8]))


@dataclass(frozen=True)
class Span:
    s: int
    e: int
    attr: str
    strength: int
    by: str
    source: str = "lexicon"
    labelled: bool = False
    components: tuple = field(default=(), compare=False)

    @property
    def score(self) -> float:
        return SCORE_HARD * (self.strength == HARD) + SCORE_DICTIONARY * (self.source != "lexicon") + SCORE_LABEL * self.labelled


def _han(text: str, i: int) -> bool:
    return 0 <= i < len(text) and bool(HAN.match(text, i))


def locale_of(text: str, clue: Clue) -> str:
    """Script around a clue: of a label the first units to its right, of others their own, else that of some characters on both sides."""
    probe = text[clue.e : clue.e + 6] if clue.seed else clue.text
    if not clue.seed and not probe.isascii():
        return "zh_cn"
    if HAN.search(probe):
        return "zh_cn"
    if re.search("[A-Za-z]", probe):
        return "en_us"
    return "zh_cn" if HAN.search(text[max(0, clue.s - 8) : clue.e + 8]) else "en_us"


# Names


def _words_right(text: str, at: int, limit: int, stop: frozenset = STOP_WORDS) -> int:
    """End of the capitalized words that go on from a word's end over joiners."""
    while True:
        j = JOINER.match(text, at)
        m = CAPITALS.match(text, j.end()) if j else None
        if not m or m.end() > limit or m[0].lower() in stop or not (m[0][1:].islower() or len(m[0]) == 1 or not m[0][1:].isupper()):
            return at
        at = m.end()


def _words_left(text: str, at: int, floor: int, stop: frozenset = STOP_WORDS, joiner: re.Pattern = JOINER, most: int = 8) -> int:
    """Start of the capitalized words that come before a word's start."""
    for _ in range(most):
        k = at
        while k > floor and not (text[k - 1].isascii() and text[k - 1].isalnum()) and at - k < 3:
            k -= 1
        j = k
        while j > floor and text[j - 1].isascii() and text[j - 1].isalpha():
            j -= 1
        if j == k or k == at or not joiner.fullmatch(text, k, at) or not CAPITALS.fullmatch(text, j, k) or text[j:k].lower() in stop:
            break
        at = j
    return at


def _english_name(text: str, s: int, e: int, clues: list[Clue], floor: int, by: str, seed: bool) -> Span | None:
    s2 = s if seed else _words_left(text, s, max(floor, e - NAME_CHARS))
    e2 = _words_right(text, e, s2 + NAME_CHARS)
    words = re.findall("[A-Za-z]+", text[s2:e2])
    at = bisect_left(clues, s2, key=lambda c: c.s)
    own = [c for c in takewhile(lambda c: c.s < e2, islice(clues, at, None)) if c.e <= e2]
    source = next((c.source for c in own if c.source != "lexicon"), "lexicon")
    if seed:
        return Span(s2, e2, "name", HARD, by, source, True) if len(words) >= 2 or own else None
    known = {c.s for c in own}
    if source != "lexicon":
        return Span(s2, e2, "name", max(c.strength for c in own), "dictionary", source)
    if len(words) > 4:
        return None
    if len(known) >= 2:
        return Span(s2, e2, "name", HARD, "given_and_family")
    if len(words) >= 2:
        return Span(s2, e2, "name", max(SOFT, own[0].strength), "given_or_family")
    if own[0].role == "given":
        return Span(s2, e2, "name", max(WEAK, own[0].strength - 1), "given")
    return None


def _zh_name(text: str, c: Clue, clues: list[Clue], negatives: list[tuple[int, int]], labelled: bool) -> Span | None:
    """A surname and its tail: an explicit given name, else up to two ideographs; alone between others than ideographs it gains a step."""
    at = bisect_left(clues, c.e, key=lambda x: x.s)
    given = next((x for x in takewhile(lambda x: x.s == c.e, islice(clues, at, None)) if x.role == "given"), None)
    if given:
        e = given.e
    else:
        e = c.e
        while e < c.e + 2 and _han(text, e):
            e += 1
        if e < len(text) and _han(text, e) and not labelled:
            return None  # the tail runs on: where the name ends is unknown
    if e == c.e:
        return None
    strength = HARD if labelled or given else c.strength
    after = negative_effect(c.s, e, strength, _touching(negatives, c.s, e))
    if after is None:
        return None
    if after == SOFT and not _han(text, c.s - 1) and not _han(text, e):
        after = HARD
    return Span(c.s, e, "name", after, "label" if labelled else "family", c.source, labelled)


def name_runs(text: str, clues: list[Clue], locale: str, addresses: list[Span]) -> Iterator[Span]:
    """After labels and starts, and around names that are known. A compound surname right before an address is a name by itself."""
    at_address = {x.s for x in addresses}
    negatives = sorted((c.s, c.e) for c in clues if c.role == "negative" and c.attr in ("name", "ui"))
    floors = sorted(c.e for c in clues if c.seed)
    names = [c for c in clues if c.family == "name" and c.role in ("family", "given", "full", "alias")]
    by_start: dict[int, list[Clue]] = {}
    for c in names:
        by_start.setdefault(c.s, []).append(c)
    for seed in clues:
        if not seed.seed or seed.attr not in ("name",):
            continue
        at = SEPARATOR.match(text, seed.e).end()
        if at >= len(text):
            continue
        by = "start" if seed.role == "start" else "label"
        starts = sorted(by_start.get(at, ()), key=lambda c: (c.role != "full", c.role != "family", c.s - c.e))
        if _han(text, at) and locale != "en_us":
            if starts and starts[0].role in ("full", "alias"):
                yield Span(at, starts[0].e, "name", HARD, by, starts[0].source, True)
            elif starts and starts[0].role == "family" and (run := _zh_name(text, starts[0], names, negatives, True)):
                yield replace(run, by=by)
            else:
                e = at
                while e < at + 4 and _han(text, e):
                    e += 1
                if 2 <= e - at and not _han(text, e) and by == "label" and negative_effect(at, e, HARD, _touching(negatives, at, e)) is not None:
                    yield Span(at, e, "name", HARD, by, labelled=True)
        elif locale != "zh_cn":
            m = CAPITALS.match(text, at)
            if m and m[0].lower() not in STOP_WORDS and (run := _english_name(text, at, m.end(), names, at, by, True)):
                yield run
    done = -1
    for c in names:
        if not c.text.isascii():
            if locale == "en_us":
                continue
            if c.role in ("full", "alias") or (c.role == "given" and c.source != "lexicon"):
                after = negative_effect(c.s, c.e, c.strength, _touching(negatives, c.s, c.e))
                if after is not None:
                    yield Span(c.s, c.e, "name", after, "dictionary", c.source)
            elif c.role == "family" and c.e in at_address and len(c.text) == 2:
                yield Span(c.s, c.e, "name", HARD, "family", c.source)
            elif c.role == "family" and (run := _zh_name(text, c, names, negatives, False)):
                yield run
        elif locale != "zh_cn" and c.s >= done and text[c.s : c.e].lower() not in STOP_WORDS:
            k = bisect_right(floors, c.s)
            run = _english_name(text, c.s, c.e, names, floors[k - 1] if k else 0, "clue", False)
            if run:
                done = run.e
                yield run


# Organizations


def _org_left(text: str, c: Clue, floor: int) -> int:
    if not c.text.isascii():
        s = c.s
        while s > max(floor, c.s - ORG_HAN) and _han(text, s - 1):
            s -= 1
        return s
    return _words_left(text, c.s, floor, frozenset(lex.DETERMINERS), ORG_JOINER, ORG_WORDS)


def org_runs(text: str, clues: list[Clue], locale: str) -> Iterator[Span]:
    """From suffixes to the left, from known names to a suffix on their right, and after labels."""
    suffixes = [c for c in clues if c.family == "organization" and c.role == "suffix"]
    negatives = sorted((c.s, c.e) for c in clues if c.role == "negative" and c.attr == "organization")
    floors, starts = sorted(c.e for c in clues if c.seed), [c.s for c in suffixes]
    after = lambda at: islice(suffixes, bisect_left(starts, at), None)
    for c in suffixes:
        if (locale == "en_us" and not c.text.isascii()) or (locale == "zh_cn" and c.text.isascii()):
            continue
        k = bisect_right(floors, c.s)
        s = _org_left(text, c, floors[k - 1] if k else 0)
        if s == c.s or _touching(negatives, c.s, c.e):
            continue
        e = c.e + (text[c.e : c.e + 1] == "." and c.text.isascii())
        nxt = next((x for x in takewhile(lambda x: x.s <= e + 2, after(e)) if x.text.isascii() and re.fullmatch(r",? ", text[e : x.s])), None)
        if nxt:
            e = nxt.e + (text[nxt.e : nxt.e + 1] == ".")
        if c.text.isascii() and c.text[0].islower() and c.strength < HARD:
            continue  # an ordinary word after a capitalized one
        strength = c.strength if c.strength == HARD or not c.text.isascii() and c.s - s < 2 else min(HARD, c.strength + (1 if c.s - s >= 2 else 0))
        yield Span(s, e, "organization", strength, "suffix")
    for c in clues:
        if c.family == "organization" and c.role in ("value", "alias", "full"):
            most = VALUE_HAN if not c.text.isascii() else VALUE_WORDS * 2
            tail = next((x for x in islice(after(c.e), 1) if distance(text, c.e, x.s, most) is not None), None)
            yield Span(c.s, tail.e if tail else c.e, "organization", c.strength, "dictionary" if c.source != "lexicon" else "known", c.source)
        elif c.seed and c.attr == "organization":
            at = SEPARATOR.match(text, c.e).end()
            stop = VALUE_END.search(text, at)
            end = stop.start() if stop else len(text)
            tail = next((x for x in takewhile(lambda x: x.e <= end, after(at)) if len(re.findall(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]", text[at : x.s])) <= ORG_SUFFIX_UNITS), None)
            if tail:
                yield Span(at, tail.e, "organization", HARD, "label", labelled=True)
            elif _han(text, at):
                e = at
                while e < min(end, at + ORG_HAN) and _han(text, e):
                    e += 1
                if e - at >= 2:
                    yield Span(at, e, "organization", HARD, "label", labelled=True)
            elif m := CAPITALS.match(text, at):
                e, n = m.end(), 1
                while n < ORG_WORDS and (j := re.compile(" ").match(text, e)) and (w := CAPITALS.match(text, j.end())) and w.end() <= end:
                    e, n = w.end(), n + 1
                if n >= 2:
                    yield Span(at, e, "organization", HARD, "label", labelled=True)


# Addresses


def _touching(spans: list[tuple[int, int]], s: int, e: int) -> list[tuple[int, int]]:
    """Those of sorted, short spans that overlap (s, e)."""
    at = bisect_left(spans, (e, -1))
    out = []
    for x in reversed(spans[max(0, at - 64) : at]):
        if x[1] > s:
            out.append(x)
    return out


def _regions(text: str, clues: list[Clue]) -> list[tuple[int, int]]:
    """Stretches around address clues in which an address may lie: some words to the left, to the right as far as pieces go on."""
    out: list[list[int]] = []
    for c in clues:
        if c.family != "address" or c.source != "lexicon":
            continue
        if c.text.isascii():
            if c.role == "key" and c.component[0] in ("road", "poi"):
                k = c.s - 1
                while k > 0 and text[k] in " \t":
                    k -= 1
                j = k
                while j > 0 and text[j - 1].isascii() and (text[j - 1].isalnum() or text[j - 1] in "'’"):
                    j -= 1
                if j >= c.s - 1 or not (text[j].isupper() or text[j].isdigit()):
                    continue
            elif c.role == "key" and not re.compile(r"\.?[ \t]*#?[ \t]*[0-9A-Z]").match(text, c.e):
                continue
            elif c.component[0] == "province" and len(c.text) == 2 and not re.compile(r"[A-Za-z],?[ \t]+").search(text, max(0, c.s - 4), c.s):
                continue
        lo = c.s
        for _ in range(12):
            m = re.compile(r"[A-Za-z0-9'’#.-]+,?[ \t]+$").search(text, max(0, lo - 48), lo) if c.text.isascii() else None
            if not m:
                break
            lo = m.start()
        if not c.text.isascii():
            lo = max(0, c.s - 24)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], c.e)
        else:
            out.append([lo, c.e])
    return [(lo, hi) for lo, hi in out]


def address_runs(text: str, clues: list[Clue], locale: str) -> Iterator[Span]:
    labels = sorted((c.s, c.e) for c in clues if c.role in ("label", "start", "inspire"))
    ends = sorted(e for _, e in labels)
    negatives = sorted((c.s, c.e) for c in clues if c.role == "negative" and c.attr in ("address", "ui"))
    found: dict[tuple[int, int], adr.Address] = {}
    for lo, hi in _regions(text, clues):
        reach = 64
        while True:  # as far as the pattern goes on
            end = min(len(text), hi + reach)
            got = [a for a in adr.find_addresses(text, lo, end) if a.s <= hi]  # later ones have clues of their own
            if end == len(text) or not got or got[-1].e < end - 40:
                break
            reach *= 4
        for a in got:
            found[a.s, a.e] = a
    for (s, e), a in sorted(found.items()):
        zh = any(HAN.search(c.text) for c in a.components)
        if (zh and locale == "en_us") or (not zh and locale == "zh_cn") or _touching(labels, s, e):
            continue
        tail = _touching(negatives, s, e)
        if tail:
            last = a.components[-1]
            k = text.rfind(last.key or last.value, s, e)
            if any(x < e and k < y for x, y in tail):  # the rightmost component is a word of its own: the address ends before it
                cut = text.rfind(last.value, s, e)
                kept = a.components[:-1]
                if not kept or cut <= s:
                    continue
                a = replace_address(a, s, adr._trim(text, s, cut)[1], kept)
                e = a.e
        near = bisect_right(ends, s) - 1
        labelled = near >= 0 and s - ends[near] < 64 and not re.search(r"[^\s:：]", text[ends[near] : s])
        yield Span(a.s, a.e, "address", HARD if labelled else a.strength, "label" if labelled else "pattern", "lexicon", labelled, tuple(a.components))
    spans, starts = sorted(found), [c.s for c in clues]
    for c in clues:
        if c.family == "address" and c.role in ("value", "full") and c.source != "lexicon":
            kind = c.component[0] if c.component else "detail"
            yield Span(c.s, c.e, "address", c.strength, "dictionary", c.source, False, (adr.Component(kind, c.text),))
        elif c.family == "address" and c.component == ("country",):
            yield Span(c.s, c.e, "address", WEAK, "country", components=(adr.Component("country", c.text),))
        elif c.seed and c.attr == "address":
            at = SEPARATOR.match(text, c.e).end()
            stop = LINE_END.search(text, at)
            s, e = adr._trim(text, at, stop.start() if stop else len(text))
            if _touching(spans, s, e):
                continue  # the pattern knows where it ends
            if e > s and any(x.family == "address" and x.role == "value" and x.e <= e for x in clues[bisect_left(starts, s) : bisect_right(starts, e)]):
                yield Span(s, e, "address", HARD, "label", "lexicon", True, tuple(adr.parse_address(text[s:e])))


def replace_address(a: adr.Address, s: int, e: int, components: list[adr.Component]) -> adr.Address:
    return adr.Address(s, e, components, adr.strength_of(components))


def absorbed(text: str, spans: list[Span]) -> list[Span]:
    """Neighbouring addresses with only commas and spaces between become one if no type would come twice, or if the second one's parts are
    among the first one's (P-9)."""
    out: list[Span] = []
    for x in spans:
        if out and x.attr == out[-1].attr == "address" and x.s >= out[-1].e and re.fullmatch(r"[ ,，]{0,3}", text[out[-1].e : x.s]):
            a, b = out[-1].components, x.components
            types = {c.type for c in a} - {"poi"}
            if not types & {c.type for c in b} or {(c.type, c.text) for c in b} <= {(c.type, c.text) for c in a}:
                parts = a if {(c.type, c.text) for c in b} <= {(c.type, c.text) for c in a} else a + b
                out[-1] = replace(out[-1], e=x.e, strength=max(out[-1].strength, x.strength, adr.strength_of(list(parts))), components=parts)
                continue
        out.append(x)
    return out


# Conflicts


def trimmed(text: str, x: Span, s: int, e: int) -> Span | None:
    """What is left of a run outside (s, e), rebuilt: a name must hold more than a surname, an address parts, an organization its suffix."""
    parts = [(x.s, min(x.e, s)), (max(x.s, e), x.e)]
    a, b = max(parts, key=lambda p: p[1] - p[0])
    a, b = adr._trim(text, a, b)
    rest = text[a:b]
    if b - a < 2:
        return None
    if x.attr == "name":
        if HAN.search(rest):
            return replace(x, s=a, e=b) if a == x.s and rest not in lex.ZH_COMPOUND else None
        words = rest.split()
        return replace(x, s=a, e=b) if len(words) >= 2 or words[0].lower() in lex.GIVEN else None
    if x.attr == "address":
        components = adr.parse_address(rest)
        return replace(x, s=a, e=b, components=tuple(components), strength=adr.strength_of(components)) if components else None
    return replace(x, s=a, e=b) if x.attr == "organization" and any(rest.lower().rstrip(".").endswith(w) for w in lex.ORG_SUFFIX_STRENGTH) else None


def beats(a: Span, b: Span) -> bool:
    """Whether ``a`` wins over an overlapping ``b``: plates; a container, unless what it holds is stronger evidence of a name in an organization; of one type
    the stronger and longer; hard before soft; organizations by suffix before addresses; score; priority of the family."""
    if (a.attr == "license_plate") != (b.attr == "license_plate"):
        return a.attr == "license_plate"
    inside, around = a.s <= b.s and b.e <= a.e, b.s <= a.s and a.e <= b.e
    if inside != around:
        return inside
    if a.s == b.s and a.e == b.e and a.attr != b.attr:
        return (a.strength, a.attr == "name", PRIORITY[a.attr]) > (b.strength, b.attr == "name", PRIORITY[b.attr])
    if a.attr == b.attr:
        return (a.strength, a.e - a.s, a.score, -a.s) >= (b.strength, b.e - b.s, b.score, -b.s)
    if a.strength != b.strength:
        return a.strength > b.strength
    if {a.attr, b.attr} == {"organization", "address"} and "suffix" in (a.by, b.by):
        return a.attr == "organization"
    return (a.score, PRIORITY[a.attr]) >= (b.score, PRIORITY[b.attr])


def settle(text: str, runs: list[Span]) -> list[Span]:
    """Disjoint spans from left to right: a run meets those it overlaps; losers shrink or go, and what is left of them competes again."""
    order = lambda x: (x.s, -x.e, -x.strength, x.attr, x.by)
    todo = [(order(x), i, x) for i, x in enumerate(sorted(set(runs), key=order))]
    out: list[Span] = []
    n = len(todo)
    while todo:
        _, _, x = heappop(todo)
        at = next((k for k in range(len(out) - 1, max(-1, len(out) - 7), -1) if out[k].s < x.e and x.s < out[k].e), None)
        if at is None:
            out.append(x)
            continue
        o = out[at]
        win, lose = (x, o) if beats(x, o) else (o, x)
        rest = trimmed(text, lose, win.s, win.e) if lose.attr != win.attr else None
        if win is x:
            del out[at]
        for again in (x if win is x else None, rest):
            if again:
                n += 1
                heappush(todo, (order(again), n, again))
    return sorted(out, key=lambda x: x.s)


#: Structured kinds that are only generic fragments: an address or plate may hold them.
GENERIC = ("num_fragment", "alnum_fragment", "num", "alnum")


def outside_taken(text: str, spans: list[Span], taken: list[tuple[int, int, str]]) -> list[Span]:
    """Spans against structured entities: names and organizations lose, addresses and plates keep generic fragments inside them; an
    address that runs into a validated entity ends before it."""
    out = []
    for x in spans:
        hits = [(s, e, k) for s, e, k in taken if s < x.e and x.s < e]
        if x.attr in ("address", "license_plate"):
            hits = [(s, e, k) for s, e, k in hits if k not in GENERIC or (s <= x.s and x.e <= e) or (s < x.s < e) or (s < x.e < e)]
            if x.attr == "address" and hits and hits[0][0] > x.s:
                rest = trimmed(text, x, hits[0][0], x.e)
                hits, x = ([], rest) if rest else (hits, x)
        if not hits:
            out.append(x)
    return out


@lru_cache(maxsize=4)
def _lexicon_matcher() -> Matcher:
    return Matcher.of((t.text, t) for t in builtin())


def _taken(taken) -> list[tuple[int, int, str]]:
    return [(t[0], t[1], t[2] if len(t) > 2 else "num") for t in taken]


def detect_text(text: str | None, taken=(), protection: str = "strong", locale: str = "mixed", matchers: tuple[Matcher, ...] = ()) -> list[Span]:
    """Spans of a text. ``taken``: structured entities (s, e, kind). ``matchers``: of dictionaries, beside the lexicon's (or instead, if
    the first one holds a lexicon of the caller's). An unknown protection level counts as strong; an unknown locale is an error."""
    if locale not in LOCALES:
        raise ValueError(f"no locale {locale!r}")
    if not text:
        return []
    protection = protection if protection in NEEDED else "strong"
    taken = _taken(taken)
    clues = [c for m in (matchers or (_lexicon_matcher(),)) for c in scan(text, m)]
    useful = [c for c in clues if c.role not in ("negative", "inspire") and c.family != "control" and (c.family != "label" or c.attr in NEEDED_LABELS)]
    plates = [Span(m.start(), m.end(), "license_plate", HARD, "prefix") for m in PLATE.finditer(text)] if not text.isascii() else []
    if not useful and not plates:
        return []
    active = [(s, e) for s, e, k in taken if k not in GENERIC]
    clues = boosted(text, resolve(text, sorted(clues, key=lambda c: (c.s, c.e)), active))
    addresses = list(address_runs(text, clues, locale))
    runs = [*plates, *name_runs(text, clues, locale, addresses), *org_runs(text, clues, locale), *addresses]
    runs = [x for x in runs if not _broken(text, x)]
    name_least, other_least = NEEDED[protection]
    good = [x for x in runs if x.strength >= (name_least if x.attr == "name" else other_least)]
    return outside_taken(text, absorbed(text, settle(text, good)), taken)


NEEDED_LABELS = ("name", "organization", "address")


def _broken(text: str, x: Span) -> bool:
    return bool(BREAK.search(text, x.s, x.e))


FOUND = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("text", pa.string()), ("attr_type", pa.string()), ("strength", pa.int32()), ("found_by", pa.string()), ("components", pa.map_(pa.string(), pa.string())), ("metadata", pa.map_(pa.string(), pa.list_(pa.string())))]))
FOUND_DDL = "array<struct<s:int,e:int,text:string,attr_type:string,strength:int,found_by:string,components:map<string,string>,metadata:map<string,array<string>>>>"
TERM_DDL = "array<struct<text:string,attr_type:string,role:string,component:string,strength:int,source:string>>"


def _row(text: str, x: Span) -> dict:
    parts = adr.Address(x.s, x.e, list(x.components)).parts() if x.components else {}
    meta = {"matched_by": [x.by], **({k: v for k, v in adr.trace(list(x.components)).items() if v} if x.components else {})}
    return {"s": x.s, "e": x.e, "text": text[x.s : x.e], "attr_type": x.attr, "strength": x.strength, "found_by": x.by, "components": list(parts.items()), "metadata": list(meta.items())}


def terms_of(rows: list[dict] | None) -> tuple[Term, ...]:
    """Dictionary entries as terms; a strength below 0 is decided by length."""
    return tuple(Term(r["text"], r["attr_type"], r["role"] or "full", -1 if r["strength"] is None else r["strength"], r["component"] or "", "", r["source"] or "local") for r in rows or ())


@lru_cache(maxsize=256)
def _matcher_of(terms: tuple[Term, ...]) -> Matcher:
    return Matcher.of((t.text, t) for t in terms)


def detect(df: DataFrame, key: str = "doc_id", text: str = "text", protection: str = "strong", hard: bool = True, locale: str = "mixed", terms: str | None = None, local: DataFrame | None = None, lexicon: list[Term] | None = None) -> DataFrame:
    """(key, s, e, text, attr_type, strength, found_by, components, metadata): names, organizations, addresses and plates of each text,
    outside of its structured entities if ``hard``.

    ``terms``: a column of dictionary entries of the row's own (session), see TERM_DDL. ``local``: entries for all rows; they go to
    every task if ``dictionary.fits`` measures them small enough, else each text's entries are found by a join first. ``lexicon``: terms instead of
    the library's own."""
    from spanveil.operators import dictionary
    from spanveil.operators.structured import candidates_of

    rows = df.select(key, F.col(text).alias("text"), *([F.col(terms).alias("own")] if terms else []))
    shared: tuple[Term, ...] = ()
    if local is not None:
        if dictionary.fits(local):
            shared = terms_of([r.asDict() for r in local.select("text", "attr_type", "role", "component", "strength", "source").collect()])
        else:
            rows = dictionary.attach(rows, local, key, "own")
            terms = "own"
    if not terms:
        rows = rows.withColumn("own", F.array().cast(TERM_DDL))
    if hard:
        rows = candidates_of(rows, "taken")
    else:
        rows = rows.withColumn("plain_text", plain(F.col("text"))).withColumn("taken", F.array().cast("array<struct<s:int,e:int,kind:string>>"))
    rows = rows.select(key, "plain_text", "taken", "own")
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (Matcher.of((t.text, t) for t in lexicon) if lexicon is not None else _lexicon_matcher(),)
        if shared:
            base = (*base, _matcher_of(shared))
        for batch in batches:
            found = []
            for t, k, own in zip(batch.column("plain_text").to_pylist(), batch.column("taken").to_pylist(), batch.column("own").to_pylist(), strict=True):
                matchers = (*base, _matcher_of(terms_of(own))) if own else base
                spans = detect_text(t, [(y["s"], y["e"], y["kind"]) for y in k or ()], protection, locale, matchers)
                found.append([_row(t, x) for x in spans])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, FOUND)], [key, "found"])

    return rows.mapInArrow(run, f"`{key}` {kind}, found {FOUND_DDL}").select(key, F.inline("found"))
