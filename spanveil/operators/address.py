"""Addresses: found in a text, taken apart into components, compared, written as traces and canonical forms.

A component has a type, a value and a key: 景明路 is the road 景明 with the key 路. English addresses are comma-separated pieces from the
street to the country, Chinese ones run from the country to the room, or backwards over commas. A type has one place in an address,
except places of interest. A value that is itself the name of an administrative level (上海 in 上海路) is kept as a suspect.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import product

from spanveil.functions import lexicons as lex

WEAK, SOFT, HARD = 0, 1, 2
# The order of components from the largest to the smallest, and of English ones in a line.
ORDER = ("country", "province", "city", "district", "district_city", "subdistrict", "road", "number", "house_number", "poi", "building", "unit", "suite", "room", "detail", "postal_code")
ADMIN = ORDER[:6]
# Levels that may follow each administrative level directly.
SUCCESSORS = {"country": ADMIN[1:], "province": ADMIN[2:], "city": ADMIN[3:], "district": ("subdistrict",), "district_city": ("subdistrict",), "subdistrict": ()}
# Most dashes of a digit tail after each component, and its longest parts.
TAIL_DASHES = {"road": 3, "poi": 3, "number": 2, "building": 1}
TAIL_ALNUM, TAIL_DIGITS = 5, 4
TAIL_TYPES = {1: ("number",), 2: ("building", "room"), 3: ("building", "unit", "room"), 4: ("number", "building", "unit", "room")}

_alt = lambda words: "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))
WORD = r"[A-Z][A-Za-z'’]*"
_SP = r"[ \t]+"
STREET, PLACE = _alt(lex.EN_KEYS["road"]), _alt(lex.EN_KEYS["poi"])
UNIT_WORDS = {w: c for c in ("unit", "suite", "room", "building", "detail") for w in lex.EN_KEYS[c]}
STATE = _alt([*lex.STATES, *lex.STATE_NAMES.values()])
DIRECTION = _alt(lex.DIRECTIONS)
EN_UNIT = rf"(?:(?i:{_alt(UNIT_WORDS)})\b\.?[ \t]*#?[ \t]*(?:[0-9][A-Za-z0-9-]*|[A-Z]{{1,2}}\b(?:-?[0-9]+)?)|#[ \t]*[0-9]+[A-Za-z]?)"
EN_ROAD = rf"(?:(?:{DIRECTION}){_SP})?(?:(?:{WORD}|[0-9]+(?:st|nd|rd|th)){_SP}){{1,3}}(?i:{STREET})\b\.?(?:{_SP}(?:{DIRECTION})\b)?"
EN_PLACE = rf"(?:{WORD}{_SP}){{1,3}}(?i:{PLACE})\b"
EN_ZIP = r"[0-9]{5}(?:-[0-9]{4})?"
EN_CITY = rf"{WORD}(?:{_SP}{WORD}){{0,2}},?{_SP}(?:{STATE})\b(?:,?{_SP}{EN_ZIP})?"
EN_COUNTRY = rf"(?i:{_alt(a for a in lex.COUNTRY_ALIASES if a.isascii())})\b"
_PIECE = rf"(?:{EN_UNIT}|{EN_PLACE})"
EN_TAIL = rf"(?:,[ \t]*{_PIECE})*(?:,[ \t]*{EN_CITY})?(?:,[ \t]*{EN_COUNTRY})?"
EN_ADDRESS = re.compile(rf"(?:{EN_UNIT}(?:,[ \t]*|{_SP}))?(?<![A-Za-z0-9])[0-9]+[A-Za-z]?{_SP}{EN_ROAD}{EN_TAIL}|(?<![A-Za-z0-9]){EN_UNIT},[ \t]*(?:{_PIECE},[ \t]*)*{EN_CITY}(?:,[ \t]*{EN_COUNTRY})?|(?<![A-Za-z0-9]){EN_PLACE}{EN_TAIL}|(?<![A-Za-z0-9]){EN_CITY}(?:,[ \t]*{EN_COUNTRY})?")
HAN = "[㐀-䶿一-鿿]"
NUM = f"[0-9A-Za-z一二三四五六七八九十百零〇两{lex.ZH_STEMS}]"
_PROV, _CITY = _alt(lex.ZH_PROVINCES), _alt(lex.ZH_CITIES)
_ZH_COUNTRY = _alt(a for a in lex.COUNTRY_ALIASES if not a.isascii())
_key = lambda *types: _alt(k for t in types for k in lex.ZH_KEYS[t])
_NAME = f"(?!(?:{_key('number', 'building', 'unit', 'room')}))"
ZH_PARTS = {
    "country": _ZH_COUNTRY,
    "province": rf"(?:{_PROV})(?:(?:省|壮族自治区|回族自治区|维吾尔自治区|自治区|市)|(?!{_key('road')}))",
    "city": rf"(?:{_CITY})(?:市|(?!{_key('road')}))|{HAN}{{2,4}}?市",
    "district": rf"{HAN}{{1,6}}?(?:{_key('district')})",
    "subdistrict": rf"{HAN}{{1,5}}?(?:{_key('subdistrict')})",
    "road": rf"{HAN}{{1,5}}?(?:{_key('road')})",
    "number": rf"{NUM}{{1,5}}(?:-[0-9]{{1,4}})?号(?!楼)",
    "poi": rf"{HAN}{{2,6}}?(?:{_key('poi')})",
    "building": rf"{NUM}{{1,4}}(?:号楼|栋|幢|座|楼(?={NUM}))",
    "unit": rf"{NUM}{{1,3}}单元",
    "detail": rf"{NUM}{{1,3}}(?:层|楼)",
    "room": rf"{NUM}{{1,5}}(?:室|房|户)",
}
_Z = {k: f"(?:{v})" for k, v in ZH_PARTS.items()}
_ZH_ADMIN = f"{_Z['country']}?{_Z['province']}?{_Z['city']}?{_Z['district']}?{_Z['subdistrict']}?"
_ZH_FINE = f"{_Z['number']}?(?:{_Z['poi']}(?:{_Z['number']})?)?{_Z['building']}?{_Z['unit']}?{_Z['detail']}?{_Z['room']}?"
_ZH_BACK = f"(?:[，,][ ]?(?:{HAN}{{1,6}}(?:区|县|市|省)|{_PROV}|{_CITY}|{_ZH_COUNTRY}))*"
ZH_ADDRESS = re.compile(f"{_ZH_ADMIN}{_Z['road']}{_ZH_FINE}{_ZH_BACK}|{_ZH_ADMIN}{_Z['poi']}{_Z['building']}{_Z['unit']}?{_Z['detail']}?{_Z['room']}?|{_Z['province']}{_Z['city']}{_Z['district']}?{_ZH_BACK}|(?:{_CITY})市{_Z['district']}|{_Z['province']}{_Z['district']}")
TAIL = re.compile(rf"(?<![0-9A-Za-z])(?:[0-9]{{1,{TAIL_DIGITS}}}[A-Za-z]?|[A-Za-z][0-9]{{1,{TAIL_DIGITS}}})(?:-[0-9A-Za-z]{{1,{TAIL_ALNUM}}}){{0,3}}(?![0-9A-Za-z-])")


@dataclass
class Component:
    type: str
    value: str
    key: str = ""
    suspects: list[dict] = field(default_factory=list)

    @property
    def text(self) -> str:
        return f"{self.value} {self.key}".strip() if self.value.isascii() and self.key.isascii() and self.type in ("road", "poi") else self.value + self.key


@dataclass
class Address:
    s: int
    e: int
    components: list[Component]
    strength: int = SOFT

    def parts(self) -> dict[str, str]:
        """Component type -> text; several places of interest are joined by a bar."""
        out: dict[str, str] = {}
        for c in self.components:
            out[c.type] = f"{out[c.type]}|{c.text}" if c.type in out else c.text
        return out


# Taking an address apart


def _suspects(value: str, kind: str) -> list[dict]:
    """Names of administrative levels that begin the value of a smaller component."""
    out = []
    for level, names in (("province", lex.ZH_PROVINCES), ("city", lex.ZH_CITIES)):
        out += [{"levels": [level], "value": n, "key": "", "origin": kind} for n in names if value.startswith(n)]
    return out


def parse_zh(text: str) -> list[Component]:
    """Components of a Chinese address, left to right; over commas it may go on backwards."""
    out: list[Component] = []
    head, *back = re.split("[，,]", text)
    at, last = 0, -1
    kinds = list(ZH_PARTS)
    while at < len(head):
        for k in range(last if last >= 0 and kinds[last] == "poi" else last + 1, len(kinds)):
            m = _ZH_ONE[kinds[k]].match(head, at)
            if m and m.end() > at:
                key = next((w for w in sorted(lex.ZH_KEYS.get(kinds[k], ()), key=len, reverse=True) if m[0].endswith(w) and len(m[0]) > len(w)), "")
                if kinds[k] == "province" and m[0].endswith("市"):
                    key = "市"
                value = m[0][: len(m[0]) - len(key)]
                out.append(Component(kinds[k], value, key, _suspects(value, kinds[k]) if kinds[k] in ("road", "poi", "subdistrict", "district") else []))
                at, last = m.end(), k
                break
        else:
            m = TAIL.match(head, at)
            if m and out and out[-1].type in TAIL_DASHES:
                out += digit_tail(m[0], out[-1].type)
                at = m.end()
            else:
                break
    for piece in back:
        piece = piece.strip()
        kind = "country" if piece in lex.COUNTRY_ALIASES else next((k for k, keys in (("district", ("区", "县")), ("city", ("市",)), ("province", ("省", "自治区"))) if piece.endswith(keys)), "province" if piece in lex.ZH_PROVINCES else "city")
        key = next((w for w in ("自治区", "省", "市", "区", "县") if piece.endswith(w)), "") if kind != "country" else ""
        out.append(Component(kind, piece[: len(piece) - len(key)], key))
    return out


_ZH_ONE = {k: re.compile(v) for k, v in ZH_PARTS.items()}
_EN_ONE = (
    ("road", re.compile(rf"(?:(?P<number>[0-9]+[A-Za-z]?){_SP})?(?P<value>{EN_ROAD})$")),
    ("place", re.compile(rf"(?P<value>{EN_PLACE})$")),
    ("state", re.compile(rf"(?:(?P<city>{WORD}(?:{_SP}{WORD}){{0,2}}){_SP})?(?P<value>{STATE})\b(?:,?{_SP}(?P<zip>{EN_ZIP}))?$")),
    ("unit", re.compile(rf"(?P<key>(?i:{_alt(UNIT_WORDS)})\b\.?|#)[ \t]*#?[ \t]*(?P<value>[A-Za-z0-9-]+)$")),
    ("zip", re.compile(rf"(?P<value>{EN_ZIP})$")),
    ("country", re.compile(rf"(?P<value>{EN_COUNTRY})$")),
    ("city", re.compile(rf"(?P<value>{WORD}(?:{_SP}{WORD}){{0,2}})$")),
)
_LEAD_UNIT = re.compile(rf"({EN_UNIT}){_SP}(?=[0-9])")


_KEYED = {kind: re.compile(rf"(.+?){_SP}((?i:{_alt(lex.EN_KEYS[kind])})\.?(?:{_SP}(?:{DIRECTION}))?)$") for kind in ("road", "poi")}


def _split_key(text: str, kind: str) -> tuple[str, str]:
    m = _KEYED[kind].match(text)
    return (m[1], m[2]) if m else (text, "")


def parse_en(text: str) -> list[Component]:
    """Components of an English address: pieces between commas, a unit before the number included."""
    out: list[Component] = []
    pieces = [p.strip() for p in text.split(",") if p.strip()]
    if pieces and (m := _LEAD_UNIT.match(pieces[0])):
        pieces[:1] = [m[1], pieces[0][m.end() :]]
    for piece in pieces:
        for kind, pattern in _EN_ONE:
            m = pattern.match(piece)
            if not m:
                continue
            if kind == "road":
                if m["number"]:
                    out.append(Component("number", m["number"]))
                out.append(Component("road", *_split_key(m["value"], "road")))
            elif kind == "unit":
                word = m["key"].rstrip(".").lower()
                out.append(Component(UNIT_WORDS.get(word, "unit"), m["value"], m["key"]))
                out[-1].value, out[-1].key = f"{m['key']} {m['value']}" if m["key"] != "#" else f"#{m['value']}", ""
            elif kind == "place":
                out.append(Component("poi", *_split_key(m["value"], "poi")))
            elif kind == "state":
                if m["city"]:
                    out.append(Component("city", m["city"]))
                out.append(Component("province", m["value"]))
                if m["zip"]:
                    out.append(Component("postal_code", m["zip"]))
            else:
                out.append(Component({"zip": "postal_code"}.get(kind, kind), m["value"]))
            break
    return out


def parse_address(text: str | None) -> list[Component]:
    """Components of an address in either script."""
    text = (text or "").strip(" ,，.。:：;；\t\n")
    return [] if not text else parse_zh(text) if re.search(HAN, text) else parse_en(text)


def digit_tail(text: str, after: str) -> list[Component]:
    """10-1-102 after a road, place, number or building: typed by the number of its parts; more dashes than the component before allows are no
    tail."""
    parts = text.split("-")
    if len(parts) - 1 > TAIL_DASHES.get(after, 0) or any(len(p) > TAIL_ALNUM or (p.isdigit() and len(p) > TAIL_DIGITS) for p in parts):
        return []
    kinds = TAIL_TYPES[len(parts)]
    if after in ("number", "poi") and len(parts) == 1:
        kinds = ("building",)
    if after == "building":
        kinds = ("room",) if len(parts) == 1 else ("unit", "room")
    return [Component(k, p) for k, p in zip(kinds, parts, strict=False)]


# Levels


def admin_paths(values: list[tuple[str, tuple[str, ...]]], parents: dict[str, Iterable[str]] | None = None) -> list[tuple[str, ...]]:
    """All ways to give each (value, possible levels) one level, so that levels follow each other from the largest to the smallest and a city
    lies in a province that ``parents`` allows."""
    parents = lex.ZH_CITY_PROVINCE if parents is None else parents
    out = []
    for path in product(*(levels for _, levels in values)):
        legal = all(b in SUCCESSORS.get(a, ()) for a, b in zip(path, path[1:], strict=False))
        for (a, _), (b, _), x, y in zip(values, values[1:], path, path[1:], strict=False):
            if legal and x == "province" and y == "city" and b in parents:
                legal = a in ([parents[b]] if isinstance(parents[b], str) else list(parents[b]))
        if legal:
            out.append(path)
    return out


def possible_levels(value: str) -> tuple[str, ...]:
    """Levels that a bare name may have; a municipality is a province and a city."""
    out = []
    if value in lex.ZH_PROVINCES or value in lex.STATES or value in lex.STATE_NAMES.values():
        out.append("province")
    if value in lex.ZH_CITIES or value in ("北京", "上海", "天津", "重庆") or value.lower() in lex.CITIES:
        out.append("city")
    return tuple(out)


def split_occupied(components: list[Component]) -> list[list[Component]]:
    """Runs of components in which each type but places has one member."""
    out, seen = [[]], set()
    for c in components:
        if c.type in seen and c.type != "poi":
            out.append([])
            seen = set()
        out[-1].append(c)
        seen.add(c.type)
    return [x for x in out if x]


def strength_of(components: list[Component]) -> int:
    """A component is as strong as its value and key together: a key or number makes it hard evidence of its type, a bare known name soft.
    Any hard component, or two soft ones, make a hard address; two weak ones a soft one."""
    each = []
    for c in components:
        if c.type in ("road", "number", "building", "room", "unit", "suite", "postal_code") and (c.key or any(ch.isdigit() for ch in c.value)):
            each.append(HARD if c.type in ("number", "postal_code") or (c.type == "road" and any(x.type in ("number", "house_number") for x in components)) else SOFT)
        elif c.type == "poi":
            each.append(SOFT)
        elif c.key or c.type in ("province", "city", "country"):
            each.append(SOFT)
        else:
            each.append(WEAK)
    if HARD in each or each.count(SOFT) >= 2:
        return HARD
    if SOFT in each or each.count(WEAK) >= 2:
        return SOFT
    return WEAK


def _trim(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and text[s] in " ,，.:：\t\n":
        s += 1
    while e > s and text[e - 1] in " ,，:：\t\n":
        e -= 1
    return s, e


def find_addresses(text: str, lo: int = 0, hi: int | None = None) -> list[Address]:
    """Addresses of a stretch of text, with their components. A surname before a Chinese road isn't part of it; an English one after a
    determiner needs a number."""
    hi, out = len(text) if hi is None else hi, []
    for pattern, zh in ((EN_ADDRESS, False), (ZH_ADDRESS, True)):
        for m in pattern.finditer(text, lo, hi):
            s, e = _trim(text, m.start(), m.end())
            if zh:
                s += _surname(text[s:e])
                tail = TAIL.match(text, e)
            else:
                tail = None
                word = re.search(r"([A-Za-z]+)[ \t]+$", text[max(0, s - 16) : s])
                if word and word[1].lower() in lex.DETERMINERS and not text[s].isdigit():
                    continue
            parts = (parse_zh if zh else parse_en)(text[s:e])
            if tail and parts and not re.match(_alt(k for keys in lex.ZH_KEYS.values() for k in keys), text[tail.end() : tail.end() + 2]):
                more = digit_tail(tail[0], parts[-1].type)
                parts += more
                e = tail.end() if more else e
            if not parts or e - s < 2:
                continue
            at = s
            for run in split_occupied(parts):
                end = e
                if len(run) < len(parts):  # a type came twice: each run has its own stretch
                    last = run[-1]
                    k = text.find(last.key or last.value, at)
                    end = min(e, k + len(last.key or last.value)) if k >= 0 else e
                out.append(Address(*_trim(text, at, end), run, strength_of(run)))
                at = end
    return out


#: Words before an address that aren't part of it.
LEADS = re.compile("(?:现?居?住在|位于|来自|寄到|送到|前往|在|去|到|从|至)")


def _surname(value: str) -> int:
    """How much of the beginning is no address: words that lead to one, what stands before a known city, a surname before a road."""
    if (m := LEADS.match(value)) and len(value) - m.end() > 2:
        return m.end() + _surname(value[m.end() :])
    m = re.match(f"{HAN}{{3,6}}?市", value)
    if m:
        city = next((n for n in lex.ZH_CITIES if m[0][:-1].endswith(n) and m[0][:-1] != n), None)
        if city and not value.startswith(lex.ZH_PROVINCES):
            return len(m[0]) - 1 - len(city)
    if value.startswith((*lex.ZH_CITIES, *lex.ZH_PROVINCES)):
        return 0
    for surname in (*lex.ZH_COMPOUND, *lex.ZH_SURNAMES):
        if value.startswith(surname) and len(surname) < len(value) and not re.match(rf"{re.escape(surname)}{HAN}?(?:路|街)", value) and re.search(r"^.{1,2}(.{2,5}?)(路|街)", value):
            return len(surname)
    return 0


# Traces


def trace(components: list[Component]) -> dict[str, list[str]]:
    """Aligned lists: types, ``type:value``, ``type:key``, suspects as JSON, and canonical countries."""
    return {
        "component": [c.type for c in components],
        "value": [f"{c.type}:{c.value}" for c in components],
        "key": [f"{c.type}:{c.key}" for c in components],
        "suspects": [json.dumps(c.suspects, ensure_ascii=False) for c in components],
        "country": [lex.COUNTRY_ALIASES.get(c.value, c.value) for c in components if c.type == "country"],
    }


def from_trace(metadata: dict[str, list[str]] | None) -> list[Component]:
    """Components of a trace; older names of types are read too. Suspects that aren't JSON, or lack a level or value, are dropped; of places that
    contain each other the longer stays."""
    metadata = metadata or {}
    renamed = {"state": "province", "street": "road", "compound": "poi", "floor": "detail", "postcode": "postal_code"}
    keys, suspects = metadata.get("key") or [], metadata.get("suspects") or []
    out: list[Component] = []
    for i, item in enumerate(metadata.get("value") or []):
        kind, _, value = item.partition(":")
        kind = renamed.get(kind, kind)
        if not value or kind not in ORDER:
            continue
        key = keys[i].partition(":")[2] if i < len(keys) else ""
        out.append(Component(kind, value, key, read_suspects(suspects[i] if i < len(suspects) else "")))
    places = [c for c in out if c.type == "poi"]
    gone = [a for a in places if any(a is not b and a.text != b.text and a.text in b.text for b in places)]
    return [c for c in out if c not in gone]


def read_suspects(text: str | None) -> list[dict]:
    try:
        items = json.loads(text or "[]")
    except ValueError:
        return []
    good = [x for x in items if isinstance(x, dict)] if isinstance(items, list) else []
    return [{"levels": list(x["levels"]), "value": str(x["value"]), "key": str(x.get("key") or ""), "origin": str(x.get("origin") or "")} for x in good if isinstance(x.get("levels"), list) and x["levels"] and x.get("value")]


# Canonical forms


def _folded(text: str) -> str:
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text or "")).lower()


_COUNTRY = {alias.lower(): name for alias, name in lex.COUNTRY_ALIASES.items()}


def canonical_part(kind: str, text: str) -> str:
    """Canonical text of a component: countries and states by their aliases, units without their word, numbers as digits."""
    t = unicodedata.normalize("NFKC", text or "").strip()
    if kind == "country":
        return _folded(_COUNTRY.get(t.lower(), t))
    if kind == "province":
        full = lex.STATE_NAMES.get(t.upper(), t)
        return _folded(re.sub("(?:省|市|(?:壮族|回族|维吾尔)?自治区)$", "", full))
    if kind in ("unit", "suite", "room", "building", "detail", "number", "house_number"):
        t = re.sub(rf"^(?:{_alt(UNIT_WORDS)}|no|#)\b\.?[ \t#]*", "", t.lower())
        found = number_tokens(t)
        return "-".join(found) if found else _folded(t)
    if kind == "city":
        return _folded(re.sub("市$", "", t))
    return _folded(t)


def normalize(parts: dict[str, str]) -> dict:
    """canonical (``type=value`` joined by bars, in the fixed order), identity (type -> canonical value), address_part, numbers (ASCII tokens of
    the parts below the road that have no precise type), terms to match (longest first), has_admin and the display SPEC."""
    from spanveil.operators.entities import address_spec

    parts = {("number" if k == "house_number" else k): v for k, v in parts.items() if v and k in ORDER}
    identity = {k: canonical_part(k, parts[k]) for k in ORDER if k in parts and canonical_part(k, parts[k])}
    rest = [k for k in ORDER if k in parts and k not in ("country", "province", "postal_code")]
    terms = sorted({parts[k] for k in rest if len(_folded(parts[k])) > 1}, key=lambda t: (-len(t), t))
    numbers = [n for k in ORDER if k in parts and k in ("detail", "building", "room", "unit") and not parts[k].isascii() for n in number_tokens(parts[k])]
    return {"canonical": "|".join(f"{k}={v}" for k, v in identity.items()), "identity": identity, "address_part": "".join(identity.get(k, "") for k in ("road", "number", "poi")), "numbers": numbers, "terms": terms, "has_admin": any(k in identity for k in ADMIN), "spec": address_spec(parts)}


def zh_number(text: str) -> int | None:
    """Value of a Chinese numeral below 10,000, digit by digit where it has no tens; None for anything else."""
    if not text or any(c not in lex.ZH_DIGITS and c not in "十百千" for c in text):
        return None
    if not set(text) & set("十百千"):
        return int("".join(str(lex.ZH_DIGITS[c]) for c in text))
    total, digit = 0, None
    for c in text:
        if c in lex.ZH_DIGITS:
            digit = lex.ZH_DIGITS[c]
        else:
            total += (1 if digit is None else digit) * {"十": 10, "百": 100, "千": 1000}[c]
            digit = None
    return total + (digit or 0)


_NUMBERS = re.compile(f"[0-9]+|[A-Za-z](?![A-Za-z])|[{''.join(lex.ZH_DIGITS)}十百千]+|[{lex.ZH_STEMS}]")


def number_tokens(text: str | None) -> list[str]:
    """Numbers of an address part as ASCII: digits without leading zeros, numerals by value, heavenly stems and single letters as letters."""
    out = []
    for m in _NUMBERS.finditer(unicodedata.normalize("NFKC", text or "")):
        t = m[0]
        if t.isascii() and t.isdigit():
            out.append(t.lstrip("0") or "0")
        elif t in lex.ZH_STEMS:
            out.append(chr(ord("a") + lex.ZH_STEMS.index(t)))
        elif t.isascii():
            out.append(t.lower())
        else:
            out.append(str(zh_number(t)))
    return out


def render(components: Iterable[Component] | dict[str, str], levels: Iterable[str] | None = None) -> str:
    """The parts of ``levels`` (types; all if None) as one text: Chinese parts run on from the largest, others from the street with commas."""
    parts = dict(components) if isinstance(components, dict) else Address(0, 0, list(components)).parts()
    wanted = [k for k in ORDER if k in parts and (levels is None or k in set(levels))]
    values = [parts[k].replace("|", "") for k in wanted]
    if any(re.search(HAN, v) for v in values):
        return "".join(values)
    line = " ".join(parts[k] for k in ("number", "house_number", "road") if k in wanted)
    fine = [parts[k] for k in ("poi", "building", "unit", "suite", "room", "detail") if k in wanted]
    end = " ".join(parts[k] for k in ("province", "postal_code") if k in wanted)
    return ", ".join(x for x in (line, *fine, parts["city"] if "city" in wanted else "", end, parts["country"] if "country" in wanted else "") if x)
