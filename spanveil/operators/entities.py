"""When two values are the same entity, and the fold that gives the values of a session their numbers.

Equality decides for most types. Names, organizations and addresses compare parts, which isn't transitive, so the fold keeps the
first match in the order of entity numbers.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from spanveil.functions import lexicons as lex

# Display levels of an address in their order, and the level of each component.
LEVELS = ("COUNTRY", "PROV", "CITY", "DIST", "ROAD", "DTL")
LEVEL_OF = {"country": "COUNTRY", "province": "PROV", "city": "CITY", "district": "DIST", "district_city": "DIST", "subdistrict": "DIST", "road": "ROAD", "number": "DTL", "house_number": "DTL", "poi": "DTL", "building": "DTL", "unit": "DTL", "room": "DTL", "suite": "DTL", "detail": "DTL"}
# Share of matching parts, and of a shorter text in a longer one, above which two addresses are the same.
PARTS_SHARE, TEXT_SHARE = 0.3, 0.5
POI_RANK = ("residence", "garden", "building", "commercial", "parking")
_UNIT_WORDS = re.compile(r"^(apt|apartment|unit|suite|ste|room|bldg|building|#)\.?\s*", re.IGNORECASE)


def fold(text: str | None) -> str:
    """Compatibility form without punctuation and spaces, in lower case."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text or "")).lower()


def name_parts(text: str) -> tuple[str, str]:
    """(family, given). A single Latin token is a given name; other shapes than Latin and Chinese have neither."""
    t = unicodedata.normalize("NFKC", text or "").strip()
    if re.fullmatch(r"[A-Za-z][A-Za-z .,'’-]*", t):
        if "," in t:
            family, _, given = t.partition(",")
            return family.strip().lower(), given.split()[0].lower() if given.split() else ""
        words = t.lower().split()
        return (words[-1] if len(words) > 1 else "", words[0])
    if re.fullmatch(r"[一-鿿·]{2,6}", t):
        n = 2 if t[:2] in lex.ZH_COMPOUND else 1
        return t[:n], t[n:]
    return "", ""


def same_name(a: str, b: str, strict: bool = False) -> bool:
    """Given names must agree; family names too if both are there. ``strict`` asks for equal text."""
    if strict:
        return fold(a) == fold(b) != ""
    (fa, ga), (fb, gb) = name_parts(a), name_parts(b)
    return bool(ga and gb and ga == gb and (not fa or not fb or fa == fb))


def same_organization(a: str, b: str) -> bool:
    """One name is part of the other, without legal forms."""
    x, y = (strip_legal(fold(v)) for v in (a, b))
    return bool(x and y and (x in y or y in x))


def strip_legal(text: str) -> str:
    again = True
    while again:
        again = False
        for s in (*lex.ZH_ORG_SUFFIXES, *lex.ORG_SUFFIXES):
            if text.endswith(s) and len(text) > len(s):
                text, again = text[: -len(s)], True
                break
    return text


def numbers_agree(a: list[str], b: list[str]) -> bool:
    """The shorter list occurs in order in the longer one's end, or in it with a share of more than 0.4."""
    if not a or not b:
        return True
    short, long = sorted((a, b), key=len)
    if long[-len(short) :] == short:
        return True
    at = next((i for i in range(len(long) - len(short) + 1) if long[i : i + len(short)] == short), None)
    return at is not None and len(short) / len(long) > 0.4


def same_address(a: dict, b: dict) -> bool:
    """``a`` and ``b``: component -> value, or {"text": value} for an address without components; these never match the others.
    Country, province, number and postal code must be equal where both have them; other shared parts must agree by substring,
    unit-like ones by kind and value; and more than PARTS_SHARE of the smaller one's parts must be shared."""
    if ("text" in a) != ("text" in b):
        return False
    if "text" in a:
        x, y = sorted((fold(a["text"]), fold(b["text"])), key=len)
        return bool(x) and (x == y or (x in y and len(x) / len(y) > TEXT_SHARE))
    x, y = ({k: fold(_UNIT_WORDS.sub("", v)) for k, v in c.items() if fold(v)} for c in (a, b))
    for k in ("country", "province", "house_number", "number", "postal_code"):
        if k in x and k in y and x[k] != y[k]:
            return False
    inner = ("unit", "room", "suite", "building", "detail")
    kinds = [{k for k in inner if k in c} for c in (x, y)]
    if kinds[0] and kinds[1] and not kinds[0] & kinds[1]:
        return False
    hits = 0
    for k in x.keys() & y.keys():
        if k in inner and x[k] != y[k]:
            return False
        if not (x[k] in y[k] or y[k] in x[k]):
            return False
        hits += 1
    return hits / max(1, min(len(x), len(y))) > PARTS_SHARE


def same_entity(attr: str, a: dict, b: dict) -> bool:
    """``a``, ``b``: canonical, and for addresses components."""
    if attr == "name":
        return same_name(a["canonical"], b["canonical"])
    if attr == "organization":
        return same_organization(a["canonical"], b["canonical"])
    if attr == "address":
        return same_address(a.get("components") or {"text": a["canonical"]}, b.get("components") or {"text": b["canonical"]})
    return bool(a["canonical"]) and a["canonical"] == b["canonical"]


def address_spec(components: dict | None) -> str:
    """Display levels of an address in their fixed order, joined by hyphens."""
    have = {LEVEL_OF[k] for k, v in (components or {}).items() if v and k in LEVEL_OF}
    return "-".join(x for x in LEVELS if x in have)


def enough(components: dict | None) -> bool:
    """Whether an address is precise enough to be looked up: one part below the district, or two above."""
    levels = [LEVEL_OF[k] for k, v in (components or {}).items() if v and k in LEVEL_OF]
    return any(x in ("ROAD", "DTL") for x in levels) or len(set(levels)) >= 2


def road_of(components: dict | None) -> str:
    return fold((components or {}).get("road"))


def poi_choice(pois: list[tuple[str, str]]) -> str | None:
    """The place of the best ranked kind, the first among equals; ``pois`` are (kind, value)."""
    rank = lambda k: POI_RANK.index(k) if k in POI_RANK else len(POI_RANK)
    return min(enumerate(pois), key=lambda p: (rank(p[1][0]), p[0]))[1][1] if pois else None


@dataclass
class Entity:
    number: int
    attr: str
    canonical: str
    components: dict = field(default_factory=dict)
    first_text: str = ""

    def take(self, components: dict | None) -> None:
        """Parts that it hasn't yet."""
        for k, v in (components or {}).items():
            if v and not self.components.get(k):
                self.components[k] = v


class Session:
    """Entities of one session. Equality types are found by key; addresses by road first, then among those without a road."""

    def __init__(self, entities: list[Entity] | None = None):
        self.entities: list[Entity] = entities or []
        self.by_key = {(e.attr, e.canonical): e for e in reversed(self.entities)}
        self.by_type: dict[str, list[Entity]] = {}
        for e in self.entities:
            self.by_type.setdefault(e.attr, []).append(e)
        self.last = max((e.number for e in self.entities), default=0)

    def number(self, attr: str, text: str, canonical: str, components: dict | None = None) -> Entity:
        found = self.by_key.get((attr, canonical)) if attr not in ("name", "organization", "address") else None
        if attr in ("name", "organization", "address"):
            value = {"canonical": canonical if attr != "name" else text, "components": components}
            road = road_of(components)
            same = self.by_type.get(attr, [])
            if attr == "address" and road:
                same = [e for e in same if road_of(e.components) == road] + [e for e in same if not road_of(e.components)]
            found = next((e for e in same if same_entity(attr, {"canonical": e.canonical if attr != "name" else e.first_text, "components": e.components or None}, value)), None)
        if found is None:
            self.last += 1
            found = Entity(self.last, attr, canonical, dict(components or {}), text)
            self.entities.append(found)
            self.by_type.setdefault(attr, []).append(found)
            self.by_key[(attr, canonical)] = found
        else:
            found.take(components)
        return found


def placeholder(entity: Entity, text: str, components: dict | None = None) -> str:
    """The placeholder of one value of an entity; its SPEC is of the value's own components."""
    from spanveil.operators.placeholders import CODES

    tail = f".LEN={len(text)}" if entity.attr in ("num", "alnum") else ""
    if entity.attr == "address" and (spec := address_spec(components)):
        tail = f".{spec}"
    return f"[[{CODES[entity.attr]}#{entity.number}{tail}]]"


def project(components: dict, spec: str) -> str:
    """The parts of an address that a SPEC names, in the order of levels."""
    wanted = spec.split("-")
    return "".join(v if ord(v[0]) > 0x2E80 else f"{v} " for level in LEVELS if level in wanted for k, v in components.items() if v and LEVEL_OF.get(k) == level).strip()


class Aliases:
    """Session aliases: reuse one for the same entity at confidence 0.85 or more, else the type's next number."""

    def __init__(self, least: float = 0.85):
        self.least, self.known, self.count = least, [], {}

    def alias(self, attr: str, canonical: str, confidence: float = 1.0) -> str:
        if confidence >= self.least:
            for a, c, name in self.known:
                if a == attr and same_entity(attr, {"canonical": c}, {"canonical": canonical}):
                    return name
        self.count[attr] = self.count.get(attr, 0) + 1
        self.known.append((attr, canonical, f"{attr}:{self.count[attr]}"))
        return self.known[-1][2]
