"""Lexicons: word lists with strengths, keyword groups, aliases and plain lists from JSON files, as terms and as a table.

A lexicon is given as {kind: path}; kinds are the keys of KINDS. The shape of a file tells how it is read:

* {"hard": [...], "soft": [...], "weak": [...]}: terms by strength,
* [{"component_type": ..., "keywords": [{"text": ..., "strength": ...}]}]: keys of address parts,
* {alias: canonical}: aliases; {"countries": [{"canonical": ..., "aliases": [{"text": ..., "strength": ...}]}]} too,
* [{"text": ..., "normalized": ...}] or [term, ...]: plain lists,
* {section: any of these}: places by level, where a section's name tells the level.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from spanveil.functions import lexicons as lex

WEAK, SOFT, HARD = 0, 1, 2
STRENGTHS = {"weak": WEAK, "soft": SOFT, "hard": HARD}
# What a term of each kind says: family, role, component of an address.
KINDS: dict[str, tuple[str, str, str]] = {
    "surnames": ("name", "family", ""),
    "given_names": ("name", "given", ""),
    "name_starts": ("name", "start", ""),
    "org_suffixes": ("organization", "suffix", ""),
    "org_names": ("organization", "value", ""),
    "address_keys": ("address", "key", ""),
    "places": ("address", "value", ""),
    "states": ("address", "value", "province"),
    "countries": ("address", "value", "country"),
    "plates": ("license_plate", "value", ""),
    "numerals": ("control", "value", ""),
    "copulas": ("control", "value", ""),
    "not_names": ("negative", "name", ""),
    "not_addresses": ("negative", "address", ""),
    "not_orgs": ("negative", "organization", ""),
    "not_ui": ("negative", "ui", ""),
}
# Levels that a section of places has.
LEVELS = {"province": "province", "state": "province", "city": "city", "cities": "city", "district": "district", "districts": "district", "county": "district_city", "county_level": "district_city", "country": "country"}
#: Largest lexicon that is read on the driver, in characters.
LARGEST = 32_000_000


@dataclass(frozen=True)
class Term:
    """``source``: lexicon, local (personas) or session (earlier turns)."""

    text: str
    family: str
    role: str
    strength: int = HARD
    component: str = ""
    canonical: str = ""
    source: str = "lexicon"
    attr: str = ""

    @property
    def attr_type(self) -> str:
        return self.attr or self.family


def _items(payload, strength: str = "hard") -> Iterator[tuple[str, str, str, str]]:
    """(text, strength, component, canonical) of any of the shapes."""
    if isinstance(payload, dict) and payload.keys() & STRENGTHS.keys():
        for s in STRENGTHS:
            for x in payload.get(s) or ():
                yield str(x), s, "", ""
    elif isinstance(payload, dict) and "countries" in payload:
        for country in payload["countries"]:
            for alias in country.get("aliases") or ():
                yield str(alias.get("text", "")), str(alias.get("strength", "soft")), "country", str(country.get("canonical", ""))
    elif isinstance(payload, dict) and all(isinstance(v, str) for v in payload.values()):
        for alias, canonical in payload.items():
            yield alias, strength, "", canonical
    elif isinstance(payload, dict):
        for section, inner in payload.items():
            level = next((v for k, v in sorted(LEVELS.items(), key=lambda x: -len(x[0])) if section.lower().rstrip("s").startswith(k.rstrip("s"))), "")
            if level and isinstance(inner, (dict, list)) and not (isinstance(inner, dict) and all(isinstance(v, (str, list)) for v in inner.values()) and not inner.keys() & STRENGTHS.keys()):
                yield from ((t, s, c or level, n) for t, s, c, n in _items(inner))
    elif isinstance(payload, list):
        for x in payload:
            if isinstance(x, dict) and "keywords" in x:
                for k in x["keywords"]:
                    yield str(k.get("text", "")), str(k.get("strength", "soft")), str(x.get("component_type", "")), ""
            elif isinstance(x, dict):
                yield str(x.get("text", "")), str(x.get("strength", strength)), "", str(x.get("normalized", ""))
            else:
                yield str(x), strength, "", ""
    else:
        raise ValueError("a lexicon is an object or a list")


def parse(kind: str, payload) -> list[Term]:
    """The terms of one file: stripped, without blanks, each text once for a role, component and level; an alias that names two things is
    an error."""
    family, role, component = KINDS[kind]
    out, aliases = {}, {}
    for text, strength, part, canonical in _items(payload):
        text = text.strip()
        if not text:
            continue
        if canonical and aliases.setdefault(text.casefold(), canonical) != canonical:
            raise ValueError(f"{text!r} stands for {aliases[text.casefold()]!r} and {canonical!r}")
        if strength not in STRENGTHS:
            raise ValueError(f"no strength {strength!r}")
        out.setdefault((text, part or component), Term(text, family, role, STRENGTHS[strength], part or component, canonical))
    return list(out.values())


def read_lexicon(spark: SparkSession, paths: dict[str, str]) -> list[Term]:
    """The terms of files or folders of any file system, by kind."""
    out: list[Term] = []
    for kind, path in paths.items():
        rows = spark.read.text(path, wholetext=True)
        if rows.selectExpr("sum(length(value)) as n").first()["n"] > LARGEST:
            raise ValueError(f"the lexicon at {path} has more than {LARGEST} characters")
        for row in rows.collect():
            out += parse(kind, json.loads(row["value"]))
    return out


def city_provinces(payload: dict[str, list[str] | str]) -> dict[str, tuple[str, ...]]:
    """City -> the provinces it may lie in."""
    return {c: tuple([p] if isinstance(p, str) else p) for c, p in payload.items()}


def builtin() -> list[Term]:
    """The library's own small lists."""
    rows: list[Term] = []

    def add(words: Iterable[str], family: str, role: str, strength: int = HARD, component: str = "", canonical=lambda w: "") -> None:
        rows.extend(Term(w, family, role, strength, component, canonical(w)) for w in words)

    add(lex.GIVEN, "name", "given", SOFT)
    add(lex.SURNAMES, "name", "family", SOFT)
    add(lex.ZH_COMPOUND, "name", "family", HARD)
    add(lex.ZH_SURNAMES, "name", "family", SOFT)
    add(lex.NAME_STARTS, "name", "start")
    for attr, words in lex.LABELS.items():
        rows.extend(Term(w, "label", "label", HARD, "", "", "lexicon", attr) for w in words)
    for word, strength in lex.ORG_SUFFIX_STRENGTH.items():
        add([word], "organization", "suffix", STRENGTHS[strength])
    add(lex.ORG_NAMES, "organization", "value")
    for component, words in lex.EN_KEYS.items():
        add(words, "address", "key", HARD, component)
    for component, words in lex.ZH_KEYS.items():
        add(words, "address", "key", WEAK if component in lex.ZH_WEAK_KEYS else SOFT, component)
    add(lex.STATES, "address", "value", SOFT, "province")
    add(lex.STATE_NAMES.values(), "address", "value", HARD, "province")
    add((c.title() for c in lex.CITIES), "address", "value", SOFT, "city")
    add(lex.ZH_PROVINCES, "address", "value", SOFT, "province")
    add(lex.ZH_CITIES, "address", "value", SOFT, "city")
    for alias, canonical in lex.COUNTRY_ALIASES.items():
        add([alias], "address", "value", SOFT, "country", lambda w, c=canonical: c)
    add(lex.ZH_NOT_NAMES, "negative", "name")
    add(lex.ZH_NOT_ADDRESSES, "negative", "address")
    add(lex.ZH_NOT_ORGS, "negative", "organization")
    return rows


SCHEMA = "text string, family string, role string, strength int, component string, canonical string, source string, attr string"


def lexicon_table(spark: SparkSession, terms: list[Term]) -> DataFrame:
    return spark.createDataFrame([(t.text, t.family, t.role, t.strength, t.component, t.canonical, t.source, t.attr) for t in terms], SCHEMA)
