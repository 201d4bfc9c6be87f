"""Canonical forms by attribute type."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.functions.lexicons import ORG_SUFFIX_STRENGTH
from spanveil.functions.validators import compact_clock, only_digits

#: Legal forms that an organization's canonical name loses: the strong ones.
LEGAL_FORMS = tuple(w for w, s in ORG_SUFFIX_STRENGTH.items() if s == "hard" or w in ("holdings", "group", "company", "co"))
# Currency words and signs that an amount loses.
CURRENCY = "USD|RMB|CNY|EUR|GBP|美元|欧元|英镑|元|dollars?|yuan"


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in batches:
        yield x.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(x: Column, mixed: bool = True) -> Column:
    """Compatibility form. Without ``mixed`` the values are known to be ASCII, which it leaves alone."""
    return _nfkc(x) if mixed else x


def half_width(x: Column) -> Column:
    """Full-width digits and a few signs as ASCII: what matters of NFKC for numbers, without Python."""
    return F.translate(x, "０１２３４５６７８９＋－（）", "0123456789+-()")


def email(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"\s", ""))


def digits(x: Column) -> Column:
    return only_digits(half_width(x))


def alnum(x: Column) -> Column:
    return F.upper(F.regexp_replace(half_width(x), r"[^\p{L}\p{N}]", ""))


def plate(x: Column) -> Column:
    return alnum(x)


def phone(x: Column, region: Column | None = None) -> Column:
    """Digits without 86 before a mobile number, and without 1 where the text shows it as a country or trunk code."""
    region = F.lit(None).cast("string") if region is None else region
    t = half_width(x)
    d = only_digits(t)
    ten = d.rlike("^1[2-9][0-9]{2}[2-9][0-9]{6}$")
    shown = t.rlike(r"^\s*(\+\s*1|\(\s*\+?1\s*\)|1[ -]*\()")
    cn, us = F.coalesce(region == "cn", F.lit(False)), F.coalesce(region == "us", F.lit(False))
    return F.when(~us & d.rlike("^861[3-9][0-9]{9}$"), F.substring(d, 3, 11)).when(ten & (us | (~cn & shown)), F.substring(d, 2, 10)).otherwise(d)


def name(x: Column) -> Column:
    """Latin names in lower case with single spaces and i read as l; other names without spaces and middle dots."""
    latin = x.rlike(r"^\s*[A-Za-z][A-Za-z .'’-]*\s*$")
    return F.when(latin, F.translate(F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))), "i", "l")).otherwise(F.regexp_replace(x, r"[\s·•・]", ""))


def amount(x: Column) -> Column:
    """The first number after currency words and signs are gone. Thousands separators end it."""
    t = F.regexp_replace(F.regexp_replace(half_width(x), f"(?i){CURRENCY}", ""), r"[$¥€£\s]", "")
    return F.regexp_extract(t, r"[0-9]+(?:\.[0-9]{2})?", 0)


PUNCTUATION = r"[\s\-_.,，。:：;；/\\|()（）【】\[\]#]+"  # fixed value: what a compact form loses


def compact(x: Column) -> Column:
    """Without punctuation and spaces, lower case if it has ASCII letters."""
    t = F.regexp_replace(half_width(x), PUNCTUATION, "")
    return F.when(t.rlike("[A-Za-z]"), F.lower(t)).otherwise(t)


def organization(x: Column, suffixes: tuple[str, ...]) -> Column:
    """Compact name without its legal forms: they are taken from the end, the longest first, one at a time, as long as something else is left."""
    one = "(?i)(?<=.)[\\s,.]*(?<![A-Za-z])(" + "|".join(_quoted(s) for s in sorted(suffixes, key=lambda s: (-len(s), s))) + ")[\\s.]*$"
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length(x) / 2).cast("int")))  # each takes a form of two characters at least
    return compact(F.aggregate(steps, F.trim(x), lambda rest, _: F.regexp_replace(F.trim(rest), one, "")))


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r".()&+*?[]{}|^$\-" else c for c in s)


def text(x: Column) -> Column:
    """Compatibility form with single spaces, in lower case; ASCII needs no Python."""
    plain = x.rlike(r"^[\x00-\x7f]*$")
    whole = F.when(plain, x).otherwise(nfkc(F.when(~plain, x)))
    return F.lower(F.trim(F.regexp_replace(whole, r"\s+", " ")))


def cleaned(x: Column) -> Column:
    """A value without separators and sentence ends around it."""
    return F.regexp_replace(F.regexp_replace(x, r"^[\s,，、:：;；|\-—]+", ""), r"[\s,，、:：;；|。.!！?？\-—]+$", "")


def plausible(attr: Column, x: Column) -> Column:
    """Whether a cleaned value may be of its type: a name has 2 to 6 ideographs or letters in 1 to 4 words and no digit; an organization at least two
    letters or ideographs; an address a word that only addresses have, or a number."""
    han, latin = x.rlike(r"^[\u4e00-\u9fff·]{2,6}$"), x.rlike(r"^[A-Za-z][A-Za-z .'’-]{0,79}$") & (F.size(F.split(x, " +")) <= 4)
    signal = x.rlike(r"[省市区县镇乡村路街巷弄号楼栋幢座室层]|[0-9]|(?i)\b(street|st|avenue|ave|road|rd|blvd|drive|lane|suite|apt|floor)\b")
    return F.when(attr == "name", han | latin).when(attr == "organization", F.length(F.regexp_replace(x, r"[^\p{L}]", "")) >= 2).when(attr == "address", signal).otherwise(F.length(x) > 0)


def canonical(attr: Column, text: Column) -> Column:
    """Canonical text by attribute type; organizations lose their legal forms, addresses need more than a string and are compacted here."""
    return (
        F.when(attr == "email", email(text))
        .when(attr == "phone", phone(text))
        .when(attr.isin("bank_number", "id_number"), digits(text))
        .when(attr.isin("passport_number", "driver_license", "alnum"), alnum(text))
        .when(attr == "license_plate", plate(text))
        .when(attr == "name", name(text))
        .when(attr == "amount", amount(text))
        .when(attr == "organization", organization(text, LEGAL_FORMS))
        .when((attr == "time") & (compact_clock(text) != ""), compact_clock(text))
        .otherwise(compact(text))
    )


def candidate_id(mode: Column, source: Column, canon: Column, attr: Column, block: Column, s: Column, e: Column) -> Column:
    """md5 over the parts joined by bars; a missing part reads None."""
    part = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    return F.md5(F.concat_ws("|", *[part(x) for x in (mode, source, canon, attr, block, s, e)]))
