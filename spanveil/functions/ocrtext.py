"""Cleaning of recognized text: compatibility forms, look-alikes, and noise-tolerant match text with a way back to the source."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters taken for each other, and what a comparison ignores.
ONES, ZEROS = "Il1", "O0О"
IGNORED = " -_.·•・()（）"


def clean(text: str) -> tuple[str, list[int]]:
    """(clean text, source index of each character): compatibility forms except of punctuation, no control or zero-width characters, runs
    of white space as one space, none at the ends."""
    out: list[str] = []
    at: list[int] = []
    for i, c in enumerate(text):
        kind = unicodedata.category(c)
        if c.isspace():
            if out and out[-1] != " ":
                out.append(" ")
                at.append(i)
        elif kind not in ("Cc", "Cf"):
            for x in c if kind.startswith("P") else unicodedata.normalize("NFKC", c):
                out.append(x)
                at.append(i)
    if out and out[-1] == " ":
        out.pop()
        at.pop()
    return "".join(out), at


def repair(text: str) -> str:
    """Look-alikes between two digits become digits, between two letters letters (lower case between lower-case ones); earlier repairs count
    for later ones."""
    out = list(text)
    for i in range(1, len(out) - 1):
        a, c, b = out[i - 1], out[i], out[i + 1]
        if c in ONES + ZEROS:
            if a.isdigit() and b.isdigit():
                out[i] = "1" if c in ONES else "0"
            elif a.isalpha() and b.isalpha() and c not in ("l",):
                low = a.islower() and b.islower()
                out[i] = ("l" if low else "I") if c in ONES else ("o" if low else "O")
    return "".join(out)


# What a comparison of each type ignores besides white space; others ignore IGNORED.
IGNORED_BY_TYPE = {"email": "", "phone": "-_.·()（）+", "bank_number": "-_.·", "id_number": "-_.·", "name": "·•・.", "license_plate": "·•-", "organization": " -_.·•・()（）,，&", "address": " -_.·•・()（）,，#"}


def match_text(value: str, attr: str = "") -> tuple[str, list[int]]:
    """Comparable text in lower case without the characters that its type ignores, and the source index of each of its characters."""
    ignored, out, at = IGNORED_BY_TYPE.get(attr, IGNORED), [], []
    for i, c in enumerate(value):
        for x in unicodedata.normalize("NFKC", c):
            if x not in ignored and not x.isspace():
                out.append(x.lower())
                at.append(i)
    return "".join(out), at


def find_value(text: str, value: str, attr: str = "") -> list[tuple[int, int]]:
    """Where a value stands in a text when noise is ignored, as spans of the text itself."""
    hay, at = match_text(text, attr)
    needle, _ = match_text(value, attr)
    out, k = [], hay.find(needle) if needle else -1
    while k >= 0:
        out.append((at[k], at[k + len(needle) - 1] + 1))
        k = hay.find(needle, k + len(needle))
    return out


@F.pandas_udf(T.StringType())
def _cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in batches:
        yield x.map(lambda v: None if v is None else repair(clean(v)[0]))


def cleaned(text: Column) -> Column:
    """Clean and repaired text. Plain ASCII without runs of spaces or look-alikes next to digits doesn't need Python."""
    simple = text.rlike(r"^[\x21-\x7e]+( [\x21-\x7e]+)*$") & ~text.rlike("[0-9][IlO][0-9]|[A-Za-z][10][A-Za-z]|[A-Z][l][A-Z]")
    return F.when(simple, text).otherwise(_cleaned(F.when(~F.coalesce(simple, F.lit(False)), text)))
