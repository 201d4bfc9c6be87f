"""Spans as column expressions: find them, exclude overlaps, measure them, rewrite text around them.

A span is ``struct<s, e, text>`` with half-open code-point offsets from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks around a match. They are removed from input text first, so offsets refer to the text without them.
OPEN, CLOSE = "\x01", "\x02"
SPAN = "struct<s:int,e:int,text:string>"
NO_SPANS = f"array<{SPAN}>"


def plain(text: Column) -> Column:
    """Text without the two marks, full-width parentheses as ASCII ones; the empty string for null."""
    return F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, "")


def normal(text: Column) -> Column:
    """What scans read: full-width parentheses as ASCII ones. Offsets stay those of ``plain``."""
    return F.translate(plain(text), "（）", "()")


def find_spans(text: Column, pattern: str) -> Column:
    """All matches of a Java regular expression, left to right. ``text`` should be an attribute: it is read once. Matches are
    marked, the text is split at the marks, and running lengths give the offsets, so code points are counted."""
    parts = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), OPEN)

    def step(acc: Column, part: Column) -> Column:
        value = F.substring_index(part, CLOSE, 1)
        s = acc["at"]
        e = s + F.length(value)
        after = s + F.length(part) - F.lit(1)
        return F.struct(
            after.cast("int").alias("at"),
            F.concat(acc["out"], F.array(F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), value.alias("text")))).alias("out"),
        )

    start = F.struct(F.length(F.element_at(parts, 1)).cast("int").alias("at"), F.array().cast(NO_SPANS).alias("out"))
    # Most texts have no match: they skip the fold.
    return F.when(F.size(parts) > 1, F.aggregate(F.slice(parts, 2, F.size(parts) - 1), start, step, lambda a: a["out"])).otherwise(F.array().cast(NO_SPANS))


def overlaps(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def outside(new: Column, old: Column) -> Column:
    """Spans of ``new`` that overlap none of ``old``. ``old`` should be an attribute."""
    return F.filter(new, lambda x: ~F.exists(old, lambda o: overlaps(x, o)))


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def longest_first(spans: Column) -> Column:
    """Spans chosen greedily without overlap: longest first, leftmost among equals; in text order. ``spans`` should be an
    attribute."""
    ranked = F.array_sort(F.transform(spans, lambda x: F.struct((x["s"] - x["e"]).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x.alias("v"))))
    kind = "array<struct<k:int,s:int,e:int>>"
    slim = F.transform(ranked, lambda x: F.struct(x["k"], x["s"], x["e"]))
    taken = F.aggregate(slim, F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda o: overlaps(x, o)), acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_sort(F.transform(taken, lambda x: F.struct(x["s"], x["e"])))


def union_length(spans: Column) -> Column:
    """Length of the union of spans (s, e): touching and overlapping ones count once."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].cast("int").alias("s"), x["e"].cast("int").alias("e"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
    return F.aggregate(
        ordered,
        zero,
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["end"]))).cast("int").alias("n"), F.greatest(acc["end"], x["e"]).alias("end")),
        lambda acc: acc["n"],
    )


def splice(text: Column, edits: Column) -> Column:
    """Text with each edit (s, e, new) applied. Edits must be disjoint and in order."""
    done = F.aggregate(
        edits,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(x["e"].cast("int").alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), x["new"]).alias("out")),
        lambda acc: F.struct(acc["at"].alias("at"), acc["out"].alias("out")),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
