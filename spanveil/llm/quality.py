"""Quality rules as a short-circuit cascade.

A document is rejected by the first rule it breaks. Each rule's cost (time of its expression, with the measures it needs) and
selectivity (share that it rejects) are estimated on a sample; rules are evaluated in the order of rejections per cost, each only
on what the earlier ones kept, and a measure is taken only for documents that reach a rule which needs it. Which rules a document
breaks doesn't depend on the order, so the verdict doesn't either.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import SPACE, SPACE_CHARS, n_words

#: Number of rows, and most characters of each, on which costs and selectivities are estimated. This bounds the estimate, never the result.
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 50_000


@dataclass(frozen=True)
class Rule:
    """``fails`` maps the measures ``needs`` of a document, and its text, to true where the rule rejects it; never null."""

    name: str
    fails: Callable[[], Column]
    needs: tuple[str, ...] = ()


def word_array(text: str = "text") -> Column:
    """Words of a text, no empty ones; an empty array for null."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _windows(words: Column, width: int = 3) -> Column:
    """A hash of each window of ``width`` words, in order."""
    at = lambda i, k: F.get(words, i + k)
    spots = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.xxhash64(*[at(i, k) for k in range(width)]))


def _covered(pairs: Column, width: int = 3) -> Column:
    """Number of words in windows whose hash occurs twice or more, from the (hash, start) pairs in order: such windows'
    starts in order, each of which adds the words up to the next start, ``width`` at most. ``pairs`` must be an attribute:
    an expression would be evaluated again for every element."""
    marked = F.transform(pairs, lambda p, k: F.when((F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]), p["i"]))
    starts = F.sort_array(F.filter(marked, lambda i: i.isNotNull()))
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i - acc["last"])).cast("int").alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _lines() -> Column:
    return F.filter(F.split(_text(), "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)


def _marked_windows(h: str) -> Column:
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), pairs)


#: Each measure as columns that are added one after another; the last is the measure. Columns that begin with _ are shared.
MEASURES: dict[str, tuple[tuple[str, Callable[[], Column]], ...]] = {
    "n_words": (("n_words", lambda: n_words(F.col("text"))),),
    "word_chars": (("word_chars", lambda: F.length(F.regexp_replace(_text(), f"{SPACE}+", "")).cast("long")),),
    "n_symbols": (("n_symbols", lambda: (F.length(_text()) - F.length(F.regexp_replace(_text(), "[#*$%&|<>]", ""))).cast("long")),),
    "n_dup_lines": (("_l", _lines), ("n_dup_lines", lambda: (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))),
    "n_repeat_words": (
        ("_w", lambda: word_array()),
        ("_h", lambda: _windows(F.col("_w"))),
        ("_p", lambda: _marked_windows("_h")),
        ("n_repeat_words", lambda: F.when(F.col("_p").isNull(), F.lit(0)).otherwise(_covered(F.col("_p"))).cast("long")),
    ),
}
BASE = tuple(MEASURES)


def _with_measures(df: DataFrame, names: tuple[str, ...], where: Column | None = None) -> DataFrame:
    """``df`` with the measures that it hasn't yet, taken only ``where``."""
    for name in names:
        if name not in df.columns:
            new = [(c, e) for c, e in MEASURES[name] if c not in df.columns]
            for column, expression in new:
                df = df.withColumn(column, expression() if where is None else F.when(where, expression()))
            df = df.drop(*[c for c, _ in new[:-1]])
    return df


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = docs.withColumn("_w", word_array()).withColumn("n_words", F.size("_w").cast("long"))
    words = words.withColumn("word_chars", F.aggregate("_w", F.lit(0).cast("long"), lambda n, w: n + F.length(w)))
    return _with_measures(words, BASE).drop("_w")


def n_lines() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(1))


def count_of(pattern: str) -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0))


#: The base rules, and the method's own ones, over whole numbers so that any engine decides alike.
BASE_RULES = (
    Rule("few_words", lambda: F.col("n_words") < 50, ("n_words",)),
    Rule("repeats", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"), ("n_words", "n_repeat_words")),
)
RULES = (
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words"), ("n_words", "n_symbols")),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")), ("n_words", "word_chars")),
    Rule("dup_lines", lambda: 100 * F.col("n_dup_lines") > 50 * n_lines(), ("n_dup_lines",)),
    Rule("letters", lambda: 100 * count_of(r"[\p{L}]") < 60 * F.col("word_chars"), ("word_chars",)),
    Rule("bullets", lambda: 100 * count_of(r"(?m)^[ \t]*[-*•]") > 90 * n_lines()),
    Rule("all_caps", lambda: 100 * count_of(r"\p{Lu}") > 60 * F.col("word_chars"), ("word_chars",)),
)


def base_failed() -> Column:
    return reduce(lambda a, b: a | b, [r.fails() for r in BASE_RULES])


def sampled(docs: DataFrame, rows: int, chars: int) -> DataFrame:
    """About ``rows`` texts of at most ``chars`` characters, chosen over the whole table by a hash of doc_id. The count reads no column, the
    choice takes one pass over the texts."""
    total = docs.count()
    share = min(1.0, rows / max(total, 1))
    bound = int(share * (1 << 32))
    chosen = docs.select("text").where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < bound) & (F.length("text") <= chars))
    return chosen.limit(2 * rows)


def plan_cascade(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> list[tuple[Rule, float, float]]:
    """Rules with cost (seconds a row) and selectivity, best rejection per cost first; ties by name. A rule's cost includes the
    measures it needs, as if it came first. Each is timed on a sample, less the time of a plain pass."""
    spark = docs.sparkSession
    texts = sampled(docs, sample_rows, sample_chars).collect()
    if not texts:
        return [(r, 0.0, 0.0) for r in rules]
    sample = spark.createDataFrame(texts, "text string").coalesce(1)

    def timed(frame: DataFrame, what: Column) -> tuple[float, int]:
        probe = frame.agg(what.alias("n"))
        probe.collect()
        start = time.perf_counter()
        n = probe.collect()[0]["n"]
        return time.perf_counter() - start, n

    plain, _ = timed(sample, F.count("text"))
    out = []
    for rule in rules:
        took, rejected = timed(_with_measures(sample, rule.needs), F.count_if(rule.fails()))
        out.append((rule, max(1e-7, (took - plain) / len(texts)), rejected / len(texts)))
    return sorted(out, key=lambda x: (-x[2] / x[1], x[0].name))


def verdict(rules: list[Rule]) -> Column:
    """Name of the first broken rule in the order given, or null; later rules aren't evaluated once one is broken."""
    return reduce(lambda rest, rule: F.when(rule.fails(), F.lit(rule.name)).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def quality_rules(docs: DataFrame, rules=RULES, order: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) reduced to doc_id with the base measures, base_failed, first_failed and kept.

    The base rules come first here, since their measures are returned anyway; a document that they reject skips the others, which
    run in the cascade's order (``order``: names, else estimated on a sample). Null text counts as an empty one: no words,
    so base_failed. Repeated rows are judged one by one. Empty input gives an empty result; other columns are ignored.
    """
    by_name = {r.name: r for r in rules}
    plan = [by_name[n] for n in order] if order else [r for r, _, _ in plan_cascade(docs, rules)]
    out = measured(docs.select("doc_id", "text")).withColumn("base_failed", base_failed())
    out = out.withColumn("first_failed", F.when(F.col("base_failed"), F.lit("base")).otherwise(verdict(plan)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "first_failed", F.col("first_failed").isNull().alias("kept"))


def cascaded(docs: DataFrame, plan: list[Rule]) -> DataFrame:
    """``docs`` (text, ...) with ``_verdict``, the first rule of ``plan`` that a row breaks, or null. Every step looks at the verdict so
    far: rows that have one skip its measures and its rule."""
    out = docs.withColumn("_verdict", F.lit(None).cast("string"))
    for rule in plan:
        live = F.col("_verdict").isNull()
        out = _with_measures(out, rule.needs, live)
        out = out.withColumn("_verdict", F.when(live & rule.fails(), F.lit(rule.name)).otherwise(F.col("_verdict")))
    return out


def keep_good(docs: DataFrame, rules=(*BASE_RULES, *RULES), order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns and nothing else. The base rules are rules of the cascade like the others.
    Judged in place: no join, no shuffle. Null text has no words and goes; a null doc_id is judged like others; repeated rows
    each; empty input gives an empty result; columns may have any names. Rows leave through an outer generator: a filter, also
    the one that an inner generator would add, would be pushed below the measures, which would then be computed anew for every
    element of the arrays they use."""
    names, by_name = docs.columns, {r.name: r for r in rules}
    plan = [by_name[n] for n in order] if order else [r for r, _, _ in plan_cascade(docs, rules)]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text"))
    judged = cascaded(held, plan)
    out = judged.select("_row", F.explode_outer(F.when(F.col("_verdict").isNull(), F.array(F.lit(1)))).alias("_one")).where("_one is not null")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names])
