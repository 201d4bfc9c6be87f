"""Structured entities: pattern scans in a fixed order, each outside the spans of those before it, then validation, canonical
forms and the emission gate. One pass a document, no shuffle, no Python."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions import lexicons as lex
from spanveil.functions import normalize, validators
from spanveil.functions.spans import NO_SPANS, find_spans, normal, outside, plain
from spanveil.functions.tokens import OCR_BREAK, UNIT

# The patterns, in the order in which they are tried. Java's \d, \w and \b are ASCII.
CLOCK = "(?:[01]?[0-9]|2[0-3])[:：][0-5][0-9](?:[:：][0-5][0-9])?"
NUMBER = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)"
PREFIX, SUFFIX = "(?i:US\\$|USD|RMB|CNY|EUR|GBP|[$¥€£])", "(?i:USD|RMB|CNY|EUR|GBP|元|美元|欧元|英镑|dollars?|yuan)"
JOIN = r"[ \-()]*"
CN_BODY = rf"1[3-9](?:{JOIN}[0-9]){{9}}"
US_BODY = rf"[2-9](?:{JOIN}[0-9]){{2}}(?:{JOIN}[2-9])(?:{JOIN}[0-9]){{6}}"
US_REST = rf"[2-9](?:{JOIN}[0-9]){{2}}(?:{JOIN}[0-9]){{4}}"
#: A run of letters and digits with single joiners that mixes both or has a joiner. Plain words and numbers, by far the most, never match.
FRAGMENT = r"(?<![A-Za-z0-9])(?:[A-Za-z]+[0-9]|[0-9]+[A-Za-z]|[A-Za-z0-9]+[._+\-/][A-Za-z0-9])[A-Za-z0-9]*(?:[._+\-/][A-Za-z0-9]+)*"
PATTERNS: tuple[tuple[str, str, str], ...] = (
    # (group, kind, pattern)
    ("email", "email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,4}(?![A-Za-z0-9_%+-]|\.[A-Za-z0-9])"),
    ("time", "time_datetime", rf"(?<![A-Za-z0-9._-])[0-9]{{4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}(?:[T ]{CLOCK})?(?![A-Za-z0-9_-])"),
    ("time", "time_date_mdy", r"(?<![A-Za-z0-9._-])[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}(?![A-Za-z0-9_-])"),
    ("time", "time_md_clock", rf"(?<![A-Za-z0-9._-])[0-9]{{1,2}}/[0-9]{{1,2}}\s+{CLOCK}(?![A-Za-z0-9_-])"),
    ("time", "time_zh_datetime", rf"(?<![A-Za-z0-9._-])[0-9]{{4}}年[0-9]{{1,2}}月[0-9]{{1,2}}日(?:\s*{CLOCK})?(?![A-Za-z0-9_-])"),
    ("time", "time_zh_md_datetime", rf"(?<![A-Za-z0-9._-])[0-9]{{1,2}}月[0-9]{{1,2}}日(?:\s*{CLOCK})?(?![A-Za-z0-9_-])"),
    ("time", "time_clock", rf"(?<![A-Za-z0-9._-]){CLOCK}(?![A-Za-z0-9_-])"),
    ("amount", "amount_currency", rf"(?<![A-Za-z0-9.])(?:{PREFIX}\s*{NUMBER}(?:\.[0-9]{{2}})?(?:\s*{SUFFIX})?|{NUMBER}(?:\.[0-9]{{2}})?\s*{SUFFIX})(?![A-Za-z0-9])"),
    ("amount", "amount_decimal", rf"(?<![A-Za-z0-9.]){NUMBER}\.[0-9]{{2}}(?![A-Za-z0-9]|\.[0-9])"),
    ("alnum", "alnum_fragment", FRAGMENT),
    ("phone", "cn_country_code_paren", rf"(?<![A-Za-z0-9])\(\+?86\){JOIN}{CN_BODY}(?![A-Za-z0-9])"),
    ("phone", "cn_country_code", rf"(?<![A-Za-z0-9])\+?86{JOIN}{CN_BODY}(?![A-Za-z0-9])"),
    ("phone", "us_country_code_paren", rf"(?<![A-Za-z0-9])\(\+?1\){JOIN}{US_BODY}(?![A-Za-z0-9])"),
    ("phone", "us_country_code", rf"(?<![A-Za-z0-9])\+1{JOIN}{US_BODY}(?![A-Za-z0-9])"),
    ("phone", "us_trunk_area_paren", rf"(?<![A-Za-z0-9])1[ \-]*\([2-9][0-9]{{2}}\){JOIN}{US_REST}(?![A-Za-z0-9])"),
    ("num", "num_fragment", r"\+?[0-9](?:[ \-()_]*[0-9])*"),
)
# Country names that look like a code; how many units a label stands before its value at most to name its type, and to let it through.
COUNTRY_CODES = ("u.s", "u.s.a", "u.k", "p.r.c")
BIND_UNITS, CONTEXT_UNITS = 5, 20
#: Types whose labels count for structured values.
LABEL_TYPES = ("phone", "email", "bank_number", "id_number", "num", "alnum")
LABEL = r"(?i)(?<![A-Za-z])(?:" + "|".join(re.escape(w) for w in sorted((w for a in LABEL_TYPES for w in lex.LABELS[a]), key=lambda w: (-len(w), w))) + ")(?![A-Za-z])"
LABEL_OF = {w: a for a in LABEL_TYPES for w in lex.LABELS[a]}
# Numbers that name a year, a share, a clause, an issue or a measure.
NOT_PRIVATE = r"[0-9]{4}年|[0-9]{1,3}%|第[0-9]+[条项页章节]|No\.[0-9]+|[0-9]+(?:kg|cm|mm|m|km|g|ml|px|pt|em|rem|dp)\b"
#: What every match of a pattern holds, one of these: looked for first, since that costs far less than the pattern.
HOLDS = {
    "email": ("@",),
    "time_date_mdy": ("-", "/"),
    "time_md_clock": ("/",),
    "time_zh_datetime": ("年",),
    "time_zh_md_datetime": ("月",),
    "time_clock": (":", "："),
    "cn_country_code_paren": ("86)",),
    "cn_country_code": ("86",),
    "us_country_code_paren": ("1)",),
    "us_country_code": ("+1",),
    "us_trunk_area_paren": ("(",),
}
#: A cheap test: a text that no pattern can match has none of these.
ANY = r"[0-9@]|[A-Za-z][._+\-/][A-Za-z]"
HARD = "array<struct<s:int,e:int,text:string,kind:string>>"


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["text"].alias("text"), F.lit(kind).alias("kind")))


def hard_spans(df: DataFrame, text: str = "text", out: str = "hard") -> DataFrame:
    """``df`` with column ``out``: structured spans (s, e, text, kind) in text order, disjoint. Each pattern is a column of its own,
    so nothing is computed twice; ``plain_text`` is the text that offsets refer to."""
    names = df.columns
    df = df.withColumn("plain_text", plain(F.col(text))).withColumn("_scan", normal(F.col(text)))
    df = df.withColumn("_any", F.col("_scan").rlike(ANY)).withColumn("_not", F.when(F.col("_any"), find_spans(F.col("_scan"), NOT_PRIVATE)).otherwise(F.array().cast(NO_SPANS)))
    # All patterns at once, then one exclusion after another: few steps, since each is a plan of its own to be analyzed.
    scans = {}
    for k, (_, kind, pattern) in enumerate(PATTERNS):
        may = reduce(lambda a, b: a | b, [F.contains("_scan", F.lit(x)) for x in HOLDS[kind]]) if kind in HOLDS else F.lit(True)
        scans[f"_f{k}"] = F.when(F.col("_any") & may, find_spans(F.col("_scan"), pattern)).otherwise(F.array().cast(NO_SPANS))
    df = df.withColumns(scans).withColumn("_h0", F.array().cast(HARD))
    for k, (group, kind, _) in enumerate(PATTERNS):
        found = F.col(f"_f{k}")
        if group == "alnum":
            found = F.filter(found, lambda x: x["text"].rlike("[A-Za-z]") & ~F.lower(x["text"]).isin(*COUNTRY_CODES))
        if group == "phone":
            found = F.filter(found, lambda x: F.length(validators.only_digits(x["text"])) >= 10)
        if group == "num":
            found = F.filter(found, lambda x: F.length(validators.only_digits(x["text"])) >= 2)
            found = F.filter(found, lambda x: ~F.exists("_not", lambda o: (o["s"] <= x["s"]) & (x["e"] <= o["e"])))
        df = df.withColumn(f"_h{k + 1}", F.concat(F.col(f"_h{k}"), outside(_tagged(found, kind), F.col(f"_h{k}"))))
    return df.select(*[F.col(c) for c in names if c != out], "plain_text", F.array_sort(F.col(f"_h{len(PATTERNS)}")).alias(out))


def group_of(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for group, name, _ in PATTERNS:
        out = F.when(kind == name, F.lit(group)).otherwise(out)
    return out


def merge_numbers(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """``candidates`` (key, plain_text, s, e, attr_type, ...) in which number candidates of a document that only spaces separate are one (islands
    of a running comparison): its text spans them, its canonical form is their digits."""
    from pyspark.sql import Window

    names = candidates.columns
    w = Window.partitionBy(key).orderBy("s")
    gap = F.substring("plain_text", F.lag("e").over(w) + 1, F.col("s") - F.lag("e").over(w))
    rows = candidates.withColumn("_new", F.when((F.col("attr_type") == "num") & (F.lag("attr_type").over(w) == "num") & gap.rlike("^ +$"), 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(w))
    rest = [c for c in names if c not in (key, "s", "e", "plain_text")]
    firsts = F.min_by(F.struct("plain_text", *rest), "s").alias("_f")
    rows = rows.groupBy(key, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("_n"), firsts)
    rows = rows.select(key, "s", "e", "_n", "_f.*")
    whole = F.substring("plain_text", F.col("s") + 1, F.col("e") - F.col("s"))
    if "text" in names:
        rows = rows.withColumn("text", F.when(F.col("_n") > 1, whole).otherwise(F.col("text")))
    if "canonical" in names:
        rows = rows.withColumn("canonical", F.when(F.col("_n") > 1, validators.only_digits(whole)).otherwise(F.col("canonical")))
    return rows.select(*names)


def _nearest(x: Column) -> Column:
    """The label that ends last before a candidate, with what lies between."""
    before = F.filter("_labels", lambda o: o["e"] <= x["s"])
    return F.element_at(before, -1)


def _staged(rows: DataFrame, context: bool) -> tuple[DataFrame, tuple[str, ...]]:
    """``rows`` with ``_c``: structured spans with all that is known of them."""

    def stage(source: str, have: tuple[str, ...], *new) -> Column:
        return F.transform(source, lambda x: F.struct(*[x[n].alias(n) for n in have], *[f(x).alias(n) for n, f in new]))

    found = find_spans(F.col("_scan"), LABEL)
    rows = rows.withColumn("_scan", normal(F.col("plain_text"))).withColumn("_labels", F.when(F.size("hard") > 0, found).otherwise(F.array().cast(NO_SPANS)))
    kinds = F.create_map(*[F.lit(v) for pair in LABEL_OF.items() for v in pair])
    raw = F.transform("hard", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.substring("plain_text", x["s"] + 1, x["e"] - x["s"]).alias("text"), x["kind"].alias("kind"), group_of(x["kind"]).alias("grp")))
    have = ("s", "e", "text", "kind", "grp")
    # Atomic and possessive: a unit that is taken is never tried again in another way.
    between = lambda most: rf"^(?>{UNIT}){{0,{most - 1}}}+$"
    sure = lambda c: F.coalesce(c, F.lit(False))
    generic = lambda x: F.when(x["fragment"] == "NUM", "num").otherwise("alnum")
    # Fields of one group don't read each other.
    groups = (
        (
            ("fragment", lambda x: F.when(x["grp"].isin("phone", "num"), "NUM").when(x["grp"] == "alnum", "ALNUM")),
            ("region", lambda x: F.when(x["kind"].startswith("cn_"), "cn").when(x["kind"].startswith("us_"), "us")),
            ("_label", lambda x: F.when(F.size("_labels") > 0, _nearest(x))),
        ),
        (
            ("digits", lambda x: validators.phone_digits(validators.only_digits(x["text"]), x["region"], x["kind"])),
            ("_gap", lambda x: F.when(x["_label"].isNotNull(), F.substring("plain_text", x["_label"]["e"] + 1, x["s"] - x["_label"]["e"]))),
        ),
        (
            ("check_name", lambda x: validators.route(x["digits"], x["text"], x["fragment"], x["region"])),
            ("in_context", lambda x: sure(x["_gap"].rlike(between(CONTEXT_UNITS)) & ~F.contains(x["_gap"], F.lit(OCR_BREAK)))),
        ),
        (
            ("label_type", lambda x: F.when(x["in_context"] & x["_gap"].rlike(between(BIND_UNITS)), F.try_element_at(kinds, F.lower(x["_label"]["text"])))),
            ("_checked", lambda x: validators.attr_of(x["check_name"])),
        ),
        (("mismatch", lambda x: sure(x["_checked"].isNotNull() & (x["label_type"] != x["_checked"]))),),
        (("attr_type", lambda x: F.coalesce(F.when(~x["mismatch"], x["_checked"]), F.when(x["grp"].isin("email", "time", "amount"), x["grp"]).otherwise(generic(x)))),),
        (
            ("canonical", lambda x: normalize.canonical(x["attr_type"], x["text"])),
            ("emitted", lambda x: validators.passes_gate(x["attr_type"], x["text"], x["in_context"] | F.lit(context))),
        ),
    )
    rows = rows.withColumn("_c", raw)
    for group in groups:
        rows = rows.withColumn("_c", stage("_c", have, *group))
        have = (*have, *[name for name, _ in group])
    return rows, have


def candidates(df: DataFrame, key: str = "doc_id", text: str = "text", context: bool = False) -> DataFrame:
    """(key, plain_text, s, e, text, kind, fragment, region, digits, check_name, in_context, label_type, mismatch, attr_type, canonical,
    emitted) for each structured span.

    A span that passes a check has its type, unless the nearest label, at most BIND_UNITS units to its left, names another: then it falls back
    to a number or code, and ``mismatch`` says so. A label at most CONTEXT_UNITS units to the left, without a break between, lets short
    numbers and codes through; ``context`` does so for all texts, for values of a form.

    The stages are arrays that leave the row through ``inline_outer``: neither a filter on the rows nor the one that
    an inner generator would add is moved below it, and no field
    is extracted from an array, so the optimizer never multiplies the expressions."""
    rows, _ = _staged(hard_spans(df.select(key, text), text), context)
    return rows.select(key, "plain_text", F.inline_outer("_c")).drop("grp", "_label", "_gap", "_checked").where("s is not null")


def candidates_of(df: DataFrame, out: str, text: str = "text") -> DataFrame:
    """``df`` with plain_text and ``out``: its structured spans (s, e, kind), kind being the type; no generator, a row a row."""
    rows, _ = _staged(hard_spans(df, text), False)
    return rows.withColumn(out, F.transform("_c", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["attr_type"].alias("kind")))).drop("_c", "_scan", "_labels", "hard")
