"""Pattern analyzer: recognizers over texts, checks, context, deny and allow lists, duplicates, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.functions import checks
from spanveil.functions.catalogue import RECOGNIZERS
from spanveil.functions.spans import NO_SPANS, find_spans, plain
from spanveil.operators.joins import contained_drop

#: What is looked for unless a caller names other entities.
COMMON = ("CREDIT_CARD", "EMAIL_ADDRESS", "IP_ADDRESS", "PHONE_NUMBER", "URL", "IBAN_CODE", "MAC_ADDRESS", "US_SSN")
# Tokens before a match that count as its context, what they add, the least and the largest score.
CONTEXT_TOKENS, CONTEXT_GAIN, CONTEXT_FLOOR = 5, 0.35, 0.4


def _quote(word: str) -> str:
    return "".join("\\" + c if c in r"\.^$|()[]{}*+?-" else c for c in word)


def deny_pattern(words: list[str]) -> str:
    """Any of the words, longest first, between non-word characters."""
    return r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(_quote(w) for w in sorted(words, key=lambda w: (-len(w), w))) + r")(?![A-Za-z0-9_])"


def _tag(spans: Column, entity: str, score: float) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(entity).alias("entity_type"), x["s"].alias("s"), x["e"].alias("e"), x["text"].alias("text"), F.lit(float(score)).alias("score")))


def matches(df: DataFrame, key: str, text: str, recognizers) -> DataFrame:
    """(key, plain_text, found) with an array of the matches of all patterns. A pattern is one pass over the text."""
    df = df.select(key, plain(F.col(text)).alias("plain_text"))
    every = []
    for i, (entity, patterns, _) in enumerate(recognizers):
        for j, (score, pattern) in enumerate(patterns):
            df = df.withColumn(f"_m{i}_{j}", find_spans(F.col("plain_text"), pattern if pattern.startswith("(?i)") else f"(?im){pattern}"))
            every.append(_tag(F.col(f"_m{i}_{j}"), entity, score))
    return df.select(key, "plain_text", F.concat(*every).alias("found"))


def checked(found: Column, entities) -> Column:
    """Matches that pass their type's check with score 1, those without a check as they are; refused ones are gone."""
    fields = ("entity_type", "s", "e", "text")
    judged = F.transform(found, lambda x: F.struct(*[x[n].alias(n) for n in fields], x["score"].alias("score"), checks.verdict(x["entity_type"], x["text"], entities).alias("ok")))
    kept = F.filter(judged, lambda x: F.coalesce(x["ok"], F.lit(True)))
    return F.transform(kept, lambda x: F.struct(*[x[n].alias(n) for n in fields], F.when(x["ok"], 1.0).otherwise(x["score"]).alias("score")))


def boosted(found: Column, recognizers) -> Column:
    """Raise the score of matches whose last CONTEXT_TOKENS tokens before them hold a context word of their type: it is part of a token, or a run
    of tokens. Tokens may be of any length; the text before a match is read from its end."""
    fields = ("entity_type", "s", "e", "text", "score")

    def near(x: Column) -> Column:
        # The reversed text is matched from its start, so that the search stops after the tokens wanted.
        back = F.reverse(F.substring("plain_text", 1, x["s"]))
        pattern = r"^(?:[^\p{L}\p{N}#]*[\p{L}\p{N}#]+){0,%d}" % CONTEXT_TOKENS
        tokens = F.regexp_extract_all(F.lower(F.reverse(F.regexp_extract(back, pattern, 0))), F.lit(r"[\p{L}\p{N}#]+"), F.lit(0))
        return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))

    def raised(x: Column) -> Column:
        hit = F.lit(False)
        for entity, _, context in recognizers:
            if context:
                hit = F.when(x["entity_type"] == entity, x["near"].rlike("|".join(_quote(w.lower()) for w in context))).otherwise(hit)
        return F.when(hit & (x["score"] < 1), F.least(F.lit(1.0), F.greatest(F.lit(CONTEXT_FLOOR), x["score"] + CONTEXT_GAIN))).otherwise(x["score"])

    found = F.transform(found, lambda x: F.struct(*[x[n].alias(n) for n in fields], near(x).alias("near")))
    return F.transform(found, lambda x: F.struct(*[x[n].alias(n) for n in fields[:-1]], raised(x).alias("score")))


def distinct_spans(found: Column) -> Column:
    """Without scores of 0, and without those inside another of the same type that comes before them by score, start and length. In the row:
    the matches of a text are sorted and each looks at those before it, until it meets one around it. ``found`` must be an attribute."""
    ranked = F.array_sort(F.transform(F.filter(found, lambda x: x["score"] > 0), lambda x: F.struct((-x["score"]).alias("k"), x["s"].alias("s"), (x["s"] - x["e"]).alias("n"), x["entity_type"].alias("entity_type"), x["text"].alias("text"))))
    return F.array_distinct(ranked)


def _uncovered(ranked: Column) -> Column:
    inside = lambda x, o: (o["entity_type"] == x["entity_type"]) & (o["s"] <= x["s"]) & (x["s"] - x["n"] <= o["s"] - o["n"])
    before = lambda x, o: (o["k"] < x["k"]) | ((o["k"] == x["k"]) & ((o["s"] < x["s"]) | ((o["s"] == x["s"]) & (o["n"] < x["n"]))))
    kept = F.filter(ranked, lambda x: ~F.exists(ranked, lambda o: inside(x, o) & before(x, o)))
    return F.transform(kept, lambda x: F.struct(x["entity_type"].alias("entity_type"), x["s"].alias("s"), (x["s"] - x["n"]).alias("e"), x["text"].alias("text"), (-x["k"]).alias("score")))


def analyze(df: DataFrame, key: str = "doc_id", text: str = "text", entities: tuple[str, ...] = COMMON, extra=(), threshold: float = 0.0, allow: tuple[str, ...] = (), allow_regex: str | None = None) -> DataFrame:
    """(key, entity_type, s, e, text, score): matches, checked, raised by context, without duplicates and contained ones of the same
    type, at or above ``threshold`` and not allowed by list or regular expression. ``extra`` adds recognizers of the catalogue's form."""
    chosen = [r for r in RECOGNIZERS if r[0] in entities] + list(extra)
    rows = matches(df, key, text, chosen)
    # Arrays in stages, then one generator: a filter on the rows can't be moved below and multiply the expressions.
    rows = rows.withColumn("found", checked(F.col("found"), {r[0] for r in chosen})).withColumn("found", boosted(F.col("found"), chosen))
    # Contained ones go where all matches of a text are, in its row: no shuffle.
    rows = rows.withColumn("found", distinct_spans(F.col("found"))).withColumn("found", _uncovered(F.col("found")))
    rows = rows.select(key, F.inline_outer("found")).where("s is not null").where(F.col("score") >= threshold)
    if allow:
        rows = rows.where(~F.col("text").isin(*allow))
    if allow_regex:
        rows = rows.where(~F.col("text").rlike(allow_regex))
    return rows.select(key, "entity_type", "s", "e", "text", F.round("score", 6).alias("score"))


def chunks(df: DataFrame, key: str, size: int = 250, overlap: int = 50, text: str = "text") -> DataFrame:
    """(key, chunk, s, e, text): pieces of ``size`` characters that start ``size - overlap`` apart and run on to the end of a
    word. Words are found once a text; a piece looks up where the word at its end ends."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length("plain_text") - overlap) / step))
    rows = df.select(key, plain(F.col(text)).alias("plain_text")).where("plain_text <> ''")
    # A piece and the stretch behind it up to the next piece's end hold its word's end, unless the word is longer; only then is the rest read.
    rows = rows.select(key, "plain_text", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("chunk")).withColumn("s", F.col("chunk") * step)
    rows = rows.withColumn("_after", F.expr(f"substring(plain_text, s + {size} + 1, {size})")).withColumn("_go", F.length(F.regexp_extract("_after", "^[^ \\n\\t]*", 0)))
    rest = F.when((F.col("_go") == F.length("_after")) & (F.length("_after") == size), F.length(F.expr(f"regexp_extract(substring(plain_text, s + {size} + 1), '^[^ \\\\n\\\\t]*', 0)"))).otherwise(F.col("_go"))
    rows = rows.withColumn("e", F.least(F.length("plain_text"), F.col("s") + size + rest))
    return rows.select(key, "chunk", "s", "e", F.expr("substring(plain_text, s + 1, e - s)").alias("text"))


def analyze_chunks(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 250, overlap: int = 50, **analysis) -> DataFrame:
    """analyze() piece by piece: (key, entity_type, s, e, text, score) with offsets in the whole text; what two pieces find is one, with its best
    score, and what lies inside another of its type is gone."""
    pieces = chunks(df, key, size, overlap, text).withColumn("_piece", F.concat_ws(":", F.col(key).cast("string"), "chunk"))
    found = analyze(pieces, "_piece", "text", **analysis)
    where = pieces.select(key, "_piece", F.col("s").alias("_s"))
    found = found.join(where, "_piece").select(key, "entity_type", (F.col("s") + F.col("_s")).cast("int").alias("s"), (F.col("e") + F.col("_s")).cast("int").alias("e"), "text", "score")
    best = found.groupBy(key, "entity_type", "s", "e", "text").agg(F.max("score").alias("score"))
    return contained_drop(best, key, "score")


def analyze_values(df: DataFrame, key: str, skip: tuple[str, ...] = (), **analysis) -> DataFrame:
    """(key, path, entity_type, s, e, text, score) of every value of a row: strings, the strings in structs, arrays and maps by their dotted
    path, numbers and booleans as text left alone (no results). Paths that ``skip`` names, and all below them, are left out."""
    parts = []
    for f in df.schema.fields:
        if f.name != key:
            parts += list(_leaves(F.col(f"`{f.name}`"), f.dataType, f.name, skip))
    if not parts:
        raise ValueError("no text in any column")
    rows = df.select(F.col(key), F.explode(F.filter(F.flatten(F.array(*parts)), lambda x: x["value"].isNotNull())).alias("x")).select(key, "x.path", "x.value")
    rows = rows.withColumn("_cell", F.concat_ws("\u0000", F.col(key).cast("string"), "path"))
    found = analyze(rows, "_cell", "value", **analysis)
    return found.join(rows.select("_cell", key, "path"), "_cell").select(key, "path", "entity_type", "s", "e", "text", "score")


def _leaves(column: Column, kind, path: str, skip: tuple[str, ...]):
    """Arrays of (path, value) for the strings in a column of any type."""
    if path in skip:
        return
    if isinstance(kind, T.StringType):
        yield F.array(F.struct(F.lit(path).alias("path"), column.alias("value")))
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _leaves(column.getField(f.name), f.dataType, f"{path}.{f.name}", skip)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        yield F.coalesce(F.transform(column, lambda x, i: F.struct(F.concat(F.lit(f"{path}."), i.cast("string")).alias("path"), x.alias("value"))), F.array().cast("array<struct<path:string,value:string>>"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType) and isinstance(kind.valueType, T.StringType):
        entries = F.filter(F.map_entries(column), lambda x: ~F.concat(F.lit(f"{path}."), x["key"]).isin(*skip) if skip else F.lit(True))
        yield F.coalesce(F.transform(entries, lambda x: F.struct(F.concat(F.lit(f"{path}."), x["key"]).alias("path"), x["value"].alias("value"))), F.array().cast("array<struct<path:string,value:string>>"))


def with_model(df: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, entity_type, s, e, text, score) from any model: ``model`` maps a list of texts to a list of lists of (entity_type, s, e, score), and
    gets the texts in Arrow batches."""
    import pyarrow as pa

    kind = dict(df.dtypes)[key]
    shape = pa.list_(pa.struct([("entity_type", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("text", pa.string()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [[{"entity_type": n, "s": s, "e": e, "text": t[s:e], "score": float(p)} for n, s, e, p in spans] for t, spans in zip(texts, model(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, shape)], [key, "found"])

    rows = df.select(key, F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, found array<struct<entity_type:string,s:int,e:int,text:string,score:double>>")
    return rows.select(key, F.inline("found"))
