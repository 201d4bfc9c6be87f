"""Anonymizer operators over spans, their inverses, and conflict resolution between results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.operators.joins import islands

Operator = Callable[[Column, Column, dict], Column]


def replace(text: Column, entity: Column, p: dict) -> Column:
    return F.lit(p["new_value"]) if p.get("new_value") else F.concat(F.lit("<"), entity, F.lit(">"))


def redact(text: Column, entity: Column, p: dict) -> Column:
    return F.lit("")


def mask(text: Column, entity: Column, p: dict) -> Column:
    """``chars_to_mask`` characters from the start or the end by ``masking_char``; no more than there are."""
    n = F.least(F.lit(max(0, int(p.get("chars_to_mask", 0)))), F.length(text))
    char = str(p.get("masking_char", "*"))
    if len(char) != 1:
        raise ValueError("masking_char is one character")
    stars = F.repeat(F.lit(char), n)
    if p.get("from_end"):
        return F.concat(F.substring(text, F.lit(1), F.length(text) - n), stars)
    return F.concat(stars, F.substring(text, n + 1, F.length(text)))


def hashed(text: Column, entity: Column, p: dict) -> Column:
    """sha256 or sha512 of text and salt. The salt is required, so that reruns agree, and has 16 bytes at least."""
    salt = p.get("salt", "")
    if len(salt.encode()) < 16:
        raise ValueError("a salt of at least 16 bytes is needed")
    return F.sha2(F.concat(text, F.lit(salt)), {"sha256": 256, "sha512": 512}[p.get("hash_type", "sha256")])


def _key(p: dict) -> Column:
    key = p["key"].encode() if isinstance(p["key"], str) else p["key"]
    if len(key) not in (16, 24, 32):
        raise ValueError("a key has 128, 192 or 256 bits")
    return F.unhex(F.lit(key.hex()))


def encrypt(text: Column, entity: Column, p: dict) -> Column:
    """AES in CBC mode; URL-safe base64 of the initial vector and the cipher text. The vector is a keyed hash of the text, so equal
    values have equal cipher texts and reruns agree."""
    iv = F.unhex(F.substring(F.sha2(F.concat(F.lit(str(p["key"])), text), 256), 1, 32))
    return F.translate(F.base64(F.aes_encrypt(text, _key(p), F.lit("CBC"), F.lit("PKCS"), iv)), "+/\r\n", "-_")


def decrypt(text: Column, entity: Column, p: dict) -> Column:
    return F.aes_decrypt(F.unbase64(F.translate(text, "-_", "+/")), _key(p), F.lit("CBC"), F.lit("PKCS")).cast("string")


def keep(text: Column, entity: Column, p: dict) -> Column:
    return text


def custom(text: Column, entity: Column, p: dict) -> Column:
    """A user function from str to str, in Arrow batches."""
    function = p["lambda"]

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            out = x.map(lambda v: None if v is None else function(v))
            if not out.map(lambda v: v is None or isinstance(v, str)).all():
                raise TypeError("a custom operator returns a string")
            yield out

    return call(text)


class Operators:
    """Registry of operators by name, one for each direction."""

    def __init__(self):
        self.anonymize: dict[str, Operator] = {"replace": replace, "redact": redact, "mask": mask, "hash": hashed, "encrypt": encrypt, "keep": keep, "custom": custom}
        self.deanonymize: dict[str, Operator] = {"decrypt": decrypt, "keep": keep}

    def add(self, name: str, operator: Operator, back: bool = False) -> None:
        (self.deanonymize if back else self.anonymize)[name] = operator

    def remove(self, name: str, back: bool = False) -> None:
        table = self.deanonymize if back else self.anonymize
        if name not in table:
            raise ValueError(f"no operator {name!r}")
        del table[name]

    def expression(self, config: dict[str, tuple[str, dict]], back: bool = False) -> Column:
        """New text of a span by its entity type; ``DEFAULT`` serves the types that aren't named, else replace or keep."""
        table = self.deanonymize if back else self.anonymize
        name, params = config.get("DEFAULT", ("keep" if back else "replace", {}))
        out = table[name](F.col("text"), F.col("entity_type"), params)
        for entity, (name, params) in config.items():
            if entity != "DEFAULT":
                out = F.when(F.col("entity_type") == entity, table[name](F.col("text"), F.col("entity_type"), params)).otherwise(out)
        return out


def merge_same_type(spans: DataFrame, key: str) -> DataFrame:
    """Overlapping spans of a type become their union, with the largest score."""
    from pyspark.sql import Window

    w = Window.partitionBy(key, "entity_type").orderBy("s", "e")
    rows = spans.withColumn("_end", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_island", F.sum(F.when(F.col("s") < F.col("_end"), 0).otherwise(1)).over(w))
    return rows.groupBy(key, "entity_type", "_island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("score").alias("score")).drop("_island")


def drop_conflicts(spans: DataFrame, key: str) -> DataFrame:
    """Drop a span inside a larger one of any type, or equal to one with a larger score (on ties the earlier type name stays)."""
    a, b = spans.alias("a"), spans.alias("b")
    inside = (F.col("b.s") <= F.col("a.s")) & (F.col("a.e") <= F.col("b.e"))
    equal = (F.col("b.s") == F.col("a.s")) & (F.col("a.e") == F.col("b.e"))
    better = (F.col("b.score") > F.col("a.score")) | ((F.col("b.score") == F.col("a.score")) & (F.col("b.entity_type") < F.col("a.entity_type")))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & inside & (~equal | better), "left_anti")


def trim_intersections(spans: DataFrame, key: str) -> DataFrame:
    """Where neighbours still intersect, the one with the lower score gives way (the later one on ties)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("s", "e")
    before = lambda c: F.lag(c).over(w)
    after = lambda c: F.lead(c).over(w)
    rows = spans.withColumn("_s", F.when((before("e") > F.col("s")) & (before("score") >= F.col("score")), before("e")).otherwise(F.col("s")))
    rows = rows.withColumn("_e", F.when((after("s") < F.col("e")) & (after("score") > F.col("score")), after("s")).otherwise(F.col("e")))
    return rows.where("_s < _e").withColumn("s", F.col("_s")).withColumn("e", F.col("_e")).drop("_s", "_e")


def merge_spaced(spans: DataFrame, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Neighbours of a type that only spaces separate become one span."""
    rows = spans.join(docs.select(key, F.col(text).alias("_text")), key)
    between = F.substring("_text", F.col("_end") + 1, F.col("s") - F.col("_end"))
    return islands(rows, [key, "entity_type"], (F.col("s") >= F.col("_end")) & between.rlike("^ *$"))


def anonymize(docs: DataFrame, spans: DataFrame, key: str, config: dict[str, tuple[str, dict]], operators: Operators | None = None, back: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts, items): ``docs`` (key, text) with ``anonymized``, and the applied operators (key, entity_type, s, e, text) with offsets in
    the new text. Spans (key, s, e, entity_type) must be disjoint; offsets move by the running sum of the length changes."""
    from pyspark.sql import Window

    from spanveil.operators.placeholders import rewrite

    rows = spans.select(key, "entity_type", "s", "e").join(docs.select(key, F.col("text").alias("_text")), key)
    rows = rows.withColumn("text", F.substring("_text", F.col("s") + 1, F.col("e") - F.col("s"))).drop("_text")
    rows = rows.withColumn("new", (operators or Operators()).expression(config, back))
    w = Window.partitionBy(key).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.length("new") - (F.col("e") - F.col("s"))).over(w), F.lit(0))
    items = rows.withColumn("_s", F.col("s") + moved).select(key, "entity_type", F.col("_s").alias("s"), (F.col("_s") + F.length("new")).alias("e"), F.col("new").alias("text"))
    return rewrite(docs, rows.withColumnRenamed("new", "placeholder"), key, out="anonymized"), items
