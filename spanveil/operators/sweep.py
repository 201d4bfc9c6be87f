"""Clue resolution over tables of spans: what ``operators.clues`` does in one text, as joins, windows and running sums.

Spans: key, s, e, and what else a caller has. All windows are by key (a document).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def starts_inside(clues: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """``clues`` with ``inside``: whether they start in an active span. Events in order of their place, ends before starts: a running sum of
    opened and closed spans, no pair is made."""
    names = clues.columns
    rows = clues.select(key, F.col("s").alias("_at"), F.lit(2).alias("_kind"), F.lit(0).alias("_d"), F.struct(*names).alias("_row"))
    none = F.lit(None).cast(rows.schema["_row"].dataType)
    opened = active.where("s < e").select(key, F.col("s").alias("_at"), F.lit(1).alias("_kind"), F.lit(1).alias("_d"), none.alias("_row"))
    closed = active.where("s < e").select(key, F.col("e").alias("_at"), F.lit(0).alias("_kind"), F.lit(-1).alias("_d"), none.alias("_row"))
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    events = rows.unionByName(opened).unionByName(closed).withColumn("_open", F.sum("_d").over(w))
    return events.where("_row is not null").select("_row.*", (F.col("_open") > 0).alias("inside"))


def drop_inside(clues: DataFrame, active: DataFrame, key: str, keep: Column | None = None) -> DataFrame:
    """Clues that don't start in an active span, and those that ``keep`` saves (postal codes)."""
    rows = starts_inside(clues, active, key)
    return rows.where(~F.col("inside") | (F.lit(False) if keep is None else keep)).drop("inside")


def complement(texts: DataFrame, cuts: DataFrame, key: str, length: str = "n") -> DataFrame:
    """(key, s, e): what cuts leave of each text of ``texts`` (key, length), in order. The furthest end so far is a running maximum."""
    ends = texts.select(key, F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(0).alias("_last")).unionByName(texts.select(key, F.col(length).cast("int").alias("s"), F.col(length).cast("int").alias("e"), F.lit(1).alias("_last")))
    rows = ends.unionByName(cuts.select(key, "s", "e", F.lit(0).alias("_last")))
    w = Window.partitionBy(key).orderBy("s", "_last", "e").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_from", F.max("e").over(w))
    return rows.where("_from < s").select(key, F.col("_from").alias("s"), F.col("s").alias("e"))


def seed_cover(clues: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """``clues`` (key, s, e, strength, source, ...) that lie in no seed, or are hard clues of a dictionary."""
    c, x = clues.alias("c"), seeds.alias("x")
    inside = (F.col(f"c.{key}") == F.col(f"x.{key}")) & (F.col("x.s") <= F.col("c.s")) & (F.col("c.e") <= F.col("x.e"))
    kept = (F.col("c.source") != "lexicon") & (F.col("c.strength") == 2)
    return c.join(x, inside & ~kept, "left_anti")


def distinct_clues(clues: DataFrame) -> DataFrame:
    """Clues that agree in everything, also in the sorted lists of their metadata, are one."""
    if "metadata" not in clues.columns:
        return clues.distinct()
    names = clues.columns
    flat = F.to_json(F.transform(F.array_sort(F.map_entries("metadata")), lambda x: F.struct(x["key"].alias("k"), F.array_sort(x["value"]).alias("v"))))
    rest = [c for c in names if c != "metadata"]
    return clues.withColumn("_flat", flat).groupBy(*rest, "_flat").agg(F.first("metadata").alias("metadata")).select(*names)


def to_units(spans: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """``spans`` with unit_start and unit_last, from the table of ``tokens.units``: as-of by two windows over units and span ends, no pair is made."""
    names = spans.columns
    row = F.struct(*names)
    kind = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in spans.schema.fields) + ">"
    events = units.select(key, F.col("char_start").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col("unit_id").alias("_unit"), F.lit(None).cast(kind).alias("_row"))
    first = spans.select(key, F.col("s").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_unit"), row.alias("_row"))
    last = spans.select(key, (F.greatest("s", F.col("e") - 1)).cast("long").alias("_at"), F.lit(2).alias("_kind"), F.lit(None).cast("int").alias("_unit"), row.alias("_row"))
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.unionByName(first).unionByName(last).withColumn("_unit", F.last("_unit", ignorenulls=True).over(w)).where("_row is not null")
    ends = rows.groupBy("_row").agg(F.max(F.when(F.col("_kind") == 1, F.col("_unit"))).alias("unit_start"), F.max(F.when(F.col("_kind") == 2, F.col("_unit"))).alias("unit_last"))
    return ends.select("_row.*", "unit_start", "unit_last")


def unit_index(clues: DataFrame, key: str) -> DataFrame:
    """(key, unit_id, starts, covers, families): by unit, the ids of the clues that start there and that cover it, and the families that start. ``clues``:
    key, clue_id, family, unit_start, unit_last."""
    rows = clues.select(key, "clue_id", "family", "unit_start", F.explode(F.sequence("unit_start", "unit_last")).alias("unit_id"))
    here = F.col("unit_id") == F.col("unit_start")
    return rows.groupBy(key, "unit_id").agg(
        F.array_sort(F.collect_list(F.when(here, F.col("clue_id")))).alias("starts"),
        F.array_sort(F.collect_list("clue_id")).alias("covers"),
        F.array_sort(F.collect_set(F.when(here, F.col("family")))).alias("families"),
    )


def covered_wholly(spans: DataFrame, covers: DataFrame, key: str) -> DataFrame:
    """Spans of which every character lies in some cover: the union of the overlaps is as long as the span."""
    from spanveil.operators.joins import islands, overlap_join

    spans = spans.withColumn("_id", F.struct("s", "e"))
    hits = overlap_join(spans, covers, key).select(F.col(f"a.{key}").alias(key), F.col("a._id").alias("_id"), F.greatest("a.s", "b.s").alias("s"), F.least("a.e", "b.e").alias("e"))
    total = islands(hits, [key, "_id"], F.col("s") <= F.col("_end")).groupBy(key, "_id").agg(F.sum(F.col("e") - F.col("s")).alias("_n"))
    return spans.join(total, [key, "_id"]).where("_n = e - s").drop("_id", "_n")


def next_right(spans: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """``spans`` with ``next_s``: the start of the first of ``others`` at or right of their end; null if there is none. One window, no pair is made."""
    names = spans.columns
    rows = spans.select(key, F.col("e").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("int").alias("_s"), F.struct(*names).alias("_row"))
    marks = others.select(key, F.col("s").alias("_at"), F.lit(1).alias("_kind"), F.col("s").cast("int").alias("_s"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(0, Window.unboundedFollowing)
    return rows.unionByName(marks).withColumn("next_s", F.first("_s", ignorenulls=True).over(w)).where("_row is not null").select("_row.*", "next_s")
