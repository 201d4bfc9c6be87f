"""Interval, as-of and band joins over spans, and windows that find runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(a: DataFrame, b: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Pairs of spans (s, e) of one ``key`` that overlap. The key is hashed; the interval test is a residual condition."""
    left, right = a.alias("a"), b.alias("b")
    return left.join(right, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.s") < F.col("b.e")) & (F.col("b.s") < F.col("a.e")), how)


def not_covered(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Spans of ``a`` that overlap no span of ``b``."""
    return overlap_join(a, b, key, "left_anti")


def covered(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Spans of ``a`` that overlap a span of ``b``."""
    return overlap_join(a, b, key, "left_semi")


def contained_drop(spans: DataFrame, key: str, score: str) -> DataFrame:
    """Drop spans without a score, and those inside another span of the same key and type that comes before them by score,
    start and length. A self-join on (key, type) with the order as its condition."""
    rank = F.struct((-F.col(score)).alias("k"), F.col("s").alias("s"), (F.col("s") - F.col("e")).alias("n"))
    x = spans.where(F.col(score) > 0).dropDuplicates([key, "entity_type", "s", "e", score]).withColumn("rank", rank)
    inside = (F.col("a.entity_type") == F.col("b.entity_type")) & (F.col("b.s") <= F.col("a.s")) & (F.col("a.e") <= F.col("b.e")) & (F.col("b.rank") < F.col("a.rank"))
    return x.alias("a").join(x.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & inside, "left_anti").drop("rank")


def islands(spans: DataFrame, keys: list[str], joined: Column) -> DataFrame:
    """Merge neighbouring spans of the same keys where ``joined``, a condition on s and the running end ``_end`` of the spans before, holds."""
    w = Window.partitionBy(*keys).orderBy("s", "e")
    rows = spans.withColumn("_end", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(w))
    return rows.groupBy(*keys, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n_spans")).drop("_island")


def union_lengths(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_islands, covered): islands and length of the union of each key's spans; touching ones are one."""
    merged = islands(spans, keys, F.col("s") <= F.col("_end"))
    return merged.groupBy(*keys).agg(F.count("*").alias("n_islands"), F.sum(F.col("e") - F.col("s")).alias("covered"))


def asof_left(events: DataFrame, key: str, at: str, is_anchor: Column, value: Column, within: int) -> DataFrame:
    """``events`` with ``anchor``: ``value`` of the nearest anchor at most ``within`` places to the left. One window, no join."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(is_anchor, F.struct(F.col(at).alias("at"), value.alias("v"))), ignorenulls=True).over(w)
    return events.withColumn("_last", last).withColumn("anchor", F.when(F.col(at) - F.col("_last.at") <= within, F.col("_last.v"))).drop("_last")


def band_boost(values: DataFrame, boosters: DataFrame, key: str, near: int = 3, far: int = 6) -> DataFrame:
    """``values`` (key, attr_type, at) with ``boost``: 2 if a booster of its type lies within ``near`` units before it, 1 within ``far``, else
    0. Boosters are dealt to buckets of width ``far`` and each value looks into two, so the join has an equality to hash."""
    b = boosters.select(F.col(key).alias("_k"), F.col("attr_type").alias("_t"), F.col("at").alias("_at"), F.floor(F.col("at") / far).alias("_b"))
    v = values.withColumn("_bucket", F.explode(F.array(F.floor(F.col("at") / far), F.floor(F.col("at") / far) - 1)))
    hit = v.join(b, (F.col(key) == F.col("_k")) & (F.col("attr_type") == F.col("_t")) & (F.col("_bucket") == F.col("_b")) & (F.col("at") - F.col("_at")).between(0, far), "left")
    best = F.min(F.col("at") - F.col("_at"))
    return hit.groupBy(*values.columns).agg(F.coalesce(F.when(best <= near, 2).otherwise(F.when(best <= far, 1)), F.lit(0)).alias("boost"))


def densest_window(values: DataFrame, keys: list[str], x: str, span: int) -> DataFrame:
    """(keys, lo, members): the window of width ``span`` that starts at a value and holds most values; least variance, then least start, on ties.
    Equal values are counted first, so a window's task holds the distinct values of a key, which are whole numbers."""
    v = values.groupBy(*keys, F.col(x).cast("long").alias("lo")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("lo").rangeBetween(0, span)
    total = lambda c: F.sum(c).over(w)
    d = F.col("lo").cast("decimal(38,0)")
    rows = v.select(*keys, "lo", total("n").alias("members"), total(F.col("n") * d).alias("s1"), total(F.col("n") * d * d).alias("s2"))
    var = ((F.col("members") * F.col("s2") - F.col("s1") * F.col("s1")).cast("double")) / (F.col("members") * F.col("members"))
    best = rows.withColumn("v", -F.round(var, 9)).groupBy(*keys).agg(F.max(F.struct("members", "v", (-F.col("lo")).alias("l"))).alias("b"))
    return best.select(*keys, (-F.col("b.l")).alias("lo"), F.col("b.members").alias("members"))


def longest_chain(values: DataFrame, keys: list[str], x: str, low: int, high: int) -> DataFrame:
    """(keys, start, links): the longest run of consecutive distinct values whose gaps lie between ``low`` and ``high``; the earliest on ties."""
    rows = values.select(*keys, F.col(x).alias("x")).distinct().withColumn("_new", F.when((F.col("x") - F.lag("x").over(Window.partitionBy(*keys).orderBy("x"))).between(low, high), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(Window.partitionBy(*keys).orderBy("x")))
    runs = rows.groupBy(*keys, "_run").agg(F.min("x").alias("start"), F.count("*").alias("links"))
    best = runs.groupBy(*keys).agg(F.max(F.struct("links", (-F.col("start")).alias("s"))).alias("b"))
    return best.select(*keys, (-F.col("b.s")).alias("start"), F.col("b.links").alias("links"))
