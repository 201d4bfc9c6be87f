"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and hash bucket. A source's target is a number of whole passes over it plus a rest; the rest is
met by the documents whose hash lies below a threshold. The histogram's running sums show the bucket in which the threshold
falls; only that bucket is split further, until it holds one hash, so nothing is sorted but histograms of bounded size.
Thresholds are nested: a larger budget takes a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.common import forget, n_words, saved

#: Bits of the hash that one level of histograms reads, and of the whole hash.
LEVEL_BITS, HASH_BITS = 12, 60


def row_hash(key: Column) -> Column:
    """A number from 0 to 2^60 - 1 that depends on the key alone; null counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, share: tuple[int, int], weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): sources by code point, null last, have the weights in
    turn and share ``share`` (a ratio) of all sizes; a target stops at ``most`` times its source's size and the excess goes
    to the others by weight. That is target = min(most * size, level * weight) with one level for all, found where the
    prefix sums over ascending size/weight first leave a level that the next source can take. One row a source: these windows have no
    partition, so all sources meet in one task, some 100 bytes each."""
    rank = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", turn.cast("long"))
    up = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before, every = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("cap_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most).withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("num", F.sum("source_size").over(every) * share[0] - F.col("cap_before") * share[1]).withColumn("den", F.col("w_left") * share[1])
    fits = F.col("num") * F.col("w") <= F.col("source_size") * most * F.col("den")  # level <= cap / weight, in whole numbers
    s = s.withColumn("k", F.row_number().over(up)).withColumn("fits", fits)
    first = F.min(F.when(F.col("fits"), F.struct("k", "num", "den"))).over(every)
    s = s.withColumn("first", first)
    level = F.col("w") * F.col("first.num")
    return s.select("source", "source_size", F.when(F.col("k") >= F.col("first.k"), level.cast("double") / F.col("first.den")).otherwise((F.col("source_size") * most).cast("double")).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, bound): hashes up to ``bound`` are taken, which brings the sum of sizes as near to ``goal`` as whole
    hashes can (the middle of the last one's stretch is not beyond the goal).

    ``rows``: source, hash, size. ``goals``: source, goal. Each level sums sizes by source and the next LEVEL_BITS bits,
    within the bucket that the level above left open; at most 2^LEVEL_BITS rows a source reach a window."""
    open_ = saved(goals.select("source", "goal", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("bound")), "open")
    shift = HASH_BITS
    while shift > 0:
        shift -= LEVEL_BITS
        inside = rows.join(open_.where("bound is null").select(F.col("source").alias("s2"), "prefix"), F.expr("source <=> s2")).where(F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
        hist = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        upto = Window.partitionBy("source").orderBy("bucket")
        hist = hist.join(open_.select(F.col("source").alias("s2"), "goal", "below"), F.expr("source <=> s2")).drop("s2")
        hist = hist.withColumn("after", F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")).withColumn("before", F.col("after") - F.col("n"))
        # A bucket wholly below the goal is taken; the first that isn't holds the bound. With one hash left, nearest decides.
        hist = hist.withColumn("passed", F.when(F.col("lo") == F.col("hi"), F.col("before") + F.col("after") <= 2 * F.col("goal")).otherwise(F.col("after") <= F.col("goal")))
        cut = hist.groupBy("source").agg(
            F.max(F.when(F.col("passed"), F.col("hi"))).alias("taken"),
            F.min(F.when(~F.col("passed"), F.struct("bucket", "before", "lo", "hi"))).alias("stop"),
        )
        new = open_.join(cut.withColumnRenamed("source", "s2"), F.expr("source <=> s2"), "left")
        single = F.col("stop").isNull() | (F.col("stop.lo") == F.col("stop.hi"))
        floor = F.coalesce("taken", F.shiftleft(F.col("prefix"), shift + LEVEL_BITS) - 1)
        new = new.select(
            "source", "goal",
            F.when(F.col("bound").isNull() & ~single, F.col("stop.bucket")).otherwise(F.col("prefix")).alias("prefix"),
            F.when(F.col("bound").isNull() & ~single, F.col("stop.before")).otherwise(F.col("below")).alias("below"),
            F.when(F.col("bound").isNull() & single, floor).otherwise(F.col("bound")).alias("bound"),
        )
        nxt = saved(new, "open")
        forget(open_)
        open_ = nxt
        if open_.where("bound is null").isEmpty():
            break
    return open_.select("source", F.coalesce("bound", F.shiftleft(F.col("prefix"), shift) - 1).alias("bound"))


def mix_plan(rows: DataFrame, share: tuple[int, int] = (3, 2), weights: tuple[int, ...] = (3, 1, 2), most: int = 2) -> DataFrame:
    """(source, source_size, target, passes, bound) for rows (source, size, hash): a row takes part ``passes`` times, and
    once more if its hash is not beyond ``bound``."""
    aims = saved(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, most), "targets")
    aims = aims.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    bounds = thresholds(rows, aims.select("source", (F.col("target") - F.col("passes") * F.col("source_size")).alias("goal")))
    return aims.join(bounds.withColumnRenamed("source", "s2"), F.expr("source <=> s2"), "left").drop("s2")


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", n_words(F.col("text"))).withColumn("hash", row_hash(F.col("doc_id")))


def times() -> Column:
    return (F.col("passes") + F.when(F.col("hash") <= F.col("bound"), 1).otherwise(0)).cast("int")


def mix_sources(docs: DataFrame, share: tuple[int, int] = (3, 2), weights: tuple[int, ...] = (3, 1, 2), most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and times of each row of ``docs`` (doc_id, text, source, ...).

    ``taken`` is size times the passes in which the row takes part: all whole passes, and the last partial one if its hash
    is not beyond its source's bound. So it is between 0 and ``most`` times the size, and a source's sum misses the target by
    no more than half of one document. Reruns agree: hashes come from doc_id alone.

    Null text has size 0. A null source is a source, ranked last. A null doc_id counts as an empty one. Rows that repeat a
    doc_id have one hash and go in or out together. Empty input gives an empty result. Other columns are ignored."""
    rows = saved(sized(docs.select("doc_id", "text", "source")).select("doc_id", "source", "size", "hash"), "sizes")
    plan = mix_plan(rows, share, weights, most).withColumnRenamed("source", "s2")
    out = rows.join(plan, F.expr("source <=> s2")).withColumn("times", times())
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "times")


def mix_documents(docs: DataFrame, share: tuple[int, int] = (3, 2), weights: tuple[int, ...] = (3, 1, 2), most: int = 2) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it, with their own columns. The plan has a row
    a source; it is written first, so its size is known when the join is planned and the texts stay where they are."""
    names = docs.columns
    rows = saved(sized(docs.select("doc_id", "text", "source")).select("source", "size", "hash"), "sizes")
    plan = saved(mix_plan(rows, share, weights, most).select(F.col("source").alias("s2"), "passes", "bound"), "plan")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "source", row_hash(F.col("doc_id")).alias("hash"))
    out = held.join(plan, F.expr("source <=> s2")).withColumn("times", times()).where("times > 0")
    out = out.select("_row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_pass"))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names])
