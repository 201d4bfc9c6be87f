"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (key, n), bucketed and sorted by key: n documents hold a line with that key. The documents come in batches. Each
counts its own keys, drops those that are settled by an anti-join with the settled ones, and is merge-joined with the runs; keys
whose documents reach the limit are settled, and the rest of the batch becomes a run of the lowest level. When a level has
``fanout`` runs they are merged into one of the next level, so a key is rewritten once a level and a batch meets few runs. All runs
have the same buckets, so only a batch's own counts are ever moved.

Keys are compared by two 64-bit hashes with different seeds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import SPACE_CHARS, ascii_lower, bucketed, forget, saved


def lines_of(text: Column) -> Column:
    """Lines separated by \\n; one empty line for a null or empty text."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


KEY = ["k1", "k2"]


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2"))


class LineRuns:
    """Document counts of line keys, fed batch by batch."""

    def __init__(self, min_docs: int, fanout: int = 2):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """``batch``: (k1, k2, n), each key once."""
        for known in self.settled:
            batch = batch.join(known, KEY, "left_anti")
        total = batch.withColumn("total", F.col("n"))
        for k, run in enumerate(r for level in self.levels for r in level):
            total = total.join(run.select(*KEY, F.col("n").alias(f"n{k}")), KEY, "left").withColumn("total", F.col("total") + F.coalesce(f"n{k}", F.lit(0))).drop(f"n{k}")
        new = bucketed(total, "batch", KEY)
        self.settled.append(bucketed(new.where(F.col("total") >= self.min_docs).select(*KEY), "settled", KEY))
        self._put(0, bucketed(new.where(F.col("total") < self.min_docs).select(*KEY, "n"), "run", KEY))
        forget(new)

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            parts, self.levels[level] = self.levels[level], []
            merged = reduce(self._merged, parts)
            out = bucketed(merged, "run", KEY)
            for p in parts:
                forget(p)
            self._put(level + 1, out)

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b.withColumnRenamed("n", "m"), KEY, "full_outer")
        return both.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

    def frequent(self) -> DataFrame:
        """Keys that at least ``min_docs`` documents hold, each once, written anew."""
        out = saved(reduce(DataFrame.unionByName, self.settled), "frequent")
        for part in self.settled:
            forget(part)
        for level in self.levels:
            for run in level:
                forget(run)
        return out


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> tuple[DataFrame, DataFrame]:
    """(frequent keys, keys of each row). The rows' keys are (doc_id, print, batch, keys): print is a hash of the text, keys the
    distinct line hashes. Rows are dealt to ``batches`` by doc_id and print and pass through the runs batch by batch."""
    # The keys themselves are made distinct: that takes a hash table, while structs would be compared pair by pair.
    keys = F.transform(F.filter(F.array_distinct(F.transform(lines_of(F.col("text")), line_key)), lambda k: F.length(k) >= min_chars), key_hash)
    rows = docs.select("doc_id", F.xxhash64("text").alias("print"), keys.alias("keys"))
    rows = saved(rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "print"), batches).cast("int")), "lines", "batch")
    runs = LineRuns(min_docs)
    for b in range(batches):
        runs.add(rows.where(F.col("batch") == b).select(F.inline("keys")).groupBy(*KEY).agg(F.count("*").alias("n")))
    return runs.frequent(), rows


def _marked(docs: DataFrame, min_docs: int, min_chars: int, batches: int) -> DataFrame:
    """``docs`` with _lines, and _drop: their frequent keys (null if none). A frequent key is hot by its nature: where the frequent
    ones are too many to be broadcast, the skew join splits its rows, which are three numbers each."""
    frequent, rows = frequent_lines(docs, min_docs, min_chars, batches)
    hits = rows.select(F.col("doc_id").alias("_id"), F.col("print").alias("_p"), F.inline("keys")).join(frequent, KEY)
    hits = hits.groupBy("_id", "_p").agg(F.collect_list(F.struct(*KEY)).alias("_drop"))
    out = docs.withColumn("_print", F.xxhash64("text")).join(hits, F.expr("doc_id <=> _id and _print = _p"), "left").drop("_id", "_p", "_print")
    return out.withColumn("_lines", lines_of(F.col("text")))


def _kept() -> Column:
    # A frequent key has at least min_chars code points, so shorter ones are in no _drop.
    held = lambda x: ~F.array_contains("_drop", key_hash(line_key(x)))
    return F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.filter("_lines", held))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row of ``docs`` (doc_id, text, ...).

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least ``min_chars`` code points
    that at least ``min_docs`` rows hold lose all their lines; the others stay, joined by \\n. Null and empty texts have one
    empty line. Each row counts as a document, rows that repeat a doc_id or a text too. Empty input gives an empty
    result. Keys are compared by 128 bits of hash. Other columns are ignored."""
    out = _marked(docs.select("doc_id", "text"), min_docs, min_chars, batches).withColumn("_kept", _kept())
    return out.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"), F.sha2(F.array_join("_kept", "\n"), 256).alias("kept_sha256"))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """``docs`` with their columns and without the frequent lines; n_chars follows the text if there is one. A text that
    loses nothing stays as it is, null too."""
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", "text")
    out = _marked(held, min_docs, min_chars, batches)
    out = out.withColumn("_new", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(_kept(), "\n")))
    new = {"text": F.col("_new"), "n_chars": F.when(F.col("_drop").isNull(), F.col("_row.n_chars") if "n_chars" in names else F.lit(0)).otherwise(F.length("_new"))}
    kinds = dict(docs.dtypes)
    return out.select(*[(new[c] if c in new else F.col("_row").getField(c)).cast(kinds[c]).alias(c) for c in names])
