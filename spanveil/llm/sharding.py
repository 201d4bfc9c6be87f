"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered by (doc_id, checksum, size). The permutation of 0..N-1 is a Feistel network on the next even number of
bits, walked along its cycle until it falls below N. Row p of the permuted order goes to shard p mod S, slot p div S, so a
row's place can be computed from its number alone, and the row at a place by the inverse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.common import saved
from spanveil.llm.neardup import mix

ROUNDS = 6


class Feistel:
    """A permutation of 0..n-1 that depends on ``seed``."""

    def __init__(self, n: int, seed: int = 0):
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.low = np.uint64((1 << self.half) - 1)
        self.keys = [int(k) for k in mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed * 1000003 & (1 << 64) - 1))]

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.low
        for k in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ (mix(left + np.uint64(k)) & self.low), left
            else:
                left, right = right, left ^ (mix(right + np.uint64(k)) & self.low)
        return (left << np.uint64(self.half)) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(x.astype(np.uint64), back)
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self._walk(x, False)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self._walk(x, True)


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, size, text_crc32, number; and the number of rows. Only these narrow rows are dealt out by range and sorted;
    each range keeps the count of its rows, so the offsets are a running sum over the ranges."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    rows = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "rows")
    ranges = rows.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = saved(ranges.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranges")
    total = ranges.agg(F.sum("n")).first()[0] or 0
    place = rows.withColumn("range", F.shiftright("at", 33)).join(ranges, "range")
    return place.select("doc_id", "size", "text_crc32", (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("number")), total


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 11) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of ``docs`` (doc_id, text, ...).

    The law is ``rows``: shards' counts are at most one apart, slots are 0, 1, 2, ... in each; grown_shard is null. Null
    text has no bytes: size 8, checksum 0. Null doc_ids come first in the numbering. Rows that repeat a doc_id each have a
    place; equal ones are interchangeable. Empty input gives an empty result. Other columns are ignored."""
    rows, total = numbered(docs)
    kind = dict(docs.dtypes)["doc_id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shuffle = Feistel(total, seed)
        for batch in batches:
            p = shuffle(batch.column("number").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), pa.array(["rows"] * len(p), pa.string()), pa.array((p % shards).astype(np.int32)), pa.array(p // shards), pa.nulls(len(p), pa.int32())],
                ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
            )

    return rows.mapInArrow(place, f"doc_id {kind}, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int")
