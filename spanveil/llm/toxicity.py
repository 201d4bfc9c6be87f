"""Toxicity by a character n-gram linear classifier with naive Bayes log-count ratios.

A text's features are the distinct n-grams of its lower-cased characters, hashed. Each is scaled by the log ratio of its
shares in toxic and other training texts; features whose ratio isn't told from chance are left out. A logistic regression
on the scaled features gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import forget, pieces, saved
from spanveil.llm.neardup import mix

BITS = 18
SIZES = (4, 5)
#: The fit uses at most so many labelled rows of each class, with at most so many characters: it is made on the driver.
FIT_ROWS, FIT_CHARS = 2000, 50_000
LEAST_Z = 2.5
THRESHOLD = 0.3
_K = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str | None) -> np.ndarray:
    """Hashed n-grams of a text, one for each place; runs of white space count as one space, the ends too."""
    flat = " " + " ".join((text or "").lower().split()) + " "
    c = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [np.empty(0, np.int64)], np.zeros(len(c), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if n > len(c):
            break
        h = h[: len(c) - n + 1] * _K + c[n - 1 :] + np.uint64(1)
        if n in SIZES:
            out.append((mix(h + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def log_ratios(c1, c0, n1: int, n0: int, least_z: float = LEAST_Z):
    """Log ratio of the shares of toxic and other training texts that hold a feature, from the counts of these texts; 0 where its
    distance from 0 is below ``least_z`` standard deviations."""
    ratio = np.log((c1 + 1) / (n1 + 2)) - np.log((c0 + 1) / (n0 + 2))
    return np.where(np.abs(ratio) / np.sqrt(1 / (c1 + 1) + 1 / (c0 + 1)) < least_z, 0.0, ratio)


def fit(used: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray, prior: float, epochs: int = 8, step: float = 0.1, decay: float = 1e-5, seed: int = 0) -> tuple[np.ndarray, float]:
    """(weight of each hashed n-gram, intercept) from the features of each text that have a ratio, labels and ratios. ``prior`` is the
    share of toxic texts among all labelled ones; samples are weighted back to it. Without both classes the weights are 0."""
    size = 1 << BITS
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    if not n1 or not n0:
        return np.zeros(size, np.float32), float(np.log(prior / (1 - prior)))
    share = np.where(toxic == 1, prior * (n1 + n0) / n1, (1 - prior) * (n1 + n0) / n0)
    w, g2, b, gb = np.zeros(size), np.full(size, 1e-8), float(np.log(prior / (1 - prior))), 1e-8
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(used)):
            x, r = used[i], ratio[used[i]]
            e = share[i] * (1 / (1 + np.exp(-np.clip(b + w[x] @ r, -30, 30))) - toxic[i])
            g = e * r + decay * w[x]
            g2[x] += g * g
            w[x] -= step * g / np.sqrt(g2[x])
            gb += e * e
            b -= step * e / np.sqrt(gb)
    return (w * ratio).astype(np.float32), b


def scores(texts: list[str | None], weight: np.ndarray, intercept: float) -> list[float]:
    out = []
    with np.errstate(over="ignore"):
        for text in texts:
            h = grams(text)
            h = np.unique(h[weight[h] != 0])
            z = intercept + float(weight[h].astype(np.float64).sum())
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
    return out


def fit_texts(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> tuple[DataFrame, dict[int, int]] | None:
    """(doc_id, toxic, text) of the rows of the fit, one a doc_id, and the number of labelled documents by label; None without any. Of
    each class the ``rows`` first by a hash of doc_id; of a doc_id's texts of at most ``chars`` characters the first by a hash."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return None
    first = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = F.broadcast(first(0).unionByName(first(1)))  # at most 2 * rows rows of two numbers
    texts = docs.select("doc_id", "text").where(F.length("text") <= chars).join(chosen, "doc_id")
    one = texts.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("doc_id", "toxic", "t.text"), totals


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> tuple[np.ndarray, float]:
    """Fit on rows that aren't held out. Rows without a label or with other labels than 0 and 1 are not used; a document with both
    counts as toxic. Texts become n-grams, and these are counted by class, on the executors; the driver gets the counts of n-grams
    that tell the classes apart (2^BITS at most), and of each text only these."""
    found = fit_texts(docs, labels, rows, chars)
    if found is None:
        return np.zeros(1 << BITS, np.float32), 0.0
    texts, totals = found
    kind = dict(docs.dtypes)["doc_id"]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            with np.errstate(over="ignore"):
                x = [np.unique(grams(t)).astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), pa.array(x, pa.list_(pa.int32()))], ["doc_id", "toxic", "x"])

    held = saved(texts.mapInArrow(features, f"doc_id {kind}, toxic int, x array<int>"), "grams")
    sizes = held.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("n1"), F.count("*").alias("n")).first()
    n1, n0 = sizes["n1"], sizes["n"] - sizes["n1"]
    counts = held.select("toxic", F.explode("x").alias("h")).groupBy("h").agg(F.sum("toxic").alias("c1"), F.count("*").alias("n"))
    c1, c0 = F.col("c1") + 1, F.col("n") - F.col("c1") + 1
    z = F.abs(F.log(c1 / (n1 + 2)) - F.log(c0 / (n0 + 2))) / F.sqrt(1 / c1 + 1 / c0)
    telling = counts.where(z >= LEAST_Z - 1e-6).toArrow()
    h, c1, n = (telling.column(c).to_numpy() for c in ("h", "c1", "n"))
    ratio = np.zeros(1 << BITS)
    ratio[h] = log_ratios(c1, n - c1, n1, n0)
    kept = docs.sparkSession.sparkContext.broadcast(ratio != 0)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [v[kept.value[v]] for v in (np.asarray(x.values, np.int32) for x in batch.column("x"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(x, pa.list_(pa.int32()))], ["doc_id", "toxic", "x"])

    got = held.mapInArrow(told, f"doc_id {kind}, toxic int, x array<int>").toArrow()
    forget(held)
    order = np.argsort([str(i) for i in got.column("doc_id").to_pylist()], kind="stable")
    x = got.column("x").combine_chunks()
    values, at = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy(zero_copy_only=False)
    return fit([values[at[i] : at[i + 1]] for i in order], got.column("toxic").to_numpy()[order], ratio, totals.get(1, 0) / sum(totals.values()))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text, ...), learned from ``labels`` (doc_id,
    toxic, ...) of rows that aren't held out (crc32 of doc_id mod 4 is 2).

    Scores depend on the text alone. Null and empty texts have the score of no features. Rows with a null doc_id are never
    held out. Without labels all scores are 0.5. Repeated rows are scored each. Empty input gives an empty result. Other columns
    are ignored."""
    weight, intercept = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((weight, intercept))  # 2^BITS floats
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in pieces(batches, "text"):
            s = scores(batch.column("text").to_pylist(), w, b)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])

    out = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
