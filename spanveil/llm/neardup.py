"""MinHash near-duplicates with sequential Bayesian verification.

Documents are sets of distinct five-word shingles. Banding of a MinHash signature proposes pairs; signature batches are
compared one after another, and a pair is dropped as soon as the posterior probability that its similarity reaches the
threshold falls below ``miss``; the survivors are verified on their full shingle sets.

What is wanted is the connected components, so no group is expanded into its pairs. Documents with equal sets are one
class. In each bucket two members, the first and last by a hash of the round, are compared with the others that are in
another component; then they leave the bucket, since all their pairs are decided. Buckets that lie in one component are
done. What a few such rounds leave is compared whole, in blocks of bounded size, so that every pair of a bucket is either
compared or already connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import forget, pieces, saved, words_of

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
STEP = 16
MASK = (1 << 64) - 1
_RNG = np.random.Generator(np.random.PCG64(20240501))
MUL = _RNG.integers(0, MASK, HASHES, dtype=np.uint64) | np.uint64(1)
ADD = _RNG.integers(0, MASK, HASHES, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each input bit reaches all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """Word -> 64-bit hash, kept for the words that were seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, cache: WordHash, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words; of the whole sequence if it is shorter; empty if there
    is no word. A-Z are lower-cased first (bytes.lower() touches nothing else)."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, map(bytes.lower, words)), np.uint64, len(words))
    if len(h) < width:
        x = np.uint64(len(h))
        with np.errstate(over="ignore"):
            for w in h:
                x = x * BASE + w
        return mix(np.array([x], np.uint64))
    x = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        x *= BASE
        x += h[k : len(h) - width + 1 + k]
    return np.unique(mix(x))


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, MASK, np.uint64)
    for i in range(0, len(shingles), 1024):
        part = shingles[i : i + 1024, None] * MUL[None, :]
        part += ADD[None, :]
        np.minimum(low, part.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in pieces(batches, "text"):
            sizes, prints, sigs = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), cache, width)
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tprint"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())],
                ["doc_id", "tprint", "n_shingles", "print", "sig"],
            )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures of a batch as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    parts = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key * BASE + parts[:, :, k])
    return key


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            key = band_keys(_matrix(part.column("sig")))
            ids = part.column("node").take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))
            band = pa.array(np.tile(np.arange(BANDS, dtype=np.int32), part.num_rows))
            yield pa.RecordBatch.from_arrays([band, pa.array(key.astype(np.int64).ravel()), ids], ["band", "key", "node"])


@lru_cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For each prefix of STEP, 2 STEP, ... hashes, the fewest matches with which P(similarity >= threshold) >= miss,
    under a uniform prior: the posterior is Beta(m + 1, n - m + 1), its upper tail the binomial sum below."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < miss and m < n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs that no batch of hashes ruled out, and their matches of all hashes."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(threshold, miss)):
        cut = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (a[alive, cut] == b[alive, cut]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive, matches


def _compare(threshold: float, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                alive, matches = surviving(_matrix(part.column("sig_a")), _matrix(part.column("sig_b")), threshold, miss)
                at = pa.array(alive)
                yield pa.RecordBatch.from_arrays([part.column("a").take(at), part.column("b").take(at), pa.array(matches)], ["a", "b", "matches"])

    return run


def _verify(percent: int, width: int):
    """100 * intersection >= percent * union, on full sets. Pairs come sorted by b, whose sets are kept a while."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        sets: dict = {}

        def of(node, text):  # a node has one text
            if node not in sets:
                if len(sets) > 32:
                    sets.clear()
                sets[node] = shingle_set(text, cache, width)
            return sets[node]

        for batch in batches:
            keep = []
            for i, (tb, ta) in enumerate(zip(batch.column("text_b"), batch.column("text_a"), strict=True)):
                y = of(batch.column("b")[i].as_py(), tb.as_py())
                x = shingle_set(ta.as_py(), cache, width)
                both = int(np.isin(x, y, assume_unique=True).sum()) if len(x) and len(y) else 0
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return run


class _Block:
    """A block of outliers and a block of members of one bucket. A pair that shares several bands is compared in the first of
    these alone, and not at all if it lies in one component."""

    def __init__(self, group: pa.Table, percent: int, miss: float):
        self.outlier = group.column("outlier").to_numpy(zero_copy_only=False).astype(bool)
        comp = group.column("comp").to_numpy(zero_copy_only=False)
        self.comp, self.band = comp, group.column("band")[0].as_py()
        self.sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(len(comp), HASHES)
        self.keys = band_keys(self.sig)[:, : self.band + 1]
        self.members, self.threshold, self.miss = np.flatnonzero(~self.outlier), percent / 100, miss

    def survivors(self) -> Iterator[tuple[int, np.ndarray]]:
        """(outlier, members) that no batch of hashes rules out."""
        for o in np.flatnonzero(self.outlier):
            m = self.members
            other = m[(self.comp[m] != self.comp[o]) & ((self.keys[m] == self.keys[o]).argmax(axis=1) == self.band)]
            if len(other):
                alive, _ = surviving(np.broadcast_to(self.sig[o], (len(other), HASHES)), self.sig[other], self.threshold, self.miss)
                if len(alive):
                    yield o, other[alive]


def _suspects(percent: int, miss: float):
    """The rows of a block that have a survivor. No texts take part, and no pair is a row."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        hit = np.zeros(group.num_rows, bool)
        for o, near in _Block(group, percent, miss).survivors():
            hit[o] = True
            hit[near] = True
        return group.filter(pa.array(hit)).select(["band", "key", "ob", "mb", "node", "comp", "outlier"])

    return run


def _blocks(percent: int, width: int, miss: float):
    """Links of a block: what the signatures can't rule out is verified on the full sets."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, text = group.column("node"), group.column("text")
        cache, sets, left, right = WordHash(), {}, [], []

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(text[i].as_py(), cache, width)
            return sets[i]

        for o, near in _Block(group, percent, miss).survivors():
            x = of(o)
            every, owner = np.concatenate([of(i) for i in near]), np.repeat(np.arange(len(near)), [len(of(i)) for i in near])
            at = np.minimum(np.searchsorted(x, every), len(x) - 1)
            both = np.bincount(owner[x[at] == every], minlength=len(near))
            union = len(x) + np.bincount(owner, minlength=len(near)) - both
            hit = near[100 * both >= percent * union]
            left += [o] * len(hit)
            right += hit.tolist()
        return pa.table({"a": ids.take(pa.array(left, pa.int64())), "b": ids.take(pa.array(right, pa.int64()))})

    return run


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b); root is the smallest node of the component.

    Each node points to its smallest neighbour or itself; pointers are doubled until they are flat; the graph is
    contracted to the roots; and so on until no edge is left. The steps grow with the logarithm of the graph's size."""
    e = saved(edges.select("a", "b").where("a <> b").distinct(), "edges")
    total = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("to")))
        up = saved(both.groupBy("node").agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("root")), "up")
        while True:
            on = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            up2 = saved(up.join(on, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "up")
            forget(up)
            up, moved = up2.drop("moved"), not up2.where("moved").isEmpty()
            up._saved_path = up2._saved_path
            if not moved:
                break
        to_a, to_b = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e2 = saved(e.join(to_a, "a").join(to_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        forget(e)
        e = e2
        if total is None:
            total = up
        else:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            total2 = saved(total.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
            forget(total)
            forget(up)
            total = total2
    if total is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    forget(e)
    return total


class _Links:
    """State of one run: verified links, the component of each linked class."""

    def __init__(self, sigs: DataFrame, texts: DataFrame, percent: int, width: int, miss: float):
        self.sigs, self.texts, self.percent, self.width, self.miss = sigs, texts, percent, width, miss
        self.comp: DataFrame | None = None  # (node, root)

    def with_comp(self, df: DataFrame, col: str = "node", to: str = "comp") -> DataFrame:
        if self.comp is None:
            return df.withColumn(to, F.col(col))
        c = self.comp.select(F.col("node").alias(col), F.col("root").alias("_root"))
        return df.join(c, col, "left").withColumn(to, F.coalesce("_root", col)).drop("_root")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components, with these."""
        return self.with_comp(self.with_comp(pairs, "a", "ca"), "b", "cb").where("ca <> cb")

    def merge(self, links: DataFrame) -> None:
        """Take verified links (a, b) in."""
        roots = connected(self.with_comp(self.with_comp(links, "a", "ca"), "b", "cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")))
        if self.comp is None:
            self.comp = roots
            return
        step = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        old = self.comp.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        new = roots.join(self.comp, "node", "left_anti").select("node", "root")
        comp = saved(old.unionByName(new), "comp")
        forget(self.comp)
        forget(roots)
        self.comp = comp

    def candidates(self, pairs: DataFrame) -> DataFrame:
        """Compare the signatures of ``pairs`` (a, b) batch by batch; those left, with their matches."""
        sa, sb = self.sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), self.sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
        return pairs.select("a", "b").join(sa, "a").join(sb, "b").mapInArrow(_compare(self.percent / 100, self.miss), "a bigint, b bigint, matches bigint")

    def exactly(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) whose full sets are similar enough."""
        pairs = saved(pairs.select("a", "b").distinct(), "verify")
        need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        texts = self.texts.join(need, "node", "left_semi")
        ta, tb = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        links = saved(pairs.join(ta, "a").join(tb, "b").sortWithinPartitions("b").mapInArrow(_verify(self.percent, self.width), "a bigint, b bigint"), "links")
        forget(pairs)
        return links

    def take(self, found: DataFrame) -> None:
        """Verify surviving pairs (a, b, matches) and merge. First each class's likeliest link to one before it, in the
        order of a hash: no cycles, one set comparison a class; then whatever still links two components."""
        found = saved(found, "found")
        if found.isEmpty():
            forget(found)
            return
        order = found.withColumn("first", F.xxhash64("a") < F.xxhash64("b")).select(F.when(F.col("first"), F.col("b")).otherwise(F.col("a")).alias("b"), F.when(F.col("first"), F.col("a")).otherwise(F.col("b")).alias("a"), "matches")
        best = order.groupBy("b").agg(F.max(F.struct("matches", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
        links = self.exactly(best)
        self.merge(links)
        forget(links)
        rest = saved(self.apart(found).select("a", "b").distinct(), "rest")
        if not rest.isEmpty():
            links = self.exactly(rest)
            self.merge(links)
            forget(links)
        forget(rest)
        forget(found)


def _ranked(*more: str) -> F.Column:
    """A row's place in the choice of the first: by doc_id, null last, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tprint", *more)


def _classes(docs: DataFrame, percent: int, width: int, miss: float, rounds: tuple[int, ...], block: int, nulls: bool) -> tuple[DataFrame, DataFrame, _Links]:
    """(sketch, classes, links) of ``docs`` (doc_id, text). Sketch: doc_id, tprint (a hash of the text), n_shingles, print, one row a
    row. Rows with equal sets are a class: print, node (its number), none, doc_id, tprint (its first row). Links has the component of each
    linked class. Rows with a null doc_id are in no class unless ``nulls``."""
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("tprint"))
    sketch = saved(docs.mapInArrow(_sketch(width), f"doc_id {kind}, tprint bigint, n_shingles bigint, print binary, sig binary"), "sketch")
    whole = sketch.where(F.col("sig").isNotNull() & (F.lit(nulls) | F.col("doc_id").isNotNull()))
    # The numbers are fixed by being written; no result depends on their order.
    first = whole.groupBy("print").agg(F.min(_ranked("n_shingles", "sig")).alias("r"))
    classes = saved(first.select("print", F.monotonically_increasing_id().alias("node"), "r.*"), "classes")
    sigs = classes.select("node", "n_shingles", "sig")
    bands = saved(sigs.mapInArrow(_bands, "band int, key bigint, node bigint"), "bands")
    shared = bands.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    members = saved(bands.join(shared, ["band", "key"]).select("band", "key", "node"), "members")
    forget(bands)

    need = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("_id"), F.col("tprint").alias("_t"))
    texts = docs.join(need, F.expr("doc_id <=> _id and tprint <=> _t")).select("node", "text")
    if not sketch.groupBy("doc_id", "tprint").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # a row may repeat: one text a class
        texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    # The first rounds take few bands, which connect most of a group; the others then meet few components.
    links = _Links(sigs, saved(texts, "texts"), percent, width, miss)
    left, done = None, 0
    for k, upto in enumerate(rounds):
        new = members.where((F.col("band") >= done) & (F.col("band") < upto))
        seen = links.with_comp(new if left is None else left.unionByName(new) if upto > done else left)
        done = upto
        order = F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("id"), F.col("comp").alias("of"))
        buckets = seen.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(order).alias("p"), F.max(order).alias("q")).where("lo < hi")
        met = saved(seen.join(buckets.select("band", "key", "p", "q"), ["band", "key"]).select("band", "key", "node", "comp", F.col("p.id").alias("p"), F.col("p.of").alias("pc"), F.col("q.id").alias("q"), F.col("q.of").alias("qc")), "met")
        forget(left)
        if met.isEmpty() and done == BANDS:
            left = met.select("band", "key", "node")
            left._saved_path = met._saved_path
            break
        pairs = met.select("node", "comp", F.explode(F.array(F.struct(F.col("p").alias("x"), F.col("pc").alias("xc")), F.struct(F.col("q").alias("x"), F.col("qc").alias("xc")))).alias("o")).where("comp <> o.xc")
        pairs = pairs.select(F.least("node", "o.x").alias("a"), F.greatest("node", "o.x").alias("b")).distinct()
        links.take(links.candidates(pairs))
        left = saved(met.where("node <> p and node <> q").select("band", "key", "node"), "left")
        forget(met)
    else:
        _rest(links, left, block)
    forget(left)
    forget(members)
    forget(links.texts)
    return sketch, classes, links


def _placed(sketch: DataFrame, classes: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``sketch`` with ``top``, the first row (none, doc_id, tprint) of its component; null for rows in no class."""
    tops = classes.select("node", "print", _ranked().alias("own"))
    if comp is not None:
        linked = comp.join(tops, "node")
        first = linked.groupBy("root").agg(F.min("own").alias("top"))
        tops = tops.join(comp.join(first, "root").select("node", "top"), "node", "left").select("print", F.coalesce("top", "own").alias("top"))
    else:
        tops = tops.select("print", F.col("own").alias("top"))
    return sketch.select("doc_id", "tprint", "n_shingles", "print").join(tops, "print", "left")


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, miss: float = 1e-6, rounds: tuple[int, ...] = (4, 12, BANDS), block: int = 512) -> DataFrame:
    """Near-duplicate components of ``docs`` (doc_id, text, ...).

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept (doc_id = component_id),
    one row per input row. Links join documents whose sets of ``width``-word shingles have 100 * intersection >=
    ``percent`` * union; they are confirmed on the full sets. A pair at the very threshold escapes all ``BANDS`` bands with
    probability (1 - 0.75^4)^32 = 5e-6, and a batch comparison with ``miss``; nothing else loses a link.

    Null or wordless texts have an empty set, are linked with nothing and kept. Rows with a null doc_id are linked with
    nothing either; their component_id is null and they are kept. Rows that repeat a doc_id are one document: it has the
    links of each of its texts, and all its rows have one component_id. Empty input gives an empty result. Other columns are
    ignored."""
    sketch, classes, links = _classes(docs, percent, width, miss, rounds, block, nulls=False)
    again = saved(sketch.where("doc_id is not null").groupBy("doc_id").agg(F.min("tprint").alias("lo"), F.max("tprint").alias("hi"), F.count("*").alias("n")).where("n > 1"), "again")
    several = not again.where("lo is null or lo < hi").isEmpty()
    if several:  # the classes of one document are linked through it
        own = sketch.where("print is not null").join(again.select("doc_id"), "doc_id", "left_semi").select("doc_id", "print").distinct().join(classes.select("print", "node"), "print")
        star = own.groupBy("doc_id").agg(F.min("node").alias("a"))
        links.merge(own.join(star, "doc_id").select("a", F.col("node").alias("b")))
    out = _placed(sketch, classes, links.comp).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("top.doc_id", "doc_id")).alias("component_id"))
    if several:  # an empty text beside others of the same document
        whole = out.join(again.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        out = out.join(whole, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_copies(docs: DataFrame, percent: int = 75, width: int = 5, miss: float = 1e-6, rounds: tuple[int, ...] = (4, 12, BANDS), block: int = 512) -> DataFrame:
    """doc_id, tprint (xxhash64 of the text), n_shingles and kept of each row of ``docs`` (doc_id, text, ...), judged text by text: of
    the rows whose texts are linked, those that are first by (doc_id, text) are kept, a null doc_id after all others. A doc_id with
    two unlike texts may keep one and lose the other. Rows that repeat both are alike: all or none are kept. Null and
    wordless texts are kept. Empty input gives an empty result."""
    sketch, classes, links = _classes(docs, percent, width, miss, rounds, block, nulls=True)
    rows = _placed(sketch, classes, links.comp)
    own = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("tprint") == F.col("top.tprint"))
    return rows.select("doc_id", "tprint", "n_shingles", F.when(F.col("top").isNull(), True).otherwise(own).alias("kept"))


def first_of_group(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with all their columns, one row of each group of linked texts: the first by near_copies(); of rows that repeat its
    doc_id and text, the first by a hash of the others columns. Rows of null or wordless texts all stay."""
    rows = saved(near_copies(docs, **params).where("n_shingles > 0").groupBy("doc_id", "tprint").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("n > 1 or not kept"), "copies")
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"))
    gone = rows.where("not kept").select("doc_id", "tprint")
    out = held.join(gone, F.expr("_id <=> doc_id and _t <=> tprint"), "left_anti")
    more = rows.where("kept").select("doc_id", "tprint")
    if not more.isEmpty():
        on = F.expr("_id <=> doc_id and _t <=> tprint")
        alike = out.join(more, on, "left_semi").groupBy("_id", "_t", F.xxhash64("_row").alias("_h")).agg(F.first("_row").alias("_row"))
        best = alike.groupBy("_id", "_t").agg(F.min("_h").alias("_h"))
        one = alike.join(best.withColumnsRenamed({"_id": "_i", "_t": "_u", "_h": "_k"}), F.expr("_id <=> _i and _t = _u and _h = _k"), "left_semi")
        out = out.join(more, on, "left_anti").select("_row").unionByName(one.select("_row"))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names])


#: Most shingles that a block's members, and its outliers, have on average: with short texts a block is bounded by its rows, with long ones by this.
BLOCK_SHINGLES = 1 << 21


def _rest(links: _Links, members: DataFrame, block: int) -> None:
    """Decide all pairs that are left in buckets of several components: outliers, which are outside the largest component of
    their bucket, meet all members, block by block. First the signatures alone are dealt to the blocks; the texts follow only for
    rows that some signature of their block didn't rule out. No pair is a row unless it is a link."""
    seen = saved(links.with_comp(members).join(links.sigs.select("node", "n_shingles"), "node"), "left")
    parts = seen.groupBy("band", "key", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    largest = F.max(F.struct("n", "comp", "w"))
    sizes = parts.groupBy("band", "key").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), largest.alias("top"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n, w: F.greatest(F.ceil(n / block), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.select("band", "key", F.col("top.comp").alias("largest"), blocks(F.col("n"), F.col("w")).alias("nm"), blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("no"))
    seen2 = saved(seen.join(sizes, ["band", "key"]), "blocks")
    forget(seen)
    if not seen2.isEmpty():
        h = F.xxhash64("node", F.lit("block"))
        kept = ["band", "key", "node", "comp"]
        as_member = seen2.select(*kept, F.lit(False).alias("outlier"), F.pmod(h, "nm").cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("no") - 1)).alias("ob"))
        as_outlier = seen2.where("comp <> largest").select(*kept, F.lit(True).alias("outlier"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("mb"), F.pmod(h, "no").cast("int").alias("ob"))
        sigs = links.sigs.select("node", "sig")
        rows = as_member.unionByName(as_outlier).join(sigs, "node")
        hits = saved(rows.groupBy("band", "key", "ob", "mb").applyInArrow(_suspects(links.percent, links.miss), "band int, key bigint, ob int, mb int, node bigint, comp bigint, outlier boolean"), "suspects")
        if not hits.isEmpty():
            known = sigs.join(links.texts, "node")
            found = saved(hits.join(known, "node").groupBy("band", "key", "ob", "mb").applyInArrow(_blocks(links.percent, links.width, links.miss), "a bigint, b bigint"), "found")
            links.merge(found)
            forget(found)
        forget(hits)
    forget(seen2)
