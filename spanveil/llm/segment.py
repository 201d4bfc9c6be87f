"""SentencePiece segmentations sampled without replacement.

A text's lattice has a node before each character and an edge for each vocabulary piece; characters that no piece covers fall
back to their UTF-8 bytes. No piece reaches over the start of a run of spaces or a line feed, so the lattice is a chain of
small ones, one a chunk, and equal chunks share theirs. Backward sums give each edge its probability among all paths from its node.

Gumbel top-k: each path's log-probability is perturbed by Gumbel noise, and the k largest are a sample of k distinct paths
without replacement. The search is best-first from the top. A group of paths has the perturbed value of its best one; the
group of all paths is split into the path found and, at each of its nodes, the group that leaves it there, whose value is a
Gumbel with the group's probability, truncated at the parent's. The best group left holds the next path. Path k + 1 sets the
threshold for the inclusion scores, 1 - exp(-exp(log p - threshold)). All noise is a hash of seed, row key and place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import pieces
from spanveil.llm.neardup import mix

K = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1B54A32D192ED03)
MIX, TABLE_BITS = np.uint64(0xBF58476D1CE4E5B9), 19
SHIFT = np.uint64(64 - TABLE_BITS)
CHUNK = re.compile(r" *[^ \n]+| +|\n")
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose lattices are in memory at once, some 130 times as much; one text is never cut.
PIECE_BYTES = 512 << 10
#: What a byte of an uncovered character adds to the log-probability of the rarest piece.
BYTE_PENALTY = -10.0
SPACE = "▁"


@dataclass
class Vocabulary:
    """Pieces as bytes, with spaces for the space mark, their log-probabilities, and a table of all their prefixes."""

    raw: list[bytes]
    score: np.ndarray
    byte_id: np.ndarray
    keys: np.ndarray  # open-addressed hashes of all prefixes; 0 is a free place
    found: np.ndarray  # piece with that spelling, or -1
    rare: float

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is a prefix's, and the piece it spells."""
        place = (h * MIX) >> SHIFT
        there = self.keys[place]
        more = np.flatnonzero((there != h) & (there != 0))
        while len(more):
            place[more] = (place[more] + np.uint64(1)) & np.uint64(len(self.keys) - 1)
            there[more] = self.keys[place[more]]
            more = more[(there[more] != h[more]) & (there[more] != 0)]
        return there == h, self.found[place]


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Read a SentencePiece model on the driver. Merge models have ranks, not probabilities: piece number r in merge order
    gets log-probability -log(r), up to a constant (Zipf's law)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    raw, score, byte_id, table, rank = [], np.zeros(n), np.full(256, -1, np.int64), {}, 0
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_id[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
            continue
        piece = piece.replace(SPACE, " ")
        raw.append(piece.encode())
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or not piece:
            continue
        if "\n" in piece or " " in piece.lstrip(" "):
            raise ValueError(f"piece {i} reaches over a chunk")
        rank += 1
        score[i] = -np.log(rank)
        h = 0
        for k, c in enumerate(piece):
            h = (h * int(K) + ord(c) + 1) & (1 << 64) - 1
            table[h] = i if k == len(piece) - 1 else table.get(h, -1)
    if (byte_id < 0).any():
        raise ValueError("the vocabulary has no byte pieces to fall back to")
    keys, found = np.zeros(1 << TABLE_BITS, np.uint64), np.full(1 << TABLE_BITS, -1, np.int32)
    if 2 * len(table) > len(keys) or 0 in table:
        raise ValueError(f"{len(table)} prefixes don't fit the table")
    for h, piece in table.items():
        at = (h * int(MIX) & (1 << 64) - 1) >> int(SHIFT)
        while keys[at]:
            at = (at + 1) % len(keys)
        keys[at], found[at] = h, piece
    return Vocabulary(raw, score, byte_id, keys, found, float(score.min()))


class Numbers(dict):
    """Chunk -> its number, in the order of first sight."""

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        return n


class Lattices:
    """The lattices of a list of chunks. Edges of a node are neighbours, longer pieces first."""

    def __init__(self, chunks: list[str], vocab: Vocabulary, alpha: float):
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        # Nodes: one before each character and one at the end of each chunk.
        self.start = np.cumsum(sizes + 1) - (sizes + 1)
        ends = self.start + sizes
        total = int((sizes + 1).sum())
        self.is_end = np.zeros(total, bool)
        self.is_end[ends] = True
        at = np.flatnonzero(~self.is_end).astype(np.int32)
        code = np.zeros(total, np.uint64)
        code[at] = points
        layers: list[tuple[np.ndarray, np.ndarray, int]] = []  # sources and pieces of the edges of one length
        alive, h, length = at, np.zeros(len(at), np.uint64), 0
        degree = np.zeros(total, np.int32)
        with np.errstate(over="ignore"):
            while len(alive):
                where = alive + length
                inside = np.flatnonzero(~self.is_end[where])
                alive, h, where = alive[inside], h[inside], where[inside]
                h = h * K + code[where] + np.uint64(1)
                length += 1
                known, got = vocab.look(h)
                alive, h, got = alive[known], h[known], got[known]
                hit = got >= 0
                layers.append((alive[hit], got[hit], length))
                degree[layers[-1][0]] += 1
                if length == 1:
                    covered = np.zeros(total, bool)
                    covered[layers[0][0]] = True
                    bare = at[~covered[at]]
        if len(at) and len(bare):
            c = code[bare].astype(np.int64)
            layers.append((bare, np.where(c < 128, vocab.byte_id[np.minimum(c, 127)], -1 - c), 0))
            degree[bare] += 1
        self.first = np.zeros(total + 1, np.int64)
        np.cumsum(degree, out=self.first[1:])
        edges = int(self.first[-1])
        self.src, self.dst, self.piece = np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges, np.int32)
        weight = np.empty(edges)
        fill = self.first[:-1].copy()
        for source, piece, length in reversed(layers):
            place = fill[source]
            fill[source] += 1
            self.src[place], self.dst[place], self.piece[place] = source, source + max(length, 1), piece
            weight[place] = vocab.score[piece] if length else vocab.rare + BYTE_PENALTY
        weight *= alpha
        # Backward sums, from the ends of all chunks at once: the nodes at distance 1, 2, ... of the chunks that have them.
        beta = np.full(total, -np.inf)
        beta[ends] = 0.0
        by_size = ends[np.argsort(-sizes, kind="stable")]
        having = np.cumsum(np.bincount(sizes, minlength=1)[::-1])[::-1] if len(sizes) else np.zeros(1, np.int64)
        self.logp = weight
        for d in range(1, len(having)):
            node = by_size[: having[d]] - d
            e, left = self.first[node], degree[node]
            sums = np.full(len(node), -np.inf)
            j, on = 0, np.arange(len(node))
            while len(on):
                k = e[on] + j
                weight[k] += beta[self.dst[k]]
                sums[on] = np.logaddexp(sums[on], weight[k])
                j += 1
                on = on[left[on] > j]
            beta[node] = sums
        weight -= beta[self.src]
        np.minimum(weight, 0.0, out=weight)
        # Sums run within a node, so that no result depends on what else is in the batch.
        p = np.exp(weight)
        self.cum = np.empty(edges, np.float32)
        total_p, j, on = np.zeros(total), 0, np.flatnonzero(degree > 0)
        while len(on):
            k = self.first[on] + j
            total_p[on] += p[k]
            self.cum[k] = total_p[on]
            j += 1
            on = on[degree[on] > j]
        self.cum[self.first[1:][degree > 0] - 1] = 2.0

    def sample(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A path from each node to its chunk's end: edges of all paths in order, and their number for each node."""
        n = np.zeros(len(nodes), np.int64)
        taken = []
        active = np.flatnonzero(~self.is_end[nodes])
        node, t = nodes[active], 0
        while len(active):
            u = unit(keys[active] + np.uint64(t) * STEP)
            e = self.first[node]
            more = np.flatnonzero(u >= self.cum[e])
            while len(more):
                e[more] += 1
                more = more[u[more] >= self.cum[e[more]]]
            taken.append((active, e))
            n[active] += 1
            node = self.dst[e]
            going = ~self.is_end[node]
            active, node, t = active[going], node[going], t + 1
        flat = np.empty(int(n.sum()), np.int32)
        base = np.cumsum(n) - n
        for t, (who, e) in enumerate(taken):
            flat[base[who] + t] = e
        return flat, n


def unit(x: np.ndarray) -> np.ndarray:
    """A number in (0, 1) from a hash."""
    return ((mix(x) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def gumbel(x: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(unit(x)))


class _Doc:
    """What is known of one document: its paths, and the groups that may hold the next one."""

    __slots__ = ("groups", "paths", "seed", "words")

    def __init__(self, seed: int, words: np.ndarray):
        self.seed, self.words = seed, words
        self.paths: list[tuple] = []  # edges, chunk of each edge, log p, perturbed value
        self.groups: list[tuple] = []  # perturbed value, path, step, edges left out, log p up to the step


def _push(lat: Lattices, docs: list[_Doc], fresh: list[tuple[int, np.ndarray, np.ndarray, float, int, tuple, np.ndarray | None]], keep: int) -> None:
    """Add a path to each document: (document, edges, chunks, value, first new step, edges left out there). Of the groups that leave it
    at a new step, the ``keep`` best can matter."""
    if not fresh:
        return
    edges = np.concatenate([f[1] for f in fresh])
    n = np.array([len(f[1]) for f in fresh])
    base = np.cumsum(n) - n
    logp = lat.logp[edges]
    doc_of = np.repeat(np.arange(len(fresh)), n)
    upto = np.concatenate([np.cumsum(logp[a : a + k]) for a, k in zip(base, n, strict=True)])
    before = upto - logp
    p = np.exp(logp)
    with np.errstate(divide="ignore"):
        rest = before + np.log1p(-np.minimum(p, 1.0))
    node = lat.src[edges]
    rest[lat.first[node + 1] - lat.first[node] == 1] = -np.inf
    step = np.arange(len(edges)) - base[doc_of]
    first = np.array([f[4] for f in fresh])
    rest[step < first[doc_of]] = -np.inf
    for k, f in enumerate(fresh):
        if f[5]:
            left = 1.0 - np.exp(lat.logp[[*f[5], f[1][f[4]]]]).sum()
            j = base[k] + f[4]
            here = lat.first[lat.src[f[1][f[4]]] + 1] - lat.first[lat.src[f[1][f[4]]]]
            rest[j] = before[j] + np.log(left) if left > 1e-12 and here > len(f[5]) + 1 else -np.inf
    seeds = np.array([docs[f[0]].seed for f in fresh], np.uint64) + np.array([len(docs[f[0]].paths) for f in fresh], np.uint64) * K
    with np.errstate(invalid="ignore"):
        x = rest + gumbel(mix(seeds)[doc_of] + step.astype(np.uint64) * STEP)
    for k, f in enumerate(fresh):
        doc = docs[f[0]]
        doc.paths.append((f[1], f[2], float(upto[base[k] + n[k] - 1]), f[3]))
    for _ in range(keep):
        best = np.maximum.reduceat(x, base)
        hit = np.flatnonzero(x == best[doc_of])
        hit = hit[np.r_[True, doc_of[hit[1:]] != doc_of[hit[:-1]]]]
        for k, j in zip(doc_of[hit].tolist(), hit.tolist(), strict=True):
            if x[j] == -np.inf:
                continue
            f = fresh[k]
            s = int(step[j])
            out = (*f[5], int(f[1][s])) if s == f[4] and f[5] else (int(f[1][s]),)
            docs[f[0]].groups.append((-float(np.logaddexp(-f[3], -x[j])), len(docs[f[0]].paths) - 1, s, out))
        x[hit] = -np.inf


def sample_texts(texts: list[str], seeds: list[int], vocab: Vocabulary, k: int, alpha: float) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to ``k`` distinct segmentations, best perturbed value first: ids, log-probability, inclusion score."""
    index = Numbers()
    docs = []
    for text, seed in zip(texts, seeds, strict=True):
        chunks = CHUNK.findall(" " + text) if text else []
        docs.append(_Doc(seed, np.fromiter(map(index.__getitem__, chunks), np.int32, len(chunks))))
    lat = Lattices(list(index), vocab, alpha)

    with np.errstate(over="ignore", divide="ignore"):
        live = [i for i, d in enumerate(docs) if len(d.words)]

        def keys(doc: _Doc, lo: int, turn: int) -> np.ndarray:
            return np.uint64(mix(np.array([doc.seed + turn], np.uint64))[0]) + np.arange(lo, len(doc.words), dtype=np.uint64) * K

        if live:
            flat, n = lat.sample(lat.start[np.concatenate([docs[i].words for i in live])], np.concatenate([keys(docs[i], 0, 0) for i in live]))
            chunk = np.concatenate([np.arange(len(docs[i].words), dtype=np.int32) for i in live])
            chunk = np.repeat(chunk, n)
            cut = np.cumsum(n)[np.cumsum([len(docs[i].words) for i in live]) - 1]
            tops = gumbel(np.array([docs[i].seed for i in live], np.uint64) ^ STEP)
            fresh = [(i, flat[a:b], chunk[a:b], float(g), 0, ()) for i, a, b, g in zip(live, np.r_[0, cut[:-1]], cut, tops, strict=True)]
            _push(lat, docs, fresh, k)
        for turn in range(1, k):
            jobs, nodes, noise = [], [], []
            for i in live:
                doc = docs[i]
                if len(doc.paths) < turn or not doc.groups:
                    continue
                at = max(range(len(doc.groups)), key=lambda g: doc.groups[g][0])
                value, path, step, out = doc.groups.pop(at)
                edges, chunk = doc.paths[path][:2]
                node = lat.src[edges[step]]
                own = np.arange(lat.first[node], lat.first[node + 1])
                own = own[~np.isin(own, out)]
                p = np.cumsum(np.exp(lat.logp[own]))
                u = float(unit(np.array([doc.seed + turn], np.uint64) * STEP)[0]) * p[-1]
                e = int(own[min(int(np.searchsorted(p, u, side="right")), len(own) - 1)])
                c = int(chunk[step])
                jobs.append((i, edges[:step], chunk[:step], e, c, value, out))
                nodes.append(np.r_[lat.dst[e], lat.start[doc.words[c + 1 :]]])
                noise.append(keys(doc, c, turn))
            if not jobs:
                break
            flat, n = lat.sample(np.concatenate(nodes), np.concatenate(noise))
            sizes = [len(x) for x in nodes]
            cut = np.cumsum(n)[np.cumsum(sizes) - 1]
            chunk = np.repeat(np.concatenate([np.arange(j[4], j[4] + s, dtype=np.int32) for j, s in zip(jobs, sizes, strict=True)]), n)
            fresh = []
            for (i, head, head_chunk, e, c, value, out), a, b in zip(jobs, np.r_[0, cut[:-1]], cut, strict=True):
                fresh.append((i, np.concatenate([head, [e], flat[a:b]]), np.concatenate([head_chunk, [c], chunk[a:b]]), value, len(head), out))
            _push(lat, docs, fresh, k - turn)

    result = []
    for doc in docs:
        kappa = max((g[0] for g in doc.groups), default=-np.inf)
        if not len(doc.words):
            result.append([(np.empty(0, np.int64), 0.0, 1.0)])
            continue
        result.append([(_ids(lat.piece[e], vocab), lp, float(-np.expm1(-np.exp(min(lp - kappa, 700.0))))) for e, _, lp, _ in doc.paths])
    return result


def _ids(piece: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    if len(piece) and piece.min() < 0:
        out: list[int] = []
        for x in piece.tolist():
            out += [x] if x >= 0 else [int(vocab.byte_id[b]) for b in chr(-1 - x).encode("utf-8", "surrogatepass")]
        return np.array(out, np.int64)
    return piece


def decode(ids, vocab: Vocabulary) -> str:
    """The text of a sequence of ids, without the space that stands before every text."""
    return b"".join(map(vocab.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def row_seed(key, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(str(key).encode("utf-8", "surrogatepass"), seed=seed)


def numbered_repeats(docs: DataFrame, name: str = "pass") -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``name``: 0, 1, ... over the rows that repeat both. Rows with the same are alike but for their
    other columns, so which of them gets which number changes no samples. One shuffle; a group is as large as a document is repeated."""
    from pyspark.sql import Window

    alike = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    return docs.withColumn(name, F.row_number().over(alike) - 1)


def segment_batches(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, k: int, alpha: float, seed: int, digest: bool, repeat: str | None) -> Iterator[pa.RecordBatch]:
    """The rows that sample_segmentations() returns for batches of (doc_id, text, repeat)."""
    import hashlib

    for batch in pieces(batches, "text", PIECE_BYTES):
        keys, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
        if repeat:
            keys = [(x, n) if n else x for x, n in zip(keys, batch.column(repeat).to_pylist(), strict=True)]
        found = sample_texts(texts, [row_seed(x, seed) for x in keys], vocab, k, alpha)
        at, rows = [], []
        for i, (text, samples) in enumerate(zip(texts, found, strict=True)):
            raw = (" " + text).encode("utf-8", "surrogatepass") if text else b""
            for rank, (ids, lp, inclusion) in enumerate(samples, 1):
                at.append(i)
                exact = b"".join(map(vocab.raw.__getitem__, ids.tolist())) == raw
                x = ids.astype("<i4")
                rows.append((rank, len(ids), hashlib.sha256(x.tobytes()).hexdigest() if digest else x, lp, inclusion, exact))
        col = lambda c, t: pa.array([r[c] for r in rows], t)  # noqa: B023, E731
        kept = [c for c in ("doc_id", repeat) if c]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(pa.array(at, pa.int64())) for c in kept], col(0, pa.int32()), col(1, pa.int64()), col(2, pa.string() if digest else pa.list_(pa.int32())), col(3, pa.float64()), col(4, pa.float64()), col(5, pa.bool_())],
            [*kept, "sample", "n_pieces", "ids_sha256" if digest else "ids", "log_prob", "inclusion", "exact"],
        )


def sample_segmentations(docs: DataFrame, k: int = 2, alpha: float = 1.0, seed: int = 17, vocabulary: str = VOCABULARY, digest: bool = False, repeat: str | None = None) -> DataFrame:
    """Up to ``k`` rows for each row of ``docs`` (doc_id, text, ...): doc_id, sample (1 for the best perturbed value), n_pieces,
    ids, log_prob, inclusion, exact (the ids decode to the whole text). With ``digest``, ids_sha256 (of little-endian
    32-bit ids) stands for ids. A lattice with fewer than k paths gives them all, each with inclusion 1.

    Null and empty texts have one segmentation of no pieces. The noise depends on doc_id, so equal texts get other samples,
    and repeated rows the same ones; a null doc_id is a key too. ``repeat`` names a column of numbers that join doc_id in the
    seed (0 adds nothing) and the result, so that rows which repeat a doc_id get samples of their own. Texts that hold the space mark keep it, as bytes. Empty
    input gives an empty result. Other columns are ignored."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return segment_batches(batches, shared.value, k, alpha, seed, digest, repeat)

    ids = "ids_sha256 string" if digest else "ids array<int>"
    more = f", `{repeat}` {dict(docs.dtypes)[repeat]}" if repeat else ""
    return docs.select("doc_id", "text", *([repeat] if repeat else [])).mapInArrow(run, f"doc_id {kind}{more}, sample int, n_pieces bigint, {ids}, log_prob double, inclusion double, exact boolean")


def decode_segmentations(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` (doc_id, sample, ids, ...) with the decoded text of each row: doc_id, sample, text."""
    kinds = dict(df.dtypes)
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in batches:
            text = [None if x is None else decode(x, vocab) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sample"), pa.array(text, pa.string())], ["doc_id", "sample", "text"])

    return df.select("doc_id", "sample", "ids").mapInArrow(run, f"doc_id {kinds['doc_id']}, sample {kinds['sample']}, text string")
