"""Licence scans: a trained passage classifier with an unknown class, confirmed against templates.

A passage is a line or a sentence of it; sentences that go over line ends are passages too, after those. Its features are its hashed word 1-, 2- and 3-grams, each once or as often as it
occurs; a multinomial logistic regression over licence families and "none" scores it. Its temperature and the least
probability of a named family are calibrated on notices that the fit doesn't see, among them licences of no family: a
passage that looks like a licence, but below that probability, is unknown. A named family is confirmed if the passage holds
enough of the word pairs of one of the family's templates, which the fit doesn't see either. A third set of notices tests it all.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import pieces
from spanveil.llm.license_texts import CALIBRATION, FAMILIES, OTHERS, PLAIN, TEMPLATES, TITLES
from spanveil.llm.neardup import BASE, WordHash, mix

BITS = 16
NAMES = (*FAMILIES, "none")
NONE = len(NAMES) - 1
#: The fit takes ordinary passages from at most so many documents and rows of them, at most so many from each, and at most so many words in
#: a row from a passage; all are chosen by hashes over whole texts.
FIT_DOCS, FIT_ROWS, FIT_PASSAGES, FIT_WORDS = 300, 600, 20, 3000
CONFIRM = 0.6
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and (chr(b).isalnum()) else b if b >= 128 or b == 1 else 32 for b in range(256))
_BREAKS = (b"\n", b". ", b"! ", b"? ", b"; ")
#: Sentences over line ends that are longer than this are cut into windows of so many words, each half over the one before: any run of up to
#: 80 words has more than three fifths of itself in one of them.
WINDOW = 96
_BLANK = re.compile(rb"\n(?:[^A-Za-z0-9\x80-\xff\n]*\n)+")
_FOLD_LINES = _FOLD[:10] + b"\n" + _FOLD[11:]


def _joined(raw: bytes) -> list[bytes]:
    """Sentences of each paragraph (up to a line without a word) that go over a line end, folded; long ones as windows."""
    if b"\n" not in raw:
        return []
    raw = _BLANK.sub(b" \x01 ", raw.replace(b"\r\n", b"\n")).replace(b"\n", b" \n")
    for b in _BREAKS[1:]:
        raw = raw.replace(b, b" \x01 ")
    out = []
    for p in raw.translate(_FOLD_LINES).split(b"\x01"):
        if b"\n" in p.strip():
            words = p.split()
            last = len(words) - WINDOW // 2 if len(words) > WINDOW else 1
            out += [b" ".join(words[k : k + WINDOW]) for k in range(0, last, WINDOW // 2)]
    return out


def _marked(text: str | None) -> bytes:
    """Folded bytes with the mark 0x01 as a word of its own between passages: lines and sentences of them, then sentences over line ends."""
    lines = raw = (text or "").encode("utf-8", "surrogatepass").replace(b"\x01", b" ")
    for b in _BREAKS:
        lines = lines.replace(b, b" \x01 ")
    return b" \x01 ".join([lines.translate(_FOLD), *_joined(raw)])


def passages(text: str | None) -> list[list[bytes]]:
    """The words of each passage of a text; A-Z in lower case, other ASCII signs are spaces."""
    return [p.split() for p in _marked(text).split(b"\x01")]


class Hashes(WordHash):
    """Word -> hash; the mark has hash 0."""

    def __missing__(self, word: bytes) -> int:
        if word == b"\x01":
            return 0
        return super().__missing__(word) or 1


def features(h: np.ndarray) -> list[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that start at each word."""
    out, x = [], np.zeros(len(h), np.uint64)
    for n in range(3):
        if n >= len(h):
            break
        x = x[: len(h) - n] * BASE + h[n:]
        out.append((mix(x + np.uint64(n + 1)) >> np.uint64(64 - BITS)).astype(np.int32))
    return out


@dataclass
class Model:
    weight: np.ndarray  # buckets x classes
    bias: np.ndarray
    temperature: float
    least: float
    above: np.ndarray  # by bucket, the most that any family gains on "none"

    def probabilities(self, words: list[bytes], cache: WordHash) -> np.ndarray:
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        with np.errstate(over="ignore"):
            f = features(h)
        z = self.bias + (self.weight[np.concatenate(f)].sum(axis=0) if f else 0.0)
        z = (z - z.max()) / self.temperature
        p = np.exp(z)
        return p / p.sum()


def _noisy(words: list[bytes], rng: np.random.Generator, junk: list[bytes]) -> list[bytes]:
    """A notice as it may be met: some words lost, ordinary words around it."""
    kept = [w for w in words if rng.random() > 0.08] or words
    around = lambda: [junk[i] for i in rng.integers(0, len(junk), rng.integers(0, 12))] if junk and rng.random() < 0.4 else []
    return around() + kept + around()


def fit(ordinary: list[list[bytes]], epochs: int = 12, copies: int = 12, step: float = 0.3, decay: float = 1e-4, seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    cache = Hashes()
    plain = [w for t in PLAIN for w in passages(t) if w]
    ordinary = [w for w in ordinary if w] + plain
    junk = sorted({w for p in ordinary for w in p})
    known: list[tuple[list[bytes], int]] = []
    for c, (name, notices) in enumerate(FAMILIES.items()):
        for notice in (*notices, *TITLES[name]):
            for words in passages(notice):
                if len(words) > 1:
                    known += [(words, c)] * 2 + [(_noisy(words, rng, junk), c) for _ in range(copies)]
    known += [(p, NONE) for p in ordinary] + [(p, NONE) for p in plain for _ in range(copies)]

    def bags(rows):
        with np.errstate(over="ignore"):
            return [np.concatenate(features(np.fromiter(map(cache.__getitem__, w), np.uint64, len(w)))) for w, _ in rows]

    x, y = bags(known), np.array([c for _, c in known])
    size = 1 << BITS
    w, b = np.zeros((size, len(NAMES))), np.zeros(len(NAMES))
    g2, gb = np.full((size, len(NAMES)), 1e-6), np.full(len(NAMES), 1e-6)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            z = b + w[x[i]].sum(axis=0)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            u = np.unique(x[i])
            g = p[None, :] + decay * w[u]
            g2[u] += g * g
            w[u] -= step * g / np.sqrt(g2[u])
            gb += p * p
            b -= step * p / np.sqrt(gb)
    model = Model(w.astype(np.float32), b, 1.0, 0.5, np.zeros(0))
    # Calibration on other notices, whole and noisy, and on ordinary passages.
    fresh = [(w, c) for c, name in enumerate(FAMILIES) for t in CALIBRATION[name] for p in passages(t) if len(p) > 1 for w in (p, _noisy(p, rng, junk), _noisy(p, rng, junk))]
    fresh += [(p, NONE) for p in ordinary[::7]]
    z = np.array([model.bias + model.weight[bag].sum(axis=0) for bag in bags(fresh)])
    target = np.array([c for _, c in fresh])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(s)), target] - np.log(np.exp(s).sum(axis=1))).mean())

    model.temperature = min((0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0), key=loss)
    right, strange = [], []
    for words, c in fresh:
        if c != NONE:
            p = model.probabilities(words, cache)
            if p.argmax() == c:
                right.append(p[c])
    for t in OTHERS[::2]:
        for words in passages(t):
            p = model.probabilities(words, cache)
            if len(words) > 1 and p.argmax() != NONE:
                strange.append(p.max())
    grid = np.linspace(0.4, 0.99, 60)
    model.least = float(max(grid, key=lambda t: (np.mean(np.array(right) >= t) - (np.mean(np.array(strange) >= t) if strange else 0.0), -t)))
    model.above = (model.weight - model.weight[:, NONE :]).max(axis=1)
    return model


def _pairs(words: list[bytes]) -> set:
    return set(zip(words, words[1:], strict=False)) or {(w,) for w in words}


_TEMPLATES: dict[str, list[set]] = {}


def similarity(family: str, words: list[bytes]) -> float:
    """The largest share of a template's word pairs that a passage holds."""
    if not _TEMPLATES:
        for name, notices in TEMPLATES.items():
            _TEMPLATES[name] = [_pairs([w for p in passages(t) for w in p]) for t in notices]
    own = _pairs(words)
    return max((len(t & own) / len(t) for t in _TEMPLATES[family]), default=0.0)


def suspects(text: str | None, model: Model, cache: WordHash) -> Iterator[tuple[int, list[bytes]]]:
    """(number, words) of the passages that could be anything but "none": those where even the most that each n-gram can give
    to a family beats "none". No other passage can have another class."""
    marked = _marked(text)
    words = marked.split()
    if not words:
        return
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    mark = h == 0
    of = np.cumsum(mark) - mark
    gain = np.zeros(int(of[-1]) + 1)
    for n, f in enumerate(features(h)):
        inside = of[: len(f)] == of[n : n + len(f)]
        for k in range(n + 1):
            inside &= ~mark[k : k + len(f)]
        gain += np.bincount(of[: len(f)][inside], weights=model.above[f[inside]], minlength=len(gain))
    top = float((model.bias - model.bias[NONE])[:NONE].max())
    ends = np.append(np.flatnonzero(mark), len(words))  # a passage's words are those before its mark
    for i in np.flatnonzero(gain + top > 0).tolist():
        own = words[ends[i - 1] + 1 if i else 0 : ends[i]]
        if own:
            yield i, own


def scan_text(text: str | None, model: Model, cache: WordHash) -> list[dict]:
    out = []
    with np.errstate(over="ignore"):
        for i, words in suspects(text, model, cache):
            p = model.probabilities(words, cache)
            c = int(p.argmax())
            if c == NONE:
                continue
            near = similarity(NAMES[c], words)
            named = p[c] >= model.least
            out.append({"passage": i, "family": NAMES[c] if named else "unknown", "probability": float(p[c]), "similarity": near, "confirmed": bool(named and near >= CONFIRM)})
    return out


def ordinary_passages(text: str | None, known: set) -> list[bytes]:
    """The FIT_PASSAGES passages of a text that are first by a hash of their number and words; those that share two word pairs with
    ``known`` are left out. Of a passage with more than FIT_WORDS words, a run that begins where its hash says."""
    good = []
    for i, words in enumerate(passages(text)):
        if words and len(_pairs(words) & known) < 2:
            h = zlib.crc32(b"%d " % i + b" ".join(words))
            k = h % (len(words) - FIT_WORDS + 1) if len(words) > FIT_WORDS else 0
            good.append((h, i, b" ".join(words[k : k + FIT_WORDS])))
    return [p for _, _, p in heapq.nsmallest(FIT_PASSAGES, good)]


def train(docs: DataFrame) -> Model:
    """Fit with ordinary passages of the FIT_DOCS documents that are first by a hash of doc_id."""
    first = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
    known = set().union(*(_pairs(p) for notices in FAMILIES.values() for t in notices for p in passages(t)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            chosen = [ordinary_passages(t, known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(chosen, pa.list_(pa.binary()))], ["doc_id", "chosen"])

    rows = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, chosen array<binary>")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "chosen").limit(FIT_ROWS).collect()
    return fit([bytes(p).split() for r in rows for p in r["chosen"]])


FOUND = pa.list_(pa.struct([("passage", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_passages and found of each row of ``docs`` (doc_id, text, ...): found has a struct (passage, family, probability,
    similarity, confirmed) for each passage that looks like a licence; a wrapped notice may be found in a line and in the sentence
    around it; family is ``unknown`` if none is probable enough.

    Null and empty texts have one empty passage and nothing found. Repeated rows are scanned each. Empty input gives an empty
    result. Other columns are ignored."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))  # 2^BITS x classes floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, Hashes()
        for batch in pieces(batches, "text"):
            texts = batch.column("text").to_pylist()
            found = [scan_text(t, model, cache) for t in texts]
            n = [_marked(t).count(b"\x01") + 1 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, FOUND)], ["doc_id", "n_passages", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_passages bigint, found array<struct<passage:bigint,family:string,probability:double,similarity:double,confirmed:boolean>>")


def by_document(scan: DataFrame) -> DataFrame:
    """doc_id, n_passages, n_found, n_confirmed, n_unknown, families (distinct confirmed ones in order, joined by commas)."""
    sure = F.filter("found", lambda x: x["confirmed"])
    return scan.select(
        "doc_id",
        "n_passages",
        F.size("found").cast("long").alias("n_found"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.size(F.filter("found", lambda x: x["family"] == "unknown")).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
    )
