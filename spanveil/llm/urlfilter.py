"""URL filters by a bit-parallel wildcard automaton.

Each glob is a run of bits, one for its start and one for each symbol; all globs are packed into a few 64-bit words. A symbol
of a URL moves every active bit one place if the symbol fits there (Shift-And); bits at a ``*`` stay active. A batch of URLs
is a matrix of such words, so one step simulates all globs on all URLs of the batch.

A canonical URL is the host, a separator that no glob symbol can be mistaken for, and the path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Symbol between host and path; bytes are 0-255.
SEP = 256
LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; then up to ``?``,
    ``#`` or the end. Both are empty without ``://``, and for null."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    cut = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(LOWER), path[:cut]


def symbols(host: str, path: str) -> list[int]:
    return [*host.encode("utf-8", "surrogatepass"), SEP, *path.encode("utf-8", "surrogatepass")]


@dataclass(frozen=True)
class Glob:
    """``*`` is any run of symbols within its part, ``?`` any one symbol of it; all else stands for itself."""

    host: str
    path: str

    def items(self) -> list[int | str]:
        part = lambda s: [x if x in "*?" else b for x in s for b in ([0] if x in "*?" else x.encode())]
        return [*part(self.host), SEP, *part(self.path)]


class Automaton:
    def __init__(self, globs: list[Glob]):
        start, loop, final, masks, bit = [], [], [], {s: [] for s in range(SEP + 1)}, 0
        for glob in globs:
            at = bit
            start.append(at)
            bit += 1
            for x in glob.items():
                if x == "*":
                    loop.append(bit - 1)
                    continue
                for s in range(SEP) if x == "?" else (x,):
                    masks[s].append(bit)
                bit += 1
            final.append(bit - 1)
        self.words = bit // 64 + 1
        self.start, self.loop = self._pack(start), self._pack(loop)
        self.masks = np.stack([self._pack(masks[s]) for s in range(SEP + 1)])
        self.final = final

    def _pack(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return out

    def match(self, urls: list[list[int]]) -> np.ndarray:
        """Rows: URLs; columns: globs; true where the glob fits the whole URL. Longer URLs come first, so that those still
        being read are a prefix of the matrix."""
        sizes = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max(initial=0))
        flat = np.array([s for u in urls for s in u], np.int64)
        begin = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        state = np.repeat(self.start[None, :], len(urls), axis=0)
        left = np.searchsorted(-sizes, -np.arange(longest), side="left")  # URLs longer than each position
        for i in range(longest):
            n = left[i]
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= self.masks[flat[begin[:n] + i]]
            moved |= now & self.loop
            state[:n] = moved
        out = np.empty((len(urls), len(self.final)), bool)
        for k, b in enumerate(self.final):
            out[order, k] = (state[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1) != 0
        return out


#: (host, path, verdict); the longest that fits wins, the first of equals.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: What the method blocks where no rule fits; all else is allowed.
BLOCKED = (
    Glob("*spam*", "*"),
    Glob("*cheap-pills*", "*"),
    Glob("*casino*", "*"),
    Glob("*", "*/ads/*"),
    Glob("*", "*.exe"),
    Glob("*", "*.zip"),
)


def rule_globs(host: str, path: str) -> tuple[Glob, Glob]:
    """The host itself and its subdomains, with paths that start with the rule's. Rules hold no wildcards."""
    if {"*", "?"} & set(host + path):
        raise ValueError(f"a rule's host and path are literal: {host}{path}")
    return Glob(host, path + "*"), Glob("*." + host, path + "*")


def judge_urls(pages: DataFrame, rules=RULES, blocked=BLOCKED, most_bytes: int = 4 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages`` (page_id, url, ...).

    ``rule`` is the host and path of the longest rule that fits, else null; ``verdict`` the rule's, else ``block`` where one
    of ``blocked`` fits and ``allow`` elsewhere. Null and empty urls, and those without ``://``, have empty host and path, so
    no rule. Repeated rows are judged each. Empty input gives an empty result. Other columns are ignored."""
    kind = dict(pages.dtypes)["page_id"]
    names, verdicts = [h + p for h, p, _ in rules], [v for _, _, v in rules]
    rank = sorted(range(len(rules)), key=lambda k: (-len(names[k]), k))
    globs = [g for h, p, _ in rules for g in rule_globs(h, p)] + list(blocked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        for batch in batches:
            for part in _cut(batch, most_bytes):
                split = [split_url(u) for u in part.column("url").to_pylist()]
                fits = automaton.match([symbols(*s) for s in split])
                mine = fits[:, : 2 * len(rules)].reshape(len(split), len(rules), 2).any(axis=2)
                bad = fits[:, 2 * len(rules) :].any(axis=1)
                best = [next((k for k in rank if row[k]), None) for row in mine]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"),
                        pa.array([h for h, _ in split], pa.string()),
                        pa.array([p for _, p in split], pa.string()),
                        pa.array([None if k is None else names[k] for k in best], pa.string()),
                        pa.array([("block" if b else "allow") if k is None else verdicts[k] for k, b in zip(best, bad, strict=True)], pa.string()),
                    ],
                    ["page_id", "host", "path", "rule", "verdict"],
                )

    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def _cut(batch: pa.RecordBatch, most_bytes: int):
    from spanveil.llm.common import pieces

    return pieces(iter([batch]), "url", most_bytes)
