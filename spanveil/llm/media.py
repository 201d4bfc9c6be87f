"""ISO media containers: write texts as tracks of 8-bit samples, walk the boxes, decode the sample tables.

``probe`` reads any such file: it walks nested boxes, decodes the sample tables of each track (also those of movie
fragments) and tells codec, duration and the byte ranges of key frames. No payload is decoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanveil.llm.common import pieces

UNIT, PAD = 192, b" "
RATE = 8000
SYNC_EVERY, CHUNK = 10, 50
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"])


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(text: str | None) -> bytes:
    """UTF-8 bytes filled with spaces up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + PAD * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def write_media(payload: bytes) -> bytes:
    """A movie with one track of unsigned 8-bit samples ('raw '). A table entry is a unit of UNIT samples; each SYNC_EVERY-th
    is marked as a key frame, CHUNK units make a chunk. No times of day: equal payloads give equal files."""
    units = len(payload) // UNIT
    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isommp41")
    data = box(b"mdat", payload)
    first = len(head) + len(data) - len(payload)
    offsets = first + np.arange(0, units, CHUNK, dtype=np.int64) * UNIT
    wide = bool(offsets[-1] >= 1 << 32)
    last = units % CHUNK
    runs = [(1, CHUNK, 1)] if units >= CHUNK else []
    if last:
        runs.append((units // CHUNK + 1, last, 1))
    sync = np.arange(1, units + 1, SYNC_EVERY, dtype=">u4")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    time64 = len(payload) >= 1 << 32
    span = struct.pack(">QQIQ" if time64 else ">IIII", 0, 0, RATE, len(payload))
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, units, UNIT)),
        full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
        full(b"stsz", struct.pack(">II", UNIT, units)),
        full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), offsets.astype(">u8" if wide else ">u4").tobytes()),
    )
    info = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
    mdia = box(b"mdia", full(b"mdhd", span, struct.pack(">HH", 0x55C4, 0), version=int(time64)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"text bytes\0"), info)
    tkhd = full(b"tkhd", struct.pack(">QQIIQ" if time64 else ">IIIII", 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=7, version=int(time64))
    mvhd = full(b"mvhd", span, struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=int(time64))
    return head + data + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


def walk(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, start and end of the body) of the boxes that lie in a range. Raises ValueError where a box doesn't fit."""
    end = len(data) if end is None else end
    at = start
    while at < end:
        if at + 8 > end:
            raise ValueError(f"box header cut off at {at}")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if at + 16 > end:
                raise ValueError(f"box header cut off at {at}")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            body += 16
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} at {at} has size {size}")
        yield kind, body, at + size
        at += size


@dataclass
class Track:
    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    sync: np.ndarray | None = None  # numbers of key samples from 0; None: all
    ticks: int = 0

    def ranges(self) -> np.ndarray:
        """Offset and size of each key sample, a row each."""
        at = np.arange(len(self.sizes)) if self.sync is None else self.sync[self.sync < len(self.sizes)]
        return np.stack([self.offsets[at], self.sizes[at]], axis=1).astype(np.int64)

    def keyframes(self) -> list[tuple[int, int]]:
        return [(a, n) for a, n in self.ranges().tolist()]


def _sample_table(data: memoryview, boxes: dict[bytes, tuple[int, int]], track: Track) -> None:
    u32 = lambda at, n: np.frombuffer(data, ">u4", n, at).astype(np.int64)

    def count(kind: bytes, at: int, width: int) -> int:
        (n,) = struct.unpack_from(">I", data, boxes[kind][0] + at)
        if boxes[kind][0] + at + 4 + n * width > boxes[kind][1]:
            raise ValueError(f"{kind!r} has {n} entries")
        return n

    if b"stsd" in boxes and count(b"stsd", 4, 0):
        track.codec = bytes(data[boxes[b"stsd"][0] + 12 : boxes[b"stsd"][0] + 16]).decode("latin-1")
    if b"stts" in boxes:
        n = count(b"stts", 4, 8)
        t = u32(boxes[b"stts"][0] + 8, 2 * n).reshape(n, 2)
        track.ticks = int((t[:, 0] * t[:, 1]).sum())
    if b"stsz" in boxes:
        body = boxes[b"stsz"][0]
        (one,) = struct.unpack_from(">I", data, body + 4)
        n = count(b"stsz", 8, 0 if one else 4)
        if n * max(one, 0) > len(data):
            raise ValueError(f"{n} samples of {one} bytes in a file of {len(data)}")
        track.sizes = np.full(n, one, np.int64) if one else u32(body + 12, n)
    elif b"stz2" in boxes:
        body = boxes[b"stz2"][0]
        bits, n = data[body + 7], struct.unpack_from(">I", data, body + 8)[0]
        if bits not in (4, 8, 16) or body + 12 + (n * bits + 7) // 8 > boxes[b"stz2"][1]:
            raise ValueError(f"{n} sample sizes of {bits} bits")
        if bits == 4:
            raw = np.frombuffer(data, np.uint8, (n + 1) // 2, body + 12)
            track.sizes = np.stack([raw >> 4, raw & 15], axis=1).ravel()[:n].astype(np.int64)
        else:
            track.sizes = np.frombuffer(data, {8: ">u1", 16: ">u2"}[bits], n, body + 12).astype(np.int64)
    kind = b"co64" if b"co64" in boxes else b"stco"
    if kind in boxes and b"stsc" in boxes and len(track.sizes):
        n = count(kind, 4, 8 if kind == b"co64" else 4)
        chunks = np.frombuffer(data, ">u8" if kind == b"co64" else ">u4", n, boxes[kind][0] + 8).astype(np.int64)
        m = count(b"stsc", 4, 12)
        runs = u32(boxes[b"stsc"][0] + 8, 3 * m).reshape(m, 3)
        if not n or not m:
            raise ValueError("samples without chunks")
        per = runs[np.searchsorted(runs[:, 0], np.arange(1, n + 1), side="right") - 1, 1]
        upto = np.cumsum(np.minimum(per, len(track.sizes)))  # what a chunk may claim beyond all samples is never laid out
        if upto[-1] < len(track.sizes):
            raise ValueError("chunks hold fewer samples than there are")
        of = np.searchsorted(upto, np.arange(len(track.sizes)), side="right")
        ends = np.cumsum(track.sizes)
        begins = ends - track.sizes
        starts = np.searchsorted(of, np.arange(n), side="left")
        first = begins[np.minimum(starts, len(begins) - 1)]
        track.offsets = chunks[of] + begins - first[of]
    if b"stss" in boxes:
        n = count(b"stss", 4, 4)
        track.sync = u32(boxes[b"stss"][0] + 8, n) - 1


def _fragment(data: memoryview, start: int, moof: tuple[int, int], tracks: dict[int, Track], defaults: dict[int, tuple]) -> None:
    """Add the samples of one movie fragment."""
    for kind, body, end in walk(data, *moof):
        if kind != b"traf":
            continue
        track, base, size, length, flags, at = None, start, 0, 0, 0, start
        for sub, b, stop in walk(data, body, end):
            f = struct.unpack_from(">I", data, b)[0] & 0xFFFFFF
            if sub == b"tfhd":
                (tid,) = struct.unpack_from(">I", data, b + 4)
                track = tracks.setdefault(tid, Track(tid))
                length, size, flags = defaults.get(tid, (0, 0, 0))
                p = b + 8
                if f & 1:
                    (base,) = struct.unpack_from(">Q", data, p)
                    p += 8
                p += 4 * bool(f & 2)
                got = []
                for bit in (8, 16, 32):
                    got.append(struct.unpack_from(">I", data, p)[0] if f & bit else None)
                    p += 4 * bool(f & bit)
                length, size, flags = (n if g is None else g for g, n in zip(got, (length, size, flags), strict=True))
                at = base
            elif sub == b"trun" and track is not None:
                n, p, lead = struct.unpack_from(">I", data, b + 4)[0], b + 8, None
                if f & 1:
                    at = base + struct.unpack_from(">i", data, p)[0]
                    p += 4
                if f & 4:
                    (lead,) = struct.unpack_from(">I", data, p)
                    p += 4
                cols = [bit for bit in (0x100, 0x200, 0x400, 0x800) if f & bit]
                if p + 4 * n * len(cols) > stop or (0x200 not in cols and n * max(size, 1) > len(data)):
                    raise ValueError(f"a run of {n} samples in a file of {len(data)}")
                t = np.frombuffer(data, ">u4", n * len(cols), p).reshape(n, len(cols)).astype(np.int64)
                col = lambda bit, other: t[:, cols.index(bit)] if bit in cols else np.full(n, other, np.int64)  # noqa: B023, E731
                sizes, marks = col(0x200, size), col(0x400, flags).copy()
                if lead is not None and n:
                    marks[0] = lead
                old = len(track.sizes)
                known = np.arange(old) if track.sync is None else track.sync
                track.sync = np.concatenate([known, old + np.flatnonzero(marks & 0x10000 == 0)])
                track.offsets = np.concatenate([track.offsets, at + np.cumsum(sizes) - sizes])
                track.sizes = np.concatenate([track.sizes, sizes])
                track.ticks += int(col(0x100, length).sum())
                at += int(sizes.sum())


def probe(data: bytes | None) -> list[Track]:
    """The tracks of a file, by track id. Raises ValueError for what isn't one."""
    view = memoryview(data or b"")
    if not len(view):
        raise ValueError("empty")
    tracks: dict[int, Track] = {}
    defaults: dict[int, tuple] = {}
    try:
        found = list(walk(view))
        for kind, body, end in found:
            if kind == b"moov":
                for sub, b, e in walk(view, body, end):
                    if sub == b"mvex":
                        for k, p, _ in walk(view, b, e):
                            if k == b"trex":
                                tid, _, length, size, flags = struct.unpack_from(">5I", view, p + 4)
                                defaults[tid] = (length, size, flags)
                    if sub != b"trak":
                        continue
                    track, table, todo = Track(), {}, [(b, e)]
                    while todo:
                        for k, p, q in walk(view, *todo.pop()):
                            v = view[p] if q > p else 0
                            if k in CONTAINERS:
                                todo.append((p, q))
                            elif k == b"tkhd":
                                (track.track_id,) = struct.unpack_from(">I", view, p + (20 if v else 12))
                            elif k == b"mdhd":
                                track.timescale, track.duration = struct.unpack_from(">IQ" if v else ">II", view, p + (20 if v else 12))
                            elif k == b"hdlr" and not track.handler:
                                track.handler = bytes(view[p + 8 : p + 12]).decode("latin-1")
                            else:
                                table[k] = (p, q)
                    _sample_table(view, table, track)
                    tracks[track.track_id] = track
        for kind, body, end in found:
            if kind == b"moof":
                _fragment(view, body - 8, (body, end), tracks, defaults)
        for t in tracks.values():
            if len(t.sizes) and (len(t.offsets) != len(t.sizes) or (t.offsets < 0).any() or (t.offsets + t.sizes > len(view)).any()):
                raise ValueError("samples lie outside the file")
            t.duration = t.duration or t.ticks
    except (struct.error, IndexError, KeyError) as error:
        raise ValueError(str(error)) from error
    if not tracks:
        raise ValueError("no track")
    return [tracks[k] for k in sorted(tracks)]


def payload(data: bytes, track: Track) -> bytes:
    """The stored bytes of a track's samples, in order; neighbours are read as one stretch."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    cut = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    firsts, lasts = track.offsets[np.concatenate([[0], cut])], ends[np.concatenate([cut - 1, [len(ends) - 1]])]
    return b"".join(data[a:b] for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True))


PROBED = "status string, tracks array<struct<track_id:bigint,handler:string,codec:string,timescale:bigint,duration:bigint,samples:bigint,keyframes:array<struct<offset:bigint,length:bigint>>>>"


def probe_media(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, status, tracks) for a column of files: status is ``ok``, or what is wrong, with no tracks. Null is empty."""
    kind = dict(df.dtypes)[key]
    shape = pa.list_(pa.struct([("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, column):
            status, rows = [], []
            for data in batch.column(column).to_pylist():
                try:
                    rows.append([{"track_id": t.track_id, "handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "samples": len(t.sizes), "keyframes": [{"offset": a, "length": b} for a, b in t.keyframes()]} for t in probe(data)])
                    status.append("ok")
                except ValueError as error:
                    rows.append(None)
                    status.append(str(error))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(status), pa.array(rows, shape)], [key, "status", "tracks"])

    return df.select(key, column).mapInArrow(run, f"{key} {kind}, {PROBED}")


def feature(track: Track) -> str:
    """Codec, duration and key frames of a track in one line; the ranges as a checksum over (offset, length) pairs."""
    keys = track.ranges().astype(">i8")
    return f"codec={track.codec} timescale={track.timescale} duration={track.duration} samples={len(track.sizes)} keyframes={len(keys)} ranges={zlib.crc32(keys.tobytes()):08x}"


MEDIA = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, timescale bigint, duration bigint, keyframes array<struct<offset:bigint,length:bigint>>"


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, codec, timescale, duration and
    keyframes (offset and length in the file) of each row of ``docs`` (doc_id, text, ...): each text is stored as a file, and everything
    after n_bytes comes from the stored file. Key frame ranges take 16 bytes for each SYNC_EVERY * UNIT bytes of text.

    Null and empty texts are one unit of spaces. Equal texts have equal values. Repeated rows are stored each. Empty input
    gives an empty result. Other columns are ignored."""
    kind, names = dict(docs.dtypes)["doc_id"], [c.split()[0] for c in MEDIA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows, frames = [], []
            for text in batch.column("text").to_pylist():
                data = write_media(padded(text))
                (track,) = probe(data)
                back = payload(data, track)
                n = len((text or "").encode("utf-8", "surrogatepass"))
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(track), track.codec, track.timescale, track.duration))
                frames.append(track.ranges())
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            ends = np.cumsum([0, *map(len, frames)]).astype(np.int32)
            flat = np.concatenate(frames)
            ranges = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["offset", "length"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, ranges], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {MEDIA}")
