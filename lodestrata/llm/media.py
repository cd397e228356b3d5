"""Media columns: ISO media containers read by their boxes and sample tables.

Codec, duration and keyframe byte ranges come from the boxes alone; a payload
is never decoded, and only read where a caller asks for its bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Boxes that hold nothing but boxes.
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"})
#: The stored form of a payload: gray pictures of 24 x 24 8-bit samples.
SIDE, FRAME, RATE, GROUP, CHUNK = 24, 576, 24, 12, 48
#: Bytes of text that are stored at a time, or one text.
STEP = 1 << 25


@dataclass
class Box:
    kind: bytes
    start: int
    body: int
    end: int


def boxes(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[Box]:
    """The boxes of a span, in order; a size of 1 is followed by 64 bits, 0 means the rest."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError(f"{end - start} bytes at {start} are no box")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError(f"no room for a long size at {start}")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has size {size}")
        yield Box(kind, start, body, start + size)
        start += size


def find(data: memoryview, path: tuple[bytes, ...], start: int = 0, end: int | None = None) -> Iterator[Box]:
    """All boxes below nested boxes of the kinds in ``path``."""
    for box in boxes(data, start, end):
        if box.kind == path[0]:
            if len(path) == 1:
                yield box
            elif box.kind in CONTAINERS:
                yield from find(data, path[1:], box.body, box.end)


def _table(data: memoryview, box: Box, columns: int, at: int = 4, kind: str = ">u4") -> np.ndarray:
    """A counted table behind a version-and-flags word."""
    (n,) = struct.unpack_from(">I", data, box.body + at)
    width = np.dtype(kind).itemsize * columns
    if box.body + at + 4 + n * width > box.end:
        raise ValueError(f"{box.kind!r} is too short for {n} entries")
    return np.frombuffer(data, kind, n * columns, box.body + at + 4).reshape(n, columns).astype(np.int64)


@dataclass
class Track:
    """What the sample tables say; offsets and sizes are per sample."""

    handler: str
    codec: str
    width: int
    height: int
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    times: np.ndarray
    keys: np.ndarray

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def keyframes(self) -> list[tuple[int, int]]:
        """Byte ranges (offset, length) of the keyframes."""
        return list(zip(self.offsets[self.keys].tolist(), self.sizes[self.keys].tolist(), strict=True))


def _track(data: memoryview, trak: Box) -> Track:
    def one(*path: bytes) -> Box | None:
        return next(find(data, path, trak.body, trak.end), None)

    def need(*path: bytes) -> Box:
        if (box := one(*path)) is None:
            raise ValueError(f"no {path[-1]!r} box in a track")
        return box

    mdhd = need(b"mdia", b"mdhd")
    long = data[mdhd.body] == 1
    timescale, duration = struct.unpack_from(">IQ" if long else ">II", data, mdhd.body + (20 if long else 12))
    handler = bytes(data[(h := need(b"mdia", b"hdlr")).body + 8 : h.body + 12]).decode("latin-1")
    stbl = (b"mdia", b"minf", b"stbl")
    stsd = need(*stbl, b"stsd")
    entry = next(boxes(data, stsd.body + 8, stsd.end), None)
    if entry is None:
        raise ValueError("no sample description")
    width = height = 0
    if handler == "vide":
        width, height = struct.unpack_from(">HH", data, entry.body + 24)
    stsz = need(*stbl, b"stsz")
    (common, count) = struct.unpack_from(">II", data, stsz.body + 4)
    if common and count > len(data):
        raise ValueError(f"{count} samples in {len(data)} bytes")
    sizes = np.full(count, common, np.int64) if common else _table(data, stsz, 1, 8)[:, 0]
    if co := one(*stbl, b"co64"):
        chunks = _table(data, co, 1, kind=">u8")[:, 0]
    else:
        chunks = _table(data, need(*stbl, b"stco"), 1)[:, 0]
    runs = _table(data, need(*stbl, b"stsc"), 3)
    first = np.append(runs[:, 0] - 1, len(chunks))
    per = np.repeat(runs[:, 1], np.diff(first))
    if len(per) != len(chunks) or per.sum() != len(sizes):
        raise ValueError(f"chunks hold {per.sum()} samples, not {len(sizes)}")
    ends = np.cumsum(sizes)
    opening = np.cumsum(per) - per  # the first sample of each chunk
    before = ends - sizes
    offsets = np.repeat(chunks - (before[opening] if len(sizes) else 0), per) + before
    if len(offsets) and int((offsets + sizes).max()) > len(data):
        raise ValueError("samples lie behind the end")
    stts = _table(data, need(*stbl, b"stts"), 2)
    if stts[:, 0].sum() != len(sizes):
        raise ValueError(f"times for {stts[:, 0].sum()} samples, not {len(sizes)}")
    deltas = np.repeat(stts[:, 1], stts[:, 0])
    stss = one(*stbl, b"stss")
    keys = np.arange(len(sizes)) if stss is None else _table(data, stss, 1)[:, 0] - 1
    if len(keys) and not 0 <= keys.min() <= keys.max() < len(sizes):
        raise ValueError("keyframes outside the samples")
    codec = entry.kind.decode("latin-1")
    return Track(handler, codec, width, height, timescale, duration, offsets, sizes, np.cumsum(deltas) - deltas, keys)


def tracks(content: bytes) -> list[Track]:
    """All tracks of a container; ValueError says what is wrong with a broken one."""
    data = memoryview(content)
    try:
        return [_track(data, t) for t in find(data, (b"moov", b"trak"))]
    except struct.error as e:
        raise ValueError(f"a box is cut short: {e}") from e


def read_samples(content: bytes, track: Track) -> bytes:
    """A track's stored bytes, sample by sample; runs that touch are read at once."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    new = np.flatnonzero(np.append(True, track.offsets[1:] != ends[:-1]))
    last = np.append(new[1:], len(ends)) - 1
    data = memoryview(content)
    return b"".join(data[a:b] for a, b in zip(track.offsets[new].tolist(), ends[last].tolist(), strict=True))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pad(text: bytes) -> bytes:
    """``text`` and bytes 255 up to a positive multiple of a frame."""
    return text + b"\xff" * (-len(text) % FRAME if text else FRAME)


def store(payload: bytes) -> bytes:
    """A container with ``payload``, a positive multiple of a frame, as raw gray pictures."""
    n = len(payload) // FRAME
    if not n or len(payload) % FRAME:
        raise ValueError(f"{len(payload)} bytes are not whole frames")
    chunks = -(-n // CHUNK)
    keys = range(1, n + 1, GROUP)
    entry = _box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 16, struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), b"\0" * 32, struct.pack(">Hh", 40, -1))
    runs = [(1, CHUNK if n >= CHUNK else n, 1)] + ([(chunks, n % CHUNK, 1)] if n > CHUNK and n % CHUNK else [])
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(base: int) -> bytes:
        offsets = struct.pack(f">{chunks}Q", *range(base, base + n * FRAME, CHUNK * FRAME))
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"co64", struct.pack(">I", chunks), offsets),
        )
        minf = _box(b"minf", _full(b"vmhd", b"\0" * 8, flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), _full(b"hdlr", struct.pack(">I4s12s", 0, b"vide", b""), b"samples\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIIIQHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0, 0), _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIHHQ", 0, 0, RATE, n, 0x10000, 0x100, 0, 0), _MATRIX, b"\0" * 24, struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    mdat = _box(b"mdat", payload)
    base = len(ftyp) + len(moov(0)) + len(mdat) - len(payload)
    return ftyp + moov(base) + mdat


def media_columns(files: DataFrame, key: str, content: str, ranges: bool = True) -> DataFrame:
    """One row per file and track: key, track, codec, handler, width, height,
    seconds, n_samples, n_keyframes, keyframes (offset, length), error.

    A null, empty or broken file gives one row with an ``error`` and nulls. A
    file without tracks gives one row with track null. Rows are independent, so
    repeated files repeat; memory is one batch of files and their tables.
    """
    kind = pa.schema([("track", pa.int32()), ("codec", pa.string()), ("handler", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("seconds", pa.float64()), ("n_samples", pa.int64()), ("n_keyframes", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, x in enumerate(batch.column(1)):
                try:
                    found = tracks(x.as_py() or b"")
                    more = [{"track": n, "codec": t.codec, "handler": t.handler, "width": t.width, "height": t.height, "seconds": t.seconds, "n_samples": len(t.sizes), "n_keyframes": len(t.keys), "keyframes": [{"offset": a, "length": b} for a, b in t.keyframes()] if ranges else None} for n, t in enumerate(found)]
                    more = more or [{"error": "no track"}]
                except ValueError as e:
                    more = [{"error": str(e)}]
                rows += more
                at += [i] * len(more)
            cols = pa.RecordBatch.from_pylist(rows, kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols.columns], [key, *kind.names])

    schema = f"`{key}` {files.schema[key].dataType.simpleString()}, track int, codec string, handler string, width int, height int, seconds double, n_samples long, n_keyframes long, keyframes array<struct<offset:long,length:long>>, error string"
    return files.select(key, content).mapInArrow(run, schema)


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: key, n_bytes, media (a container whose samples are the text's
    UTF-8, padded to whole frames). A null text counts as empty."""

    def run(batches):
        for batch in batches:
            column, lo, size, texts = batch.column(1).cast(pa.binary()), 0, 0, []
            for i, x in enumerate(column):
                texts.append(x.as_py() or b"")
                size += len(texts[-1])
                if size >= STEP or i == len(batch) - 1:
                    part = pa.array([len(t) for t in texts], pa.int64()), pa.array([store(pad(t)) for t in texts], pa.large_binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), part[0], part[1].cast(pa.binary())], [key, "n_bytes", "media"])
                    lo, size, texts = i + 1, 0, []

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def digest_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests of stored containers and of the payload read back through their sample
    tables, with a feature string made of the tables alone."""

    def run(batches):
        for batch in batches:
            out = []
            for n, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                content = x.as_buffer().to_pybytes()
                (t,) = tracks(content)
                payload = read_samples(content, t)
                keys = t.keyframes()
                marks = zlib.crc32(np.array(keys, "<i8").tobytes())
                feature = f"{t.codec.strip()}:{t.width}x{t.height}:{t.seconds:.6f}s:{len(t.sizes)}:{len(keys)}:{keys[0][0]}+{keys[0][1]}:{keys[-1][0]}+{keys[-1][1]}:{marks:08x}"
                out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(content), hashlib.sha256(content).hexdigest(), feature))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = f"`{key}` {media.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(key, "n_bytes", "media").mapInArrow(run, schema)
