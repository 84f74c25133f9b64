"""Media columns over ISO media containers: nested boxes, sample tables, keyframe byte ranges; payloads stay undecoded.

`store` writes a payload of 8-bit samples as one audio track; `inspect` walks the boxes of any such file, expands its
sample tables and reads codec, duration and the byte ranges of its keyframes (sync samples). The payload is read back
by the ranges that the tables give, never by where the writer put it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.llm.common import as_bytes

#: Bytes of one sample (64 8-bit values), samples a second x 64, samples a chunk, samples from one keyframe to the next.
SAMPLE, RATE, CHUNK, KEYFRAME = 64, 8000, 32, 16
CODEC = b"raw "
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return struct.pack(">I4s", size, kind) + b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def store(payload: bytes) -> bytes:
    """A file whose one track holds the payload, a positive multiple of 64 bytes, sample by sample."""
    n = len(payload) // SAMPLE
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    data = box(b"mdat", payload)
    at = len(head) + len(data) - len(payload)
    chunks = -(-n // CHUNK)
    offsets = at + np.arange(chunks, dtype=np.int64) * CHUNK * SAMPLE
    last = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK), (chunks, last)] if chunks > 1 and last != CHUNK else [(1, min(n, CHUNK))]
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    long = n * SAMPLE >= 1 << 32
    duration = struct.pack(">Q" if long else ">I", n * SAMPLE)
    times = b"\0" * (16 if long else 8)
    wide = offsets[-1] >= 1 << 32
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), box(CODEC, b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))),
        full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
        full(b"stss", struct.pack(">I", -(-n // KEYFRAME)), np.arange(1, n + 1, KEYFRAME, dtype=">u4").tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", first, many, 1) for first, many in runs)),
        full(b"stsz", struct.pack(">II", SAMPLE, n)),
        full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
    )
    media = box(
        b"mdia",
        full(b"mdhd", times, struct.pack(">I", RATE), duration, struct.pack(">HH", 0x55C4, 0), version=int(long)),
        full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 12, b"\0"),
        box(b"minf", full(b"smhd", b"\0" * 4), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
    )
    track = box(b"trak", full(b"tkhd", times, struct.pack(">II", 1, 0), duration, b"\0" * 8, struct.pack(">4H", 0, 0, 0x100, 0), matrix, b"\0" * 8, version=int(long), flags=7), media)
    movie = full(b"mvhd", times, struct.pack(">I", RATE), duration, struct.pack(">IHH", 0x10000, 0x100, 0), b"\0" * 8, matrix, b"\0" * 24, struct.pack(">I", 2), version=int(long))
    return head + data + box(b"moov", movie, track)


def boxes(data: bytes, at: int = 0, end: int | None = None, path: tuple = ()):
    """(path, first byte, start of the content, end) of every box, outer boxes first. Sizes that leave what holds them,
    and boxes inside more than DEEPEST others, are an error."""
    open_ = [(at, len(data) if end is None else end, path)]
    while open_:
        at, end, path = open_.pop()
        if at >= end:
            continue
        if end - at < 8:
            raise ValueError("a box is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise ValueError("a box is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError("a box leaves what holds it")
        if len(path) >= DEEPEST:
            raise ValueError("boxes inside each other without end")
        yield (*path, kind), at, at + head, at + size
        open_.append((at + size, end, path))
        if kind in NESTED:
            open_.append((at + head, at + size, (*path, kind)))


def walk(data: bytes):
    """(path, start, end) of every box's content."""
    for path, _, start, end in boxes(data):
        yield path, start, end


def _numbers(data: bytes, at: int, kind: str, count: int) -> np.ndarray:
    if count * np.dtype(kind).itemsize > len(data) - at:
        raise ValueError("a table is longer than its file")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


#: Boxes inside each other at most; files of the standard nest a handful.
DEEPEST = 64


class Track:
    """One track's codec, timescale, duration and samples: offset and size of each, and which are keyframes.

    at: where the contents of the track's own boxes begin. Samples of fragments follow those of the sample table.
    """

    def __init__(self, data: bytes, at: dict[bytes, int], fragments: list[tuple] = (), defaults: dict[int, tuple] | None = None) -> None:
        u32 = lambda where: struct.unpack_from(">I", data, where)[0]
        self.codec = data[at[b"stsd"] + 12 : at[b"stsd"] + 16].decode("latin-1").strip()
        self.id = u32(at[b"tkhd"] + (20 if data[at[b"tkhd"]] == 1 else 12)) if b"tkhd" in at else 0
        long = data[at[b"mdhd"]] == 1
        self.timescale = u32(at[b"mdhd"] + (20 if long else 12))
        self.ticks = struct.unpack_from(">Q" if long else ">I", data, at[b"mdhd"] + (24 if long else 16))[0]
        same, n = u32(at[b"stsz"] + 4), u32(at[b"stsz"] + 8)
        if same * n > len(data):
            raise ValueError("samples are longer than their file")
        self.sizes = np.full(n, same, np.int64) if same else _numbers(data, at[b"stsz"] + 12, ">u4", n)
        wide = b"co64" in at
        where = at[b"co64" if wide else b"stco"]
        chunks = _numbers(data, where + 8, ">u8" if wide else ">u4", u32(where + 4))
        runs = _numbers(data, at[b"stsc"] + 8, ">u4", 3 * u32(at[b"stsc"] + 4)).reshape(-1, 3)
        steps = np.diff(np.append(runs[:, 0], len(chunks) + 1))
        if len(runs) and (runs[0, 0] < 1 or (steps < 0).any() or int((runs[:, 1] * steps).sum()) > n):
            raise ValueError("chunks don't hold the samples there are")
        many = np.repeat(runs[:, 1], steps)
        begin = np.cumsum(self.sizes) - self.sizes
        first = np.cumsum(many) - many
        chunk = np.repeat(np.arange(len(chunks)), many)[:n]
        if len(chunk) < n:
            raise ValueError("chunks hold fewer samples than there are")
        self.offsets = chunks[chunk] + begin - begin[first[chunk]] if n else np.empty(0, np.int64)
        self.keyframes = _numbers(data, at[b"stss"] + 8, ">u4", u32(at[b"stss"] + 4)) - 1 if b"stss" in at else np.arange(n)
        self._read_fragments(data, fragments, (defaults or {}).get(self.id, (0, 0, 0)))

    def _read_fragments(self, data: bytes, fragments, default: tuple[int, int, int]) -> None:
        """The samples of movie fragments: (first byte of the fragment, tfhd, [trun, ...]) in file order."""
        u32 = lambda where: struct.unpack_from(">I", data, where)[0]
        offsets, sizes, keys, lasted = [], [], [], 0
        for begin, head, runs in fragments:
            flags, at = u32(head) & 0xFFFFFF, head + 4
            if u32(at) != self.id:
                continue
            at += 4
            base, (duration, size, sample) = begin, default
            if flags & 1:
                base, at = struct.unpack_from(">Q", data, at)[0], at + 8
            at += 4 * bool(flags & 2)
            if flags & 8:
                duration, at = u32(at), at + 4
            if flags & 16:
                size, at = u32(at), at + 4
            if flags & 32:
                sample = u32(at)
            here = base
            for run in runs:
                told, n, at = u32(run) & 0xFFFFFF, u32(run + 4), run + 8
                if told & 1:
                    here, at = base + struct.unpack_from(">i", data, at)[0], at + 4
                if not told & 0x200 and n * size > len(data) or not told & 0xF00 and n > len(data):
                    raise ValueError("samples are longer than their file")
                first = None
                if told & 4:
                    first, at = u32(at), at + 4
                fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if told & bit]
                table = _numbers(data, at, ">u4", n * len(fields)).reshape(n, len(fields))
                column = {bit: table[:, k] for k, bit in enumerate(fields)}
                each = column.get(0x200, np.full(n, size, np.int64))
                flag = column.get(0x400, np.full(n, sample, np.int64)).copy()
                if first is not None and n:
                    flag[0] = first
                lasted += int(column.get(0x100, np.full(n, duration, np.int64)).sum())
                offsets.append(here + np.cumsum(each) - each)
                sizes.append(each)
                keys.append(flag & 0x10000 == 0)
                here += int(each.sum())
        if sizes:
            self.keyframes = np.append(self.keyframes, len(self.sizes) + np.flatnonzero(np.concatenate(keys)))
            self.offsets, self.sizes = np.concatenate([self.offsets, *offsets]), np.concatenate([self.sizes, *sizes])
            self.ticks = self.ticks or lasted

    @property
    def keyframe_ranges(self) -> np.ndarray:
        """[start, end) of each keyframe in the file."""
        start = self.offsets[self.keyframes]
        return np.stack((start, start + self.sizes[self.keyframes]), axis=1)

    def payload(self, data: bytes) -> bytes:
        """The samples in order; samples that lie side by side are read at once."""
        ends = self.offsets + self.sizes
        cut = np.flatnonzero(self.offsets[1:] != ends[:-1]) + 1
        starts, stops = self.offsets[np.append(0, cut)], ends[np.append(cut - 1, len(ends) - 1)]
        return b"".join(data[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True))


def tracks(data: bytes) -> list[Track]:
    """The tracks of a file in its order, each from its own boxes alone."""
    own: list[dict[bytes, int]] = []
    fragments: list[tuple] = []
    defaults, begin = {}, 0
    for path, first, start, _ in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            own.append({})
        elif b"trak" in path:
            own[-1].setdefault(kind, start)
        elif kind == b"trex":
            track, _, duration, size, flags = struct.unpack_from(">5I", data, start + 4)
            defaults[track] = (duration, size, flags)
        elif kind == b"moof":
            begin = first
        elif kind == b"tfhd":
            fragments.append((begin, start, []))
        elif kind == b"trun":
            fragments[-1][2].append(start)
    return [Track(data, at, fragments, defaults) for at in own]


_COLUMNS = {"track": pa.int64(), "codec": pa.string(), "duration_s": pa.float64(), "n_samples": pa.int64(), "n_keyframes": pa.int64(), "keyframe_ranges": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
_COLUMNS_SQL = "track long, codec string, duration_s double, n_samples long, n_keyframes long, keyframe_ranges array<struct<start: long, end: long>>"


def media_columns(table: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """(id, track, codec, duration_s, n_samples, n_keyframes, keyframe_ranges) of a binary column of ISO media files: one
    row a track, numbered from 1 in the file's order; fragmented files too.

    A null, empty or broken file, and one without tracks, gives one row of nulls. Ids and repeated rows
    stay as they are.
    """

    def told(data: bytes) -> list[tuple]:
        try:
            out = []
            for k, t in enumerate(tracks(data), 1):
                ranges = [{"start": s, "end": e} for s, e in t.keyframe_ranges.tolist()]
                out.append((k, t.codec, t.ticks / t.timescale, len(t.sizes), len(ranges), ranges))
            return out or [(None,) * 6]
        except (KeyError, ValueError, IndexError, struct.error, ZeroDivisionError):
            return [(None,) * 6]

    def run(batches):
        for b in batches:
            found = [*map(told, as_bytes(b.column(1)))]
            place = pa.array(np.repeat(np.arange(len(found)), [*map(len, found)]))
            columns = list(zip(*(row for rows in found for row in rows), strict=True)) or [[]] * len(_COLUMNS)
            yield pa.RecordBatch.from_arrays([b.column(0).take(place), *[pa.array(list(c), k) for c, k in zip(columns, _COLUMNS.values(), strict=True)]], names=["id", *_COLUMNS])

    kind = table.schema[id_col].dataType.simpleString()
    return table.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, f"id {kind}, {_COLUMNS_SQL}")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes (null: none), zeros up to a positive multiple of 64, as a file."""

    def run(batches):
        for b in batches:
            texts = as_bytes(b.column(1))
            media = [store(t + b"\0" * ((-len(t)) % SAMPLE if t else SAMPLE)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, media binary")


def op8_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every text stored as a file and read back through its tables; one pass, nothing shuffled."""
    media = stored(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def run(batches):
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "keyframe_ranges"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]
        for b in batches:
            out = []
            for doc_id, n, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                t = tracks(data)[0]
                back = t.payload(data)
                ranges = t.keyframe_ranges
                feature = f"{t.codec};{t.ticks / t.timescale:.6f}s;{len(t.sizes)} samples;{len(ranges)} keyframes;ranges {zlib.crc32(ranges.astype('<i8').tobytes()):08x}"
                out.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, t.codec, t.ticks / t.timescale, _told(ranges)))
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframe_ranges string")


def _told(ranges: np.ndarray) -> str:
    """Byte ranges as start-end, comma-joined; ranges that lie side by side and are equally long as start-endxlength."""
    if not len(ranges):
        return ""
    size = ranges[:, 1] - ranges[:, 0]
    cut = np.flatnonzero((ranges[1:, 0] != ranges[:-1, 1]) | (size[1:] != size[:-1])) + 1
    firsts, lasts = np.append(0, cut), np.append(cut - 1, len(ranges) - 1)
    return ",".join(f"{ranges[a, 0]}-{ranges[z, 1]}" + (f"x{size[a]}" if z > a else "") for a, z in zip(firsts, lasts, strict=True))
