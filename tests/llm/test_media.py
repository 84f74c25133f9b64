import hashlib
import struct
import zlib

import numpy as np
import pytest

from framewell.llm import media


@pytest.mark.parametrize("n", [64, 128, 64 * 31, 64 * 32, 64 * 33, 64 * 64, 64 * 1000])
def test_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    data = media.store(payload)
    track = media.tracks(data)[0]
    assert track.payload(data) == payload
    assert (track.codec, track.timescale, track.ticks) == ("raw", 8000, n)
    ranges = track.keyframe_ranges
    assert [data[a:b] for a, b in ranges.tolist()] == [payload[k * 64 : k * 64 + 64] for k in range(0, n // 64, 16)]


def test_boxes_of_other_writers():
    payload = bytes(range(200))
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + 200) + payload  # 64-bit size
    at = 8 + 16
    entry = media.box(b"avc1", b"\0" * 78)
    table = media.box(
        b"stbl", media.full(b"stsd", struct.pack(">I", 1), entry), media.full(b"stts", struct.pack(">III", 1, 4, 10)),
        media.full(b"stss", struct.pack(">III", 2, 1, 3)), media.full(b"stsc", struct.pack(">IIIIIII", 2, 1, 1, 1, 2, 3, 1)),
        media.full(b"stsz", struct.pack(">II4I", 0, 4, 20, 30, 40, 50)), media.full(b"co64", struct.pack(">IQQ", 2, at + 100, at)),
    )
    mdhd = media.full(b"mdhd", b"\0" * 16, struct.pack(">IQ", 1000, 40), b"\0" * 4, version=1)
    data = media.box(b"free") + mdat + media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", table))))
    track = media.tracks(data)[0]
    assert (track.codec, track.timescale, track.ticks) == ("avc1", 1000, 40)
    assert track.keyframe_ranges.tolist() == [[at + 100, at + 120], [at + 30, at + 70]]
    assert track.payload(data) == payload[100:120] + payload[:120]


def track_of(kind, number, offsets, sizes, sync=None):
    n = len(sizes)
    table = media.box(
        b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(kind, b"\0" * 28)), media.full(b"stts", struct.pack(">III", 1, n, 10)),
        *([media.full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync))] if sync else []), media.full(b"stsc", struct.pack(">I3I", 1, 1, 1, 1) if n else struct.pack(">I", 0)),
        media.full(b"stsz", struct.pack(f">II{n}I", 0, n, *sizes)), media.full(b"stco", struct.pack(f">I{n}I", n, *offsets)),
    )
    mdhd = media.full(b"mdhd", b"\0" * 8, struct.pack(">II", 100, 10 * n), b"\0" * 4)
    return media.box(b"trak", media.full(b"tkhd", b"\0" * 8, struct.pack(">I", number), b"\0" * 68), media.box(b"mdia", mdhd, media.box(b"minf", table)))


def test_each_track_is_read_from_its_own_boxes(spark):
    data = media.box(b"moov", track_of(b"mp4a", 1, [900, 910], [5, 6]), track_of(b"avc1", 2, [100, 200, 300, 400, 500], [9, 8, 7, 6, 5], [1, 5]))
    audio, video = media.tracks(data)
    assert (audio.codec, audio.id, audio.keyframe_ranges.tolist()) == ("mp4a", 1, [[900, 905], [910, 916]])
    assert (video.codec, video.id, video.keyframe_ranges.tolist()) == ("avc1", 2, [[100, 109], [500, 505]])
    got = media.media_columns(spark.createDataFrame([(7, data)], "id long, media binary")).collect()
    assert [(r.id, r.track, r.codec, r.duration_s, r.n_samples, r.n_keyframes) for r in got] == [(7, 1, "mp4a", 0.2, 2, 2), (7, 2, "avc1", 0.5, 5, 2)]


def test_fragments():
    head = media.box(b"moov", track_of(b"avc1", 4, [], []), media.box(b"mvex", media.full(b"trex", struct.pack(">5I", 4, 1, 10, 7, 0x10000))))
    run = media.full(b"trun", struct.pack(">IiI3I", 3, 60, 0, 20, 30, 40), flags=0x205)
    more = media.full(b"trun", struct.pack(">I", 2))
    moof = media.box(b"moof", media.full(b"mfhd", b"\0" * 4), media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 4), flags=0x20000), run, more), media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 9)), more))
    (track,) = media.tracks(head + moof)
    at = len(head) + 60
    assert track.offsets.tolist() == [at, at + 20, at + 50, at + 90, at + 97] and track.sizes.tolist() == [20, 30, 40, 7, 7]
    assert track.keyframe_ranges.tolist() == [[at, at + 20]] and (track.ticks, track.timescale) == (50, 100)


def test_broken_files_give_nulls(spark):
    good = media.store(b"\1" * 128)
    rows = [(1, good), (None, good), (2, None), (3, b""), (4, good[:-40]), (5, b"\0\0\0\4moov"), (6, b"not media at all"), (1, good)]
    got = media.media_columns(spark.createDataFrame([(*r, "x") for r in rows], "id long, media binary, codec string")).collect()
    assert [(r.id, r.codec, r.n_samples, r.duration_s) for r in got] == [(i, "raw", 2, 0.016) if k in (0, 1, 7) else (i, None, None, None) for k, (i, _) in enumerate(rows)]
    assert [(x.start, x.end) for x in got[0].keyframe_ranges] == [(36, 100)]
    assert media.media_columns(spark.createDataFrame([], "id long, media binary")).count() == 0


def test_query(spark, tmp_path):
    texts = {1: "é" * 40, 2: "", 3: None, 4: "x" * 64, 5: "y " * 100_000, 6: "é" * 40}
    spark.createDataFrame([*texts.items(), (None, "z")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in media.op8_media_columns(spark, str(tmp_path)).collect()}
    assert len(got) == 7
    for i, t in [*texts.items(), (None, "z")]:
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64) or b"\0" * 64
        stored = media.store(padded)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[1].feature == got[6].feature != got[5].feature


def test_broken_files_end_in_nulls_within_their_memory(spark):
    good = media.store(b"\1" * 6400)
    nested = b""
    for _ in range(1500):
        nested = struct.pack(">I4s", 8 + len(nested), b"udta") + nested
    at = good.index(b"stsz") + 8
    endless = good[:at] + struct.pack(">II", 64, 0xFFFFFFFF) + good[at + 8 :]
    runs = good.index(b"stsc") + 12
    crooked = good[:runs] + struct.pack(">I", 0xFFFFFFF0) + good[runs + 4 :]
    rows = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(nested)), (3, bytearray(endless)), (4, bytearray(crooked)), (5, bytearray(good[:200]))], "id long, media binary")
    got = {r.id: r.codec for r in media.media_columns(rows).collect()}
    assert got.pop(1) and set(got.values()) == {None} and len(got) == 4


def test_ranges_are_told_whole():
    ranges = np.array([[10, 20], [20, 30], [30, 40], [50, 60], [60, 65]])
    assert media._told(ranges) == "10-40x10,50-60,60-65" and media._told(ranges[:0]) == ""
