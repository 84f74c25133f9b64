import struct

import numpy as np
from pyspark.sql import functions as F

from framewell import api
from framewell.functions.exif import turned
from framewell.operators import embed as embedding
from framewell.operators.catalog import Catalog
from framewell.sources import rasters
from test_api import _tags
from test_operators import bmp, rows

SEEN = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
BACK = {5: 5, 6: 8, 7: 7, 8: 6}  # what undoes a turn


def packed(raster, head):
    return head + struct.pack("<HHH", *raster.shape) + raster.tobytes()


def unpacker(skip):
    def decode(data):
        shape = struct.unpack_from("<HHH", data, skip)
        return np.frombuffer(data, np.uint8, offset=skip + 6).reshape(shape)

    return decode


WEBP = b"RIFF\0\0\0\0WEBP"


def test_each_turn_reaches_the_model_upright(spark):
    table = [(how, 1.0, f"/p{how}", "RAW", bytearray(packed(turned(SEEN, BACK.get(how, how)), _tags("<", how)))) for how in range(1, 9)]
    table += [(9, 1.0, "/broken", "raw", bytearray(_tags("<", 3) + b"x")), (10, 1.0, "/null", "raw", None), (11, 1.0, "/other", None, bytearray(b"x"))]
    contents = spark.createDataFrame(table, "image_id long, mtime double, path string, ext string, content binary")
    read = rasters.decoded_by(contents, {"raw": unpacker(len(_tags("<", 1)))})
    assert rows(read, "path", "orientation") == [(f"/p{k}", k) for k in range(1, 9)]
    picture = F.struct("height", "width", "channels", "data", "orientation").alias("picture")

    def load():
        return lambda pictures: [[*p.shape, *p.ravel()] for p in pictures]

    found = embedding.embed(contents.join(read.select("path", picture), "path"), load, "picture", 3).collect()
    assert len(found) == 8 and all(r.vector == [2, 3, 3, *SEEN.ravel()] for r in found)
    assert embedding.seen({"data": b"x", "height": 1, "width": 2, "channels": 3, "orientation": 1}) is None and embedding.seen("text") == "text"


def test_decoders_return_pictures_or_nothing(spark):
    bad = {"a": lambda data: None, "b": lambda data: np.zeros((2, 2), float), "c": lambda data: np.zeros((0, 2, 3), np.uint8), "d": lambda data: np.full((2, 2), 7, np.uint8)}
    contents = spark.createDataFrame([(f"/{k}", k, bytearray(b"x")) for k in bad], "path string, ext string, content binary")
    got = rasters.decoded_by(contents, bad).collect()
    assert [(r.path, r.height, r.channels, bytes(r.data)) for r in got] == [("/d", 2, 1, b"\7" * 4)]
    kinds = {b"\xff\xd8\xff\xe0": "jpeg", b"GIF89a": "gif", b"BM..": "bmp", b"MM\0*": "tiff", WEBP: "webp", b"RIFF\0\0\0\0WAVE": None, b"": None, b"\x89PNG\r\n\x1a\n.": "png"}
    table = spark.createDataFrame([(bytearray(k), v) for k, v in kinds.items()], "content binary, want string")
    assert all(r.want == r.got for r in table.select("want", rasters.picture_format(F.col("content")).alias("got")).collect())


def test_a_format_without_decoder_is_unsupported_until_one_is_brought(spark, tmp_path):
    base = np.kron(np.random.default_rng(5).integers(0, 256, (8, 8, 3), dtype=np.uint8), np.ones((8, 8, 1), np.uint8))
    (tmp_path / "in").mkdir()
    for name, data in {"a.bmp": bmp(base), "b.webp": packed(base, WEBP), "c.webp": WEBP + b"\1", "d.png": b"p" * 50}.items():
        (tmp_path / "in" / name).write_bytes(data)
    cat = Catalog(spark, str(tmp_path / "catalog"))
    api.scan(cat, [str(tmp_path / "in")], min_size=0)
    api.dedup(cat)
    failed = lambda: {r.path[-6:]: r.reason for r in cat.read("failed_files").collect()}
    assert failed() == {"b.webp": "unsupported", "c.webp": "unsupported", "/d.png": "corrupt"}
    decoders = {"webp": unpacker(len(WEBP))}
    api.dedup(cat, decoders=decoders)
    assert failed() == {"c.webp": "unsupported", "/d.png": "corrupt"}
    hashes = {r.path[-6:]: r.phash for r in cat.read("image_hashes").join(cat.read("images"), "image_id").collect()}
    assert hashes["b.webp"] == hashes["/a.bmp"] and cat.read("dedup_groups").count() == 2
    assert api.prewarm_thumbnails(cat, decoders=decoders) == 2 and api.prewarm_thumbnails(cat, decoders=decoders) == 0
    cat.replace("dedup_groups", cat.read("dedup_groups").limit(0))

    def load():
        return lambda pictures: [[float(x) for x in p.shape] for p in pictures]

    api.embed(cat, load, decoders=decoders)
    assert [list(r.vector) for r in cat.read("embeddings").collect()] == [[64.0, 64.0, 3.0]] * 2
    assert api.decoders_named(["WEBP=test_rasters:unpacker"]) == {"webp": unpacker} or api.decoders_named(None) is None
