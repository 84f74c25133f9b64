import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewell import api
from framewell.functions.thumbnail import png, squared, thumbnails
from framewell.operators import transfer
from framewell.operators.catalog import Catalog
from framewell.sources import files
from test_operators import bmp, rows, tree  # noqa: F401


def test_thumbnail_is_a_square():
    picture = np.zeros((40, 300, 3), np.uint8)
    picture[:, :, 0] = 255  # blue, as stored
    out = squared(picture)
    assert out.shape == (150, 150, 3) and out[75, 75].tolist() == [0, 0, 255] and out[0, 0].tolist() == [0, 0, 0]
    assert squared(np.full((3, 5, 1), 7, np.uint8)).shape == (5, 5, 3)
    data = png(out)
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")])
    assert len(raw) == 150 * (1 + 450) and raw[1 + 450 + 1 :][:3] == b"\0\0\0"


def _tags(order, value):
    import struct

    return {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "IH", 8, 2) + struct.pack(order + "HHIHH", 0x0100, 3, 1, 9, 0) + struct.pack(order + "HHIHH", 0x0112, 3, 1, value, 0)


def test_orientation_is_read_and_undone():
    import struct

    from framewell.functions.exif import orientation, turned

    for order in "<>":
        tags = _tags(order, 6)
        app1 = b"Exif\0\0" + tags
        jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xda"
        png_file = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s", 1, b"tEXt") + b"x1234" + struct.pack(">I4s", len(tags), b"eXIf") + tags + b"1234"
        assert [orientation(x) for x in (tags, jpeg, png_file)] == [6, 6, 6] and orientation(jpeg[:30]) == 1
    assert [orientation(x) for x in (None, b"", b"BM", b"\xff\xd8\xff\xe1", _tags("<", 9), b"\xff\xd8\xff\xda")] == [1] * 6
    seen = np.arange(6).reshape(2, 3, 1)
    stored = {2: seen[:, ::-1], 3: np.rot90(seen, 2), 4: seen[::-1], 5: seen.swapaxes(0, 1), 6: np.rot90(seen, 1), 7: np.rot90(seen, 2).swapaxes(0, 1), 8: np.rot90(seen, -1)}
    assert all((turned(raster, how) == seen).all() for how, raster in stored.items()) and turned(seen, None) is seen


def test_few_files_are_decoded_by_name(spark, tree, tmp_path, monkeypatch):  # noqa: F811
    import shutil

    shutil.copytree(tree, tmp_path / "in")
    shutil.copy(tree / "a.bmp", tmp_path / "in" / "od[d]{x}*?.bmp")
    root = f"{tmp_path}/in"
    want = [f"{root}/a.bmp", f"{root}/od[d]{{x}}*?.bmp", f"{root}/sub/b c+d%.bmp"]
    only = spark.createDataFrame([(p,) for p in [*want, f"{root}/gone.bmp", f"{root}/sub/broken.bmp"]], "path string")
    one = rows(files.decoded(spark, root, only), "path", "width")
    monkeypatch.setattr(files, "FEW_FILES", 1)
    assert one == rows(files.decoded(spark, root, only), "path", "width") == [(p, 64) for p in want]
    assert files.decoded(spark, root, only.limit(0)).count() == 0


def test_thumbnails_are_upright(spark):
    raster = np.zeros((2, 4, 3), np.uint8)
    raster[0, 0] = 255
    data = [(str(k), 2, 4, 3, raster.tobytes(), k) for k in (1, 6)]
    made = thumbnails(spark.createDataFrame(data, "path string, height int, width int, channels int, data binary, orientation int"), encode=lambda rgb: rgb.tobytes())
    got = {r.path: np.frombuffer(bytes(r.blob), np.uint8).reshape(4, 4, 3) for r in made.collect()}
    assert got["1"][1, 0].all() and got["6"][0, 2].all() and got["6"].sum() == 3 * 255


def test_plans_are_carried_out(spark, tmp_path):
    paths = []
    for k in range(4):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "a.jpg").write_bytes(b"x" * (k + 1))
        paths.append(f"{tmp_path}/d{k}/a.jpg")
    images = spark.createDataFrame([(p, k + 1) for k, p in enumerate([*paths, f"{tmp_path}/gone.jpg"])], "path string, size long")
    plan = transfer.export_plan(images.select("path"), images, f"{tmp_path}/out").cache()
    for _ in range(2):  # twice gives the same files
        assert transfer.totals(transfer.carried_out(plan)).first()[:] == (4, 10, 1)
    assert {f.name: len(f.read_bytes()) for f in (tmp_path / "out").iterdir()} == {"a.jpg": 1, "a_1.jpg": 2, "a_2.jpg": 3, "a_3.jpg": 4}
    moved = plan.withColumn("dst", F.concat("dst", F.lit(".moved")))
    for _ in range(2):
        assert transfer.totals(transfer.carried_out(moved, move=True)).first()["files"] == 4
    assert not any((tmp_path / f"d{k}" / "a.jpg").exists() for k in range(4))


def test_nothing_is_written_over(spark, tmp_path):
    (tmp_path / "out").mkdir()
    for name, data in {"a.jpg": b"mine", "b.jpg": b"same", "out/a.jpg": b"other", "out/b.jpg": b"same"}.items():
        (tmp_path / name).write_bytes(data)
    plan = spark.createDataFrame([(f"{tmp_path}/{n}", f"{tmp_path}/out/{n}", 4) for n in ("a.jpg", "b.jpg")], "src string, dst string, size long")
    assert sorted((r.src[-5:], r.done) for r in transfer.carried_out(plan, move=True).collect()) == [("a.jpg", False), ("b.jpg", True)]
    assert (tmp_path / "a.jpg").read_bytes() == b"mine" and (tmp_path / "out/a.jpg").read_bytes() == b"other"
    assert not (tmp_path / "b.jpg").exists() and sorted(f.name for f in (tmp_path / "out").iterdir()) == ["a.jpg", "b.jpg"]


def test_moves_pass_over_names_in_the_folder(spark, tree, tmp_path):  # noqa: F811
    import shutil

    shutil.copytree(tree, tmp_path / "in")
    (tmp_path / "moved").mkdir()
    for name in ("a.bmp", "a.BMP", "a_1.bmp"):
        (tmp_path / "moved" / name).write_bytes(b"there before")
    cat = Catalog(spark, str(tmp_path / "catalog"))
    api.scan(cat, [f"{tmp_path}/in"], min_size=1000)
    for k in range(2):
        api.dedup(cat, move_to=str(tmp_path / "moved"))
        left = sorted(f.name for f in (tmp_path / "moved").iterdir())
        assert len(left) == 4 and all((tmp_path / "moved" / n).read_bytes() == b"there before" for n in ("a.bmp", "a.BMP", "a_1.bmp"))


def words():
    return lambda values: [[float(len(v)), 1.0, 0.0] for v in values]


def test_catalog_verbs(spark, tree, tmp_path, capsys, monkeypatch):  # noqa: F811
    known = spark.sparkContext.environment
    monkeypatch.setitem(known, "PYTHONPATH", os.pathsep.join([os.path.dirname(__file__), *filter(None, [known.get("PYTHONPATH")])]))
    cat = Catalog(spark, str(tmp_path / "catalog"))
    api.main(["--catalog", cat.root, "scan", "--path", f"{tree},{tree}/sub", "--min-size", "1"], spark)
    assert cat.read("images").count() == 5
    assert api.stats(cat).first().duplicates == 0
    summary = api.dedup(cat).first()
    assert (summary.total, summary.similar, summary.duplicates, summary.failed) == (5, 2, 1, 2)
    assert cat.dimensions(f"{tree}/a.bmp") == (64, 64)
    assert api.dedup(cat).first() == summary and api.stats(cat).first().duplicates == 1

    def load():
        return lambda values: [[float(len(bytes(v))), float(bytes(v)[60]), 1.0] for v in values]

    api.embed(cat, load)
    assert cat.read("embeddings").count() == 2
    assert api.cluster(cat).count() == 2
    found = api.search(cat, [1.0, 0.0, 0.0], threshold=0).collect()
    kept = cat.search_index()
    assert cat.search_index() is kept
    capsys.readouterr()
    api.main(["--catalog", cat.root, "search", "a word", "--model", "test_api:words", "--threshold", "0"], spark)
    assert "a.bmp" in capsys.readouterr().out.lower()
    api.main(["--catalog", cat.root, "embed", "--model", "test_api:words", "--full"], spark)
    assert cat.read("embeddings").count() == 2 and cat.search_index() is not kept
    cat.replace("embeddings", cat.read("embeddings").limit(0))
    api.embed(cat, load, a_commit=1)
    assert cat.read("embeddings").count() == 2
    api.main(["--catalog", cat.root, "report", "--to", str(tmp_path / "reports")], spark)
    assert "largest_groups" in capsys.readouterr().out
    assert spark.read.json(str(tmp_path / "reports" / "duplicates")).first()["total"] == 5
    assert [r["rank"] for r in found] == [1, 2] and found[0].score >= found[1].score
    h = cat.read("image_hashes").first()["phash"]
    assert api.phash_search(cat, h).filter("distance = 0").count() >= 1
    assert api.prewarm_thumbnails(cat) == 3 and api.prewarm_thumbnails(cat) == 0
    assert rows(cat.read("thumbnails"), "ext") == [("png",)] * 3
    api.dedup(cat, move_to=str(tmp_path / "moved"))
    assert len(list((tmp_path / "moved").iterdir())) == 1
    api.main(["--catalog", cat.root, "stats"], spark)
    assert "total_size" in capsys.readouterr().out
    api.main(["--catalog", cat.root, "clear"], spark)
    assert cat.read("images").count() == 0
    with pytest.raises(SystemExit):
        api.main(["--catalog", cat.root, "nothing"], spark)
