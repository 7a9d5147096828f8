"""Scans, sinks, splits and streams in a temporary folder."""

import gzip
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridoc.operators import relational as L
from veridoc.sources import files
from veridoc.streaming import incremental


def test_predictions(spark, tmp_path):
    lines = [json.dumps({"image_name": "a.jpg", "report": "r"}), "", json.dumps({"image_name": "b.jpg", "report": "s"})]
    (tmp_path / "p.jsonl").write_text("\n".join(lines))
    with gzip.open(tmp_path / "p.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    for name in ("p.jsonl", "p.jsonl.gz"):
        assert {r.image_name for r in files.load_predictions(spark, str(tmp_path / name)).collect()} == {"a.jpg", "b.jpg"}
    (tmp_path / "bad.jsonl").write_text('{"image_name": "a"}')
    with pytest.raises(ValueError):
        files.load_predictions(spark, str(tmp_path / "bad.jsonl"))


def test_prediction_folders(spark, tmp_path):
    for name, text in (("x", '{"report": "r"}'), ("y", '{"image_name": "n", "report": "s"}'), ("z", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "report.json").write_text(text)
    assert {(r.image_name, r.report) for r in files.load_prediction_folders(spark, str(tmp_path)).collect()} == {("x", "r"), ("n", "s")}


def test_maps_round_trip(spark, tmp_path):
    a = np.arange(6, dtype=np.float32).reshape(2, 3)
    np.save(tmp_path / "m.npy", a[None])
    maps = files.load_maps(spark, str(tmp_path))
    r = maps.first()
    assert (r.stem, r.h, r.w, list(r.data)) == ("m", 2, 3, list(a.ravel()))
    assert len(files.npy_bytes(maps).first().content) > 24


def test_metadata(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.load_metadata(spark, str(tmp_path))
    (tmp_path / "metadata.csv").write_text("sample_id,has_mask\n1,true\n2,\n")
    assert [r.has_mask for r in files.load_metadata(spark, str(tmp_path)).orderBy("sample_id").collect()] == [True, True]
    assert "language" in files.missing_columns(files.load_metadata(spark, str(tmp_path)))


def test_excluded_and_templates(spark, tmp_path):
    (tmp_path / "e.txt").write_text("a/b/doc1.jpg\n# no\n\ndoc2  # why\n")
    assert {r.stem for r in files.load_excluded(spark, str(tmp_path / "e.txt")).collect()} == {"doc1", "doc2"}
    assert files.load_template(spark, str(tmp_path / "e.txt")).first().name == "e"


def test_chat_sink(spark, tmp_path):
    df = spark.createDataFrame([("1", None), ("2", "x")], "id string, image string").withColumn("record", F.when(F.col("image").isNotNull(), F.struct("id", "image", F.lit(None).cast("string").alias("mask"))))
    assert files.write_chat(df, str(tmp_path / "out")) == 1
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value) == {"id": "2", "image": "x", "mask": None}


def test_parts(spark):
    df = spark.createDataFrame([("s12", "a/part003/x.jpg"), ("s2007", "b")], "sample_id string, image_path string")
    assert [r.part for r in files.infer_parts(df, ["image_path"]).collect()] == [3]
    assert sorted(r.part for r in files.infer_parts(df.where("sample_id = 's2007'"), ["image_path"]).collect()) == [2]


def test_split_covers_and_is_disjoint(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("a"), F.when(F.col("id") < 3, "rare").otherwise("many").alias("b"))
    out = L.stratified_split(df, "k", ["a", "b"]).collect()
    assert len({r.k for r in out}) == len(out) == 200
    assert sum(r.split == "val" for r in out) == 20 and all(r.split == "train" for r in out if r.b == "rare")


def test_asof_header(spark):
    marks = spark.createDataFrame([(1, 50), (1, 3000)], "t int, at int")
    headers = spark.createDataFrame([(1, 10, 1), (1, 40, 2), (1, 60, 3)], "t int, at int, index int")
    assert {r.at: r["index"] for r in L.asof_headers("t", marks, headers).collect()} == {50: "2", 3000: None}


def test_each_id_once(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    for n, ids in enumerate(([1, 2], [2, 3])):
        spark.createDataFrame([(i,) for i in ids], "id int").coalesce(1).write.mode("append").json(src)
        q = incremental.once_per_id(incremental.new_files(spark, src, "id int"), lambda b: b, out, "id", check)
        q.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_metadata_from_folders(spark, tmp_path):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "image_file string")
    masks = spark.createDataFrame([("a", 2, 2, [0, 1, 0, 0]), ("b_mask", 2, 2, [0, 0, 0, 0]), ("c", 1, 1, [0]), ("c_mask", 1, 1, [1]), ("d_mask", 1, 3, [0, 0, 7])], "stem string, h int, w int, data array<int>")
    for kind in ("masks", "images", "reports"):
        (tmp_path / kind).mkdir()
    for r in files.png_bytes(masks).collect():
        (tmp_path / "masks" / f"{r.stem}.png").write_bytes(r.content)
    read = {r.stem: (r.h, r.w, r.data) for r in files.load_masks(spark, str(tmp_path / "masks")).where("h > 1 OR w > 1").collect()}
    assert read == {"a": (2, 2, [0, 1, 0, 0]), "b": (2, 2, [0, 0, 0, 0]), "d": (1, 3, [0, 0, 1])}
    for n in ("a.png", "a.jpg", "b.PNG", "e.webp"):
        (tmp_path / "images" / n).write_text("x")
    for n, v in (("d", "AUTHENTIC"), ("e", "FORGED")):
        (tmp_path / "reports" / f"{n}_report.md").write_text(f"# FORGERY ANALYSIS REPORT\n\n**[Conclusion]:** {v}\n")
    out = files.metadata_from_folders(spark, names("a.tif", "b.jpg", "c.jpg", "d.jpg", "e.jpg", "f.jpg"), *[str(tmp_path / k) for k in ("reports", "masks", "images")])
    got = {r.sample_id: (r.type, r.image_path and r.image_path.rsplit("/", 1)[1], r.mask_path and r.mask_path.rsplit("/", 1)[1]) for r in out.collect()}
    assert got == {"a": ("BLACK", "a.jpg", "a.png"), "b": ("PRISTINE", "b.PNG", "b_mask.png"), "c": ("PRISTINE", None, "c.png"), "d": ("PRISTINE", None, "d_mask.png"), "e": ("BLACK", "e.webp", None), "f": ("PRISTINE", None, None)}


def test_updated_records(spark):
    old = spark.createDataFrame([(1, "x"), (2, None), (3, None), (None, None)], "id int, augmentation string")
    new = spark.createDataFrame([(1, "y"), (2, "z")], "id int, augmentation string")
    assert {(r.id, r.augmentation) for r in L.updated_records(old, new, "id", "augmentation").collect()} == {(1, "x"), (2, "z"), (3, None), (None, None)}


def png(pixels, depth, colour, palette=None, passes=((0, 0, 1, 1),)):
    """A PNG of rows of samples (height x width x channels), its rows' filters in turn all five."""
    step, lines, number = max(1, depth * pixels.shape[2] // 8), b"", 0
    for x, y, right, down in passes:
        part = pixels[y::down, x::right]
        before = None
        for row in part if part.size else ():
            flat = row.ravel()
            line = flat.astype(">u2").tobytes() if depth == 16 else flat.astype(np.uint8).tobytes() if depth == 8 else np.packbits((flat[:, None] >> np.arange(depth - 1, -1, -1)) & 1).tobytes()
            before, now = before or bytes(len(line)), []
            for i, v in enumerate(line):
                a, b, c = line[i - step] if i >= step else 0, before[i], before[i - step] if i >= step else 0
                near = min((a, b, c), key=lambda k: abs(a + b - c - k))  # noqa: B023
                now.append((v - (0, a, b, (a + b) // 2, near)[number % 5]) % 256)
            lines, before, number = lines + bytes([number % 5, *now]), line, number + 1
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], depth, colour, 0, 0, len(passes) > 1)
    return files.PNG + chunk(b"IHDR", head) + (chunk(b"PLTE", bytes(palette)) if palette else b"") + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_masks_of_any_kind(spark, tmp_path):
    """PNG masks are listed by tasks, not on the driver, and equal what Spark's image reader makes of them."""
    rng, folder = np.random.default_rng(5), tmp_path / "masks"
    folder.mkdir()
    for colour, depth, channels in ((0, 1, 1), (0, 2, 1), (0, 4, 1), (0, 8, 1), (4, 8, 2), (2, 8, 3), (6, 8, 4), (2, 16, 3), (3, 2, 1), (3, 8, 1)):
        for passes in (((0, 0, 1, 1),), files._PASSES):
            for h, w in ((1, 1), (13, 11), (5, 2)):
                v = rng.integers(0, 2**depth, (h, w, channels)) * (rng.random((h, w, channels)) < 0.5)
                palette = [0, 0, 0, 1, 0, 0, 2, 2, 2, 9, 200, 3] * 64 if colour == 3 and depth == 8 else [0, 0, 0, 1, 0, 0, 2, 2, 2, 9, 200, 3] if colour == 3 else None
                v = np.where(v == 1, 600, v) if depth == 16 else v  # 16 bits count by their upper eight
                (folder / f"{colour}-{depth}-{len(passes)}-{h}-{w}_mask.png").write_bytes(png(v, depth, colour, palette, passes))
    (folder / "broken.png").write_bytes(files.PNG + b"rest")
    (folder / "text.png").write_text("no picture")
    rows = lambda: {r.path: (r.stem, r.h, r.w, r.data) for r in files.load_masks(spark, str(folder), keep_path=True).collect()}
    assert files.load_masks(spark, str(folder)).inputFiles() == []
    own = rows()
    (folder / "text").write_text("not named .png")  # the folder goes to Spark's image reader
    assert len(own) == 60 and own == rows()
    (folder / "text").unlink()
    (folder / "photo.png").write_bytes(b"\xff\xd8\xff")
    with pytest.raises(Exception, match="of another kind"):
        rows()
