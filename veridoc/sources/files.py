"""Metadata, predictions, records, maps, images and templates as DataFrames; results as files."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import report as R
from . import documents as D

#: Columns that document metadata has.
EXPECTED = ("sample_id", "language", "language_code", "type", "image_file", "mask_file", "has_mask", "report_file", "report_text")
#: Schemas of the JSON records.
OCR_ITEMS = "array<struct<id:int,text:string,bbox:array<int>,confidence:double>>"
DETECTION = f"image_name string, stem string, image_size array<int>, dtd_threshold double, dtd_regions array<array<int>>, dtd_region_overlaps array<struct<region_index:int,bbox:array<int>,overlapping_ocr:array<struct<id:int,text:string,bbox:array<int>,overlap_frac:double>>>>, ocr_n_items int, ocr_lang string, ocr_input struct<lang:string,n_items:int,ocr_items:{OCR_ITEMS},reading_order_text:string>"
REGIONS = "stem string, image_name string, threshold double, n_regions int, dtd_regions array<array<int>>"
VALIDATION = "struct<has_think:boolean,has_report:boolean,stages_found:array<int>,report_match:boolean,forbidden_phrase:string,ok:boolean>"
TRACE = f"image_name string, stem string, mode string, raw_teacher_output string, extracted_think string, extracted_report string, augmented_gt_report string, original_gt_report string, dtd_regions array<array<int>>, mask_bboxes array<array<int>>, dtd_tp_flags array<boolean>, is_pristine boolean, ocr_n_items int, ocr_lang string, teacher_elapsed_sec double, total_elapsed_sec double, validation {VALIDATION}"


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = _hadoop_path(spark, path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_metadata(spark: SparkSession, root: str, prefer: str = "parquet", null_mask: bool = True) -> DataFrame:
    """metadata.parquet or .csv under root, the preferred kind first.  null_mask: what a missing has_mask becomes."""
    kinds = ("parquet", "csv") if prefer == "parquet" else ("csv", "parquet")
    found = next((k for k in kinds if exists(spark, f"{root}/metadata.{k}")), None)
    if found is None:
        raise FileNotFoundError(f"no metadata under {root}")
    df = spark.read.parquet(f"{root}/metadata.parquet") if found == "parquet" else spark.read.csv(f"{root}/metadata.csv", header=True, multiLine=True, escape='"')
    return df.withColumn("has_mask", F.coalesce(F.col("has_mask").cast("boolean"), F.lit(null_mask))) if "has_mask" in df.columns else df


def missing_columns(df: DataFrame, expected: Sequence[str] = EXPECTED) -> list[str]:
    return sorted(set(expected) - set(df.columns))


def _address(root: str) -> Column:
    """The file's address, as Spark's readers give it."""
    base = D.opened(root)[1].rstrip("/")
    return F.concat(F.lit(f"file:{base}/" if root.startswith(("/", "file:")) else f"{root.rstrip('/')}/"), F.col("name"))


def _seen(found: DataFrame) -> DataFrame:
    """Without hidden files and folders, which Spark's readers leave out too."""
    return found.where(~F.col("name").rlike(r"(?:^|/)[_.]"))


def _parsed(found: DataFrame, schema: str) -> DataFrame:
    """found (content: one JSON record, or an array of them) with the schema's columns; broken records are null, objects in string columns lose blanks."""
    text = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
    said = {"columnNameOfCorruptRecord": "_corrupt_record"}
    one, many = F.from_json(text, schema, said), F.from_json(text, ArrayType(StructType.fromDDL(schema)), said)
    records = F.when(text.rlike(r"^\s*\["), F.coalesce(many, F.array(F.lit(None).cast(StructType.fromDDL(schema))))).otherwise(F.array(one))
    return _seen(found).where(F.length("content") > 0).withColumn("_record", F.explode(records)).select(*found.columns, "_record.*")


def listing(spark: SparkSession, root: str, *extensions: str) -> DataFrame:
    """path, name, stem, part of files below root that aren't empty; contents aren't read."""
    df = _seen(D.load_documents(spark, root, folders="any", contents="false")).select(_address(root).alias("path"))
    if extensions:
        df = df.where(F.lower("path").rlike(r"\.(?:" + "|".join(extensions) + r")$"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return df.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), part_of(F.col("path")).alias("part"))


def part_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(part\d{3,})", 1), F.lit(""))


def infer_parts(meta: DataFrame, paths: Sequence[str], id_column: str = "sample_id", per_part: int = 1000) -> DataFrame:
    """part: numbers named in any path column, or if there are none, trailing digits of the id divided by per_part."""
    named = meta.select(F.explode(F.array(*[F.regexp_extract(c, r"part(\d{3})", 1) for c in paths])).alias("p")).where("p <> ''").select(F.col("p").cast("int").alias("part")).distinct()
    counted = meta.select(F.regexp_extract(F.col(id_column).cast("string"), r"(\d+)$", 1).alias("d")).where("d <> ''").select(F.floor(F.col("d").cast("bigint") / per_part).cast("int").alias("part")).distinct()
    return named.unionByName(counted.where(named.agg(F.count(F.lit(1)) == 0).scalar()))


def resolve_paths(meta: DataFrame, files: DataFrame) -> DataFrame:
    """image_path, mask_path, report_path by file name; absent ones are null, of equal names the greatest path counts."""
    index = files.groupBy("name").agg(F.max("path").alias("path"))
    for kind in ("image", "mask", "report"):
        meta = meta.join(index.select(F.col("name").alias(f"{kind}_file"), F.col("path").alias(f"{kind}_path")), f"{kind}_file", "left")
    return meta


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """image_name, report from JSON lines, plain or gzip; blank lines are skipped, missing columns are an error."""
    df = spark.read.json(path)
    if lacking := {"image_name", "report"} - set(df.columns):
        raise ValueError(f"missing columns: {sorted(lacking)}")
    return df.where(F.col("image_name").isNotNull() | F.col("report").isNotNull())


def load_prediction_folders(spark: SparkSession, root: str) -> DataFrame:
    """image_name, report of */report.json; broken files are skipped, the folder's name stands in for a missing name."""
    found = D.load_documents(spark, root, "*/report.json", folders="any").where(F.col("name").rlike(r"^[^/]+/report\.json$"))
    df = _parsed(found.select("name", "stem", "content"), "image_name string, report string, _corrupt_record string")
    return df.where("_corrupt_record IS NULL").select(F.coalesce("image_name", "stem").alias("image_name"), F.coalesce("report", F.raise_error("a prediction lacks its report").cast("string")).alias("report"))


def load_records(spark: SparkSession, root: str, schema: str = DETECTION, suffix: str = "_dtd_ocr.json", parts: Sequence[str] | None = None) -> DataFrame:
    """JSON records below root, with their path and part; only the named parts are listed."""
    made = []
    for folder in [f"{root}/{p}" for p in parts] if parts else [root]:
        found = D.load_documents(spark, folder, f"*{suffix}", folders="any").select(_address(folder).alias("path"), "name", "content")
        made.append(_parsed(found, schema).drop("name", "content"))
    df = reduce(DataFrame.unionByName, made)
    return df.select(*StructType.fromDDL(schema).names, "path", part_of(F.col("path")).alias("part"))


def decoded_maps(files: DataFrame) -> DataFrame:
    """stem, h, w, data of .npy files (stem, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            arrays = [np.squeeze(np.load(io.BytesIO(c), allow_pickle=False)).astype(np.float32) for c in f["content"]]
            yield pd.DataFrame({"stem": f["stem"], "h": [a.shape[0] for a in arrays], "w": [a.shape[1] for a in arrays], "data": [a.ravel().tolist() for a in arrays]})

    return files.select("stem", "content").mapInPandas(run, "stem string, h int, w int, data array<float>")


def load_maps(spark: SparkSession, root: str) -> DataFrame:
    """stem, h, w, data of .npy maps."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(root)
    return decoded_maps(raw.select(F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.npy$", 1), "_prob$|_heatmap$", "").alias("stem"), "content"))


def npy_bytes(maps: DataFrame) -> DataFrame:
    """stem, content: maps as .npy files' bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for h, w, d in zip(f["h"], f["w"], f["data"], strict=True):
                np.save(b := io.BytesIO(), np.asarray(d, np.float32).reshape(h, w))
                out.append(b.getvalue())
            yield pd.DataFrame({"stem": f["stem"], "content": out})

    return maps.mapInPandas(run, "stem string, content binary")


def png_bytes(masks: DataFrame) -> DataFrame:
    """stem, content: masks (stem, h, w, data; anything but 0 is white) as grey PNG files."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for h, w, d in zip(f["h"], f["w"], f["data"], strict=True):
                grey = np.where(np.asarray(d).reshape(h, w) != 0, 255, 0).astype(np.uint8)
                rows = np.pad(grey, ((0, 0), (1, 0))).tobytes()
                out.append(PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
            yield pd.DataFrame({"stem": f["stem"], "content": out})

    return masks.select("stem", "h", "w", "data").mapInPandas(run, "stem string, content binary")


def metadata_from_folders(spark: SparkSession, names: DataFrame, reports: str, masks: str, images: str) -> DataFrame:
    """sample_id, image_file, image_path, mask_path, report_text, type for image names (image_file), found by their stems.

    A report's conclusion gives the type; without one a mask with any white pixel does, otherwise it is PRISTINE.  A mask is named
    as the stem, or else with _mask behind it; of several kinds of files the first of the fixed order counts.
    """
    kinds = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")

    def first(folder: str, allowed: tuple[str, ...], suffix: str | None = None) -> DataFrame:
        found = listing(spark, folder, *allowed)
        kind = F.array_position(F.array(*[F.lit(k) for k in allowed]), F.lower(F.regexp_extract("name", r"([^.]+)$", 1)))
        plain = F.struct(F.col("stem"), F.lit(0).alias("late"))
        both = F.array(plain, F.struct(F.regexp_replace("stem", f"{suffix}$", "").alias("stem"), F.lit(1).alias("late"))) if suffix else F.array(plain)
        keys = found.select("path", kind.alias("kind"), F.explode(both).alias("k"))
        return keys.groupBy(F.col("k.stem").alias("sample_id")).agg(F.min_by("path", F.struct("k.late", "kind", "path")).alias("path"))

    text = _seen(D.load_documents(spark, reports, "*_report.md", folders="any")).where("stem <> '' AND length(content) > 0")
    said = text.select(F.col("stem").alias("sample_id"), F.col("content").cast("string").alias("report_text")).groupBy("sample_id").agg(F.min("report_text").alias("report_text"))
    white = load_masks(spark, masks, keep_path=True).select(F.col("path").alias("mask_path"), F.exists("data", lambda v: v > 0).alias("white"))
    rows = names.select(F.regexp_replace("image_file", r"\.[^.]+$", "").alias("sample_id"), "image_file")
    rows = rows.join(first(images, kinds).withColumnRenamed("path", "image_path"), "sample_id", "left").join(first(masks, ("png", "jpg", "jpeg"), "_mask").withColumnRenamed("path", "mask_path"), "sample_id", "left")
    rows = rows.join(said, "sample_id", "left").join(white, "mask_path", "left").withColumn("report_text", F.coalesce("report_text", F.lit("")))
    conclusion = F.upper(R.parse_report(F.col("report_text"))["conclusion"])
    forged = F.when((F.col("report_text") != "") & (F.coalesce(conclusion, F.lit("")) != ""), conclusion == "FORGED").otherwise(F.coalesce("white", F.lit(False)))
    return rows.select("sample_id", "image_file", "image_path", "mask_path", "report_text", F.when(forged, "BLACK").otherwise("PRISTINE").alias("type"))


PNG = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by colour type, and the passes of interlaced files: first column and row, steps.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """A PNG's rows of bytes; step: bytes a pixel.  Averages and Paeth's rule take a Python step a byte."""
    out = np.zeros((len(lines), lines.shape[1] - 1), np.uint8)
    before = np.zeros(lines.shape[1] - 1, np.uint8)
    for y, (kind, line) in enumerate(zip(lines[:, 0].tolist(), lines[:, 1:], strict=True)):
        if kind == 1:
            line = line.reshape(-1, step).cumsum(0, dtype=np.uint8).ravel()
        elif kind == 2:
            line = line + before
        elif kind in (3, 4):
            now, up = bytearray(step) + line.tobytes(), bytes(step) + before.tobytes()
            for i in range(step, len(now)):
                a, b, c = now[i - step], up[i], up[i - step]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - c - c)
                    guess = a if to_a <= to_b and to_a <= to_c else b if to_b <= to_c else c
                now[i] = (now[i] + guess) & 255
            line = np.frombuffer(bytes(now[step:]), np.uint8)
        elif kind:
            raise ValueError(f"no such filter: {kind}")
        out[y] = before = line
    return out


def decoded_png(content: bytes) -> np.ndarray | None:
    """height x width x channels of a PNG of any kind, 8 bits each: grey (1) or red, green, blue (3), without alpha; None if it can't be read."""
    try:
        at, head, colours, packed = len(PNG), None, None, []
        while content.startswith(PNG) and at + 8 <= len(content):
            n, kind = struct.unpack(">I4s", content[at : at + 8])
            body = content[at + 8 : at + 8 + n]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                colours = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                packed.append(body)
            at += n + 12
        w, h, depth, colour, _, _, interlaced = head
        raw, used, channels = zlib.decompress(b"".join(packed)), 0, _SAMPLES[colour]
        out = np.zeros((h, w, channels), np.uint8)
        for x, y, right, down in _PASSES if interlaced else ((0, 0, 1, 1),):
            part = out[y::down, x::right]
            if not part.size:
                continue
            (rows, columns), bits = part.shape[:2], depth * channels
            wide = (columns * bits + 7) // 8
            plain = _unfiltered(np.frombuffer(raw, np.uint8, rows * (wide + 1), used).reshape(rows, wide + 1), max(1, bits // 8))
            used += rows * (wide + 1)
            if depth < 8:
                plain = (np.unpackbits(plain, axis=1)[:, : columns * depth].reshape(rows, columns, depth) << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)
                plain = plain if colour == 3 else plain * (255 // (2**depth - 1))
            part[:] = plain.reshape(rows, columns, channels, -1)[..., 0]  # of 16 bits the upper ones
        return colours[out[..., 0]] if colour == 3 else out[..., : 1 if channels < 3 else 3]
    except (zlib.error, struct.error, ValueError, IndexError, KeyError, TypeError):
        return None


def _luma(blue: np.ndarray, green: np.ndarray, red: np.ndarray) -> np.ndarray:
    return (blue * 0.114 + green * 0.587 + red * 0.299).astype(np.uint8)


def load_masks(spark: SparkSession, root: str, keep_path: bool = False, pixels: int = 2_000_000) -> DataFrame:
    """stem, h, w, data (0 or 1) of images, their path if asked for; colours count by their luma.

    A folder of PNG files is read by tasks that list their own shares, about `pixels` at a time.  Other kinds need Spark's image
    reader, which lists the folder on the driver: it reads any folder with a file of another name.
    """
    kind = "stem string, path string, h int, w int, data array<int>"
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"(?:_mask)?\.[^.]+$", "").alias("stem")
    names = _seen(D.load_documents(spark, root, folders="any", contents="false"))
    seen = names.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.lower("name").endswith(".png")).alias("others")).first()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for h, w, n, data in zip(f["height"], f["width"], f["nChannels"], f["data"], strict=True):
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)
                grey = a[..., 0] if n == 1 else _luma(a[..., 0], a[..., 1], a[..., 2])
                out.append((grey > 0).astype(int).ravel().tolist())
            yield pd.DataFrame({"stem": f["stem"], "path": f["origin"], "h": f["height"], "w": f["width"], "data": out})

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out, held = [], 0
            for stem, path, content in zip(f["stem"], f["path"], f["content"], strict=True):
                if (a := decoded_png(content)) is None:
                    if content.startswith((b"\xff\xd8", b"GIF8", b"BM")):
                        raise ValueError(f"named .png, but of another kind: {path}")
                    continue
                grey = a[..., 0] if a.shape[2] == 1 else _luma(a[..., 2], a[..., 1], a[..., 0])
                out.append((stem, path, *a.shape[:2], (grey > 0).astype(int).ravel().tolist()))
                held += grey.size
                if held > pixels:
                    yield pd.DataFrame(out, columns=["stem", "path", "h", "w", "data"])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=["stem", "path", "h", "w", "data"])

    if seen["n"] and not seen["others"]:
        found = _seen(D.load_documents(spark, root, folders="any")).select(_address(root).alias("path"), "content")
        masks = found.select(stem, "path", "content").mapInPandas(decode, kind)
    else:
        df = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root).select("image.*")
        df = df.withColumn("path", F.regexp_replace("origin", "^file:/+", "file:/"))
        masks = df.select(stem, F.col("path").alias("origin"), "height", "width", "nChannels", "data").mapInPandas(run, kind)
    return masks.select("stem", *(["path"] if keep_path else []), "h", "w", "data")


def load_template(spark: SparkSession, path: str) -> DataFrame:
    """name, text of prompt templates, whole."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("name"), F.col("value").alias("text"))


def load_excluded(spark: SparkSession, path: str) -> DataFrame:
    """stem of each line; blank lines and # comments don't count, folders and extensions go."""
    line = F.trim(F.regexp_replace("value", r"#.*$", ""))
    return spark.read.text(path).select(F.regexp_replace(F.regexp_extract(line, r"([^/]+)$", 1), r"\.[^.]+$", "").alias("stem")).where("stem <> ''").distinct()


def write_chat(df: DataFrame, path: str, record: str = "record") -> int:
    """One JSON record a line; null fields are written.  Returns how many, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    df.where(F.col(record).isNotNull()).select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value")).observe(seen, F.count(F.lit(1)).alias("n")).write.text(path)
    return seen.get["n"]


def write_split(df: DataFrame, path: str) -> None:
    """train and val rows as partitions, in one pass."""
    df.write.partitionBy("split").parquet(path)


def write_by(df: DataFrame, path: str, *by: str, kind: str = "json", mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*by).format(kind).save(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A one-row result as one JSON file."""
    df.coalesce(1).write.json(path)
