"""Image files and settings: listings, sizes from headers, planned moves, YAML."""

from __future__ import annotations

import dataclasses
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "gif", "tif", "tiff", "webp")


def list_images(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS, recursive: bool = False) -> DataFrame:
    """path, length and content of image files by extension, whatever its case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    return files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions)).select("path", "length", "content")


def by_base_name(files: DataFrame) -> DataFrame:
    """name and path; of several files with one name the last path."""
    return files.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.max("path").alias("path"))


def _tiff_size(data: bytes) -> tuple[int, int] | None:
    """Width and height (tags 256 and 257) of the first directory of a TIFF or BigTIFF file."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    big = struct.unpack(order + "H", data[2:4])[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
    at += 8 if big else 2
    found = {}
    for k in range(n):
        tag, kind = struct.unpack_from(order + "HH", data, at + k * (20 if big else 12))
        if tag in (256, 257):
            value = {1: "B", 3: "H", 4: "I", 16: "Q"}[kind]
            found[tag] = struct.unpack_from(order + value, data, at + k * (20 if big else 12) + (12 if big else 8))[0]
    return (found[256], found[257]) if len(found) == 2 else None


def _webp_size(data: bytes) -> tuple[int, int] | None:
    kind, body = data[12:16], data[20:]
    if kind == b"VP8X":
        return 1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little")
    if kind == b"VP8L" and body[:1] == b"\x2f":
        bits = int.from_bytes(body[1:5], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
        return struct.unpack("<H", body[6:8])[0] & 0x3FFF, struct.unpack("<H", body[8:10])[0] & 0x3FFF
    return None


def header_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF, BMP, JPEG, TIFF or WebP file; None where it can't be read."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:4] == b"GIF8":
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            width, height = struct.unpack("<ii", data[18:26])
            return width, abs(height)
        if data[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
            return _tiff_size(data)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp_size(data)
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(data) and data[at] == 0xFF:
                kind = data[at + 1]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                    return width, height
                at += 1 if kind == 0xFF else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    except (struct.error, KeyError):
        pass
    return None


def image_sizes(files: DataFrame) -> DataFrame:
    """path, width and height; files whose header can't be read are left out.

    Headers may lie anywhere (a TIFF's directory is often its end, a JPEG's frame follows all embedded profiles), so that the
    whole content is looked at.
    """

    def run(batches):
        for batch in batches:
            sizes = [header_size(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([s and s[k] for s in sizes], pa.int64()) for k in (0, 1))], ["path", "width", "height"])

    found = files.select("path", "content").mapInArrow(run, "path string, width long, height long").where("width is not null")
    return found.select("path", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))


def planned_moves(sizes: DataFrame, target: str) -> DataFrame:
    """source and destination of each image in a folder for its resolution; of equal destinations only the first source moves."""
    name = F.element_at(F.split("path", "/"), -1)
    plan = sizes.select(F.col("path").alias("source"), F.concat(F.lit(f"{target}/"), "width", F.lit("x"), "height", F.lit("/"), name).alias("destination"))
    first = plan.groupBy("destination").agg(F.min("source").alias("_first"))
    return plan.join(first, "destination").select("source", "destination", (F.col("source") == F.col("_first")).alias("moves"))


def without_prefix(name, prefix: str = "undistorted_"):
    return F.regexp_replace(name, f"^{prefix}", "")


def load_settings(cls, path: str | None = None):
    """A frozen settings dataclass from a YAML mapping: unknown keys are ignored, a missing or empty file gives the defaults."""
    import os

    import yaml

    found = {}
    if path and os.path.exists(path):
        with open(path) as f:
            found = yaml.safe_load(f) or {}
    known = {f.name: f for f in dataclasses.fields(cls)}
    return cls(**{k: v for k, v in found.items() if k in known})


def pixel_table(spark: SparkSession, folder: str) -> DataFrame:
    """(path, row, col, b, g, r) of the images that can be decoded; gray images have equal channels."""
    import numpy as np

    source = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        for batch in batches:
            for origin, height, width, channels, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = np.frombuffer(data, np.uint8).reshape(height * width, channels)
                p = p[:, :3] if channels >= 3 else np.repeat(p[:, :1], 3, axis=1)
                rows, cols = np.divmod(np.arange(height * width), width)
                for k in range(0, len(p), 1 << 18):
                    part = slice(k, k + (1 << 18))
                    columns = [pa.array([origin] * len(p[part])), *(pa.array(x[part].astype(np.int32)) for x in (rows, cols, p[:, 0], p[:, 1], p[:, 2]))]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "row", "col", "b", "g", "r"])

    return source.mapInArrow(run, "path string, row int, col int, b int, g int, r int")


def write_csv(df: DataFrame, folder: str) -> None:
    """A folder of CSV parts with headers; arrays are joined by spaces."""
    joined = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*joined).write.mode("overwrite").option("header", True).csv(folder)
