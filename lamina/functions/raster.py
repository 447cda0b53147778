"""Image bytes: PNG writing, cropping and turning of decoded pixels, page counts.

Decoding is Spark's ``image`` source (png, jpeg, bmp, tiff, gif); PDF and WebP need
a plug-in that isn't part of this engine, and their rows get an error code.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .geometry import image_ok


def png_bytes(pixels: np.ndarray) -> bytes:
    """A PNG of rows x columns x RGB bytes."""
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * 3)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 9)) + chunk(b"IEND", b"")


def rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Pixels of an ``image`` row, which come as blue, green, red."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]


def crop(pixels: np.ndarray, box: tuple[float, float, float, float], rotate: int = 0) -> np.ndarray:
    """Part of a page by relative corners (halves to even), turned clockwise."""
    h, w, _ = pixels.shape
    x0, y0, x1, y1 = round(box[0] * w), round(box[1] * h), round(box[2] * w), round(box[3] * h)
    return np.ascontiguousarray(np.rot90(pixels[y0:y1, x0:x1], k=-(rotate // 90)))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``origin, width, height, channels, data, page_count``; images that can't be decoded, or have too many pixels, have page_count 0 and no data."""
    x = spark.read.format("image").option("dropInvalid", False).load(path)
    ok = (F.col("image.width") > 0) & image_ok(F.col("image.width"), F.col("image.height"))
    return x.select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"), F.when(ok, F.col("image.data")).alias("data"), ok.cast("int").alias("page_count"))


@F.arrow_udf(BinaryType())
def _crop_png(data: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array, xmin: pa.Array, ymin: pa.Array, xmax: pa.Array, ymax: pa.Array, rotate: pa.Array) -> pa.Array:
    out = []
    for d, h, w, c, a, b, e, f, r in zip(*(x.to_pylist() for x in (data, height, width, channels, xmin, ymin, xmax, ymax, rotate)), strict=True):
        part = crop(rgb(d, h, w, c), (a, b, e, f), r) if d and w > 0 else np.zeros((0, 0, 3), np.uint8)
        out.append(png_bytes(part) if part.size else None)
    return pa.array(out, type=pa.binary())


def crop_png(image: dict[str, Column], box: dict[str, Column], rotate: Column) -> Column:
    """The PNG of a region; null if it holds no pixel or the image couldn't be decoded."""
    return _crop_png(image["data"], image["height"], image["width"], image["channels"], box["xmin"], box["ymin"], box["xmax"], box["ymax"], rotate)
