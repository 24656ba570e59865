"""Image files as pixel frames: listing, decoding, pairing, failures."""

from __future__ import annotations

import io
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspark.functions.scalar import file_stem

from .tiff import decode, layout, read_tiffs


def list_files(spark: SparkSession, folder: str, suffix: str = ".tif", recursive: bool = False) -> DataFrame:
    """``path, stem`` of the files with the suffix, in order; an absent folder raises FileNotFoundError."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(folder)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select("path", file_stem(F.col("path")).alias("stem")).orderBy("path")


def read_tiff(data: bytes) -> np.ndarray:
    """The first image of a TIFF file in memory: height x width x channels."""
    file = io.BytesIO(data)
    shape = layout(file)
    out = np.zeros((shape.height, shape.width, shape.channels), shape.dtype.newbyteorder("="))
    for i in range(len(shape.offsets)):
        plane, top, left = shape.place(i)
        part = decode(file, shape, i)
        out[top : top + part.shape[0], left : left + part.shape[1], slice(None) if plane is None else slice(plane, plane + 1)] = part
    return out


def write_tiff(image: np.ndarray) -> bytes:
    """Uncompressed little-endian TIFF of a height x width (x channels) array of unsigned integers."""
    image = image[..., None] if image.ndim == 2 else image
    h, w, c = image.shape
    raw = np.ascontiguousarray(image, image.dtype.newbyteorder("<")).tobytes()
    bits = image.dtype.itemsize * 8
    tags = [(256, 4, w), (257, 4, h), (258, 3, bits), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, c), (278, 4, h), (279, 4, len(raw)), (284, 3, 1), (339, 3, 1)]
    body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, v in tags) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, 8 + len(raw)) + raw + body


def scan_images(spark: SparkSession, folder: str, suffix: str = ".tif", channels: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Pixels of all readable images, and ``image, error`` of the others. A bad file never stops the scan; a folder without files raises."""
    rows = read_tiffs(spark, folder, suffix, channels)
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("image", "error").distinct()


def pair_by_stem(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files of two listings with one stem (the label file's name first): by name, not by position."""
    return left.select("stem", F.col("path").alias("label_path")).join(right.select("stem", F.col("path").alias("raw_path")), "stem")


def label_for_image(images: DataFrame, labels: DataFrame) -> DataFrame:
    """The label file of an image's own name, else the first that starts with its stem."""
    # Each label is listed under every beginning of its stem, so that the join is one of equal keys.
    begins = F.transform(F.sequence(F.lit(0), F.length("stem")), lambda k: F.substring("stem", F.lit(1), k))
    begun = labels.select(F.col("stem").alias("label_stem"), F.col("path").alias("label_path"), F.explode(begins).alias("begin"))
    rows = images.select(F.col("stem").alias("image"), "path").join(begun, F.col("begin") == F.col("image"))
    best = rows.groupBy("image", "path").agg(F.min(F.struct((F.col("label_stem") != F.col("image")).alias("longer"), "label_path")).alias("b"))
    return best.select("image", "path", "b.label_path")
