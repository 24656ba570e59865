"""TIFF as a Spark data source: ``spark.read.format("tiff").load(folder)``, a row for each pixel and channel.

A file is read by shares of its strips or tiles, so that one large image is the work of many tasks, each of which reads the file's
directory and its own segments only. Classic and BigTIFF, either byte order, strips and tiles, chunky and planar, 8 to 64 bits of
integers or floats, uncompressed, LZW, deflate and PackBits, horizontal differences. The first directory is read.

Channels named by the option ``channels`` (``"0,2"``), or by a filter ``c = ..`` or ``c IN (..)`` that Spark pushes down (option
``pushdown``, where ``spark.sql.python.filterPushdown.enabled`` is on), are the only ones that are read where planes are apart, and the only ones that become rows.

A file that can't be read gives one row with ``image`` and ``error`` and nulls; it never stops the scan. A folder without files raises FileNotFoundError.
"""

from __future__ import annotations

import fnmatch
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "image string, c int, y int, x int, v double, error string"
#: Bytes of a file for each task.
SPLIT = 64 << 20
#: Rows of an Arrow batch.
ROWS = 1 << 18

# Fixed values of the file format: tags, compressions, and the sizes of field types.
WIDTH, HEIGHT, BITS, PACKING, STRIPS, CHANNELS, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, KIND = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
_FIELDS = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}


def unlzw(data: bytes) -> bytes:
    """Variable codes of 9 to 12 bits, most significant first; 256 clears the table, 257 ends."""
    out, table = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""]
    bits = have = 0
    width, last = 9, b""
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code, bits = bits >> have, bits & (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("broken LZW stream")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        # The width grows one entry early.
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


_UNPACK = {PLAIN: bytes, LZW: unlzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpackbits}


@dataclass
class Layout:
    """What the first directory of a file says."""

    width: int
    height: int
    channels: int
    dtype: np.dtype
    packing: int
    planar: bool
    differences: bool
    segment: tuple[int, int]  # rows and columns
    offsets: list[int]
    sizes: list[int]

    @property
    def across(self) -> int:
        return -(-self.width // self.segment[1])

    def place(self, i: int) -> tuple[int | None, int, int]:
        """Channel (None: all of them), first row and first column of a segment."""
        each = self.across * -(-self.height // self.segment[0])
        plane, at = divmod(i, each)
        return (plane if self.planar else None), at // self.across * self.segment[0], at % self.across * self.segment[1]


def layout(file) -> Layout:
    """Reads the header and first directory of a seekable file."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        data = file.read(n)
        if len(data) < n:
            raise ValueError("file ends early")
        return data

    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack(order + "Q", read(8, 8))[0] if big else struct.unpack(order + "I", head[4:8])[0]
    count, entry, inline = ("Q", 20, 8) if big else ("H", 12, 4)
    wide = struct.calcsize(order + count)
    n_tags = struct.unpack(order + count, read(at, wide))[0]
    table = read(at + wide, n_tags * entry)
    tags: dict[int, tuple] = {}
    for i in range(n_tags):
        tag, kind, n = struct.unpack_from(order + ("HHQ" if big else "HHI"), table, i * entry)
        if kind in _FIELDS:
            code, size = _FIELDS[kind]
            value = table[(i + 1) * entry - inline : (i + 1) * entry]
            data = value if n * size <= inline else read(struct.unpack(order + ("Q" if big else "I"), value)[0], n * size)
            tags[tag] = struct.unpack_from(f"{order}{n}{code}", data)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    if WIDTH not in tags or HEIGHT not in tags:
        raise ValueError("no image in the file")
    width, height, channels, packing = one(WIDTH), one(HEIGHT), one(CHANNELS, 1), one(PACKING, PLAIN)
    bits, kind, predictor = tags.get(BITS, (1,)), one(KIND, 1), one(PREDICTOR, 1)
    if len(set(bits)) > 1 or bits[0] not in (8, 16, 32, 64) or kind not in (1, 2, 3) or (kind == 3 and bits[0] == 8) or packing not in _UNPACK or predictor not in (1, 2) or (predictor == 2 and kind == 3):
        raise ValueError(f"unsupported TIFF: {bits[0]} bits, kind {kind}, compression {packing}, predictor {predictor}")
    dtype = np.dtype(f"{order}{'uif'[kind - 1]}{bits[0] // 8}")
    tiled = TILES in tags
    segment = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(STRIP_ROWS, height), height) or 1, width)
    offsets, sizes = (tags.get(t) for t in ((TILES, TILE_BYTES) if tiled else (STRIPS, STRIP_BYTES)))
    if not offsets or not sizes or len(offsets) != len(sizes):
        raise ValueError("no pixels in the file")
    return Layout(width, height, channels, dtype, packing, one(PLANAR, 1) == 2 and channels > 1, predictor == 2, segment, list(offsets), list(sizes))


def decode(file, shape: Layout, i: int) -> np.ndarray:
    """One segment as rows x columns x channels (one channel where planes are apart), cut to the image."""
    file.seek(shape.offsets[i])
    raw = _UNPACK[shape.packing](file.read(shape.sizes[i]))
    _, top, left = shape.place(i)
    rows, columns = shape.segment
    channels = 1 if shape.planar else shape.channels
    if len(raw) < rows * columns * channels * shape.dtype.itemsize:  # the last strip holds the rows that are left
        rows = min(rows, shape.height - top)
    pixels = np.frombuffer(raw, shape.dtype, rows * columns * channels).reshape(rows, columns, channels)
    if shape.differences:
        pixels = np.cumsum(pixels, axis=1, dtype=shape.dtype.newbyteorder("="))
    return pixels[: shape.height - top, : shape.width - left]


@dataclass
class Share(InputPartition):
    path: str
    part: int
    parts: int

    def __init__(self, path: str, part: int, parts: int):
        super().__init__((path, part, parts))
        self.path, self.part, self.parts = path, part, parts


def _open(path: str):
    fs, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    return fs, at


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.suffix = options.get("path"), options.get("suffix", ".tif")
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))
        named = options.get("channels")
        self.wanted: set[int] | None = {int(c) for c in named.split(",")} if named else None

    def partitions(self) -> list[Share]:
        fs, at = _open(self.folder)
        infos = fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=self.recursive))
        files = sorted((f for f in infos if f.is_file and fnmatch.fnmatch(f.base_name, f"*{self.suffix}") and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
        if not files:
            raise FileNotFoundError(f"no *{self.suffix} files in {self.folder}")
        head = self.folder.split("://")[0] + "://" if "://" in self.folder else ""
        return [Share(head + f.path, k, n) for f in files for n in [max(1, -(-f.size // self.split))] for k in range(n)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        names = ["image", "c", "y", "x", "v", "error"]
        image = _stem(share.path)
        try:
            fs, at = _open(share.path)
            with fs.open_input_file(at) as file:
                shape = layout(file)
                n = len(shape.offsets)
                for i in range(share.part * n // share.parts, (share.part + 1) * n // share.parts):
                    plane, top, left = shape.place(i)
                    if self.wanted is not None and plane is not None and plane not in self.wanted:
                        continue
                    pixels = decode(file, shape, i)
                    channels = [plane] if plane is not None else [c for c in range(shape.channels) if self.wanted is None or c in self.wanted]
                    step = max(1, ROWS // max(1, pixels.shape[1]))
                    for c in channels:
                        own = pixels[..., 0 if plane is not None else c]
                        for row in range(0, own.shape[0], step):
                            part = own[row : row + step]
                            y, x = np.indices(part.shape, np.int32)
                            k = part.size
                            yield pa.RecordBatch.from_arrays([pa.array([image] * k), pa.array(np.full(k, c, np.int32)), pa.array(y.ravel() + np.int32(top + row)), pa.array(x.ravel() + np.int32(left)), pa.array(part.ravel().astype(np.float64)), pa.nulls(k, pa.string())], names)
        except Exception as e:  # noqa: BLE001  the error becomes a row
            if share.part == 0 or "shape" in locals():
                nothing = [pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array([image]), *nothing, pa.array([f"{type(e).__name__}: {e}"])], names)


class PushingTiffReader(TiffReader):
    """Spark refuses a reader with this method where the pushdown of filters is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on the channel; the others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("c",):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = found if self.wanted is None else self.wanted & found
            yield f  # Spark checks again, as unreadable files have no channel


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TiffReader:
        return (PushingTiffReader if self.options.get("pushdown", "false").lower() == "true" else TiffReader)(self.options)


def read_tiffs(spark: SparkSession, folder: str, suffix: str = ".tif", channels: list[int] | None = None, recursive: bool = False, split_bytes: int = SPLIT) -> DataFrame:
    """``image, c, y, x, v, error`` of a folder's files."""
    spark.dataSource.register(TiffSource)
    reader = spark.read.format("tiff").option("suffix", suffix).option("recursive", str(recursive).lower()).option("splitBytes", str(split_bytes)).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled"))
    if channels is not None:
        reader = reader.option("channels", ",".join(map(str, channels)))
    return reader.load(folder)
