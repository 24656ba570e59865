"""Token ids as one wavelet-matrix file per shard.

Documents are tokenised, dealt to shards by ranges of ``doc_id`` and written, in ascending
``doc_id`` order, as succinct bit planes with rank samples; token access, counting and
occurrence lookup work on the one compressed file.

File layout (little endian): magic, version, numbers of ids, planes and documents, lengths of the
directory and the table; the directory (doc ids, first ids); the table (ones before each block of
each plane: the rank samples; ends of the blocks); the planes' packed bits in blocks of
``BLOCK_BITS``. Each part is a zstd frame of its own, so a lookup inflates only the blocks that it
passes, one for each plane and place.

Defined results: a null or empty text holds only the end id; null ``doc_id`` rows come first
(in the order of their texts, as do repeated ids); an empty table has no files.
Very long texts are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import id_back, id_key, new_folder, read_table, store

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Bytes of text for a shard, about: 1 to 3 million ids.
SHARD_BYTES = 8 << 20
#: Words held per Python worker before the memo is emptied.
MEMO = 400_000
_MAGIC, _HEAD = b"WVMX", struct.Struct("<4sHHQQQQ")
#: Bits of a plane that are compressed together.
BLOCK_BITS = 1 << 18


class WaveletMatrix:
    """Bit planes of a sequence of unsigned ids, most significant first; each plane stably sorts the ids by its bit.

    ``ranks``: ones before each block of each plane, and in the whole plane; ``load(plane, block)``: the packed bits.
    """

    def __init__(self, n: int, ranks: np.ndarray, load: Callable[[int, int], bytes]):
        self.n, self.ranks, self.load = n, ranks, load
        self.bits, self.blocks = ranks.shape[0], ranks.shape[1] - 1
        self.zeros = (n - ranks[:, -1]).tolist()
        self.held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        ids = np.asarray(ids)
        bits = bits or max(1, int(ids.max(initial=0)).bit_length())
        size = BLOCK_BITS // 8
        cuts = range(0, -(-len(ids) // 8), size)
        planes, ranks, now = [], np.zeros((bits, len(cuts) + 1), np.int64), ids
        for plane, level in enumerate(range(bits - 1, -1, -1)):
            bit = (now & ids.dtype.type(1 << level)) != 0
            packed = np.packbits(bit, bitorder="little")
            ranks[plane, 1:] = np.cumsum([int(np.bitwise_count(packed[c : c + size]).sum(dtype=np.int64)) for c in cuts])
            planes.append(packed)
            now = np.concatenate([now[~bit], now[bit]])
        return cls(len(ids), ranks, lambda plane, block: planes[plane][block * size : (block + 1) * size].tobytes())

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of a block, and the ones of the plane before each word."""
        if (plane, block) not in self.held:
            packed = self.load(plane, block) if block < self.blocks else b""
            words = np.frombuffer(packed.ljust(BLOCK_BITS // 8, b"\0"), "<u8")
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.held[plane, block] = words, self.ranks[plane, block] + np.concatenate([[0], ones[:-1]])
        return self.held[plane, block]

    def _look(self, plane: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit at each place and the ones before it."""
        bit, ones = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        block = at // BLOCK_BITS
        for b in np.unique(block).tolist():
            own = block == b
            words, before = self._block(plane, b)
            word, inside = at[own] % BLOCK_BITS >> 6, (at[own] & 63).astype(np.uint64)
            bit[own] = (words[word] >> inside) & np.uint64(1)
            ones[own] = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << inside) - np.uint64(1)))
        return bit, ones

    def _nth(self, plane: int, one: bool, want: np.ndarray) -> np.ndarray:
        """The places of the ones (or zeros) that have so many of their kind before them."""
        edges = np.minimum(np.arange(self.blocks + 1) * BLOCK_BITS, self.n)
        block = np.searchsorted(self.ranks[plane] if one else edges - self.ranks[plane], want, side="right") - 1
        out = np.empty(len(want), np.int64)
        for b in np.unique(block).tolist():
            own, first = block == b, b * BLOCK_BITS
            words, before = self._block(plane, b)
            count = before if one else first + np.arange(len(words)) * 64 - before
            word = np.searchsorted(count, want[own], side="right") - 1
            kind = np.unpackbits(words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") == one
            out[own] = first + word * 64 + np.argmax(np.cumsum(kind, axis=1) == (want[own] - count[word] + 1)[:, None], axis=1)
        return out

    def access(self, at) -> np.ndarray:
        """The ids at the places."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.uint32)
        for plane in range(self.bits):
            bit, ones = self._look(plane, at)
            at = np.where(bit == 1, self.zeros[plane] + ones, at - ones)
            out = (out << np.uint32(1)) | bit.astype(np.uint32)
        return out

    def to_ids(self) -> np.ndarray:
        """All ids, by undoing the stable sorts from the last plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for plane in range(self.bits - 1, -1, -1):
            packed = b"".join([self.load(plane, b) for b in range(self.blocks)])
            bit = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n, bitorder="little").view(bool)
            before, zeros = np.empty(self.n, kind), self.zeros[plane]
            before[~bit] = ids[:zeros]
            before[bit] = ids[zeros:] | kind(1 << (self.bits - 1 - plane))
            ids = before
        return ids

    def _range(self, token: int, before: int) -> tuple[int, int]:
        """Where the id's occurrences before a place stand below the last plane."""
        low, high = 0, before
        if token >> self.bits:
            return 0, 0
        for plane in range(self.bits):
            ones = self._look(plane, np.array([low, high]))[1].tolist()
            if token >> (self.bits - 1 - plane) & 1:
                low, high = self.zeros[plane] + ones[0], self.zeros[plane] + ones[1]
            else:
                low, high = low - ones[0], high - ones[1]
        return low, high

    def rank(self, token: int, before: int) -> int:
        """Occurrences of the id before a place."""
        low, high = self._range(token, before)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def positions(self, token: int, first: int = 0, end: int | None = None) -> np.ndarray:
        """The places of the id's occurrences from the ``first``-th, counted from 0, to the one before ``end``."""
        low, high = self._range(token, self.n)
        at = np.arange(low + first, high if end is None else min(low + end, high))
        for plane in range(self.bits - 1, -1, -1):
            one = bool(token >> (self.bits - 1 - plane) & 1)
            at = self._nth(plane, one, at - self.zeros[plane] if one else at)
        return at

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, counted from 0; -1 if there are fewer."""
        found = self.positions(token, k, k + 1) if k >= 0 else []
        return int(found[0]) if len(found) else -1


def to_file(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, bits: int = 16) -> bytes:
    wm = WaveletMatrix.build(ids, bits)
    pack = zstandard.ZstdCompressor(level=1, write_checksum=True).compress
    blocks = [pack(wm.load(plane, b)) for plane in range(bits) for b in range(wm.blocks)]
    directory = pack(np.concatenate([doc_ids, starts]).astype("<i8").tobytes())
    table = pack(np.concatenate([wm.ranks.ravel(), np.cumsum([0, *map(len, blocks)])]).astype("<i8").tobytes())
    return _HEAD.pack(_MAGIC, 2, bits, len(ids), len(doc_ids), len(directory), len(table)) + b"".join([directory, table, *blocks])


def from_file(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """Document ids, the place of each one's first id in the shard, and the ids, whose blocks are inflated once they are looked at."""
    magic, version, bits, n, n_docs, d, t = _HEAD.unpack_from(data)
    body = _HEAD.size + d + t
    if (magic, version) != (_MAGIC, 2) or len(data) < body:
        raise ValueError("not a whole wavelet-matrix file")
    unpack = zstandard.ZstdDecompressor().decompress
    directory = np.frombuffer(unpack(data[_HEAD.size : _HEAD.size + d]), "<i8")
    table = np.frombuffer(unpack(data[_HEAD.size + d : body]), "<i8")
    blocks = -(-n // BLOCK_BITS)
    ranks, ends = table[: bits * (blocks + 1)].reshape(bits, blocks + 1), (body + table[bits * (blocks + 1) :]).tolist()
    if len(data) != ends[-1]:
        raise ValueError("not a whole wavelet-matrix file")

    def load(plane: int, block: int) -> bytes:
        i = plane * blocks + block
        return unpack(data[ends[i] : ends[i + 1]])

    return directory[:n_docs], directory[n_docs:], WaveletMatrix(n, ranks, load)


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _special(path: str) -> list[str]:
    return [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]


#: Texts of only these characters split as ``_WORD`` says once they are in lower case.
_PLAIN = re.compile(r"[\x20-\x7e\nÀ-ÖØ-öø-ÿ]*")
#: Fixed value: the vocabulary's own split pattern, its classes spelt out for plain texts.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \na-zß-öø-ÿ0-9]+")


class _Memo(dict):
    """Word in lower case -> its ids as little-endian unsigned 16-bit integers, by the library's model."""

    def __init__(self, tok: Tokenizer):
        super().__init__()
        self.model = tok.model
        visible = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: visible.pre_tokenize_str(chr(c))[0][0] for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        ids = array("H", [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))])
        if sys.byteorder == "big":
            ids.byteswap()
        out = ids.tobytes()
        if len(word) < 40:
            self[word] = out
        return out


@functools.lru_cache(maxsize=2)
def _memo(path: str) -> _Memo:
    """Kept by the Python worker from task to task."""
    return _Memo(_tokenizer(path))


def tokenize_text(text: str, path: str) -> bytes:
    """The library's ids as little-endian unsigned 16-bit integers.

    The vocabulary drops white space and encodes each word by itself, so that plain texts are
    split into words here and the library's model sees each distinct word once. Texts with other
    characters, or with one of its special strings, go to the library whole.
    """
    tok = _tokenizer(path)
    if not _PLAIN.fullmatch(text) or any(s in text for s in _special(path)):
        return np.array(tok.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    memo = _memo(path)
    return b"".join([memo[w] for w in _WORD.findall(text.lower())])


def _tokenize(path: str, end_id: int, cuts: list[int]):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bounds = np.array(cuts, np.int64)
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                did = part.column("did").to_numpy(zero_copy_only=False)
                ids = [tokenize_text(t or "", path) + end for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, did, side="left"), pa.int64()), part.column("did"), pa.array(ids, pa.binary())], ["shard", "did", "ids"])

    return run


def _write(folder: str):
    def run(key, rows):
        rows = rows.sort_values(["did", "ids"], kind="stable")
        sizes = rows["ids"].str.len().to_numpy(np.int64) // 2
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        data = to_file(rows["did"].to_numpy(np.int64), starts, np.frombuffer(b"".join(rows["ids"]), "<u2"))
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        # A repeated task writes the same bytes: under another name first, then moved into place.
        part = f"{path}/.{key[0]:010d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            out.write(data)
        fs.move(part, f"{path}/{key[0]:010d}.wvm")
        return pd.DataFrame({"shard": [key[0]], "n_ids": [int(sizes.sum())], "n_docs": [len(rows)]})

    return run


def write_shards(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> tuple[str, DataFrame]:
    """Writes one file per shard; returns the folder and ``shard, n_ids, n_docs``."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "wavelet")
    base = docs.select(id_key().alias("did"), F.coalesce("text", F.lit("")).alias("text"))
    total = base.agg(F.sum(F.octet_length("text") + 4)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    cuts = base.stat.approxQuantile("did", [i / shards for i in range(1, shards)], min(0.001, 0.1 / shards)) if shards > 1 else []
    tokens = base.mapInArrow(_tokenize(vocabulary, end_id, sorted({int(c) for c in cuts})), "shard long, did long, ids binary")
    return folder, store(tokens.repartition(shards, "shard").groupBy("shard").applyInPandas(_write(folder), "shard long, n_ids long, n_docs long"), "wavelet-shards")


def _read(batches):
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            doc_ids, starts, wm = from_file(data.as_py())
            ids = wm.to_ids().astype("<u4")
            ends = np.concatenate([starts[1:], [wm.n]])
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            shard = int(path.rsplit("/", 1)[-1].split(".")[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc_ids), shard)), pa.array(doc_ids), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], ["shard", "did", "start", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """Per document, from the files: place of its first id among all ids, number of ids, crc32 of the ids.

    The table ``shards`` has a row for each file, so the running sum over it is small.
    """
    first = shards.select(F.col("shard").alias("s"), (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("before"))
    if not shards.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder).select("path", "content")
    docs = files.mapInArrow(_read, "shard long, did long, start long, n_tokens long, ids_crc32 long")
    return docs.join(first, docs["shard"] == first["s"]).select(id_back("did").alias("doc_id"), (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """``token, doc_id, place``: each occurrence of the ids, by select on the shards' files; ``place`` counts from the document's first id."""
    wanted = sorted(set(tokens))

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                doc_ids, starts, wm = from_file(data.as_py())
                for token in wanted:
                    for first in range(0, wm.count(token), 50_000):
                        at = wm.positions(token, first, first + 50_000)
                        doc = np.searchsorted(starts, at, side="right") - 1
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), token)), pa.array(doc_ids[doc]), pa.array(at - starts[doc])], ["token", "did", "place"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder).select("content")
    return files.mapInArrow(run, "token long, did long, place long").select("token", id_back("did").alias("doc_id"), "place")


def op9_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder, shards = write_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return read_shards(spark, folder, shards)
