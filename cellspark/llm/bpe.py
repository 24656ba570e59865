"""Byte-level BPE encoding by overlapping chunks, and decoding by concatenating raw bytes.

Texts of up to ``chunk_chars`` characters are encoded where they are read. Longer ones are
cut into overlapping chunks that are dealt to all tasks: each chunk is pre-tokenised from
its own start, neighbours are stitched at the first pre-token boundary that both scans
found inside their overlap (a scan's future depends only on the text after a boundary, so
from there on they agree), and the pieces between the stitches are encoded separately.
A text none of whose overlaps resynchronises (one endless run of letters, say) is encoded whole.

Defined results: a null or empty text has no ids and decodes to no bytes; a null ``doc_id``
is kept; repeated rows each give a row; other columns are ignored.
An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import read_table, store

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Segments held per Python worker before the memo is emptied.
MEMO = 200_000

#: A run of blanks and the run of other characters after it. Between two such segments no
#: pre-token can lie, as none has a non-space character before a space.
_SEGMENT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space of any kind other than the two above: such texts are not cut into segments.
_OTHER_SPACE = regex.compile(r"[^\S \n]|[\x1c-\x1f\x85]")


@functools.lru_cache(maxsize=4)
def encoder(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class _Memo(dict):
    """Segment -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, enc: tiktoken.Encoding):
        super().__init__()
        self.encode = enc.encode_ordinary

    def __missing__(self, segment: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        ids = np.array(self.encode(segment), "<u4").tobytes()
        if len(segment) < 64:
            self[segment] = ids
        return ids


def _encode_text(text: str, memo: _Memo) -> bytes:
    if _OTHER_SPACE.search(text):
        return np.array(memo.encode(text), "<u4").tobytes()
    return b"".join([memo[s] for s in _SEGMENT.findall(text)])


def _encode_column(ranks_path: str, pattern: str, keep: list[str]):
    """mapInArrow function: replaces the column ``text`` by ``ids``."""

    def run(batches):
        memo = _Memo(encoder(ranks_path, pattern))
        for batch in batches:
            ids = pa.array([_encode_text(t.as_py() or "", memo) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids], [*keep, "ids"])

    return run


def _cut_chunks(chunk: int, overlap: int):
    def run(batches):
        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
                starts = range(0, len(text), chunk)
                spans = [(max(0, s - overlap), min(len(text), s + chunk + overlap)) for s in starts]
                for at in range(0, len(spans), 64):
                    part = spans[at : at + 64]
                    k = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id] * k, pa.int64()), pa.array([key] * k, pa.int64()), pa.array(range(at, at + k), pa.int32()), pa.array([a for a, _ in part], pa.int64()), pa.array([b == len(text) for _, b in part], pa.bool_()), pa.array([text[a:b] for a, b in part], pa.string())],
                        ["doc_id", "key", "idx", "start", "ends", "text"],
                    )

    return run


def _boundaries(pattern: str, chunk: int, overlap: int):
    """mapInArrow function: pre-tokenises each chunk; keeps the boundaries that lie in its two overlaps."""

    def run(batches):
        find = regex.compile(pattern).finditer
        for batch in batches:
            heads, tails = [], []
            for idx, start, ends, text in zip(*(batch.column(c).to_pylist() for c in ("idx", "start", "ends", "text")), strict=True):
                # The last pre-token may be cut short by the chunk's end, so that its end is no boundary.
                at = [start + m.end() for m in find(text)]
                at = at if ends else at[:-1]
                left, right = idx * chunk, (idx + 1) * chunk
                heads.append([p for p in at if left - overlap < p <= left + overlap] if idx else [])
                tails.append([] if ends else [p for p in at if right - overlap < p <= right + overlap])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], [*batch.schema.names, "heads", "tails"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = 32_768, overlap: int = 512) -> DataFrame:
    """``doc_id, ids``: the ids of each whole text as a binary of little-endian unsigned 32-bit integers."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    long_text = F.length("text") > chunk_chars
    short = base.where(~long_text).mapInArrow(_encode_column(ranks_path, pattern, ["doc_id"]), "doc_id long, ids binary")

    keyed = base.where(long_text).withColumn("key", F.xxhash64("text"))
    rows = keyed.select("doc_id", "key")
    chunks = keyed.mapInArrow(_cut_chunks(chunk_chars, overlap), "doc_id long, key long, idx int, start long, ends boolean, text string").dropDuplicates(["doc_id", "key", "idx"])
    scanned = chunks.mapInArrow(_boundaries(pattern, chunk_chars, overlap), "doc_id long, key long, idx int, start long, ends boolean, text string, heads array<long>, tails array<long>")
    by_text = Window.partitionBy("doc_id", "key").orderBy("idx")
    cut = F.array_min(F.array_intersect(F.lag("tails").over(by_text), F.col("heads")))
    stitched = scanned.withColumn("from", F.when(F.col("idx") == 0, F.lit(0)).otherwise(cut)).withColumn("to", F.lead("from").over(by_text)).withColumn("last", F.lead("idx").over(by_text).isNull())
    pieces = stitched.select(
        "doc_id", "key", "idx",
        (F.col("from").isNull() | (F.col("to").isNull() & ~F.col("last"))).alias("torn"),
        F.expr("substring(text, int(from - start + 1), int(coalesce(to, start + length(text)) - from))").alias("text"),
    )
    encoded = pieces.mapInArrow(_encode_column(ranks_path, pattern, ["doc_id", "key", "idx", "torn"]), "doc_id long, key long, idx int, torn boolean, ids binary")
    joined = encoded.groupBy("doc_id", "key").agg(F.expr("listagg(ids) WITHIN GROUP (ORDER BY idx)").alias("ids"), F.max("torn").alias("torn"))
    joined = store(joined.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "torn", F.when(~F.col("torn"), F.col("ids")).alias("ids")), "long-texts-ids")
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key"))
    whole = keyed.join(joined.where("torn").select("d", "k"), same, "left_semi").select("doc_id", "text").mapInArrow(_encode_column(ranks_path, pattern, ["doc_id"]), "doc_id long, ids binary")
    return short.unionByName(rows.join(joined.where("not torn"), same).select("doc_id", "ids")).unionByName(whole)


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``: the raw bytes of the ids, concatenated."""
    names = tokens.columns

    def run(batches):
        raw = encoder(ranks_path, pattern)
        table = [raw.decode_single_token_bytes(i) for i in range(raw.n_vocab)]
        for batch in batches:
            out = [b"".join([table[i] for i in np.frombuffer(x.as_py() or b"", "<u4").tolist()]) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields, StructField("decoded", BinaryType())]))


def digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, **sizes: int) -> DataFrame:
    import public_tokenizers

    ranks_path, pattern = ranks_path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    both = decode(encode(docs, ranks_path, pattern, **sizes), ranks_path, pattern)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
