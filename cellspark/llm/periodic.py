"""Periodic runs of words in each text, by bit-parallel lags, and their collapse to one period.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
``max(least, 2 * q)`` that no neighbouring word extends keeping the period.

1. Every run lies in one stretch of words that strings of ``least // 2`` words cover which occur again in the text
   (of a run at lag q, at least ``max(least - q, q)`` words in a row are equal to those q later). Hashes of the strings find
   these stretches; a collision only makes one longer. Most texts have none.
2. The ids of a stretch's words are big integers, one for each bit of the ids. For a lag q each plane is XORed with itself
   shifted by q; the OR of the results marks the places whose words differ from those q later.
3. Of the complement, AND with itself by doubling shifts leaves the places where enough equal words start. Each stretch of
   ones is a run of period q, unless the same words were a run at a smaller lag: by the theorem of Fine and Wilf a stretch
   of two periods or more has a smaller period only if that divides the larger, and then both have the same ends.

A text is worked on by itself where it is read: nothing is shuffled and no rows are gathered.

Defined results: a null or empty text, or one without words, has no runs and collapses to the empty text; a null
``doc_id`` is kept; repeated rows each give a row; very long texts are worked on whole (their time grows with the square of
the longest stretch that repeats, divided by the machine's word); an empty table gives an empty one; other columns,
also those named like results, are ignored. Equal lengths: the longest run is the one that starts first, then the one of least period.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import read_table

LEAST = 12
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
#: An odd 64-bit multiplier of the strings' hashes.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUNS = "array<struct<start:long,length:long,period:long>>"


def word_ids(words: list[str]) -> np.ndarray:
    codes: dict[str, int] = {}
    return np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))


def repeating_stretches(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """``[start, end)`` of the stretches of at least ``least`` words that strings of ``least // 2`` words cover which occur again."""
    k = max(1, least // 2)
    n = len(ids) - k + 1
    if n < 2:
        return []
    codes = (ids.astype(np.uint64) + np.uint64(1)) * _BASE
    codes ^= codes >> np.uint64(29)
    hashes = np.zeros(n, np.uint64)
    for i in range(k):
        hashes = hashes * _BASE + codes[i : i + n]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return []
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + k, -1)
    covered = np.concatenate([[False], np.cumsum(edges)[:-1] > 0, [False]])
    starts, ends = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(~covered[1:] & covered[:-1])
    return [(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a >= least]


def bit_planes(ids: np.ndarray) -> list[int]:
    """One big integer for each bit of the ids; bit i of it is that of word i."""
    _, dense = np.unique(ids, return_inverse=True)
    return [int.from_bytes(np.packbits((dense >> b) & 1, bitorder="little").tobytes(), "little") for b in range(max(1, int(dense.max()).bit_length()))]


def lag_stretches(planes: list[int], n: int, q: int, need: int) -> list[tuple[int, int]]:
    """``start, size`` of each maximal stretch of at least ``need`` places whose words equal those q later."""
    differ = 0
    for p in planes:
        differ |= p ^ (p >> q)
    equal = ~differ & ((1 << (n - q)) - 1)
    have = 1
    while have < need and equal:
        step = min(have, need - have)
        equal &= equal >> step
        have += step
    out, base = [], 0
    while equal:
        skip = (equal & -equal).bit_length() - 1
        equal >>= skip
        ones = (~equal & (equal + 1)).bit_length() - 1
        out.append((base + skip, ones + need - 1))
        equal >>= ones
        base += skip + ones
    return out


def runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run, by start and period."""
    found = []
    for a, b in repeating_stretches(ids, least):
        n, seen = b - a, set()
        planes = bit_planes(ids[a:b])
        for q in range(1, n // 2 + 1):
            for start, size in lag_stretches(planes, n, q, max(least - q, q)):
                if (start, size + q) not in seen:
                    seen.add((start, size + q))
                    found.append((a + start, size + q, q))
            if (0, n) in seen:  # of two periods or more of it, any larger period would have this one or a part of it beside it
                break
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """Words that lie in no run behind its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]


def _find(least: int, rewrite: Callable[[int | None, list[str]], list[str]] | None):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            found, kept = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = _WORDS(text.as_py() or "")
                words = rewrite(doc_id, words) if rewrite else words
                own = runs(word_ids(words), least) if len(words) >= least else []
                found.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                kept.append(" ".join(kept_words(words, own)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind), pa.array(kept, pa.string())], ["doc_id", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, least: int = LEAST, rewrite: Callable[[int | None, list[str]], list[str]] | None = None) -> DataFrame:
    """``doc_id, runs, collapsed``: the runs of each text by start, then period, and the words that stay, joined by one space.

    ``rewrite(doc_id, words)`` may change the words of a text before they are looked at.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find(least, rewrite), f"doc_id long, runs {_RUNS}, collapsed string")


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with the first period of each run only; texts without runs, and null ones, stay as they are."""
    shorter = F.arrow_udf(_collapse(least), StringType())(F.col("text"))
    fixed = docs.withColumn("__new", F.coalesce(shorter, F.col("text")))
    return fixed.select(*(F.col("__new").alias("text") if c == "text" else F.length("__new").cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes))


def _collapse(least: int):
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            words = _WORDS(text.as_py() or "")
            own = runs(word_ids(words), least) if len(words) >= least else []
            out.append(" ".join(kept_words(words, own)) if own else None)
        return pa.array(out, pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return run


def echoed(doc_id: int | None, words: list[str]) -> list[str]:
    """The contract's rewriting: texts of one in ten ids end in repeats of a part of their own."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(read_table(spark, sf_dir, "documents"), rewrite=echoed)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.p")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
