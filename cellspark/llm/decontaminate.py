"""Benchmark decontamination by the q-gram lemma.

A passage within ``e`` byte edits of an item of ``m`` bytes shares at least
``m - q + 1 - q * e`` q-grams with it, all on ``e + 1`` neighbouring diagonals (place in the
document minus place in the item). Shared q-grams are counted in overlapping bands of
diagonals, bands that reach the bound are kept and verified by an alignment in bits. Texts and
items are compared in lower case with white space collapsed, as UTF-8 bytes; the edit budget
of an item is ``EDIT_RATE`` of its length. Items shorter than ``Q`` bytes must occur verbatim
between blanks or text ends.

The documents are never shuffled: the benchmark comes to them, in blocks of ``BLOCK_BYTES``
(each one pass over the documents), so its size decides only how many passes there are.

Defined results: null and empty texts, and null and empty items, match nothing; equal items
are all reported; repeated rows each give a row; a null ``doc_id`` is kept.
Very long texts are worked on whole, in overlapping slices; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, store

Q = 8
EDIT_RATE = 0.08
BLOCK_BYTES = 4 << 20
#: Width of the windows of the density test, and bytes of text handled at once.
_WINDOW, _SLICE = 64, 1 << 19
_BITS = 22
#: A name beside those of any documents table.
_FOUND = "__found_items"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str | None) -> bytes:
    return " ".join((text or "").replace("\0", " ").lower().split()).encode("utf-8", "replace")


def _grams(a: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one integer."""
    c = a.astype(np.uint64)
    for width in (1, 2, 4):
        c = c[:-width] | (c[width:] << np.uint64(8 * width))
    return c


def edit_budget(m: int, rate: float = EDIT_RATE) -> int:
    """The share of the length, but never so much that the bound on shared q-grams falls under one."""
    return max(0, min(int(rate * m), (m - Q) // Q))


def banded_distance(item: np.ndarray, region: np.ndarray, low: int, high: int) -> int:
    """Least edits from the item to any part of the region, on alignments whose diagonals stay in low..high."""
    width = high - low + 1
    ramp = np.arange(width, dtype=np.int32)
    big = np.int32(1 << 20)
    padded = np.full(len(region) + 2 * (len(item) + width) + abs(low) + 2, 256, np.int32)
    shift = len(item) + width + abs(low)
    padded[shift : shift + len(region)] = region
    start = ramp + low  # the column of row 0 on each diagonal: the part may begin anywhere
    now = np.where((start >= 0) & (start <= len(region)), 0, big).astype(np.int32)
    for i, byte in enumerate(item.tolist()):
        here = padded[shift + low + i : shift + low + i + width]
        new = np.where(here != 256, now + (here != byte), big)
        new[:-1] = np.minimum(new[:-1], now[1:] + 1)
        now = (np.minimum.accumulate(new - ramp) + ramp).astype(np.int32)
        column = ramp + low + i + 1
        now[(column < 0) | (column > len(region))] = big
    return int(now.min())


def places_of(item: bytes) -> dict[int, int]:
    """For each byte value, its places in the item as bits."""
    out: dict[int, int] = {}
    for i, byte in enumerate(item):
        out[byte] = out.get(byte, 0) | 1 << i
    return out


def is_within(places: dict[int, int], m: int, region: bytes, edits: int) -> bool:
    """Whether an item of m bytes is within the edits of any part of the region: a column of the alignment is two integers of m bits (Myers)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for byte in region:
        same = places.get(byte, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(across | up)), up & across
        if more & high:
            score += 1
        elif less & high:
            score -= 1
            if score <= edits:
                return True
        more, less, same = more << 1, less << 1, same | down
        up, down = (less | ~(same | more)) & full, more & same & full
    return m <= edits


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = EDIT_RATE):
        self.short = [(i, t) for i, t in items if 0 < len(t) < Q]
        self.places: dict[int, dict[int, int]] = {}
        full = [(i, t) for i, t in items if len(t) >= Q]
        self.ids = [i for i, _ in full]
        self.items = [np.frombuffer(t, np.uint8) for _, t in full]
        self.sizes = np.array([len(t) for _, t in full], np.int64)
        self.edits = np.array([edit_budget(len(t), rate) for _, t in full], np.int64)
        self.bounds = self.sizes - Q + 1 - Q * self.edits
        if not full:
            return
        codes = np.concatenate([_grams(t) for t in self.items])
        owner = np.repeat(np.arange(len(full)), self.sizes - Q + 1)
        place = np.concatenate([np.arange(m - Q + 1) for m in self.sizes])
        order = np.argsort(codes, kind="stable")
        self.codes, first = np.unique(codes[order], return_index=True)
        self.first = np.append(first, len(codes))
        self.owner, self.place = owner[order], place[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.codes * _ODD) >> np.uint64(64 - _BITS)] = True
        self.width = int(self.edits.max()) + 1
        self.reach = int((self.sizes + self.edits).max()) + 1
        # A region of m + e bytes with that many shared q-grams has a window with this many.
        windows = -(-(self.sizes + self.edits) // _WINDOW)
        self.dense = int((-(-self.bounds // windows)).min())

    def search(self, texts: list[bytes]) -> list[list[int]]:
        """Ids of the items found in each normalised text."""
        found: list[set[int]] = [set() for _ in texts]
        for i, needle in self.short:
            for k, t in enumerate(texts):
                if b" " + needle + b" " in b" " + t + b" ":
                    found[k].add(i)
        if self.ids:
            at, total = 0, 0
            for k, t in enumerate(texts):
                total += len(t) + Q
                if total >= _SLICE or k == len(texts) - 1:
                    self._scan(texts[at : k + 1], found[at : k + 1])
                    at, total = k + 1, 0
        return [sorted(f) for f in found]

    def _scan(self, texts: list[bytes], found: list[set[int]]) -> None:
        a = np.frombuffer((b"\0" * Q).join([*texts, b""]), np.uint8)
        if len(a) < Q:
            return
        starts = np.concatenate([[0], np.cumsum([len(t) + Q for t in texts])])
        codes = _grams(a)
        hits = np.flatnonzero(self.bitmap[(codes * _ODD) >> np.uint64(64 - _BITS)])
        if not len(hits):
            return
        code = np.minimum(np.searchsorted(self.codes, codes[hits]), len(self.codes) - 1)
        real = self.codes[code] == codes[hits]
        hits, code = hits[real], code[real]
        if len(hits) < self.dense:
            return
        # Only q-grams near a dense window can belong to a region that meets the bound.
        tight = hits[: len(hits) - self.dense + 1][hits[self.dense - 1 :] - hits[: len(hits) - self.dense + 1] < _WINDOW]
        if not len(tight):
            return
        edge = np.zeros(len(hits) + 1, np.int64)
        np.add.at(edge, np.searchsorted(hits, tight - self.reach), 1)
        np.add.at(edge, np.searchsorted(hits, tight + self.reach, side="right"), -1)
        near = np.cumsum(edge[:-1]) > 0
        hits, code = hits[near], code[near]
        text, first = np.unique(np.searchsorted(starts, hits, side="right") - 1, return_index=True)
        for k, own in zip(text.tolist(), map(slice, first.tolist(), [*first[1:].tolist(), len(hits)]), strict=True):  # one text at a time keeps the expansion small
            self._bands(a, hits[own], code[own], int(starts[k]), int(starts[k]) + len(texts[k]), found[k])

    def _places(self, i: int) -> dict[int, int]:
        if i not in self.places:
            self.places[i] = places_of(self.items[i].tobytes())
        return self.places[i]

    def _bands(self, a, hits, code, begin: int, end: int, found: set[int]) -> None:
        keys, counts = [], []
        for part in np.array_split(np.arange(len(hits)), -(-len(hits) // 20_000)):
            times = self.first[code[part] + 1] - self.first[code[part]]
            rows = np.repeat(self.first[code[part]] - np.concatenate([[0], np.cumsum(times)])[:-1], times) + np.arange(times.sum())
            diagonal = np.repeat(hits[part], times) - begin - self.place[rows] + self.reach
            band = diagonal // self.width
            key = self.owner[rows] << 36 | band
            key = np.concatenate([key, key - 1])  # bands overlap by half: each diagonal is in two
            u, c = np.unique(key, return_counts=True)
            keys.append(u)
            counts.append(c)
        key, count = keys[0], counts[0]
        if len(keys) > 1:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)
        item = key >> 36
        for i, band in zip(item[count >= self.bounds[item]].tolist(), (key[count >= self.bounds[item]] & ((1 << 36) - 1)).tolist(), strict=True):
            if self.ids[i] in found:
                continue
            low = band * self.width - self.reach
            left = max(0, low - int(self.edits[i]))
            region = a[begin + left : min(end, begin + low + 2 * self.width + int(self.sizes[i] + self.edits[i]))]
            if self.items[i].tobytes() in region.tobytes():
                found.add(self.ids[i])
            elif self.edits[i] and is_within(self._places(i), int(self.sizes[i]), region.tobytes(), int(self.edits[i])):
                found.add(self.ids[i])


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[int, bytes]]]:
    """The items in blocks of a bounded size, read one block after the other."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and trim(text) <> ''")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r["item_id"], t) for r in part.collect() if (t := normalise(r["text"]))]


def _search(items: list[tuple[int, bytes]], rate: float) -> Column:
    """The sorted ids of a block's items in the column ``text``. Only texts go to Python, and only ids come back."""

    @F.arrow_udf("array<long>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(items, rate)
        for texts in batches:
            found = [ids for at in range(0, len(texts), 1000) for ids in index.search([normalise(t) for t in texts.slice(at, 1000).to_pylist()])]
            yield pa.array(found, pa.list_(pa.int64()))

    return search(F.col("text"))


def _found(docs: DataFrame, benchmark: DataFrame, rate: float, block_bytes: int) -> DataFrame:
    out = docs
    for i, items in enumerate(_blocks(benchmark, block_bytes)):
        if i:  # a plan holds one block, whatever the size of the benchmark
            out = store(out, "found-items")
        out = out.withColumn(_FOUND, F.array_sort(F.array_union(_FOUND, _search(items, rate))) if i else _search(items, rate))
    return out


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of docs and ``found_items``, the sorted ids of the items in each text; it replaces a column of that name."""
    return _found(docs, benchmark, rate, block_bytes).drop("found_items").withColumnRenamed(_FOUND, "found_items")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose texts hold no benchmark passage."""
    return _found(docs, benchmark, EDIT_RATE, BLOCK_BYTES).where(F.size(_FOUND) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_items(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("found_items").cast("long").alias("n_items"), F.array_join(F.transform("found_items", lambda x: x.cast("string")), ",").alias("items"), (F.size("found_items") == 0).alias("kept"))
