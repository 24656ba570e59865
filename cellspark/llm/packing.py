"""Packing of token pieces into as few sequences as possible, by bin completion over the counts of their lengths.

Pieces of one length are interchangeable, so the search needs the number of pieces of each length only: at most ``capacity`` counts,
whatever the corpus. Each filling of a sequence is found once, with the number of times it is used, and Spark deals
the pieces, numbered within their length, to the places of the fillings. No piece passes through the driver.

1. Best-fit decreasing over the counts gives the first incumbent. If its sequences meet the lower bound (total length,
   and the bound L2 of Martello and Toth for pieces over half a sequence), it is optimal.
2. Else a depth-first branch and bound takes the largest length left and enumerates the undominated fillings around it: a
   filling is dominated if a piece that is left could take the place of some of its pieces that fit in it. Branches
   whose waste exceeds what the incumbent allows are pruned, those of less waste are tried first, and each better solution
   becomes the incumbent. A filling is tried as often as the counts allow and once.
3. The search ends when the bound is met, when nothing is left to try (then the incumbent is optimal) or after
   ``steps`` steps of enumeration, a parameter: then the incumbent stands, which is never worse than best fit.

Defined results: a null or empty text is the end id alone; a null ``doc_id`` is kept; repeated rows are packed each; a text over
the capacity is cut into pieces of the whole capacity and one that may be shorter; an empty table gives no pieces; other
columns are ignored. Pieces of one length take their places in the order of document, piece and digest; of quite equal rows either may come first.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import id_back, id_key, new_folder, numbered, read_table, store
from .wavelet import END_ID, VOCABULARY, tokenize_text

CAPACITY = 4096
STEPS = 50_000

#: A filling and how often it is used: ``times, ((length, number), ...)``.
Filling = tuple[int, tuple[tuple[int, int], ...]]


def _cut(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for did, text in zip(batch.column("did").to_pylist(), batch.column("text"), strict=True):
                ids = np.frombuffer(tokenize_text(text.as_py() or "", path) + end, "<u2").astype("<u4").tobytes()
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((did, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["did", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds, strict=False)], names[:n])

    return run


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``did, piece, start, length, ids_crc32[, ids]`` of each piece of each text, its end id included."""
    shape = "did long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(id_key().alias("did"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_cut(vocabulary, end_id, capacity, with_ids), shape)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: the total length, or for a length a the pieces over ``capacity - a``, those over half, and what of the others from a on doesn't fit beside these."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], np.int64)
    pieces, length = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(sizes * n)])
    a = np.concatenate([[0], sizes[2 * sizes <= capacity]])
    half, whole, rest = np.searchsorted(2 * sizes, capacity, side="right"), np.searchsorted(sizes, capacity - a, side="right"), np.searchsorted(sizes, a)
    free = (pieces[whole] - pieces[half]) * capacity - (length[whole] - length[half])
    more = -(-(length[half] - length[rest] - free) // capacity)
    return max(-(-int(length[-1]) // capacity), int((pieces[-1] - pieces[half] + np.maximum(more, 0)).max()))


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best-fit decreasing, all pieces of a length and all sequences of one filling at a time."""
    bins: dict[int, list[list]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        added: list[tuple[int, int, tuple]] = []

        def fill(room: int, times: int, filling: tuple, size: int = size, added: list = added) -> None:
            nonlocal left
            most = room // size
            full = min(times, left // most)
            if full:
                added.append((room - most * size, full, (*filling, (size, most))))
                left -= full * most
            if full < times and left:
                added.append((room - left * size, 1, (*filling, (size, left))))
                left, full = 0, full + 1
            if full < times:
                added.append((room, times - full, filling))

        for room in sorted(r for r in bins if r >= size):
            if not left:
                break
            for times, filling in bins.pop(room):
                if left:
                    fill(room, times, filling)
                else:
                    added.append((room, times, filling))
        if left:
            fill(capacity, -(-left // (capacity // size)), ())
        for room, times, filling in added:
            bins.setdefault(room, []).append([times, filling])
    return [(times, filling) for group in bins.values() for times, filling in group]


def _dominated(filling: list[tuple[int, int]], waste: int, free: list[int]) -> bool:
    """Whether a piece that is left (``free``: their lengths) could replace pieces of the filling that fit in it."""
    sums, own = 1, {s for s, _ in filling}
    for size, number in filling:
        for _ in range(number):
            sums |= sums << size
    for x in free:
        low = max(0, x - waste)
        top = x if x in own else x + 1  # the same length is no change
        if top > low and (sums >> low) & ((1 << (top - low)) - 1):
            return True
    return False


def fillings(left: dict[int, int], room: int, waste: int, budget: list[int]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """``waste, filling`` of each undominated filling of ``room`` that wastes at most ``waste``, larger pieces first."""
    sizes = [s for s in sorted(left, reverse=True) if left[s] and s <= room]
    # Of the lengths from a place on, all there is.
    after = [0] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        after[i] = after[i + 1] + sizes[i] * left[sizes[i]]
    stack: list[tuple[int, int, list[tuple[int, int]]]] = [(0, room, [])]
    while stack and budget[0] > 0:
        budget[0] -= 1
        i, rest, chosen = stack.pop()
        while i < len(sizes) and sizes[i] > rest:
            i += 1
        if i == len(sizes):
            used = dict(chosen)
            if rest <= waste and not _dominated(chosen, rest, [s for s in sizes if left[s] > used.get(s, 0)]):
                yield rest, chosen
        elif rest - after[i] <= waste:
            s = sizes[i]
            for k in range(0, min(left[s], rest // s) + 1):
                stack.append((i + 1, rest - k * s, [*chosen, (s, k)] if k else chosen))


def solve(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[Filling]:
    """Fillings, and how often each is used, that hold all pieces in as few sequences as the search finds."""
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    fewest, total, budget = sum(t for t, _ in best), sum(s * n for s, n in counts.items()), [steps]
    left, used, wasted = dict(counts), 0, 0
    path: list[tuple[int, tuple, int]] = []

    def branches(allowed: int) -> Iterator[tuple[int, int, tuple]]:
        largest = max(s for s, n in left.items() if n)
        left[largest] -= 1
        found = sorted(fillings(left, capacity - largest, allowed, budget), key=lambda f: f[0])
        left[largest] += 1
        for waste, chosen in found:
            need = dict(chosen)
            need[largest] = need.get(largest, 0) + 1
            most = min(left[s] // k for s, k in need.items())
            for times in (most, 1) if most > 1 else (1,):
                yield times, waste, tuple(sorted(need.items(), reverse=True))

    stack = [branches((fewest - 1) * capacity - total)] if fewest > bound else []
    while stack and fewest > bound and budget[0] > 0:
        if len(path) == len(stack):  # back from a branch
            times, filling, waste = path.pop()
            for s, k in filling:
                left[s] += times * k
            used, wasted = used - times, wasted - times * waste
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            continue
        times, waste, filling = step
        for s, k in filling:
            left[s] -= times * k
        used, wasted = used + times, wasted + times * waste
        path.append((times, filling, waste))
        allowed = (fewest - 1) * capacity - total - wasted
        if not any(left.values()):
            if used < fewest:
                fewest, best = used, [(t, f) for t, f, _ in path]
        elif allowed >= 0 and used + lower_bound({s: n for s, n in left.items() if n}, capacity) < fewest:
            stack.append(branches(allowed))
            continue
    return best


def _deal(best: list[Filling]):
    """mapInArrow function: ``sequence_id, offset`` of the piece with a number within its length."""
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, filling in best:
        at = 0
        for size, k in filling:
            places.setdefault(size, []).append((taken.get(size, 0), k, sequence, at))
            taken[size] = taken.get(size, 0) + times * k
            at += size * k
        sequence += times
    table = {size: np.array(rows, np.int64).T for size, rows in places.items()}

    def run(batches):
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("__rank").to_numpy() - 1
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length).tolist():
                own = np.flatnonzero(length == size)
                first, k, base, at = table[size]
                i = np.searchsorted(first, number[own], side="right") - 1
                t = number[own] - first[i]
                sequence[own], offset[own] = base[i] + t // k[i], at[i] + t % k[i] * size
            names = [n for n in batch.schema.names if n != "__rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(parts: DataFrame, order: list[str], capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """Adds ``sequence_id, offset`` to rows with a ``length`` of 1 to ``capacity``; ``order`` numbers rows of one length. Lengths have at most ``capacity`` counts, which alone reach the driver."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranked = numbered(parts, ["length"], order, "__rank")
    shape = StructType([*(f for f in parts.schema.fields), StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(_deal(solve(counts, capacity, steps)), shape)


_ORDER = ["did", "piece", "start", "ids_crc32"]


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """A row for each piece with its place."""
    out = pack(store(pieces(docs, vocabulary, capacity), "pieces"), _ORDER, capacity, steps)
    return out.select(id_back("did").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def write_sequences(docs: DataFrame, vocabulary: str, folder: str | None = None, capacity: int = CAPACITY, steps: int = STEPS) -> str:
    """Writes ``sequence_id, ids, parts`` as Parquet: the ids of each sequence as little-endian unsigned 32-bit integers, and where its pieces lie. A sequence holds at most ``capacity`` pieces."""
    folder = folder or new_folder(docs.sparkSession, "sequences")
    out = pack(store(pieces(docs, vocabulary, capacity, with_ids=True), "pieces-ids"), _ORDER, capacity, steps)
    part = F.struct("offset", "length", id_back("did").alias("doc_id"), "piece", "ids")
    rows = out.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda x, p: F.concat(x, p["ids"]))
    rows.select("sequence_id", ids.alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("parts")).write.option("compression", "zstd").parquet(folder)
    return folder


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
