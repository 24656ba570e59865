"""Removal of bytes that long repeated strings cover, by a sparse hash-compared suffix array.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else in the
corpus. Anchors make the suffix array sparse: in every window of ``length`` bytes the ``gram``-byte
string of least hash is its anchor, so equal windows have equal anchors at equal places, at about
one in a hundred bytes. Prefix polynomial hashes give the hash of any string in two lookups.

1. Anchors whose gram occurs once drop out (one grouped count), and with them the windows that they
   anchor; the forward windows of the others are counted.
2. Stretches between repeated forward windows are covered as they are; what is left are anchors at
   the ends of repeats. For their grams, contexts (the bytes that the anchor's windows reach) are
   gathered and equal contexts counted.
3. The contexts of a gram are suffix-sorted from the anchor rightwards and leftwards: a mergesort
   whose comparisons find the common extension by binary search over the prefix hashes and
   check the bytes of neighbours. Contexts that agree ``l`` bytes to the left and ``length - l`` to the
   right share a window. Grams of more than ``HOT`` distinct contexts are counted window by
   window in Spark instead, so that no task gathers them.

The texts are dealt once, into buckets of their keys; the joins that follow move marks and intervals to them.
Grams and windows that hold a large share of the rows are told to all tasks as a bounded list instead of being
joined, so that no task gathers them.

Strings of words are held against each other in the same way: a text's symbols are then 64-bit codes of its words
instead of its bytes, and lengths and places count words.

Defined results: null texts are empty; shorter texts lose nothing; repeated rows are repeats of
each other; a null ``doc_id`` is kept. Rows are told apart by a 64-bit hash of id and text.
Very long texts are worked on whole, in segments of bounded size; other columns, also those named like results, are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .common import drop, read_table, store, store_by

LENGTH, GRAM = 400, 200
#: Distinct contexts of one gram that are sorted in one task at most.
HOT = 2000
#: Words of the strings that ``digests`` reports beside the bytes: passages of over 50.
WORDS = 51
#: Keys with more than this part of the rows, and of more than ``MANY`` rows, are not joined but told.
SHARE, MANY = 256, 1000
_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 19
_U = np.uint64


@functools.lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64) | _U(1)


@functools.lru_cache(maxsize=1)
def _table(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    n, inverse = 1 << bits, pow(_BASE, -1, 2**64)
    out = []
    for b in (_BASE, inverse):
        p = np.ones(n, np.uint64)
        step, size = b, 1
        while size < n:
            p[size : 2 * size] = p[:size] * _U(step)
            step, size = step * step % 2**64, 2 * size
        out.append(p)
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _table(max(17, int(n).bit_length()))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def symbols(texts: pa.Array, words: bool) -> list[np.ndarray]:
    """The symbols of each text: its bytes, or a code for each word; every different word is hashed once a call."""
    if not words:
        return [np.frombuffer(t.as_buffer(), np.uint8) for t in texts]
    split = pc.ascii_split_whitespace(pc.cast(texts, options=pc.CastOptions(pa.string(), allow_invalid_utf8=True)))
    flat, bounds = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    whole = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end makes an empty one
    coded = flat.dictionary_encode()
    codes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    values = codes[coded.indices.to_numpy()[whole]]
    at = np.concatenate([[0], np.cumsum(whole)])[bounds]
    return [values[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def prefix_hashes(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((_values()[a] if a.dtype == np.uint8 else a) * powers(len(a))[0][: len(a)], out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    """Hash of the strings of the sizes at the starts."""
    return (prefix[start + size] - prefix[start]) * powers(len(prefix))[1][start]


def anchors(a: np.ndarray, prefix: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, and the first and the last window start that has each as its anchor."""
    width, n = length - gram + 1, len(a) - length + 1
    at, first, last = [], [], []
    for begin in range(0, n, _SEGMENT):
        windows = min(_SEGMENT, n - begin)
        places = np.arange(begin, begin + windows + width - 1)
        key = (_mix(substring_hashes(prefix, places, gram)) >> _U(20) << _U(20)) | (places - begin).astype(np.uint64)
        size = 1
        while size * 2 <= width:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < width:
            key = np.minimum(key[: windows], key[width - size : width - size + windows])
        place = (key & _U((1 << 20) - 1)).astype(np.int64) + begin
        edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        at.append(place[edge])
        first.append(edge + begin)
        last.append(np.append(edge[1:], windows) - 1 + begin)
    return np.concatenate(at), np.concatenate(first), np.concatenate(last)


def _scan(length: int, gram: int, words: bool):
    """mapInArrow function: one row for each document of at least one window, with its anchors.

    The first and the last window of a text are listed too (``lo`` and ``hi`` -1), under the gram of their anchor.
    ``f1, f2`` are hashes of the window that starts at ``pos``; ``f2`` is -1 if there is none.
    """
    fields = ["dk", "pos", "lo", "hi", "kh", "f1", "f2"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: list[tuple] = []
                for dk, a in zip(part.column("dk").to_pylist(), symbols(part.column("text"), words), strict=True):
                    if len(a) < length:
                        continue
                    prefix = prefix_hashes(a)
                    pos, lo, hi = anchors(a, prefix, length, gram)
                    kh = _mix(substring_hashes(prefix, pos, gram)).view(np.int64)
                    last = len(a) - length
                    ends = np.setdiff1d([0, last], pos)
                    kh = np.concatenate([kh, np.where(ends == 0, kh[0], kh[-1])])
                    whole = np.concatenate([(pos <= last) & (np.diff(pos, prepend=-1) > 0), np.ones(len(ends), bool)])  # an anchor can stand at two segments' border
                    none = np.full(len(ends), -1)
                    pos, lo, hi = np.concatenate([pos, ends]), np.concatenate([lo, none]), np.concatenate([hi, none])
                    f1, f2 = np.zeros(len(pos), np.int64), np.full(len(pos), -1, np.int32)
                    f1[whole] = _mix(substring_hashes(prefix, pos[whole], length)).view(np.int64)
                    view, size = memoryview(a.view(np.uint8)), a.itemsize
                    f2[whole] = [xxhash.xxh3_64_intdigest(view[p * size : (p + length) * size]) & 0x7FFFFFFF for p in pos[whole].tolist()]
                    rows.append((dk, pos.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32), kh, f1, f2))
                types = [pa.int64(), *(pa.list_(t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], fields)

    return run


def merge(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """Union of half-open intervals."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [s for s, _ in out], [e for _, e in out]


def _open_ends(length: int):
    """mapInArrow function over one row for each document: covered stretches, and which anchors they leave open."""

    def run(batches):
        for batch in batches:
            rows = []
            marks = batch.column("marks")
            bounds = marks.offsets.to_numpy()
            pos_of, lo_of, hi_of, h_of = (marks.values.field(c).to_numpy() for c in ("pos", "lo", "hi", "h"))
            for dk, x, y in zip(batch.column("dk").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                pos, lo, hi, h = pos_of[x:y], lo_of[x:y], hi_of[x:y], h_of[x:y]
                forward = np.sort(pos[hi < 0])
                gap = np.flatnonzero(np.diff(forward) > length)
                starts, ends = forward[np.append(0, gap + 1)[: len(forward)]], forward[np.append(gap, len(forward) - 1)[: len(forward)]] + np.int32(length)
                own = hi >= 0
                k = np.searchsorted(starts, lo[own], side="right") - 1
                covered = (k >= 0) & (np.append(ends, 0)[k] >= hi[own] + length)
                rows.append((dk, starts, ends, np.unique(h[own][~covered])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], ["dk", "starts", "ends", "grams"])

    return run


def _contexts(length: int, words: bool):
    """mapInArrow function: the bytes of the symbols that the windows of each wanted anchor reach.

    An anchor that its document leaves open has a row of its own (``dk, pos``). Of the others, which only lend their
    bytes, those that a task meets again are counted in one row.
    """

    def flat(rows):
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["kh", "c1", "c2", "dk", "pos", "off", "n", "ctx"])

    def run(batches):
        lent: dict[tuple, list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for dk, a, wanted, grams in zip(part.column("dk").to_pylist(), symbols(part.column("text"), words), part.column("wanted").to_pylist(), part.column("grams").to_pylist(), strict=True):
                    still = set(grams)
                    for m in wanted:
                        ctx, off = a[m["lo"] : m["hi"] + length].tobytes(), m["pos"] - m["lo"]
                        digest = xxhash.xxh3_128_intdigest(ctx + off.to_bytes(4, "little"))
                        key = (m["h"], (digest & (2**64 - 1)) - 2**63, (digest >> 64) - 2**63)
                        if m["h"] in still:
                            rows.append((*key, dk, m["pos"], off, 1, ctx))
                        elif key in lent:
                            lent[key][1] += 1
                        else:
                            lent[key] = [off, 1, ctx]
                if len(lent) > 20_000:
                    rows += [(*key, None, None, *rest) for key, rest in lent.items()]
                    lent.clear()
                yield flat(rows)
        yield flat([(*key, None, None, *rest) for key, rest in lent.items()])

    return run


class SuffixSorter:
    """Orders suffixes of an array of symbols up to given sizes; compares by common extensions."""

    def __init__(self, a: np.ndarray):
        self.a, self.prefix = a, prefix_hashes(a)

    def common(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Symbols, up to size, that the suffixes at x and y share: binary search over prefix hashes."""
        low, high = np.zeros(len(x), np.int64), size.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = substring_hashes(self.prefix, x, mid) == substring_hashes(self.prefix, y, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def _before(self, x, xs, xg, y, ys, yg, or_equal: bool) -> np.ndarray:
        """Whether suffix x (of size xs and group xg) comes before y."""
        size = np.where(xg == yg, np.minimum(xs, ys), 0)
        k = self.common(x, y, size)
        whole = k == size
        bx = self.a[np.minimum(x + k, len(self.a) - 1)]
        by = self.a[np.minimum(y + k, len(self.a) - 1)]
        shorter = (xs <= ys) if or_equal else (xs < ys)
        return np.where(xg != yg, xg < yg, np.where(whole, shorter, bx < by))

    def sort(self, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order by group, then suffix: a bottom-up mergesort that merges all pairs of runs at once."""
        n = len(start)
        order = np.argsort(group, kind="stable")
        run = 1
        while run < n:
            place = np.arange(n)
            block, inside = place // (2 * run), place % (2 * run)
            left = inside < run
            # Each element's rank in the other run of its pair, by binary search.
            low = np.where(left, block * 2 * run + run, block * 2 * run)
            other = np.minimum(low, n)
            end = np.minimum(np.where(left, block * 2 * run + 2 * run, block * 2 * run + run), n)
            low, high = other.copy(), np.maximum(end, other)
            me = order
            while True:
                act = np.flatnonzero(low < high)
                if not len(act):
                    break
                mid = (low[act] + high[act]) // 2
                o, x = order[mid], me[act]
                # Elements of the right run go after equal ones of the left run.
                strict = self._before(start[o], size[o], group[o], start[x], size[x], group[x], False)
                loose = self._before(start[o], size[o], group[o], start[x], size[x], group[x], True)
                go = np.where(left[act], strict, loose)
                low[act] = np.where(go, mid + 1, low[act])
                high[act] = np.where(go, high[act], mid)
            rank = low - other
            new = np.empty(n, np.int64)
            new[np.where(left, block * 2 * run + inside + rank, block * 2 * run + (inside - run) + rank)] = order
            order = new
            run *= 2
        return order

    def neighbours(self, order: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Common symbols of each suffix with the one before it in order; verified, so that a hash collision can't lengthen one."""
        out = np.zeros(len(order), np.int64)
        x, y = order[:-1], order[1:]
        most = np.where(group[x] == group[y], np.minimum(size[x], size[y]), 0)
        out[1:] = self.common(start[x], start[y], most)
        for i in range(1, len(order)):
            k, p, q = int(out[i]), int(start[x[i - 1]]), int(start[y[i - 1]])
            if k and not np.array_equal(self.a[p : p + k], self.a[q : q + k]):
                out[i] = int(np.argmax(self.a[p : p + k] != self.a[q : q + k]))
        return out


def shared_windows(contexts: list[bytes], offs: np.ndarray, grams: np.ndarray, counts: np.ndarray, length: int, gram: int, kind: type = np.uint8) -> tuple[np.ndarray, np.ndarray]:
    """For each context the greatest and the least ``l`` whose window (from ``l`` symbols before the anchor) is shared; -1 without."""
    n = len(contexts)
    sizes = np.array([len(c) for c in contexts], np.int64) // np.dtype(kind).itemsize
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    a = np.frombuffer(b"".join(contexts), kind)
    group = np.unique(grams, return_inverse=True)[1]
    right_size, left_size = sizes - offs, offs.astype(np.int64)
    right = SuffixSorter(a)
    ro = right.sort(begin + offs, right_size, group)
    rl = right.neighbours(ro, begin + offs, right_size, group)
    left = SuffixSorter(a[::-1].copy())
    back = len(a) - (begin + offs)  # the reversed text before the anchor
    lo_order = left.sort(back, left_size, group)
    ll = left.neighbours(lo_order, back, left_size, group)
    most, least = np.where(counts > 1, offs, -1), np.where(counts > 1, length - right_size, -1)
    rc, lc = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(length - gram + 1):  # noqa: E741
        fit = (l <= left_size) & (length - l <= right_size)
        if fit.sum() < 2:
            continue
        # Classes that agree far enough: runs of the sorted order between too short extensions.
        rc[ro] = np.cumsum(rl < length - l)
        lc[lo_order] = np.cumsum(ll < l) if l else group[lo_order]
        key = (rc * (n + 1) + lc)[fit]
        _, back_to, times = np.unique(key, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(fit)[times[back_to] > 1]
        most[hit] = np.maximum(most[hit], l)
        least[hit] = np.where(least[hit] < 0, l, np.minimum(least[hit], l))
    return most, least


def _sort_bucket(length: int, gram: int, kind: type):
    def run(rows):
        most, least = shared_windows([bytes(c) for c in rows["ctx"]], rows["off"].to_numpy(np.int64), rows["kh"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), length, gram, kind)
        out = pd.DataFrame({"c1": rows["c1"], "c2": rows["c2"], "most": most, "least": least})
        return out[out["most"] >= 0]

    return run


def _windows(length: int, kind: type):
    """mapInArrow function for hot grams: a row with two hashes for each window of a context."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a = np.frombuffer(batch.column("ctx")[i].as_py(), kind)
                off = batch.column("off")[i].as_py()
                prefix = prefix_hashes(a)
                s = np.arange(len(a) - length + 1)
                w2 = [xxhash.xxh3_64_intdigest(a[k : k + length].tobytes()) - 2**63 for k in s.tolist()]
                k = len(s)
                same = lambda c: pa.array([batch.column(c)[i].as_py()] * k, pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same("c1"), same("c2"), same("n"), pa.array((off - s).astype(np.int32)), pa.array(substring_hashes(prefix, s, length).view(np.int64)), pa.array(w2, pa.int64())], ["c1", "c2", "n", "l", "w1", "w2"])

    return run


def _key() -> Column:
    """A hash of id and text: of one row, or of rows that are the same."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))))


def _among(rows: DataFrame, keys: list[str], wanted: DataFrame, many: list[tuple]) -> DataFrame:
    """The rows whose keys are in ``wanted`` (``__k0, ...``). The keys ``many``, a bounded list, are told to all tasks, so that no join gathers the rows of one."""
    same = functools.reduce(lambda x, y: x & y, (F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)))
    if not many:
        return rows.join(wanted, same, "left_semi")
    listed = lambda names: functools.reduce(lambda x, y: x | y, (functools.reduce(lambda x, y: x & y, (F.col(n) == v for n, v in zip(names, m, strict=True))) for m in many)) if len(keys) > 1 else F.col(names[0]).isin([m[0] for m in many])
    names = [f"__k{i}" for i in range(len(keys))]
    found = [tuple(r) for r in wanted.where(listed(names)).select(*names).distinct().collect()]
    rest = rows.where(~listed(keys)).join(wanted, same, "left_semi")
    return rest.unionByName(rows.where(listed(keys))) if found else rest


def _repeated(rows: DataFrame, keys: list[str], counted: str = "true") -> tuple[DataFrame, DataFrame, list[tuple]]:
    """The rows whose keys occur more than once among those counted; a table to drop once they are read; and the keys of over a ``SHARE``-th of the rows, ``SHARE`` of them at most."""
    names = [f"__k{i}" for i in range(len(keys))]
    again = store(rows.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.count_if(F.expr(counted)).alias("__n")).where("__n > 1"), "repeated-keys")
    total = again.agg(F.sum("__n")).first()[0] or 0
    many = [tuple(r) for r in again.where(F.col("__n") > max(total // SHARE, MANY)).select(*names).collect()]
    return _among(rows, keys, again, many), again, many


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, words: int | None = None) -> DataFrame:
    """``dk, starts, ends``: the byte intervals that go, for each document that loses any.

    With ``words``, strings of that many words instead of ``length`` bytes are held against each other, and the intervals count words.
    """
    return _spans(store_by(docs.select(_key().alias("__dk"), "text"), "__dk", "texts"), length, gram, hot, words)


def _spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, words: int | None = None) -> DataFrame:
    """docs: ``__dk, text``, stored in buckets of ``__dk``."""
    texts = docs.select(F.col("__dk").alias("dk"), F.coalesce("text", F.lit("")).alias("text"))
    least, kind = length, np.uint8
    if words:
        length, gram, least, kind = words, words // 2, 2 * words - 1, np.uint64
    texts = texts.select("dk", F.col("text").cast("binary").alias("text")).where(F.octet_length("text") >= least)
    found = store(texts.mapInArrow(_scan(length, gram, bool(words)), "dk long, pos array<int>, lo array<int>, hi array<int>, kh array<long>, f1 array<long>, f2 array<int>"), "anchors")
    marks = found.select("dk", F.explode(F.arrays_zip("pos", "lo", "hi", "kh", "f1", "f2")).alias("x")).select(F.col("x.kh").alias("h"), "dk", "x.pos", "x.lo", "x.hi", "x.f1", "x.f2")
    rows, keys, many = _repeated(marks, ["h"], "hi >= 0")
    shared = store(rows, "shared-grams")
    drop(keys)
    drop(found)
    windows, again, _ = _repeated(shared.where("f2 >= 0"), ["f1", "f2"])
    windows = windows.select("h", "dk", "pos", F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
    grams = shared.where("hi >= 0").select("h", "dk", "pos", "lo", "hi")
    repeated = grams.unionByName(windows)

    by_doc = repeated.groupBy("dk").agg(F.collect_set(F.struct("h", "pos", "lo", "hi")).alias("marks"))
    covered = store(by_doc.mapInArrow(_open_ends(length), "dk long, starts array<int>, ends array<int>, grams array<long>"), "covered")
    drop(again)
    wanted = store(covered.select(F.explode("grams").alias("__k0")).distinct(), "open-grams")
    partners = _among(grams, ["h"], wanted, many).groupBy("dk").agg(F.collect_set(F.struct("h", "pos", "lo", "hi")).alias("wanted")).withColumnRenamed("dk", "pk")
    # Repeated rows have one key, one set of marks for all of them and so one context for each.
    once = partners.join(covered.select(F.col("dk").alias("ck"), "grams"), F.col("pk") == F.col("ck"))
    cut = texts.join(once, F.col("dk") == F.col("pk")).select("dk", "text", "wanted", "grams")
    contexts = store(cut.mapInArrow(_contexts(length, bool(words)), "kh long, c1 long, c2 long, dk long, pos int, off int, n long, ctx binary"), "contexts")

    distinct = contexts.groupBy("kh", "c1", "c2").agg(F.first("ctx").alias("ctx"), F.first("off").alias("off"), F.sum("n").alias("n"))
    sizes = contexts.select("kh", "c1", "c2").distinct().groupBy(F.col("kh").alias("gk")).agg(F.count("*").alias("size"))
    distinct = store(distinct.join(sizes, F.col("kh") == F.col("gk")).drop("gk"), "distinct-contexts")
    n_buckets = max(1, distinct.count() // 1000)
    shape = "c1 long, c2 long, most int, least int"
    solved = distinct.where(F.col("size") <= hot).withColumn("bucket", F.pmod(F.xxhash64("kh"), F.lit(n_buckets))).groupBy("bucket").applyInPandas(_sort_bucket(length, gram, kind), shape)
    busy = distinct.where(F.col("size") > hot)
    if busy.take(1):
        each = busy.mapInArrow(_windows(length, kind), "c1 long, c2 long, n long, l int, w1 long, w2 long")
        each = store(each, "windows")
        again = each.groupBy(F.col("w1").alias("x1"), F.col("w2").alias("x2")).agg(F.sum("n").alias("times")).where("times > 1")
        hits = each.join(again, (F.col("w1") == F.col("x1")) & (F.col("w2") == F.col("x2")), "left_semi")
        solved = solved.unionByName(hits.groupBy("c1", "c2").agg(F.max("l").cast("int").alias("most"), F.min("l").cast("int").alias("least")))
    solved = solved.withColumnsRenamed({"c1": "s1", "c2": "s2"})
    ends = contexts.where("dk is not null").join(solved, (F.col("c1") == F.col("s1")) & (F.col("c2") == F.col("s2"))).select("dk", F.struct((F.col("pos") - F.col("most")).alias("s"), (F.col("pos") - F.col("least") + length).alias("e")).alias("part"))
    stretches = covered.select("dk", F.explode(F.arrays_zip("starts", "ends")).alias("x")).select("dk", F.struct(F.col("x.starts").alias("s"), F.col("x.ends").alias("e")).alias("part"))
    parts = ends.unionByName(stretches).groupBy("dk").agg(F.collect_list("part").alias("parts"))

    def union(batches):
        for batch in batches:
            rows = [merge([p["s"] for p in parts], [p["e"] for p in parts]) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("dk"), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["dk", "starts", "ends"])

    out = store(parts.mapInArrow(union, "dk long, starts array<int>, ends array<int>"), "spans")
    for table in (shared, covered, wanted, contexts, distinct):
        drop(table)
    return out


@F.arrow_udf(BinaryType())
def _rest(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """The bytes outside the intervals; null where there are no intervals."""
    out = []
    for text, s, e in zip(texts, starts.to_pylist(), ends.to_pylist(), strict=True):
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        out.append(b"".join(raw[x:y] for x, y in zip([0, *e], [*s, len(raw)], strict=True)) if s else None)
    return pa.array(out, pa.binary())


_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


@F.arrow_udf(StringType())
def _rest_of_words(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """The text without the words inside the intervals and the white space after them; null where there are no intervals."""
    out = []
    for text, s, e in zip(texts, starts.to_pylist(), ends.to_pylist(), strict=True):
        if not s:
            out.append(None)
            continue
        raw = text.as_buffer().to_pybytes()
        at = [*(m.start() for m in _WORD.finditer(raw)), len(raw)]
        cut = [(at[a], at[b]) for a, b in zip(s, e, strict=True)]
        out.append(b"".join(raw[x:y] for x, y in zip([0, *(y for _, y in cut)], [*(x for x, _ in cut), len(raw)], strict=True)).decode("utf-8", "ignore"))
    return pa.array(out, pa.string())


def _join_spans(keyed: DataFrame, **sizes: int) -> DataFrame:
    """All columns of a table stored in buckets of ``__dk`` and ``__starts, __ends``, null where nothing goes."""
    found = _spans(keyed, **sizes).select(F.col("dk").alias("__sk"), F.col("starts").alias("__starts"), F.col("ends").alias("__ends"))
    return keyed.join(found, F.col("__dk") == F.col("__sk"), "left").drop("__sk")


#: Python gets the texts that lose something only.
_CUT = lambda cut: cut(F.when(F.col("__starts").isNotNull(), F.col("text")), F.col("__starts"), F.col("__ends"))


def _keyed(docs: DataFrame) -> DataFrame:
    return store_by(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("__dk", _key()), "__dk", "keyed-documents")


def digests(docs: DataFrame, **sizes: int) -> DataFrame:
    """Bytes that go and what stays, by strings of ``length`` bytes; ``has_repeats`` tells the documents that lose any."""
    out = _join_spans(_keyed(docs), **sizes)
    out = out.select("doc_id", F.col("text").cast("binary").alias("text"), "__starts", _CUT(_rest).alias("rest"))
    n, rest = F.octet_length("text").cast("long"), F.coalesce("rest", "text")
    removed = (n - F.octet_length(rest)).cast("long")
    return out.select("doc_id", n.alias("n_bytes"), removed.alias("n_removed"), F.coalesce(F.size("__starts"), F.lit(0)).cast("long").alias("n_spans"), F.sha2(rest, 256).alias("kept_sha256"), (removed > 0).alias("has_repeats"))


def passage_words(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n_passage_words``: the words of each text that lie in a string of ``words`` words that starts anywhere else too.

    It reports only. A passage of over 50 words can have fewer than 400 bytes.
    """
    keyed = _keyed(docs)
    found = _spans(keyed, words=words).select(F.col("dk").alias("__pk"), F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y).alias("__words"))
    return keyed.join(found, F.col("__dk") == F.col("__pk"), "left").select("doc_id", F.coalesce("__words", F.lit(0)).cast("long").alias("n_passage_words"))


def strip_repeats(docs: DataFrame, **sizes: int) -> DataFrame:
    """docs with the texts that stay, whole characters only, and ``n_chars`` brought up to date; a null text stays null.

    By words (``words=51``: strings of over 50) nothing is cut inside a word; by bytes a character that is cut goes.
    """
    out = _join_spans(store_by(docs.withColumn("__dk", _key()), "__dk", "keyed-documents"), **sizes)
    rest = _CUT(_rest_of_words) if sizes.get("words") else _decode(_CUT(_rest))
    fixed = out.withColumn("__new", F.coalesce(rest, "text"))
    return fixed.select(*(F.col("__new").alias("text") if c == "text" else F.length("__new").cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes))


@F.arrow_udf(StringType())
def _decode(rest: pa.Array) -> pa.Array:
    """Bytes that a cut left of a character are dropped."""
    return pa.array([b.as_buffer().to_pybytes().decode("utf-8", "ignore") if b.is_valid else None for b in rest], pa.string())


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
