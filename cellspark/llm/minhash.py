"""Near-duplicate documents by one-permutation MinHash.

A document's set of 4-word shingles is hashed once; the hash range is cut into ``BINS`` bins, each
keeps its least hash, and empty bins copy from a bin chosen by a universal hash of the bin's
number and the attempt (optimal densification). Groups of ``ROWS`` bins make ``BANDS`` bucket keys.
Inside a bucket candidate edges form stars: every member meets the centre, the one that shares most
buckets with other documents, so that pairs stay linear in the members. Each edge is confirmed on
the full sets. Buckets that still hold several components get further centres from outside the
largest one, more of them each round, until no bucket holds two components with an
untried pair: no pair of a common bucket is lost and no bucket is cut short.

Most pairs of a bucket that are no link are told from their parities: each set carries, for ``SKETCH``
cells of hashes, whether it has an odd number of them there (an odd sketch). Cells that differ
are at most as many as the elements that differ, so a pair whose cells differ too often for the
limit is none. That test is exact, and pairs that pass it are held against each other in full.

Documents of equal sets are one node, so exact copies make no pairs; buckets of the same members are one. A pair at the limit of 80 %
shares a bucket with probability ``1 - (1 - 0.8**ROWS)**BANDS``, over 0.9999995.

Defined results: null and blank texts have no shingles and stay by themselves; fewer words than a
shingle's are one shingle; repeated rows each give a row; rows with a null ``doc_id`` take part and
count as the smallest id (their ``component_id`` is null, as is that of all that they reach).
Very long texts are worked on whole; other columns, also those named like results, are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, id_back, id_key, read_table, store

SHINGLE = 4
ROWS, BANDS = 6, 48
BINS = ROWS * BANDS
SKETCH = 1024
#: Links that a document tries in the first round.
FIRST = 4
#: Per cent of the union that the intersection must reach.
PERCENT = 80
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
MEMO = 300_000
#: Names beside those of any documents table.
_KEYS = ("__minhash_id", "__minhash_text", "__minhash_null")


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = SHINGLE, memo: _WordHash | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    memo = _WordHash() if memo is None else memo
    h = np.array([memo[w] for w in words], np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


@functools.lru_cache(maxsize=4)
def _probes(bins: int, attempts: int = 64) -> np.ndarray:
    """The bin that each empty bin tries at each attempt."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1_000_003) + np.arange(1, attempts + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    return (_mix(at) % np.uint64(bins)).astype(np.int64)


def signature(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Least hash of each bin, empty bins densified. hashes: sorted and not empty."""
    where = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    full = np.zeros(bins, bool)
    full[where[first]] = True
    out = np.zeros(bins, np.uint64)
    out[where[first]] = hashes[first]
    empty = np.flatnonzero(~full)
    if len(empty):
        probes = _probes(bins)
        good = full[probes[empty]]
        hit = good.any(axis=1)
        source = probes[empty, good.argmax(axis=1)]
        out[empty[hit]] = out[source[hit]]
        at = probes.shape[1]
        rest = empty[~hit]
        while len(rest):  # a nearly empty signature: go on with further attempts
            at += 1
            source = (_mix(rest.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(at * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(bins)).astype(np.int64)
            hit = full[source]
            out[rest[hit]] = out[source[hit]]
            rest = rest[~hit]
    return out


def bucket_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = sig.reshape(-1, rows)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for k in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, k])
    return key.view(np.int64)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity of the number of hashes in each cell, as bits of 64-bit integers."""
    return np.packbits(np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1).view(np.int64)


def may_link(n: str, sketch: str, n_other: str, sketch_other: str, percent: int) -> Column:
    """Whether two sets can reach the limit, by their sizes and by the cells in which their parities differ."""
    both = F.col(n) + F.col(n_other)
    differ = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(sketch)[i].bitwiseXOR(F.col(sketch_other)[i])) for i in range(SKETCH // 64)])
    return (100 * F.least(n, n_other) >= percent * F.greatest(n, n_other)) & (100 * (both - differ) >= percent * (both + differ))


def _sets(width: int):
    """mapInArrow function: size, digest, bucket keys and odd sketch of each document's set."""

    def run(batches):
        memo = _WordHash()  # of one task
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, low, keys, sketches = [], [], [], []
                for text in part.column("text"):
                    h = shingles(text.as_py(), width, memo)
                    sizes.append(len(h))
                    low.append(xxhash.xxh3_64_intdigest(h.tobytes()) - 2**63)
                    keys.append(bucket_keys(signature(h)) if len(h) else np.zeros(0, np.int64))
                    sketches.append(odd_sketch(h) if len(h) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("did"), part.column("th"), pa.array(sizes, pa.int64()), pa.array(low, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                    ["did", "th", "n_shingles", "low", "keys", "sketch"],
                )

    return run


def _confirm(width: int, percent: int):
    """mapInArrow function: keeps the edges whose full sets reach the limit."""

    def run(batches):
        memo = _WordHash()
        last: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                centre = b.as_py()
                if centre != last[0]:
                    last = (centre, shingles(centre, width, memo))
                x, y = shingles(a.as_py(), width, memo), last[1]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "same"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """``node, comp``: the least node that each end of the edges ``a, b`` reaches.

    Alternating large-star and small-star steps; stops when no edge moves.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    digest = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    now = store(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = digest(now)
    while True:
        pairs = both(now)
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = pairs.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        new = store(small, "edges")
        after = digest(new)
        drop(now)
        now = new
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    out = store(now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots), "labels")
    drop(now)
    return out


def _links(nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame | None:
    """The components ``node, comp`` that confirmed edges between nodes (sets) make, found by rounds of stars; None without edges.

    nodes: ``node, did, th, n_shingles, keys, sketch`` with one row for each distinct set; docs: ``did, th, text``.
    """
    rows = nodes.select("node", F.posexplode("keys").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = store(rows.join(sizes, "bucket").select("bucket", "node", "size"), "members")
    # The documents that share most buckets lead: a text that many were edited from is the natural centre.
    shared = members.groupBy("node").agg(F.sum(F.col("size") - 1).alias("shared"))
    facts = store(nodes.drop("keys").join(shared, "node"), "facts")
    heads = facts.select("node", F.col("did").alias("nid"), F.col("th").alias("nth"))
    texts = docs.select("did", "th", "text").dropDuplicates(["did", "th"]).join(heads, (F.col("did") == F.col("nid")) & (F.col("th") == F.col("nth"))).select("node", "text")
    texts = store(texts, "candidate-texts")

    same = members.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("d1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("d2"))
    once = same.groupBy("n", "d1", "d2").agg(F.min("bucket").alias("ob")).select("ob")
    open_rows = members.join(once, F.col("bucket") == F.col("ob"), "left_semi").select("bucket", "node").join(facts.select("node", "n_shingles", "shared", "sketch"), "node")
    open_rows = store(open_rows.select("bucket", "node", "n_shingles", "shared", "sketch", F.col("node").alias("comp"), F.lit(None).cast("long").alias("main")), "open")
    drop(members)

    def judged(pairs: DataFrame) -> DataFrame:
        left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        full = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
        return store(full.mapInArrow(_confirm(width, percent), "a long, b long, same boolean"), "judged")

    def reopened(rest: DataFrame, labels: DataFrame | None) -> DataFrame:
        """The rows of buckets that hold several components still, with ``comp`` and the bucket's largest, ``main``."""
        rest = rest.drop("comp", "main")
        if labels is None:
            rest = rest.withColumn("comp", F.col("node"))
        else:
            rest = rest.join(labels.select(F.col("node").alias("ln"), F.col("comp").alias("lc")), F.col("node") == F.col("ln"), "left").withColumn("comp", F.coalesce("lc", "node")).drop("ln", "lc")
        parts = rest.groupBy("bucket", "comp").agg(F.count("*").alias("n")).groupBy(F.col("bucket").alias("ab")).agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
        return store(rest.join(parts, F.col("bucket") == F.col("ab")).drop("ab"), "open")

    def settled(pairs: DataFrame, labels: DataFrame | None, tried: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
        """Labels and tried pairs after the pairs are held against each other in full."""
        if not pairs.take(1):
            return labels, tried
        found = judged(pairs)
        seen = found.where("not same").select(F.least("a", "b").alias("tl"), F.greatest("a", "b").alias("th"))
        return _relabel(labels, found.where("same").select("a", "b")), seen if tried is None else tried.unionByName(seen)

    # First each member meets its bucket's centre, and tries the FIRST centres that share most.
    centre = open_rows.groupBy(F.col("bucket").alias("cb")).agg(F.max(F.struct("shared", "node", "n_shingles", "sketch")).alias("c")).select("cb", F.col("c.shared").alias("sb"), F.col("c.node").alias("b"), F.col("c.n_shingles").alias("nb"), F.col("c.sketch").alias("kb"))
    near = open_rows.join(centre, (F.col("bucket") == F.col("cb")) & (F.col("node") != F.col("b")) & may_link("n_shingles", "sketch", "nb", "kb", percent))
    best = near.groupBy(F.col("node").alias("a")).agg(F.slice(F.sort_array(F.collect_set(F.struct("sb", "b")), False), 1, FIRST).alias("best")).select("a", F.explode("best").alias("x")).select("a", F.col("x.b").alias("b"))
    pairs = store(_once(best), "pairs")
    labels, tried = settled(pairs, None, None)
    drop(pairs)
    new = reopened(open_rows, labels)
    drop(open_rows)
    open_rows = new

    width_of_star = 16
    while open_rows.take(1):
        # Further centres for each bucket, none of its largest component, whose members are linked already;
        # row_number() <= k is cut down before the rows are dealt by bucket.
        order = Window.partitionBy("bucket").orderBy(F.desc("shared"), "node")
        outside = open_rows.where("comp <> main").select("bucket", "node", "shared")
        centres = store(outside.withColumn("k", F.row_number().over(order)).where(F.col("k") <= width_of_star).select(F.col("node").alias("c")).distinct(), "centres")
        # A centre meets the others of all its buckets, and is done.
        stars = open_rows.join(centres, F.col("node") == F.col("c"), "left_semi").select(F.col("bucket").alias("cb"), F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("comp").alias("comp_b"), F.col("sketch").alias("kb"))
        near = open_rows.join(stars, (F.col("bucket") == F.col("cb")) & (F.col("comp") != F.col("comp_b")) & may_link("n_shingles", "sketch", "nb", "kb", percent))
        pairs = _once(near.select(F.col("node").alias("a"), "b"))
        if tried is not None:
            pairs = pairs.join(tried, (F.least("a", "b") == F.col("tl")) & (F.greatest("a", "b") == F.col("th")), "left_anti")
        pairs = store(pairs, "pairs")
        labels, tried = settled(pairs, labels, tried)
        drop(pairs)
        new = reopened(open_rows.join(centres, F.col("node") == F.col("c"), "left_anti"), labels)
        drop(open_rows)
        open_rows = new
        width_of_star *= 4
    drop(texts)
    return labels


def _once(pairs: DataFrame) -> DataFrame:
    """Of a pair that several buckets give, or both directions, one stays."""
    one = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("b").alias("b"))
    return one.select(F.when(F.col("b") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("a"), "b")


def _relabel(labels: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """Components after new edges: the edges join components, and those joins are resolved among themselves."""
    if not edges.take(1):
        return labels
    if labels is None:
        return components(edges)
    at = lambda side: labels.select(F.col("node").alias(f"n{side}"), F.col("comp").alias(f"c{side}"))
    lifted = edges.join(at("a"), F.col("a") == F.col("na"), "left").join(at("b"), F.col("b") == F.col("nb"), "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = components(lifted).select(F.col("node").alias("from"), F.col("comp").alias("to"))
    old = labels.join(moved, F.col("comp") == F.col("from"), "left").select("node", F.coalesce("to", "comp").alias("comp"))
    fresh = moved.join(labels, F.col("from") == F.col("node"), "left_anti").select(F.col("from").alias("node"), F.col("to").alias("comp"))
    return store(old.unionByName(fresh), "labels")


def classes(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each document, with ``th``, a hash of its text, and ``cls``, its class (null without shingles)."""
    base = docs.select(id_key().alias("did"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    sets = store(base.select("did", "th", "text").mapInArrow(_sets(width), "did long, th long, n_shingles long, low long, keys array<long>, sketch array<long>"), "sets")
    # One node for each distinct set, named by the set's hash; its text is that of its least document.
    rep = sets.where("n_shingles > 0").groupBy("low").agg(F.min(F.struct("did", "th")).alias("rep"))
    rep = store(rep.select(F.col("low").alias("node"), F.col("rep.did").alias("rid"), F.col("rep.th").alias("rth")), "reps")
    nodes = sets.join(rep, (F.col("low") == F.col("node")) & (F.col("did") == F.col("rid")) & (F.col("th") == F.col("rth"))).dropDuplicates(["node"]).select("node", "did", "th", "n_shingles", "keys", "sketch")
    labels = _links(nodes, base, width, percent)
    known = rep.select("node", "rid", F.col("node").alias("comp"))
    if labels is not None:
        known = rep.join(labels.withColumnRenamed("node", "ln"), F.col("node") == F.col("ln"), "left").select("node", "rid", F.coalesce("comp", "node").alias("comp"))
    least = known.groupBy("comp").agg(F.min("rid").alias("component")).withColumnRenamed("comp", "lc")
    known = known.join(least, F.col("comp") == F.col("lc")).select("node", "component", F.col("comp").alias("cls"))
    out = sets.select("did", "th", "n_shingles", "low").join(known, F.col("low") == F.col("node"), "left").withColumn("component", F.coalesce("component", "did"))
    return out.select(id_back("did").alias("doc_id"), "n_shingles", id_back("component").alias("component_id"), (F.col("did") == F.col("component")).alias("kept"), "th", "cls")


def keep_one(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The rows of docs, all columns, that stand for their class: of each class the least row by id and text's hash.

    Classes are told apart by themselves, not by the id of their least row: several may share one, or have none.
    Rows without shingles all stay; of rows with the same id and text one does.
    """
    leads = classes(docs, width).where("kept").select(id_key().alias(_KEYS[0]), F.col("th").alias(_KEYS[1]), "cls")
    linked = leads.where("cls is not null").groupBy("cls").agg(F.min(F.struct(*_KEYS[:2])).alias("k")).select("k.*")
    verdicts = linked.unionByName(leads.where("cls is null").select(*_KEYS[:2]))
    # An empty and a null text have one hash and are two rows.
    rows = docs.withColumns({_KEYS[0]: id_key(), _KEYS[1]: F.xxhash64(F.coalesce("text", F.lit(""))), _KEYS[2]: F.col("text").isNull()})
    return rows.join(verdicts, list(_KEYS[:2]), "left_semi").dropDuplicates(list(_KEYS)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents")).drop("th", "cls")
