"""Alignment of the tokens of two tokenizers, relationally: cuts where both end, groups between cuts, links of overlapping tokens.

:func:`align` is the method itself, on any table of token lengths: tokens are posexploded and given windowed cumulative ends;
an equi-join on text and end finds the cuts; running cut counts number the groups; tokens of a group are linked by an equi-join on
blocks of 64 bytes and a check of the overlap, so that long groups don't pair all with all.

A corpus is aligned by its segments: a text falls apart wherever white space follows something else and neither vocabulary
has a token over that place (checked on the vocabularies), and each tokenizer encodes a segment in the text as it does by itself.
So :func:`segments` counts the distinct segments, only these are tokenised and aligned, and links are counted
with the segments' numbers of occurrences. :func:`documents` puts the texts together again: segments that make up at least a
``2**-21``-th of all occurrences (at most ``2**21`` of them, whose lengths add up to at most as many mean
lengths) are told to all tasks; the others, none of which is frequent, are joined.

Defined results: a text that is null or empty, or whose joined tokens differ from space + text in either tokenizer, has no tokens, all
zeros and an empty groups text, and its links count nowhere; a null ``doc_id`` is kept; repeated rows each
count and each give a row; very long texts are worked on by segments; counts that tie for a B id's highest are all best; an
empty table gives an empty one; other columns, also those named like results, are ignored.
"""

from __future__ import annotations

import contextlib
import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bound_batches, drop, drop_buckets, read_table, release, store, store_by, store_in_buckets

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Segments (and id pairs) of at least this share of all occurrences are told to all tasks; there are at most as many.
TOLD = 1 << 21
#: Bytes of a block in the join of overlapping tokens.
BLOCK = 64
#: Segments of a task of the alignment.
SEGMENTS = 100_000

#: White space as both tokenizers' patterns have it.
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: White space that no token of either vocabulary has behind something else.
_SAFE = r" \n\t"
_CUT = rf"(?=[{_SAFE}])(?<=[^{_SPACE}])"


@functools.lru_cache(maxsize=2)
def _first(path: str) -> tuple[Tokenizer, list[bytes]]:
    """The byte-level tokenizer and the bytes of each id."""
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    # The byte-level alphabet shows printable bytes as themselves and the others from U+0100 on, in order.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}
    special = {i for i, t in tok.get_added_tokens_decoder().items() if t.special}
    return tok, [b"" if i in special else bytes(byte[c] for c in tok.id_to_token(i)) for i in range(tok.get_vocab_size())]


@functools.lru_cache(maxsize=2)
def _second(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """The piece tokenizer and the bytes of each id. Raises if a piece lies over a place where texts are cut, or holds the line feed that keeps a segment apart."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    if any("\n" in p or re.search(r"[^\s▁][▁\n\t]", p) for p in pieces):
        raise ValueError("pieces of this vocabulary lie over white space, so its texts can't be cut there")
    return sp, [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for r in rows for x in r], kind))


def _tokenize(a_path: str, b_path: str):
    """mapInArrow function: adds ids and byte lengths of both tokenizers, and whether both give back the segment."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        (a_tok, a_bytes), (b_tok, b_bytes) = _first(a_path), _second(b_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column("seg").to_pylist()
                a = [e.ids for e in a_tok.encode_batch(texts, add_special_tokens=False)]
                # The model puts a space before a text; behind a line feed, which is a token by itself, the segment stands as inside a text.
                b = [ids[2:] for ids in b_tok.encode(["\n" + t for t in texts], num_threads=1)]
                raw = [t.encode() for t in texts]
                ok = [b"".join([a_bytes[i] for i in x]) == r == b"".join([b_bytes[i] for i in y]) for x, y, r in zip(a, b, raw, strict=True)]
                a, b = ([x if k else [] for x, k in zip(ids, ok, strict=True)] for ids in (a, b))
                columns = [_lists(a, pa.int32()), _lists([[len(a_bytes[i]) for i in x] for x in a], pa.int32()), _lists(b, pa.int32()), _lists([[len(b_bytes[i]) for i in y] for y in b], pa.int32()), pa.array(ok)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, "a_ids", "a_lens", "b_ids", "b_lens", "ok"])

    return run


def _segments(text: str = "text") -> Column:
    """The segments of space + text; null for texts without tokens."""
    return F.when(F.length(text) > 0, F.split(F.concat(F.lit(" "), F.col(text)), _CUT, -1))


def segments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``sid, seg, n, a_ids, a_lens, b_ids, b_lens, ok``: the distinct segments, their occurrences in texts that have tokens, and their tokens. Stored."""
    shape = "seg string, n long, sid long, a_ids array<int>, a_lens array<int>, b_ids array<int>, b_lens array<int>, ok boolean"
    counts = docs.select(F.explode(_segments()).alias("seg")).groupBy("seg").agg(F.count("*").alias("n")).withColumn("sid", F.monotonically_increasing_id())
    found = store(counts.mapInArrow(_tokenize(a_path, b_path), shape), "segments")
    odd = found.where("not ok").select("seg")
    if not odd.take(1):
        return found
    # Texts with a segment that a tokenizer changes have no tokens: theirs are counted again and taken away.
    keyed = docs.select(F.xxhash64("text").alias("h"), "text")
    hit = keyed.select("h", F.explode(_segments()).alias("seg")).join(odd, "seg", "left_semi").select("h").distinct()
    away = keyed.join(hit, "h", "left_semi").select(F.explode(_segments()).alias("away")).groupBy("away").agg(F.count("*").alias("m"))
    rest = store(found.join(away, F.col("seg") == F.col("away"), "left").withColumn("n", F.col("n") - F.coalesce("m", F.lit(0))).drop("away", "m"), "segments")
    drop(found)
    return rest


@contextlib.contextmanager
def co_partitioned(spark: SparkSession) -> Iterator[None]:
    """Joins on ``sid`` and more use rows that are dealt by ``sid`` as they lie. For the time of a write only."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _ends(tokens: DataFrame, side: str) -> DataFrame:
    each = tokens.select("sid", "n", F.posexplode(F.arrays_zip(F.col(f"{side}_ids").alias("id"), F.col(f"{side}_lens").alias("len"))).alias("pos", "t"))
    upto = Window.partitionBy("sid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.select("sid", "n", F.col("t.id").alias(side), F.col("t.len").alias("len"), F.sum("t.len").over(upto).alias("end")).select(F.col("sid").alias(f"{side}_sid"), F.col("n").alias(f"{side}_n"), side, (F.col("end") - F.col("len")).alias(f"{side}_start"), F.col("end").alias(f"{side}_end"))


def meet(tokens: DataFrame) -> DataFrame:
    """``sid, n, end, a, a_start, b, b_start``: every place of a text ``sid`` where a token ends, and the tokens of either side that end there.

    tokens: ``sid, n, a_ids, a_lens, b_ids, b_lens``; both sides of a text have the same total length. Dealt by ``sid`` already.
    """
    both = _ends(tokens, "a").join(_ends(tokens, "b"), (F.col("a_sid") == F.col("b_sid")) & (F.col("a_end") == F.col("b_end")), "full")
    return both.select(F.coalesce("a_sid", "b_sid").alias("sid"), F.coalesce("a_n", "b_n").alias("n"), F.coalesce("a_end", "b_end").alias("end"), "a", "a_start", "b", "b_start")


def align(met: DataFrame) -> DataFrame:
    """Rows of :func:`meet` with ``grp``, the group that they belong to: the places before at which both sides end."""
    before = Window.partitionBy("sid").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn("grp", F.coalesce(F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)).over(before), F.lit(0)))


def links(placed: DataFrame) -> DataFrame:
    """``sid, n, a, b, c``: how often tokens a and b of a text overlap. placed: rows of :func:`align`."""
    block = lambda c: F.floor(c / BLOCK)
    spread = lambda s: F.explode(F.sequence(block(F.col(f"{s}_start")), block(F.col("end") - 1))).alias("block")
    a = placed.where("a is not null").select("sid", "n", "grp", "a", "a_start", F.col("end").alias("a_end"), spread("a"))
    b = placed.where("b is not null").select("sid", "grp", "b", "b_start", F.col("end").alias("b_end"), spread("b"))
    pairs = a.join(b, ["sid", "grp", "block"]).where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.col("block") == block(F.greatest("a_start", "b_start"))))
    return pairs.groupBy("sid", "n", "a", "b").agg(F.count("*").alias("c"))


def group_texts(placed: DataFrame) -> DataFrame:
    """``sid, n_a, n_b, n_groups, groups``: the numbers of a text's tokens and groups, and the groups as ``a1,a2|b1;...``."""
    cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    each = placed.groupBy("sid").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count(F.when(cut, 1)).alias("n_groups"), F.sort_array(F.collect_list(F.struct("end", "a", "b"))).alias("s"))
    # A token's id, and behind it a semicolon where the other side ends too, which ends the group; the last token does.
    one = lambda s, o: F.transform("s", lambda x: F.when(x[s].isNotNull(), F.concat(x[s].cast("string"), F.when(x[o].isNotNull(), ";").otherwise(","))))
    listed = lambda s, o: F.split(F.rtrim(F.array_join(one(s, o), ""), F.lit(";")), ";")
    whole = F.array_join(F.zip_with(listed("a", "b"), listed("b", "a"), lambda a, b: F.concat(a, F.lit("|"), b)), ";")
    return each.select("sid", "n_a", "n_b", "n_groups", whole.alias("groups"))


def pair_counts(found: DataFrame) -> DataFrame:
    """``a, b, count, best, rows``: links of an id pair in the corpus, whether no pair of that b has more, and the rows of ``found`` that hold it. Stored."""
    counts = store(found.groupBy("a", "b").agg(F.sum(F.col("c") * F.col("n")).alias("count"), F.count("*").alias("rows")), "pair-counts")
    most = counts.groupBy(F.col("b").alias("mb")).agg(F.max("count").alias("most"))  # as many rows as the second vocabulary has ids
    return counts.join(F.broadcast(most), F.col("b") == F.col("mb")).select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"), "rows")


def _counted(found: DataFrame) -> DataFrame:
    """``sid, n_links, n_best, count_sum``. Pairs that hold a large share of the rows are told to all tasks, the others joined."""
    counts = store(pair_counts(found), "pair-counts")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    often = F.col("rows") * TOLD >= total
    side = counts.select(F.col("a").alias("ka"), F.col("b").alias("kb"), "count", "best", "rows")
    same = (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb"))
    told = found.join(F.broadcast(side.where(often)), same)
    rest = found.join(F.broadcast(side.where(often)), same, "left_anti").join(side.where(~often), same)
    return told.unionByName(rest).groupBy("sid").agg(F.sum("c").alias("n_links"), F.sum(F.when(F.col("best"), F.col("c")).otherwise(0)).alias("n_best"), F.sum(F.col("c") * F.col("count")).alias("count_sum"))


_SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def aligned_segments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``seg, n, n_a, n_b, n_groups, n_links, n_best, count_sum, groups, ok`` of each distinct segment. Stored in buckets of ``seg``."""
    spark = docs.sparkSession
    found = segments(docs, a_path, b_path)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), found.count() // SEGMENTS + 1)
    with co_partitioned(spark):
        dealt = found.where("ok").select("sid", "n", "a_ids", "a_lens", "b_ids", "b_lens").repartition(n, "sid")
        release(spark)
        # A full join's rows are where both sides were dealt, but Spark no longer knows it: from buckets they needn't be dealt again.
        met = store_in_buckets(meet(dealt), n, "sid", "met")
        release(spark)
        placed = store_in_buckets(align(met), n, "sid", "aligned")
        drop_buckets(met)
        linked, texts = store(links(placed), "links"), store(group_texts(placed), "group-texts")
    drop_buckets(placed)
    release(spark)
    counted = store(_counted(linked), "segment-links")
    drop(linked)
    release(spark)
    own = texts.join(counted.withColumnRenamed("sid", "cid"), F.col("sid") == F.col("cid")).drop("cid").withColumnRenamed("sid", "tid")
    out = found.select("sid", "seg", "n", "ok").join(own, F.col("sid") == F.col("tid"), "left")
    out = store_by(out.select("seg", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in _SUMS), F.coalesce("groups", F.lit("")).alias("groups"), "ok"), "seg", "aligned-segments")
    for t in (found, texts, counted):
        drop(t)
    release(spark)
    return out


def _regroup(batches):
    """mapInArrow function: one row for each text from the rows of its segments, which follow each other.

    ``parts``: the groups of told segments, joined between the others, whose segments are ``open``, in order.
    """
    kept: list[pa.RecordBatch] = []
    last = -1
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("rid").to_numpy()
        if ids[0] < last or (np.diff(ids) < 0).any():
            raise RuntimeError("rows of a text don't follow each other")
        last = int(ids[-1])
        if kept and kept[0].column("rid")[0].as_py() != ids[0]:
            yield _texts(pa.concat_batches(kept))
            kept = []
        cut = int(np.searchsorted(ids, last))  # rows of the last text may go on in the next batch
        if cut:
            yield _texts(pa.concat_batches([*kept, batch.slice(0, cut)]))
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield _texts(pa.concat_batches(kept))


def _texts(rows: pa.RecordBatch) -> pa.RecordBatch:
    ids = rows.column("rid").to_numpy()
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    groups, seg = rows.column("groups"), rows.column("seg")
    told, is_open = groups.is_valid().to_numpy(zero_copy_only=False), seg.is_valid().to_numpy(zero_copy_only=False)
    n_told, n_open = np.concatenate([[0], np.cumsum(told)]), np.concatenate([[0], np.cumsum(is_open)])
    # A part starts with each text and behind each open segment.
    at = np.sort(np.concatenate([first, np.flatnonzero(is_open) + 1]), kind="stable")
    of_part = pa.ListArray.from_arrays(pa.array(np.append(n_told[at], n_told[-1]).astype(np.int32)), groups.drop_null())
    joined = pc.binary_join(of_part, ";")
    opens = n_open[np.append(first, len(ids))]
    sums = [pa.array(np.add.reduceat(rows.column(c).fill_null(0).to_numpy(), first)) for c in _SUMS]
    ok = np.logical_and.reduceat(rows.column("ok").fill_null(True).to_numpy(zero_copy_only=False), first)
    did = rows.column("did").take(pa.array(first))
    parts = pa.ListArray.from_arrays(pa.array((opens + np.arange(len(opens))).astype(np.int32)), joined)
    rest = pa.ListArray.from_arrays(pa.array(opens.astype(np.int32)), seg.drop_null())
    return pa.RecordBatch.from_arrays([pa.array(ids[first]), did, *sums, pa.array(ok), parts, rest], ["rid", "did", *_SUMS, "ok", "parts", "open"])


def documents(docs: DataFrame, aligned: DataFrame, digest: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of each text from its segments (:func:`aligned_segments`); with ``digest``, ``groups_sha256`` instead of the groups."""
    spark = docs.sparkSession
    total = aligned.agg(F.sum("n")).first()[0] or 0
    release(spark)
    often = F.col("n") * TOLD >= total
    side = aligned.withColumnsRenamed({"seg": "key"})
    # An untold row keeps its segment; a text without tokens is one row without any.
    rows = docs.select(F.col("doc_id").cast("long").alias("did"), "text").withColumn("rid", F.monotonically_increasing_id()).select("rid", "did", F.explode_outer(_segments()).alias("seg"))
    near = rows.join(F.broadcast(side.where(often).drop("n")), F.col("seg") == F.col("key"), "left")
    near = near.select("rid", "did", F.when(F.col("key").isNull(), F.col("seg")).alias("seg"), *_SUMS, "groups", "ok")
    sums = ", ".join(f"{c} long" for c in _SUMS)
    # A text's row stays where it was read: the table's buckets are those of the tasks that read, and what is joined comes to them.
    part = F.shiftright("rid", 33).cast("int").alias("part")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = near.mapInArrow(_regroup, f"rid long, did long, {sums}, ok boolean, parts array<string>, open array<string>").select(part, "*")
    texts = store_in_buckets(whole, n, "part", "texts")
    release(spark)
    each = texts.select("rid", F.posexplode("open").alias("j", "seg"))
    found = each.join(side.where(~often).drop("n"), F.col("seg") == F.col("key"))
    dealt = found.select(part, "rid", "j", "groups", *_SUMS, "ok").repartition(n, "part")
    more = dealt.groupBy("part", F.col("rid").alias("mid")).agg(*(F.sum(c).alias(f"m_{c}") for c in _SUMS), F.min("ok").alias("m_ok"), F.transform(F.sort_array(F.collect_list(F.struct("j", "groups"))), lambda x: x["groups"]).alias("filled"))
    more = more.withColumnRenamed("part", "mpart")
    out = texts.join(more, (F.col("part") == F.col("mpart")) & (F.col("rid") == F.col("mid")), "left")
    # Parts and open segments take turns; where there are none of these, the one part is all.
    mixed = F.flatten(F.transform(F.arrays_zip("parts", F.coalesce("filled", F.array().cast("array<string>")).alias("filled")), lambda x: F.array(x["parts"], x["filled"])))
    joined = F.array_join(F.filter(mixed, lambda x: x.isNotNull() & (x != "")), ";")
    out = out.select("did", *((F.col(c) + F.coalesce(f"m_{c}", F.lit(0))).alias(c) for c in _SUMS), (F.col("ok") & F.coalesce("m_ok", F.lit(True))).alias("ok"), joined.alias("groups"))
    ok = F.col("ok")
    text = F.when(ok, F.col("groups")).otherwise(F.lit(""))
    last = F.when(text == "", F.lit("")).otherwise(F.sha2(text.cast("binary"), 256)).alias("groups_sha256") if digest else text.alias("groups")
    out = out.select(F.col("did").alias("doc_id"), *(F.when(ok, F.col(c)).otherwise(F.lit(0)).alias(c) for c in _SUMS), last)
    with co_partitioned(spark):
        out = store(out, "aligned-texts")
    drop_buckets(texts)
    return out


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    bound_batches(spark)
    return documents(docs, aligned_segments(docs, public_tokenizers.path(A_VOCABULARY), public_tokenizers.path(B_VOCABULARY)), digest=True)
