import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from cellspark.llm import alignment as m
from tokenizers import Tokenizer

A, B = public_tokenizers.path(m.A_VOCABULARY), public_tokenizers.path(m.B_VOCABULARY)


def tokens(text):
    """``(id, start, end)`` of both sides of a whole text, straight from the libraries."""
    if not text:
        return [], []
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    a = [(i, bytes(byte[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    raw = (" " + text).encode()
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return [], []
    out = []
    for side in (a, b):
        at, own = 0, []
        for i, x in side:
            own.append((i, at, at + len(x)))
            at += len(x)
        out.append(own)
    return tuple(out)


def brute(rows):
    every, count = [], Counter()
    for doc_id, text, *_ in rows:
        a, b = tokens(text)
        linked = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 3000 else near(a, b)
        count.update(linked)
        every.append((doc_id, a, b, linked))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for doc_id, a, b, linked in every:
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(x[0]) for x in a if low < x[2] <= cut) + "|" + ",".join(str(y[0]) for y in b if low < y[2] <= cut))
            low = cut
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), len(cuts), len(linked), sum(count[p] == top[p[1]] for p in linked), sum(count[p] for p in linked), sha))
    return sorted(out, key=str)


def near(a, b):
    return [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]


SPACES = [" ", "  ", "\n", "\t", "\r\n", "\r", " \r", "\xa0", "　", "\n \n", " ", "\x1c", "\x85"]


def corpus():
    rng = random.Random(11)
    words = ["the", "naïve", "code();", "it's", "x86", "—", "日本語", "ﬁ①", "Straße", "<s>", "<|endoftext|>", "<0x0A>", "e\u0301", "😀👍", "12345", "aaaaaaaa", "';\r", "don't", "\x00", "{\r"]
    rows = []
    for i in range(120):
        rows.append((i, "".join(rng.choice(SPACES[:2] * 6 + SPACES) + rng.choice(words) + rng.choice(["", ",", rng.choice(words)]) for _ in range(rng.randint(0, 40))) + rng.choice(["", " ", "\n", "  \n"])))
    rows += [(200, None), (201, ""), (202, " "), (203, "has ▁ in it the code"), (204, "plain the code"), (None, "no id"), (None, "no id"), (5, rows[5][1]), (205, "x" * 5000), (206, "日本" * 700), (207, "the code " * 900), (208, "▁")]
    return rows


def test_same_as_brute_force(spark, tmp_path, monkeypatch):
    """Nulls, empty, very long and unbroken texts, texts that a tokenizer changes, repeated rows, clashing columns; with few segments told and with all."""
    rows = corpus()
    want = brute(rows)
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, groups string, n_a int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for told in (20, 1 << 20):
        monkeypatch.setattr(m, "TOLD", told)
        got = sorted((tuple(r) for r in m.op11_token_alignment(spark, str(tmp_path)).collect()), key=str)
        assert got == want
    assert sum(r[1] == 0 for r in want) == 4 + sum(not t for _, t in rows[:120])
    assert any(0 < r[5] < r[4] for r in want)


def test_segments_stand_alone():
    """Any text's tokens are those of its segments, on both sides."""
    import re

    space = m._SPACE.replace(r"\x{", "\\u{").replace("}", "")
    space = re.sub(r"\\u\{([0-9a-f]+)", lambda x: re.escape(chr(int(x[1], 16))), space)
    cut = re.compile(rf"(?=[{m._SAFE}])(?<=[^{space}])")
    tok, _ = m._first(A)
    sp, _ = m._second(B)
    rng = random.Random(2)
    letters = [*"abcst'the 12.;(){}*/,\"é日😀e\u0301", *SPACES, "\x00", "<s>"]  # a text with the piece model's own space sign has no tokens at all
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 30)))
        parts = cut.split(" " + text)
        assert tok.encode(" " + text, add_special_tokens=False).ids == [i for p in parts for i in tok.encode(p, add_special_tokens=False).ids], repr(text)
        assert sp.encode(text) == [i for p in parts for i in sp.encode("\n" + p)[2:]], repr(text)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert m.op11_token_alignment(spark, str(tmp_path)).collect() == []


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_stored_rows_are_not_dealt_again(spark):
    """Neither the rows of the full join for their running counts, nor the distinct segments for the texts."""
    tokens = spark.createDataFrame([(1, 1, [5, 6], [1, 2], [7], [3]), (2, 3, [5], [4], [8, 9], [2, 2])], "sid long, n long, a_ids array<int>, a_lens array<int>, b_ids array<int>, b_lens array<int>")
    with m.co_partitioned(spark):
        met = m.store_in_buckets(m.meet(tokens.repartition(4, "sid")), 4, "sid", "met")
        placed = m.align(met)
        assert exchanges(placed) == exchanges(m.group_texts(placed)) == 0
    assert sorted(m.group_texts(placed).collect()) == [(1, 2, 1, 1, "5,6|7"), (2, 1, 2, 1, "5|8,9")]
    m.drop_buckets(met)

    aligned = m.aligned_segments(spark.createDataFrame([(1, "the code the code")], "doc_id long, text string"), A, B)
    other = aligned.select(m.F.concat("seg", m.F.lit("")).alias("key"))
    assert exchanges(other.hint("merge").join(aligned, other.key == aligned.seg)) == 1
