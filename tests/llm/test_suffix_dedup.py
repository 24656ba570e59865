import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cellspark.llm import suffix_dedup as s


def brute(rows, length, words):
    raws = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (doc_id, *_), r in zip(rows, raws, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((doc_id, len(r), len(r) - len(rest), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(rest).hexdigest()))
    left = brute_words([t for _, t, *_ in rows], words)
    lost = sorted(((o[0], len((t or "").split()) - len(k)) for o, (_, t, *_), k in zip(out, rows, left, strict=True)), key=str)
    return sorted(((*o, o[2] > 0) for o in out), key=str), lost


def corpus(seed, length):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgé  \n") for _ in range(n))
    passages = [text(rng.randint(length // 2, 4 * length)) for _ in range(8)]
    rows = [(0, None), (1, ""), (2, "x"), (3, "q" * (3 * length)), (4, "ab" * (2 * length)), (5, text(length)), (6, text(length - 1))]
    for i in range(50):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p) + 1), 2))
            parts += [text(rng.randint(0, length)), rng.choice([p, p[a:b], p[a:], p[:b]])]
        rows.append((10 + i, "".join(parts)))
    return rows + [(70, rows[20][1]), (71, rows[20][1][: length + 5]), (20, rows[20][1]), (20, rows[20][1]), (20, rows[25][1]), (None, rows[30][1]), (None, rows[31][1])]


@pytest.mark.parametrize("seed, hot", [(1, 2000), (2, 3)])
def test_same_as_brute_force(spark, monkeypatch, seed, hot):
    """With hot 3 most grams are counted window by window, and with MANY 2 the keys of most rows are told."""
    length, gram = 40, 20
    monkeypatch.setattr(s, "MANY", hot)
    rows = corpus(seed, length)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, pos string")
    got = sorted((tuple(r) for r in s.digests(df, length=length, gram=gram, hot=hot).collect()), key=str)
    lost = sorted((tuple(r) for r in s.passage_words(df, words=4).collect()), key=str)
    assert (got, lost) == brute(rows, length, 4) and any(r[-1] for r in got) and any(r[-1] for r in lost)


def test_suffix_sorter():
    rng = np.random.default_rng(4)
    a = rng.integers(97, 99, 200).astype(np.uint8)
    start, group = rng.permutation(200), rng.integers(0, 3, 200)
    size = np.minimum(rng.integers(1, 40, 200), 200 - start)
    sorter = s.SuffixSorter(a)
    order = sorter.sort(start, size, group)
    keys = [(group[i], a[start[i] : start[i] + size[i]].tobytes()) for i in order]
    assert keys == sorted(keys)
    for i, k in list(enumerate(sorter.neighbours(order, start, size, group)))[1:]:
        (g, x), (h, y) = keys[i - 1], keys[i]
        want = 0 if g != h else next((j for j, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert k == want


def test_anchors_of_long_texts_span_segments(monkeypatch):
    a = np.random.default_rng(0).integers(0, 256, 5000).astype(np.uint8)
    prefix = s.prefix_hashes(a)
    whole = s.anchors(a, prefix, 40, 20)
    monkeypatch.setattr(s, "_SEGMENT", 700)
    parts = s.anchors(a, prefix, 40, 20)
    assert set(whole[0]) == set(parts[0])
    lo, hi = parts[1], parts[2]
    assert lo[0] == 0 and hi[-1] == 5000 - 40 and (lo[1:] == hi[:-1] + 1).all()


def test_strip_repeats_and_empty_table(spark):
    shared = "é" * 7 + "".join(chr(97 + i % 26) for i in range(60)) + "ü" * 9
    rows = [(1, "start " + shared, "s", "en", 5), (2, shared + " end", None, None, None), (3, None, "s", "en", 0), (4, "short", "s", "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    out = s.strip_repeats(docs, length=40, gram=20)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("start ", 6), 2: (" end", 4), 3: (None, None), 4: ("short", 5)}
    assert s.digests(docs.where("false")).count() == 0


def test_passages_of_words_below_the_bytes(spark):
    """A passage of 51 short words in two texts, set with other white space, is reported and nothing is removed."""
    words = [f"w{i}" for i in range(51)]
    rows = [(1, "a b " + " ".join(words) + " c"), (2, "\n".join(words)), (3, " ".join(words[:50])), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_passage_words for r in s.passage_words(docs).collect()} == {1: 51, 2: 51, 3: 0, None: 0}
    assert {(r.n_removed, r.has_repeats) for r in s.digests(docs).collect()} == {(0, False)}


def brute_words(rows, n):
    seen = Counter(tuple(w[i : i + n]) for t in rows for w in [(t or "").split()] for i in range(len(w) - n + 1))
    out = []
    for t in rows:
        w = (t or "").split()
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append([x for j, x in enumerate(w) if j not in gone])
    return out


def test_strings_of_words_same_as_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "be", "é", "word", "longer"]) + str(rng.randrange(40))
    passages = [[word() for _ in range(rng.randint(5, 30))] for _ in range(6)]
    texts = [None, "", "  ", "a " * 40, " ".join(passages[0][:10])]
    for _ in range(40):
        parts = [word() for _ in range(rng.randint(0, 12))] + rng.choice(passages)[rng.randint(0, 3) :] + [word() for _ in range(rng.randint(0, 12))]
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_chars int, dk string")
    got = {r.doc_id: r for r in s.strip_repeats(docs, words=10).collect()}
    assert [(got[i].text or "").split() for i in range(len(texts))] == brute_words(texts, 10)
    assert got[0].text is None and got[2].text == "  " and got[0].dk == "k"
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.values())
    assert sum(len((got[i].text or "").split()) < len((t or "").split()) for i, t in enumerate(texts)) > 20
