import random

import numpy as np
from cellspark.llm import minhash


def brute(rows, width=4):
    sets = []
    for _, text in rows:
        w = [x for x in "".join(c if c not in " \t\n\v\f\r" else " " for c in text or "").translate({c: c + 32 for c in range(65, 91)}).split(" ") if x]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    key = lambda d: -(2**63) if d is None else d
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), key(d)), key(d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = low[find(i)] if sets[i] else key(d)
        out.append((d, len(sets[i]), None if c == -(2**63) else c, key(d) == c))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [None, "", " \n", "a b", "A  B", "a b c d", "a b c d e", "é É x y z", "é É x y z", "one " * 50]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else "\n ".join(copy))
    drift = [word() for _ in range(150)]
    for _ in range(15):  # each version is near the one before only
        drift[rng.randrange(150)] = word()
        drift[rng.randrange(150)] = word()
        texts.append(" ".join(drift))
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


def test_same_components_as_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        rows += [rows[12], rows[12], (rows[20][0], rows[30][1]), (None, rows[14][1]), (None, None)]
        df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
        got = sorted((tuple(r)[:4] for r in minhash.classes(df).collect()), key=str)
        assert got == brute(rows)


def test_keep_one(spark):
    rows = [(5, "a b c d e f", "x", "en", 1), (3, "A b c d e f", "y", None, 2), (3, "A b c d e f", "y", None, 2), (7, None, None, None, None), (8, "", "z", "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, th int")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]


def test_keep_one_of_each_class_whatever_its_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(None, a), (2, a), (None, b), (3, b + " more"), (None, c), (9, d), (9, a + " " + b), (9, d), (None, None), (None, ""), (None, " "), (None, " ")]
    kept = sorted((tuple(r) for r in minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert kept == sorted([(None, a), (None, b), (None, c), (9, d), (9, a + " " + b), (None, None), (None, ""), (None, " ")], key=str)


def test_empty_table(spark):
    assert minhash.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    for n in (1, 5, 60, 3000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (minhash.signature(a) == minhash.signature(a.copy())).all()
        assert set(minhash.signature(a).tolist()) <= set(a.tolist())
    pool = rng.integers(0, 2**64, 1200, dtype=np.uint64)
    share = (minhash.signature(np.unique(pool[:1000])) == minhash.signature(np.unique(pool[200:]))).mean()
    assert abs(share - 800 / 1200) < 0.1


def test_sketches_exclude_no_link(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n in (1, 2, 9, 100, 900, 5000):
        for share in (0.3, 0.7, 0.8, 0.9, 1.0):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            k = int(np.ceil(n * 2 * share / (1 + share)))
            b = np.concatenate([a[:k], rng.integers(0, 2**63, n - k).astype(np.uint64)])
            common = len(np.intersect1d(a, b))
            rows.append((len(a), minhash.odd_sketch(a).tolist(), len(b), minhash.odd_sketch(b).tolist(), 100 * common >= 80 * (len(a) + len(b) - common)))
    pairs = spark.createDataFrame(rows, "n long, s array<long>, m long, t array<long>, link boolean")
    found = pairs.withColumn("may", minhash.may_link("n", "s", "m", "t", 80)).collect()
    assert all(r["may"] for r in found if r["link"]) and any(r["link"] for r in found)
    assert not any(r["may"] for r in found if r["n"] == 100 and len(np.intersect1d(r["s"], r["t"])) == 0)
