import hashlib
import random
import zlib

import numpy as np
from cellspark.llm import periodic as p


def brute(words, least=12):
    """Every stretch and period by definition, without hashes, planes or lags of its own."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            e = s + q
            while e < n and words[e] == words[e - q]:
                e += 1
            if e - s >= max(least, 2 * q) and (s == 0 or words[s - 1] != words[s - 1 + q]):
                part = words[s:e]
                if not any(all(part[i] == part[i + d] for i in range(len(part) - d)) for d in range(1, q)):
                    out.append((s, e - s, q))
            s = max(s + 1, e - q) if e - s > q else s + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(seed=1):
    rng = random.Random(seed)
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 300, list("ab") * 6, list("ab") * 5 + ["a"], list("abc") * 4, list("aab") * 30, list("abcdef") * 2, list("abcdefg") * 2 + ["a"], list("abcdef") * 2 + list("xyz") + list("abcdef") * 2]
    for _ in range(250):
        words = []
        while len(words) < rng.randint(5, 120):
            part = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 14))]
            words += part * rng.randint(1, 5)
        out.append(words)
    return out


def test_runs_same_as_definition():
    found = 0
    for words in texts():
        got = p.runs(p.word_ids(words))
        assert got == brute(words), words
        found += len(got)
    assert found > 300


def test_stretches_and_planes():
    ids = np.array([5, 6, 7, 8, 9, 10, 1, 2, 3, 5, 6, 7, 8, 9, 10] + list(range(20, 60)))
    assert p.repeating_stretches(ids, 12) == []  # six words twice are two stretches of six
    ids = np.array(list(range(6)) * 2 + list(range(50, 90)))
    assert p.repeating_stretches(ids, 12) == [(0, 12)]
    assert p.lag_stretches(p.bit_planes(ids[:12]), 12, 6, 6) == [(0, 6)]


def test_a_long_text():
    words = [f"w{i % 700}" for i in range(3000)] + ["x"] * 4000 + [f"v{i}" for i in range(3000)]
    assert p.runs(p.word_ids(words)) == [(0, 3000, 700), (3000, 4000, 1)]


def reference(doc_id, text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            period = 1 + int((n - a) / (3 + g % 8))
            words = [words[i] if i < a else words[a + (i - a) % period] for i in range(n)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, None if not found else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_same_as_brute_force(spark, tmp_path):
    """Nulls, empty texts, repeated rows, columns named like results, other white space; one text in ten is rewritten."""
    rng = random.Random(3)
    rows = [(i, rng.choice([" ", "\n", "　 "]).join(w), "en", 7) for i, w in enumerate(texts(5))]
    rows += [(None, "a " * 40, None, None), (1000, None, "en", 1), (1001, "", None, None), (1002, " \t\n", "x", 2), (1003, "é " * 30, "x", 2), (1003, "é " * 30, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, collapsed string, n_runs int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in p.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((reference(d, t) for d, t, *_ in rows), key=str)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in rows) > 10


def test_collapse_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "go " * 20 + "on", 61), (2, None, None), (3, "as  it\nis", 9)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in p.collapse(docs).orderBy("doc_id").collect()] == [(1, "go on", 5), (2, None, None), (3, "as  it\nis", 9)]
    assert p.find_runs(docs.where("false")).count() == 0
