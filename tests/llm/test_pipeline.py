"""The five stages on a small corpus with planted cases, each held against plain Python."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def word(rng):
    return "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels, benchmark: poor texts, copies, near copies, a passage of 60 words in four texts, benchmark items."""
    rng, path = random.Random(11), str(tmp_path_factory.mktemp("pipeline"))
    prose = lambda n: [word(rng) for _ in range(n)]
    items = [(i, " ".join(prose(20))) for i in range(4)]
    rows, labels = [], []
    for i in range(160):
        words = prose(rng.randint(60, 120))
        if i % 8 == 7:
            words = [w + "##%%" for w in words]
        rows.append([i, " ".join(words)])
        if i % 2:
            labels.append((i, int(i % 8 != 7), 0))
    for i in range(8):
        rows.append([200 + i, rows[i][1]])
        near = rows[10 + i][1].split()
        near[20] = "zzz"
        rows.append([300 + i, " ".join(near)])
    passage = " ".join(prose(60))
    for i in (40, 41, 42, 44):
        rows[i][1] += "\n" + passage
    for i in (50, 51):
        rows[i][1] += " " + items[i - 50][1] + " end"
    rows += [[400, None], [401, ""], [None, " ".join(prose(80))], [None, " ".join(prose(80))]]
    table = [(d, t, "en", f"s{k % 3}", len(t or "")) for k, (d, t) in enumerate(rows)]
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def near_kept(rows):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else None for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    classes: dict = {}
    for i, (d, t) in enumerate(rows):
        key = find(i) if sets[i] else ("own", d, t)
        classes.setdefault(key, []).append((float("-inf") if d is None else d, t))
    return Counter(min(c, key=lambda x: (x[0], str(x[1])))[0] for c in classes.values()), len(classes)


def cut(texts, n):
    seen = Counter(tuple(w[i : i + n]) for t in texts for w in [(t or "").split()] for i in range(len(w) - n + 1))
    for t in texts:
        w = (t or "").split()
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        yield [x for j, x in enumerate(w) if j not in gone]


def test_stages_same_as_plain_python(spark, folder):
    import public_tokenizers
    from cellspark.llm import bpe, decontaminate

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    pairs = lambda df: sorted([(r.doc_id, r.text) for r in df.collect()], key=str)

    good = stages["quality_classifier"](spark, docs, folder)
    assert good.columns == columns
    before, after = pairs(docs), pairs(good)
    poor = [x for x in before if "##" in (x[1] or "")]
    assert not set(after) & set(poor) and set(before) - set(after) - set(poor) <= {(400, None), (401, "")}

    one = stages["minhash_near_dedup"](spark, good, folder)
    ids, n = near_kept(after)
    assert one.columns == columns and one.count() == n
    assert Counter(float("-inf") if d is None else d for d, _ in pairs(one)) == ids
    assert not {d for d, _ in pairs(one) if d and d >= 200 and d < 400}

    bare = stages["suffix_array_dedup"](spark, one, folder)
    was = {r.doc_id: r.text for r in one.where("doc_id is not null").collect()}
    nulls = [r.text for r in one.where("doc_id is null").collect()]
    want = dict(zip(was, list(cut([*was.values(), *nulls], 51)), strict=False))
    got = {r.doc_id: (r.text or "").split() for r in bare.where("doc_id is not null").collect()}
    assert bare.columns == columns and got == want
    assert all(len(was[i].split()) - len(got[i]) == 60 for i in (40, 41, 42, 44))

    clean = stages["benchmark_decontamination"](spark, bare, folder)
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = [x for x in pairs(bare) if not any(i in decontaminate.normalise(x[1]) for i in items)]
    assert clean.columns == columns and pairs(clean) == want and {50, 51} <= {d for d, _ in pairs(bare)} - {d for d, _ in pairs(clean)}

    enc = bpe.encoder(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    digest = lambda t: (len(ids := enc.encode_ordinary(t or "")), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((t or "").encode()).hexdigest())
    tokens = stages["byte_bpe"](spark, clean, folder)
    assert sorted([tuple(r) for r in tokens.collect()], key=str) == sorted([(d, *digest(t)) for d, t in want], key=str)

    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, tokens.collect()), key=str)


def test_empty_tables_and_further_columns(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table = spark.read.parquet(f"{folder}/{name}.parquet")
        extra = {"kd": table[table.columns[0]], "found_items": table[table.columns[0]], "h": table[table.columns[0]]} if name == "documents" else {}
        table.withColumns(extra).where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(12)
    docs = docs.withColumns({c: docs["doc_id"] for c in ("kd", "kt", "found_items", "h", "dk", "evidence", "host", "rest")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        assert all(r.kd == r.doc_id == r.found_items == r.dk == r.rest for r in out.collect())


