import random

import numpy as np
import pytest
from cellspark.llm import decontaminate as d


def substring_distance(item, text):
    now = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(now[j] + 1, new[-1] + 1, now[j - 1] + (a != b)))
        now = new
    return min(now)


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "é"]) for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 40)))) for i in range(12)] + [(50, "ab c"), (51, "thonan ere")]
    texts = []
    for k in range(60):
        parts = [word() for _ in range(rng.randint(0, 120))]
        if k % 2:
            t = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, max(1, int(0.12 * len(t))))):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "QQ"])
            parts.insert(rng.randint(0, len(parts)), "".join(t).upper() if k % 3 else "".join(t).replace(" ", "\n  "))
        texts.append(" ".join(parts))
    return items, [*texts, "", None, "x" * 3000, items[0][1], (items[1][1] + " ") * 30]


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_same_as_brute_force(spark, block_bytes):
    items, texts = corpus()
    rows = [(i, t, [7]) for i, t in enumerate(texts)] + [(None, texts[1], None), (3, texts[3], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id array<int>")
    bench = spark.createDataFrame([*items, (99, None), (98, " "), (None, "some item text")], "item_id long, text string")
    got = [(r["doc_id"], r["text"], r["found_items"]) for r in d.find_items(docs, bench, block_bytes=block_bytes).collect()]
    assert len(got) == len(rows)
    hits = 0
    for doc_id, text, found in got:
        t, want = d.normalise(text), []
        for i, item in items:
            n = d.normalise(item)
            ok = b" " + n + b" " in b" " + t + b" " if len(n) < d.Q else substring_distance(n, t) <= d.edit_budget(len(n))
            want += [i] * ok
        assert found == want, (doc_id, text)
        hits += len(want)
    assert hits > 20


def test_banded_distance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        item, text = rng.integers(97, 99, rng.integers(1, 9)).astype(np.uint8), rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)
        assert d.banded_distance(item, text, -9, 13) == substring_distance(item.tolist(), text.tolist())


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "abc")], "doc_id long, text string"), spark.createDataFrame([(1, "abc")], "item_id long, text string")
    assert d.find_items(docs.where("false"), bench).count() == 0
    assert [r.found_items for r in d.find_items(docs, bench.where("false")).collect()] == [[]]
    assert d.keep_clean(docs, bench.where("false")).columns == docs.columns
