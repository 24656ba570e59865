import random
import zlib

import numpy as np
from cellspark.llm import toxicity

BAD = ["idiot", "scum", "loser"]


def corpus(n=600):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(60)]
        if toxic:
            words[rng.randrange(60)] = rng.choice(BAD)
        rows.append((i, " ".join(words), i, "x"))
        if i % 2 == 0:
            labels.append((i, int(toxic), 1))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    truth = {i: any(b in t for b in BAD) for i, t, *_ in rows}
    docs = spark.createDataFrame([*rows, (None, "idiot", 1, "y"), (9000, None, 1, "y"), (9001, "", 1, "y"), (9001, "", 1, "y")], "doc_id long, text string, score long, label string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    assert len({r.score for r in got if r.doc_id in (9000, 9001)}) == 1


def test_risk_stays_useful_when_it_would_turn_negative():
    rng = np.random.default_rng(0)
    x = (rng.random((300, 20)) < 0.2).astype(float)
    positive = np.arange(300) < 30
    x[positive, 0] = 1
    w, b = toxicity.fit_weights(x, positive, 0.1)
    assert np.isfinite(w).all() and w[0] == w.max() and b < 0


def test_no_positives_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0, 0]
    empty = docs.where("false")
    assert toxicity.score(empty, toxicity.fit(empty, spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int"))).count() == 0


def plain(rows, labels):
    """Counts, choice of words, dense fit and scores over all rows at once."""
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 0
    toxic = {}
    for d, v, *_ in labels:
        if d is not None and v is not None and not held(d):
            toxic[d] = max(v, toxic.get(d, 0))

    def words(text):
        low = set()
        for w in "".join(" " if c.isspace() or (c.isascii() and not c.isalpha() and c >= " ") else c for c in (text or "").lower()).split(" "):
            if w:
                low |= {w} | {"^" + w[:k] for k in (4, 5) if len(w) > k}
        return low

    sets = [words(t) for _, t, *_ in rows]
    learnt = [i for i, r in enumerate(rows) if not held(r[0])]
    bad = [i for i in learnt if toxic.get(rows[i][0]) == 1]
    chosen = []
    candidates = [w for w in set().union(*(sets[i] for i in bad)) if sum(w in sets[i] for i in bad) >= 3]
    for w in candidates:
        k, e = sum(w in sets[i] for i in bad), len(bad) * sum(w in sets[i] for i in learnt) / len(learnt)
        if k >= 4 * e and np.exp(k - e) * (e / k) ** k <= 1 / len(candidates):
            chosen.append(w)
    chosen.sort()
    x = np.array([[float(w in s) for w in chosen] for s in sets])
    prior = sum(v == 1 for v in toxic.values()) / len(toxic)
    xp, xu = x[bad], x[learnt]
    theta = np.append(np.zeros(len(chosen)), np.log(prior / (1 - prior)))
    first = second = 0.0
    add = lambda a: np.column_stack([a, np.ones(len(a))])
    xp, xu = add(xp), add(xu)
    for t in range(1, 601):
        zp, zu = xp @ theta, xu @ theta
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        rest = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        if rest >= 0:
            g = prior * xp.T @ (sp - 1) / len(xp) + xu.T @ su / len(xu) - prior * xp.T @ sp / len(xp)
        else:
            g = prior * xp.T @ sp / len(xp) - xu.T @ su / len(xu)
        g = g + 1e-4 * np.append(theta[:-1], 0)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - 0.05 * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return [1 / (1 + np.exp(-z)) for z in add(x) @ theta]


def test_same_as_plain_numpy(spark):
    """Every score, with nulls, repeated rows, empty and very long texts, other letters and labels that disagree."""
    rows, labels = corpus(400)
    rows += [(None, "idiot", 1, "y"), (9000, None, 1, "y"), (9001, "", 1, "y"), (9001, "", 1, "y"), (9002, "quiet words " * 60_000 + "scum", 1, "y"), (9003, "IDIOT!scum\tnaïve—idiots", 1, "y")]
    labels += [(None, 1, 1), (labels[3][0], 1 - labels[3][1], 1), (9001, None, 1), (77777, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long, label string")
    got = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text int"))).collect()
    want = sorted(((str(r[0]), s) for r, s in zip(rows, plain(rows, labels), strict=True)))
    got = sorted((str(r.doc_id), r.score) for r in got)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-4, atol=1e-6)


def test_a_score_of_one_half_is_predicted(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert [(r.score, r.predicted) for r in toxicity.score(docs, toxicity.Model([], np.zeros(0), 0.0)).collect()] == [(0.5, 1)] * 2
