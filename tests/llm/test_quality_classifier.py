import random

import numpy as np
from cellspark.llm import quality_classifier as q


def corpus(n=500):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < (0.9 if i % 10 == 9 else 0.1)
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        text = " ".join(w + "###" for w in words) if bad else " ".join(words) + "."
        rows.append((i, text, "poor" if i % 10 == 9 else f"s{i % 3}", "en" if i % 2 else None, len(text)))
        if i % 3:
            labels.append((i, int(not bad), "x"))
    return rows, labels


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def test_verdicts(spark):
    rows, labels = corpus()
    extra = [(None, rows[0][1], None, None, None), (1000, None, "s1", "en", 0), (1001, "", "s1", "en", 0), (1001, "", "s1", "en", 0)]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    got = q.judge(docs, marks).collect()
    assert len(got) == len(rows) + 4
    truth = {r[0]: "###" not in r[1] for r in rows}
    unlabelled = [r for r in got if r.doc_id in truth and r.doc_id % 3 == 0]
    assert np.mean([r.kept == truth[r.doc_id] for r in unlabelled]) > 0.98
    kept = q.keep(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(r.doc_id for r in got if r.kept and r.doc_id is not None)


def test_every_byte_of_a_long_text_counts():
    rng = random.Random(3)
    head = "".join(rng.choice("abcdefgh ") for _ in range(4096))
    noise = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    squeezed = lambda text: q.features(text)[-3]
    assert squeezed(head + "same again " * 2000) < squeezed(head) / 3 < squeezed(head + noise)
    assert squeezed("same again " * 400 + noise) > 3 * squeezed("same again " * 400)


def test_sparse_sites_stay_near_the_global_rate(spark):
    rows = [("a", "x", 3.0)] * 50 + [("b", "x", -3.0)] * 50 + [("c", "x", -3.0), ("c", None, 3.0)]
    sites = {(r.h, r.l): r.p_path for r in q.site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}
    assert sites["a", "x"] > 0.9 and sites["b", "x"] < 0.1
    assert sites["b", "x"] < sites["c", "x"] < 0.5 < sites["c", None]


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "s", "en", 1), (2, None, None, None, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.keep(docs, none).count() == 2
    assert q.judge(docs.where("false"), none).count() == 0 and q.keep(docs.where("false"), none).count() == 0


def plain(rows, labels):
    """Fit, posteriors and scores over all rows at once: numpy and dictionaries only. rows: ``(doc_id, text, source, lang)``."""
    quality = {}
    for d, v, *_ in labels:
        if d is not None and v is not None:
            quality[d] = max(v, quality.get(d, 0))
    x = np.array([q.features(t) for _, t, *_ in rows])
    known = [i for i, r in enumerate(rows) if r[0] in quality]
    y = np.array([float(quality[rows[i][0]]) for i in known])
    mean, scale = x[known].mean(axis=0), x[known].std(axis=0) + 1e-6
    z = np.minimum(np.maximum((x - mean) / scale, -8), 8)
    w, first, second = np.zeros(z.shape[1] + 1), 0.0, 0.0
    design = np.column_stack([z[known], np.ones(len(known))])
    for t in range(1, 301):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) / len(y) + 1e-3 * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w = w - 0.1 * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    evidence = np.clip(z @ w[:-1] + w[-1], -12, 12)
    p = 1 / (1 + np.exp(-evidence))
    sites, hosts = {}, {}
    for (_, _, h, l, *_), v in zip(rows, p, strict=True):
        sites.setdefault((h, l), []).append(v)
        hosts.setdefault(h, []).append(v)

    def strength(groups):
        rates = np.array([np.mean(g) for g in groups])
        spread = rates.mean() * (1 - rates.mean()) / rates.var() - 1 if rates.var() else np.inf
        return min(1000.0, max(1.0, spread))

    k_host, k_path, whole = strength(hosts.values()), strength(sites.values()), p.mean()
    odds = lambda v: np.log(v / (1 - v))
    inside = lambda v: min(max(v, 1e-6), 1 - 1e-6)
    out = []
    for (d, _, h, l, *_), e in zip(rows, evidence, strict=True):
        p_host = (sum(hosts[h]) + k_host * whole) / (len(hosts[h]) + k_host)
        p_path = inside((sum(sites[h, l]) + k_path * p_host) / (len(sites[h, l]) + k_path))
        score = 1 / (1 + np.exp(-(e + odds(p_path) - odds(inside(whole)))))
        out.append((d, 1 / (1 + np.exp(-e)), p_path, score))
    return out


def test_same_as_plain_numpy(spark):
    """Every score, with nulls, repeated rows, empty and very long texts, and sites of one document."""
    rows, labels = corpus(300)
    rows += [(None, rows[0][1], None, None, None), (1000, None, "s1", "en", 0), (1001, "", "s1", "en", 0), (1001, "", "s1", "en", 0), (1002, "very long text " * 40_000, "alone", "xx", 1), (1003, "### " * 9, "alone", None, 1)]
    labels += [(None, 1, "x"), (1001, 0, "x"), (1001, None, "x"), (5000, 1, "x"), (labels[0][0], 1 - labels[0][1], "x")]
    got = q.judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, text string")).collect()
    want = plain(rows, labels)
    order = lambda r: (str(r[0]), r[3])
    got = sorted(((r.doc_id, r.p_doc, r.p_path, r.score, r.kept) for r in got), key=order)
    assert [r[0] for r in got] == [r[0] for r in sorted(want, key=order)]
    for g, w in zip(got, sorted(want, key=order), strict=True):
        assert np.allclose(g[1:4], w[1:], rtol=1e-5, atol=1e-7), (g, w)
        assert g[4] == (g[3] >= q.THRESHOLD)


def test_a_score_at_the_threshold_is_kept(spark):
    rows = spark.createDataFrame([(1, "h", "p", 0.0)], "doc_id long, __host string, __path string, __evidence double")
    sites = spark.createDataFrame([("h", "p", 0.5, 0.0)], "h string, l string, p_path double, shift double")
    got = q._with_verdict(rows, sites).first()
    assert got["__score"] == 0.5 and (got["__score"] >= q.THRESHOLD) == (q.THRESHOLD <= 0.5)
