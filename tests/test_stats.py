from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from cellspark.functions import special
from cellspark.operators import celltype, frame, ml, stats
from cellspark.plans import analysis, queries
from pyspark.sql import functions as F


def test_tails():
    assert special.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.t_two_sided(12.706, 1) == pytest.approx(0.05, abs=1e-4)
    assert special.t_two_sided([0.0, 1e9], [5, 5]).tolist() == pytest.approx([1, 0])
    assert special.normal_two_sided([1.959964])[0] == pytest.approx(0.05, abs=1e-6)
    assert special.log_gamma(np.array([1.0, 5.0, 0.5])) == pytest.approx([0, np.log(24), np.log(np.sqrt(np.pi))])


def test_fdr(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double")
    got = {r.i: r.p_adj for r in stats.adjust_fdr(df, "p", ["i"]).collect()}
    assert got == pytest.approx({1: 0.04, 2: 0.04 * 4 / 3, 3: 0.04 * 4 / 3, 4: 1.0})
    with pytest.raises(ValueError):
        stats.adjust_fdr(df, "p", ["i"], method="bonferroni")


def test_markers_against_direct_formula(spark):
    rng = np.random.default_rng(0)
    rows = [(f"l{i % 3}", f, float(rng.normal(i % 3 if f == "a" else 0, 1) + 1e6)) for i in range(90) for f in ("a", "b")] + [("tiny", "a", 1.0)]
    got = {(r.label, r.feature): r for r in stats.find_markers(spark.createDataFrame(rows, "label string, feature string, value double")).collect()}
    assert ("tiny", "a") not in got
    x = np.array([v for k, f, v in rows if f == "b" and k == "l0"])
    y = np.array([v for k, f, v in rows if f == "b" and k != "l0"])
    t = (x.mean() - y.mean()) / np.sqrt(x.var(ddof=1) / len(x) + y.var(ddof=1) / len(y))
    assert got["l0", "b"].statistic == pytest.approx(t, rel=1e-6)
    assert all(0 <= r.pval <= r.p_adj <= 1 for r in got.values())
    for test in ("mannwhitneyu", "wilcoxon"):
        assert stats.find_markers(spark.createDataFrame(rows, "label string, feature string, value double"), test=test).count() >= 6
    with pytest.raises(ValueError):
        stats.find_markers(spark.createDataFrame(rows, "label string, feature string, value double"), test="nope")


def test_permutation(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=40)
    rows = [("strong", float(v), float(v + rng.normal() * 0.1)) for v in x] + [("none", float(v), float(w)) for v, w in zip(x, rng.normal(size=40), strict=True)] + [("few", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "feature string, value double, target double")
    p = {r.feature: r.p for r in stats.permutation_p(df, 1000).collect()}
    assert p["strong"] == pytest.approx(1 / 1001) and p["none"] > 0.02 and "few" not in p
    assert p == {r.feature: r.p for r in stats.permutation_p(df, 1000).collect()}
    screen = stats.correlation_screen(df, 200).collect()
    assert screen[0].feature == "strong" and len(screen) == 2


def test_permutation_over_chunks(spark):
    """Rows over many chunks, the last one not full: p within the sampling error of whole shuffles, by values and by ranks."""
    for n in (1, 2, 3, 4, 5, 7, 64, 1000):
        assert sorted(stats.keyed_permutation(np.arange(n), n, 9)) == list(range(n))
    assert (stats.keyed_permutation(np.arange(1000), 1000, 1) != stats.keyed_permutation(np.arange(1000), 1000, 2)).mean() > 0.9
    rng = np.random.default_rng(8)
    data = {}
    for name, share in (("weak", 0.055), ("none", 0.0), ("odd", 0.05)):
        x = rng.normal(size=997) if name != "odd" else rng.exponential(size=997) ** 3
        data[name] = (x, share * x + rng.normal(size=997))
    df = spark.createDataFrame([(f, float(v), float(w)) for f, (x, y) in data.items() for v, w in zip(x, y, strict=True)], "feature string, value double, target double")
    for method in ("pearson", "spearman"):
        got = {r.feature: r.p for r in stats.permutation_p(df, 2000, method=method, block=256, chunk=64).collect()}
        for f, (x, y) in data.items():
            x, y = (v.argsort().argsort() + 1.0 if method == "spearman" else v for v in (x, y))
            x, y = x - x.mean(), y - y.mean()
            want = (np.abs(rng.permuted(np.broadcast_to(y, (4000, 997)), axis=1) @ x) >= abs(x @ y)).mean()
            assert abs(got[f] - want) < 5 * np.sqrt(want * (1 - want) * (1 / 2000 + 1 / 4000)) + 1e-3, (method, f)


def test_features_of_the_same_targets_share_shuffles(spark, monkeypatch):
    """A shuffle is made once for all features that have the same targets, in whatever order; each has the p of its own values (F21)."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 4, size=50).astype(float)
    rows = [(f"f{k}", float(v), float(w)) for k in range(5) for v, w in zip(0.1 * k * y + rng.normal(size=50), y, strict=True)]
    rows += [("twin", v, w) for f, v, w in rows if f == "f1"]
    rows = [rows[i] for i in rng.permutation(len(rows))] + [("other", float(v), float(v + rng.normal())) for v in rng.normal(size=30)]
    df = spark.createDataFrame(rows, "feature string, value double, target double")
    together = {r.feature: r.p for r in stats.permutation_p(df, 400, block=64, chunk=16).collect()}
    each = {}
    for f in together:
        each |= {r.feature: r.p for r in stats.permutation_p(df.where(F.col("feature") == f), 400, block=64, chunk=16).collect()}
    assert len(together) == 7 and together == each
    assert together["twin"] == together["f1"]  # by the very same shuffles
    monkeypatch.setattr(stats, "FEATURES", 2)  # in blocks of features
    assert {r.feature: r.p for r in stats.permutation_p(df, 400, block=64, chunk=16).collect()} == together


def test_mixture(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in np.concatenate([rng.normal(0, 1, 300), rng.normal(10, 1, 200)])] + [("one", 1.0), ("nan", float("nan")), ("null", None), ("same", 2.0), ("same", 2.0)]
    got = {r.image: r.threshold for r in celltype.mixture_thresholds(spark.createDataFrame(rows, "image string, int_mean double")).collect()}
    assert got["a"] == pytest.approx(5, abs=0.3) and got["same"] == pytest.approx(2) and "one" not in got and "nan" not in got
    assert celltype.mixture_thresholds(spark.createDataFrame(rows, "image string, int_mean double"), group=None).count() == 1


def test_mixture_takes_exact_values(spark):
    rng = np.random.default_rng(4)
    ties = np.round(np.concatenate([rng.normal(0, 1, 150), rng.normal(20, 2, 100)]), 1)
    pairs = [*np.linspace(1, 2, 50), *np.linspace(9, 10, 50)]
    # In steps of the range, the first group's thresholds differ by a half; the others take more than 16 values.
    for bins, groups in ((4096, {"outliers": [*pairs, 100.0, 1e4, 1e6], "ties": ties}), (16, {"outlier": [*pairs, 1e6], "ties": ties, None: [0.0] * 90 + list(range(50, 70)), "few": [1.0, 1.0, 5.0]})):
        df = spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values], "image string, int_mean double")
        got = {r.image: r.threshold for r in celltype.mixture_thresholds(df, bins=bins).collect()}
        for g, values in groups.items():
            v, n = np.unique(values, return_counts=True)
            assert got.pop(g) == pytest.approx(sum(celltype.mixture_means(n, v)) / 2, rel=1e-6)
        assert not got


def test_cd3_decides(spark):
    ids = spark.createDataFrame([("x",), ("y",), ("z",)], "nuc_id string")
    a, c = ids.where("nuc_id in ('x', 'y')"), ids.where("nuc_id = 'y'")
    assert {r.nuc_id: r.cell_type for r in celltype.assign_cell_types(ids, a, c).collect()} == {"x": "DZ B-cells", "y": "T-cells", "z": "LZ B-cells"}


def test_clean_and_prune(spark):
    df = spark.createDataFrame([("1_1", 1.0, 4.0, 1.0, "img1"), ("1_2", 2.0, 5.0, 1.0, "img1"), ("1_3", 3.0, 6.0, 1.0, "img1")], "nuc_id string, feature1 double, feature2 double, constant double, image string")
    assert frame.clean_data(df)[0] == ["feature1", "feature2"]
    assert frame.clean_data(df, legacy=True)[1] == ["constant"]
    rng = np.random.default_rng(3)
    f1, f2 = rng.normal(size=100), rng.normal(size=100)
    corr = spark.createDataFrame([(float(a), float(b), float(0.99 * a + 0.01 * b)) for a, b in zip(f1, f2, strict=True)], "feature1 double, feature2 double, feature3 double")
    assert frame.correlated_columns(corr, corr.columns) == ["feature3"]


def test_folds_cover_all_rows_once(spark):
    df = spark.range(57).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    folds = ml.stratified_folds(df, "y", "id", 5)
    assert folds.count() == 57 and {r.fold for r in folds.select("fold").distinct().collect()} == set(range(5))
    assert {r["count"] for r in ml.undersample(df, "y", "id").groupBy("y").count().collect()} == {19}


def test_forest_separates(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "p" if i % 2 else "q", float(rng.normal(4 * (i % 2))), float(rng.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "nuc_id long, kind string, a double, b double")
    cv = ml.cross_validate(df, ["a", "b"], "kind", "nuc_id", folds=3, trees=10)
    assert cv["summary"].first()["mean"] > 0.9 and cv["importance"].first().feature == "a" and cv["predictions"].count() == 120


def test_queries_leave_nothing_out(spark, monkeypatch):
    seen = {}
    note = lambda name, out: lambda df, *args, **own: seen.setdefault(name, []).append((*args, own)) or out(df)
    monkeypatch.setattr(ml, "cross_validate", note("forest", lambda df: {"folds": df, "importance": df}))
    monkeypatch.setattr(ml, "embedding", note("embedding", lambda df: df.withColumns({"e0": F.lit(0.0), "e1": F.lit(0.0), "cluster": F.lit(0)})))
    monkeypatch.setattr(ml, "clusters", lambda df, columns: df)
    monkeypatch.setattr(ml, "fit_predict", note("probability", lambda df: df.withColumn("probability", F.lit(0.0))))
    monkeypatch.setattr(stats, "correlation_screen", note("screen", lambda df: df))
    monkeypatch.setattr(analysis, "correlate_metadata", note("metadata", lambda df: {"correlation_results": df}))
    tables = {
        "embeddings": spark.createDataFrame([(1, 0, [float(k) for k in range(64)])], "vec_id long, label int, embedding array<float>"),
        "orders": spark.createDataFrame([(1, 2.0)], "o_custkey long, o_totalprice double"),
        "customer": spark.createDataFrame([(1, 3, 4.0, "name")], "c_custkey long, c_nationkey int, c_acctbal double, c_name string"),
    }
    cells = spark.createDataFrame([("i", 1, "T-cells", 0.0, 0.0)], "image string, id long, cell_type string, y double, x double")
    d = SimpleNamespace(table=tables.__getitem__, feat=spark.createDataFrame([("f", 1.0, 0)], "feature string, value double, label int"), cells=cells)
    for name in ("cross_validation", "feature_importance", "embedding_clusters", "dz_probability", "correlation_screen", "metadata_correlation"):
        getattr(queries, name)(d)
    every = [f"f{k}" for k in range(64)]
    assert seen["forest"] == [(every, "kind", "nuc_id", {})] * 2 and seen["embedding"] == [(every, {})]
    assert seen["probability"][0][-1] == {} and seen["screen"] == [({},)]
    assert seen["metadata"][0][0] == ["c_acctbal", "name_length"] and len(seen["metadata"][0]) == 3 and seen["metadata"][0][-1] == {}


def test_running_values_over_ranges(spark):
    rows = [(i % 3 if i % 7 else None, (i * 37) % 101, i) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, v int, i int").repartition(6)
    got = frame.running(df, [F.col("v").asc(), F.col("i").asc()], sums={"upto": F.col("v")}, least={"low": -F.col("i")}, previous={"before": F.col("i")}).collect()
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    want = {}
    for n, r in enumerate(order):
        want[r[2]] = (sum(x[1] for x in order[: n + 1]), min(-x[2] for x in order[: n + 1]), order[n - 1][2] if n else None)
    assert {r.i: (r.upto, r.low, r.before) for r in got} == want
    keyed = frame.numbered(df, [F.col("v").asc(), F.col("i").asc()], ("k",)).collect()
    for k in (None, 0, 1, 2):
        mine = [r[2] for r in order if r[0] == k]
        assert {r.i: r.rn for r in keyed if r.k == k} == {i: n + 1 for n, i in enumerate(mine)}
    assert frame.running(df.where("false"), [F.col("v").asc()], sums={"upto": F.col("v")}).count() == 0


def test_evaluation_variants(spark):
    rows = [(i, i % 10 // 2 % 3, "ab"[(i * 7) % 3 == 0], "ab"[(i * 5) % 4 == 0], ((i * 31) % 17) / 17) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, fold int, truth string, predicted string, score double")
    scores = {r.fold: r for r in ml.fold_scores(df, "truth").collect()}
    shares = {}
    for f in range(3):
        mine = [(t, p) for _, g, t, p, _ in rows if g == f]
        assert abs(scores[f].accuracy - np.mean([t == p for t, p in mine])) < 1e-12
        recall = [np.mean([p == c for t, p in mine if t == c]) for c in "ab"]
        f1 = [2 * sum(t == p == c for t, p in mine) / (sum(t == c for t, _ in mine) + sum(p == c for _, p in mine)) for c in "ab"]
        assert abs(scores[f].balanced_accuracy - np.mean(recall)) < 1e-12 and abs(scores[f].f1_macro - np.mean(f1)) < 1e-12
        for c in "ab":
            for q in "ab":
                shares.setdefault((c, q), []).append(np.mean([p == q for t, p in mine if t == c]))
    assert {(r.truth, r.predicted): round(r.share, 9) for r in ml.mean_fold_confusion(df, "truth").collect()} == {k: round(float(np.mean(v)), 9) for k, v in shares.items()}
    curve = {round(r.fpr * 10): r.tpr for r in ml.mean_roc(df.withColumn("y", (F.col("truth") == "b").cast("int")), "y", "score", points=11).collect()}
    want = np.zeros(11)
    for f in range(3):
        y, s = (np.array(x) for x in zip(*[(t == "b", s) for _, g, t, _, s in rows if g == f], strict=True))
        at = np.sort(np.unique(s))[::-1]
        fpr, tpr = [0.0, *((s[~y] >= a).mean() for a in at)], [0.0, *((s[y] >= a).mean() for a in at)]
        want += [max([t for x, t in zip(fpr, tpr, strict=True) if abs(x - g) < 1e-9], default=np.interp(g, fpr, tpr)) for g in np.linspace(0, 1, 11)]
    want = want / 3
    want[0], want[-1] = 0, 1
    assert np.allclose([curve[i] for i in range(11)], want)
    folds = ml.ordered_folds(df, "truth", "id", 4).collect()
    for c in "ab":
        ids = [r.fold for r in sorted(folds, key=lambda r: r.id) if r.truth == c]
        assert ids == sorted(ids) and max(ids.count(k) for k in range(4)) - min(ids.count(k) for k in range(4)) <= 1
    assert ml.accuracy(df, "truth", "predicted").first()[0] == np.mean([t == p for _, _, t, p, _ in rows])
    assert ml.n_clusters(spark.createDataFrame([(0,), (1,), (1,), (-1,)], "cluster int")).first()[0] == 2


def test_paired_and_rank_tests_of_two_groups(spark):
    rows = [("f", g, i, float((i * 13 + (g == "x") * 5) % 29)) for i in range(30) for g in "xy"]
    df = spark.createDataFrame(rows, "feature string, g string, id int, value double")
    (w,) = stats.group_difference(df, "g", "x", "y", "wilcoxon", "id").collect()
    d = np.array([a[3] for a in rows if a[1] == "x"]) - np.array([a[3] for a in rows if a[1] == "y"])
    ranks = pd.Series(np.abs(d[d != 0])).rank().to_numpy()
    assert w.statistic == min(ranks[d[d != 0] > 0].sum(), ranks[d[d != 0] < 0].sum()) and 0 < w.pval <= 1 and w.n1 == 30
    (u,) = stats.group_difference(df, "g", "x", "y", "mannwhitneyu").collect()
    assert u.statistic == sum((a[3] > b[3]) + 0.5 * (a[3] == b[3]) for a in rows if a[1] == "x" for b in rows if b[1] == "y")
    markers = stats.sorted_markers(stats.find_markers(df.withColumnRenamed("g", "label"))).collect()
    assert [m.p_adj for m in markers] == sorted(m.p_adj for m in markers)
    assert frame.centroid_columns(["a", "x_Centroid", "centroid_0", "centroid_1"]) == ("centroid_0", "centroid_1") and frame.centroid_columns(["My_centroid_y", "b", "centroidX"]) == ("My_centroid_y", "centroidX")


def test_probability_without_training_rows(spark):
    """All cells lie near T cells, or one class only lies apart: test rows stay, without a probability."""
    near, away = "T-cell interactors", "Non-T-cell interactors"
    for far in ([], [(9, "DZ B-cells", away, 9.0), (10, "DZ B-cells", away, 8.0)]):
        rows = [(i, "DZ B-cells" if i % 2 else "LZ B-cells", near, float(i)) for i in range(6)] + far
        train, test = ml.split_for_probability(spark.createDataFrame(rows, "nuc_id int, cell_type string, influence string, y double"))
        out = ml.fit_predict(train, test, ["y"], "cell_type", "DZ B-cells", "nuc_id").collect()
        assert sorted(r.nuc_id for r in out) == sorted(r[0] for r in rows) and all(r.probability is None for r in out)


def test_quartiles_by_running_counts(spark, monkeypatch):
    """No aggregate holds a column's values, and quartiles interpolate as before."""
    monkeypatch.setattr(F, "percentile", lambda *a: pytest.fail("percentile"))
    a, b = [float((i * 7) % 23) for i in range(50)], [float(i) if i % 3 else None for i in range(50)]
    got = {r.feature: r for r in frame.describe(spark.createDataFrame([(x, y, None) for x, y in zip(a, b, strict=True)], "a double, b double, none double"), ["a", "b", "none"]).collect()}
    for c, v in (("a", a), ("b", [x for x in b if x is not None])):
        assert got[c].n == len(v) and [got[c].p25, got[c].p50, got[c].p75] == pytest.approx(list(np.percentile(v, [25, 50, 75])))
    assert got["none"].n == 0 and got["none"].p50 is None
