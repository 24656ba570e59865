"""Classification, its metrics, embedding and clustering."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frame


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 10, seed: int = 42) -> DataFrame:
    """``fold``: within each class rows go round the folds in the order of a seeded hash of their key."""
    return _numbered(df, label, key, seed).withColumn("fold", F.pmod(F.col("_rn") - 1, F.lit(folds)).cast("int")).drop("_rn")


def _numbered(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """``_rn``: numbers within each class by a seeded hash of the key; a class is spread over tasks."""
    return frame.numbered(df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))), [F.col("_h").asc(), F.col(key).asc()], (label,), "_rn").drop("_h")


def ordered_folds(df: DataFrame, label: str, key: str, folds: int = 10) -> DataFrame:
    """``fold``: within each class, consecutive shares of the rows in the order of their key (stratified, not shuffled)."""
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    rows = frame.numbered(df, [F.col(key).asc()], (label,), "_rn").join(sizes, F.col(label).eqNullSafe(F.col("_l")))
    # The first n % folds folds hold one row more.
    size, more = F.floor(F.col("_n") / folds), F.pmod(F.col("_n"), F.lit(folds))
    at = F.col("_rn") - 1
    fold = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return rows.withColumn("fold", fold.cast("int")).drop("_l", "_n", "_rn")


def undersample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of every class as the smallest has, by the order of a seeded hash."""
    least = df.groupBy(label).count().agg(F.min("count").alias("least"))
    return _numbered(df, label, key, seed).join(F.broadcast(least)).where(F.col("_rn") <= F.col("least")).drop("_rn", "least")  # one row


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def fold_scores(predictions: DataFrame, truth: str, predicted: str = "predicted") -> DataFrame:
    """``fold, accuracy, balanced_accuracy, f1_macro`` from out-of-fold predictions."""
    t, p = F.col(truth), F.col(predicted)
    ends = F.array(F.struct(t.alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (t == p).cast("int").alias("h")), F.struct(p.alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")))
    g = predictions.select("fold", F.explode(ends).alias("r")).groupBy("fold", "r.label").agg(F.sum("r.t").alias("t"), F.sum("r.p").alias("p"), F.sum("r.h").alias("h"))
    out = g.groupBy("fold").agg((F.sum("h") / F.sum("t")).alias("accuracy"), F.avg(F.try_divide("h", "t")).alias("balanced_accuracy"), F.avg(2 * F.col("h") / (F.col("t") + F.col("p"))).alias("f1_macro"))
    return out.select("fold", "accuracy", "balanced_accuracy", "f1_macro")


def score_summary(scores: DataFrame) -> DataFrame:
    """``score, avg, std, min, max`` of each score over the folds."""
    names = ["accuracy", "balanced_accuracy", "f1_macro"]
    return scores.unpivot([], names, "score", "v").groupBy("score").agg(F.avg("v").alias("avg"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def mean_fold_confusion(predictions: DataFrame, truth: str, predicted: str = "predicted") -> DataFrame:
    """Mean over the folds of each fold's confusion matrix with rows scaled to one; a label pair that a fold lacks counts as 0, a label that it lacks not at all."""
    counts = predictions.groupBy("fold", truth, predicted).agg(F.count("*").alias("n"))
    rows = counts.groupBy(F.col("fold").alias("_f"), F.col(truth).alias("_t")).agg(F.sum("n").alias("_n"))
    shares = counts.join(rows, (F.col("fold") == F.col("_f")) & F.col(truth).eqNullSafe(F.col("_t"))).groupBy(truth, predicted).agg(F.sum(F.col("n") / F.col("_n")).alias("s"))
    folds = rows.groupBy(F.col("_t").alias("_l")).agg(F.count("*").alias("_k"))
    return shares.join(folds, F.col(truth).eqNullSafe(F.col("_l"))).select(truth, predicted, (F.col("s") / F.col("_k")).alias("share"))


def confusion(df: DataFrame, truth: str, predicted: str, normalize: bool = False) -> DataFrame:
    out = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth))) if normalize else out


def report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    rows = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("h")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("r")).select("r.*")
    g = rows.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("claimed"), F.sum("h").alias("hits"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    g = g.withColumns({"precision": zero(F.try_divide("hits", "claimed")), "recall": zero(F.try_divide("hits", "support"))})
    return g.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))).select("label", "precision", "recall", "f1", "support")


def balanced_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    recalls = df.groupBy(truth).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("recall"))
    return recalls.agg(F.avg("recall").alias("balanced_accuracy"))


def roc_points(df: DataFrame, positive: str, score: str) -> DataFrame:
    """``score, fpr, tpr`` at each distinct score, from counts by score: the running sums are over scores, not rows.

    ``positive`` is a 0/1 column.
    """
    g = df.groupBy(F.col(score).alias("score")).agg(F.sum(positive).alias("p"), F.sum(1 - F.col(positive)).alias("n"))
    total = g.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    run = frame.running(g, [F.desc("score")], sums={"tp": F.col("p"), "fp": F.col("n")})
    return run.join(F.broadcast(total)).select("score", F.try_divide("fp", "all_n").alias("fpr"), F.try_divide("tp", "all_p").alias("tpr"))  # one row


def auc(points: DataFrame) -> DataFrame:
    """Area under the curve by trapezoids, from the origin on."""
    step = frame.running(points, [F.desc("score")], previous={"f0": F.col("fpr"), "t0": F.col("tpr")}).na.fill(0.0, ["f0", "t0"])
    return step.agg(F.sum((F.col("fpr") - F.col("f0")) * (F.col("tpr") + F.col("t0")) / 2).alias("auc"))


def mean_roc(df: DataFrame, positive: str, score: str, fold: str = "fold", points: int = 100) -> DataFrame:
    """``fpr, tpr, std``: the folds' curves, interpolated at ``points`` even places of the false-positive rate, and averaged; 0 at the origin and 1 at the end."""
    g = df.groupBy(F.col(fold).alias("f"), F.col(score).alias("score")).agg(F.sum(positive).alias("p"), F.sum(1 - F.col(positive)).alias("n"))
    total = g.groupBy(F.col("f").alias("tf")).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n")).where("all_p > 0 and all_n > 0")
    run = frame.running(g, [F.desc("score")], ("f",), sums={"tp": F.col("p"), "fp": F.col("n")}).join(F.broadcast(total), F.col("f") == F.col("tf"))  # one row for each fold
    # Segment between a score's point and the one before it.
    x1, y1 = F.col("fp") / F.col("all_n"), F.col("tp") / F.col("all_p")
    x0, y0 = (F.col("fp") - F.col("n")) / F.col("all_n"), (F.col("tp") - F.col("p")) / F.col("all_p")
    first, last = F.ceil(x0 * (points - 1) - 1e-9), F.floor(x1 * (points - 1) + 1e-9)
    seg = run.select("f", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.when(first <= last, F.sequence(first, last)).alias("at")).select("*", F.explode("at").alias("i"))
    x = F.col("i") / (points - 1)
    y = F.when(F.col("x1") > F.col("x0"), F.col("y0") + (x - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).otherwise(F.col("y1"))
    curve = seg.groupBy("f", "i").agg(F.max(y).alias("y"))  # where a curve rises straight up, its top counts
    ends = F.when(F.col("i") == 0, F.lit(0.0)).when(F.col("i") == points - 1, F.lit(1.0)).otherwise(F.col("y"))
    return curve.groupBy("i").agg(F.avg(ends).alias("tpr"), F.stddev_pop(ends).alias("std")).select((F.col("i") / (points - 1)).alias("fpr"), "tpr", "std")


def roc_one_vs_rest(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """``label, auc`` of each class against the rest; scores: class -> its score column."""
    parts = [auc(roc_points(df.withColumn("_y", (F.col(label) == c).cast("int")), "_y", s)).select(F.lit(c).alias("label"), "auc") for c, s in scores.items()]
    return reduce(DataFrame.unionByName, parts)


def _assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip").transform(df)


def _forest(seed: int, trees: int) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=trees, maxDepth=12, seed=seed, probabilityCol="_prob", predictionCol="_pred", rawPredictionCol="_raw")


def weighted(df: DataFrame) -> DataFrame:
    """Weights that balance the classes."""
    counts = df.groupBy(F.col("_y").alias("_c")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return df.join(F.broadcast(counts.join(F.broadcast(total)).select("_c", (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("_w"))), F.col("_y") == F.col("_c")).drop("_c")  # one row for each class


class _Fitted(dict):
    """Tables by name, made when they are first asked for; one call may make several."""

    def __init__(self, makers: dict[str, Callable[[], dict[str, DataFrame]]]):
        super().__init__()
        self.makers = makers

    def __missing__(self, name: str) -> DataFrame:
        self.update(self.makers[name]())
        return self[name]


def cross_validate(df: DataFrame, columns: list[str], label: str, key: str, folds: int = 10, seed: int = 42, balance: bool = True, trees: int = 100, shuffle: bool = True) -> dict[str, DataFrame]:
    """Out-of-fold predictions, scores by fold and importances of a forest fitted on all rows.

    The fold models give labels, probabilities and scores alike: ``folds`` forests for the predictions and what follows from them, one for
    the importances; either is fitted when a table that needs it is first asked for. With ``shuffle`` off, folds
    are shares in key order and only the rows that a fold's model is trained on are balanced.
    """
    names = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    coded = df.withColumn("_y", F.element_at(F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, float(i)))), F.col(label)))
    rows = weighted(_assembled(undersample(coded, label, key, seed) if balance and shuffle else coded, columns))
    rows = stratified_folds(rows, label, key, folds, seed) if shuffle else ordered_folds(rows, label, key, folds)
    rows = frame.materialized(rows.select(key, label, "_y", "_w", "_x", "fold"))

    def importance() -> dict[str, DataFrame]:
        final = _forest(seed, trees).fit(rows)
        return {"importance": df.sparkSession.createDataFrame(sorted(zip(columns, map(float, final.featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0])), "feature string, importance double")}

    def predictions_and_scores() -> dict[str, DataFrame]:
        train = lambda k: undersample(rows.where(F.col("fold") != k), label, key, seed) if balance and not shuffle else rows.where(F.col("fold") != k)
        parts = [_forest(seed, trees).fit(train(k)).transform(rows.where(F.col("fold") == k)) for k in range(folds)]
        back = F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("_pred") + 1).cast("int"))
        predictions = reduce(DataFrame.unionByName, parts).select(key, "fold", label, back.alias("predicted"), vector_to_array("_prob").alias("probabilities"))
        recall = predictions.groupBy("fold", label).agg(F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("r"))
        by_fold = recall.groupBy("fold").agg(F.avg("r").alias("balanced_accuracy"))
        summary = by_fold.agg(F.avg("balanced_accuracy").alias("mean"), F.stddev_pop("balanced_accuracy").alias("std"), F.min("balanced_accuracy").alias("min"), F.max("balanced_accuracy").alias("max"))
        return {"predictions": predictions, "folds": by_fold, "summary": summary, "scores": fold_scores(predictions, label), "confusion": mean_fold_confusion(predictions, label)}

    return _Fitted({"importance": importance, **dict.fromkeys(("predictions", "folds", "summary", "scores", "confusion"), predictions_and_scores)})


def fit_predict(train: DataFrame, test: DataFrame, columns: list[str], label: str, positive: str, key: str, seed: int = 42, trees: int = 100) -> DataFrame:
    """``test`` with the probability of the positive label, the predicted and the positive label; without training rows the first two are null."""
    if not train.take(1):
        return test.withColumns({"probability": F.lit(None).cast("double"), "predicted_positive": F.lit(None).cast("boolean"), "positive_label": F.lit(positive)})
    rows = weighted(_assembled(train.withColumn("_y", (F.col(label) == positive).cast("double")), columns))
    out = _forest(seed, trees).fit(rows).transform(_assembled(test, columns))
    return out.withColumns({"probability": vector_to_array("_prob")[1], "predicted_positive": F.col("_pred") == 1.0, "positive_label": F.lit(positive)}).drop("_x", "_raw", "_prob", "_pred")


def split_for_probability(cells: DataFrame, key: str = "nuc_id", share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training rows: ``share`` of the smaller B-cell class from each class of the non-interactors. Test rows: all other non-interactors and the interactors.

    Where a class has no non-interactors, nothing is trained on.
    """
    b = cells.where(F.col("cell_type").isin("DZ B-cells", "LZ B-cells"))
    away, near = b.where("influence = 'Non-T-cell interactors'"), b.where("influence = 'T-cell interactors'")
    size = away.agg(F.floor(share * F.least(F.count_if(F.col("cell_type") == "DZ B-cells"), F.count_if(F.col("cell_type") == "LZ B-cells"))).alias("size"))
    numbered = _numbered(away, "cell_type", key, seed).join(F.broadcast(size))  # one row
    return numbered.where(F.col("_rn") <= F.col("size")).drop("_rn", "size"), numbered.where(F.col("_rn") > F.col("size")).drop("_rn", "size").unionByName(near)


def embedding(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """Principal components of standardised columns. Not a neighbour embedding: those need libraries that are not here."""
    rows = _assembled(frame.standardize(df, columns), columns)
    out = PCA(k=k, inputCol="_x", outputCol="_e").fit(rows).transform(rows)
    return out.withColumn("e", vector_to_array("_e")).withColumns({f"e{i}": F.col("e")[i] for i in range(k)}).drop("_x", "_e", "e")


def clusters(df: DataFrame, columns: list[str], k: int = 4, seed: int = 42) -> DataFrame:
    """K-means clusters, the stand-in for density clusters."""
    rows = _assembled(df, columns)
    return KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(rows).transform(rows).drop("_x")


def n_clusters(df: DataFrame, column: str = "cluster") -> DataFrame:
    """Clusters without the label -1, which stands for noise."""
    return df.where(F.col(column) != -1).agg(F.count_distinct(column).alias("n_clusters"))
