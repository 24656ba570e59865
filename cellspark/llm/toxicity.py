"""Toxicity scores by non-negative positive-unlabelled learning.

Positives are documents labelled toxic; all text together is the unlabelled sample. Spark counts, over every
document that may be learnt from, in how many of them each word of the positives stands; the words
that stand in more positives than chance allows are the features of a logistic model,
fitted in numpy on a bounded sample by the non-negative risk estimator
``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))`` with the class prior ``pi`` from the labels.

Bound (a documented parameter): ``MAX_FIT`` rows are fitted, a quarter of them positives, those of the least hashes.
Every word of those positives, of any length, is a candidate, and every one that passes is a feature: it stands in
``MIN_POSITIVES`` of them at least, ``MIN_LIFT`` times as often as elsewhere, and so often that by chance (a Poisson
bound over all candidates) ``CHANCE`` words would at most.
Held out are rows whose ``crc32(doc_id as text) mod 5`` is 0 (a null id counts as an empty
text); nothing of them, label or text, is learnt from.

Defined results: null and empty texts get the score of a document without features; without
positives every score is the prior (0 if there are no labels); repeated rows each give a row.
Very long texts are scored whole; other columns, also those named like results, are ignored; an empty table gives an empty one; a score of
one half is predicted as 1.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

FOLDS = 5
MAX_FIT = 20_000
#: A feature stands in at least so many positives, at least so many times the share elsewhere, and not by chance.
MIN_POSITIVES, MIN_LIFT, CHANCE = 3, 4.0, 1.0
#: Lengths of the beginnings of words that are features too: inflected forms share them.
PREFIXES = (4, 5)
#: The logistic loss is weighted so that a document without any feature scores below one half.
STEPS, RATE, DECAY = 600, 0.05, 1e-4

_EDGE = "0-9\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E"
_SPLIT = re.compile(rf"[\s{_EDGE}]+")


def words_of(text: str | None) -> set[str]:
    """Lower-case runs without white space, digits and ASCII punctuation, and their beginnings, marked by ``^``."""
    words = set(_SPLIT.split((text or "").lower()))
    words.discard("")
    return words.union(*(["^" + w[:k] for w in words if len(w) > k] for k in PREFIXES))


def _held_out(name: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


class Rows:
    """0/1 rows as the numbers of their features, one after the other."""

    def __init__(self, own: list[list[int]], width: int):
        self.n, self.width = len(own), width
        self.column = np.concatenate([np.asarray(o, np.int64) for o in own]) if own else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(self.n), [len(o) for o in own])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        """Sums of the rows' numbers by feature."""
        return np.bincount(self.column, weights=r[self.row], minlength=self.width)


def fit_weights(x: Rows | np.ndarray, positive: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Adam on the non-negative PU risk with logistic loss. x: 0/1 rows; positive: which rows are confirmed, the others being unlabelled."""
    if isinstance(x, np.ndarray):
        x = Rows([np.flatnonzero(row).tolist() for row in x], x.shape[1])
    w, b = np.zeros(x.width), np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    pull = np.zeros(x.n)
    for t in range(1, steps + 1):
        z = x.dot(w) + b
        zp, zu = z[positive], z[~positive]
        negative_part = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_plus, gp_minus, gu = (sigmoid(zp) - 1) / len(zp), sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
        if negative_part >= 0:
            pull[positive], pull[~positive] = prior * (gp_plus - gp_minus), gu
        else:  # the estimate fell below what a risk can be: step back from the part that overfits
            pull[positive], pull[~positive] = prior * gp_minus, -gu
        g = np.concatenate([x.back(pull) + decay * w, [pull.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def chosen(in_p: dict[str, int], in_all: dict[str, int], n_p: int, n_all: int) -> list[str]:
    """The words that mark positives.

    The chance of k or more where e are expected is at most ``exp(k - e) * (e / k) ** k``; it is held against ``CHANCE`` over all candidates.
    """
    least = np.log(max(len(in_p), 1) / CHANCE)
    out = []
    for w, k in in_p.items():
        e = n_p * in_all[w] / n_all
        if k >= MIN_POSITIVES and k >= MIN_LIFT * e and k * np.log(k / e) - (k - e) >= least:
            out.append(w)
    return sorted(out)


def _count_words(only: frozenset[str] | None):
    """mapInArrow function: in how many documents of each batch a word stands."""

    def run(batches):
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column("text"):
                own = words_of(text.as_py())
                counts.update(own if only is None else own & only)
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    return run


class Model:
    def __init__(self, words: list[str], weights: np.ndarray, bias: float):
        self.weights, self.bias = dict(zip(words, weights.tolist(), strict=True)), bias

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[w] for w in words_of(text) & self.weights.keys())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Model:
    """No text is shuffled: the ids of the positives that are fitted (``max_fit / 4`` at most) are broadcast, and so are their words."""
    learnt = docs.where(~_held_out()).select("doc_id", "text")
    marks = labels.where(~_held_out() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = marks.agg(F.count("toxic"), F.count_if(F.col("toxic") == 1)).first()
    prior = n_toxic / n if n else 0.0
    flat = Model([], np.zeros(0), float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))
    if not n_toxic:
        return flat

    # The rows of the least hashes: a repeated run fits the same ones.
    ids = marks.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit // 4).select(F.col("doc_id").alias("__label_of"))
    positives = learnt.join(F.broadcast(ids), F.col("doc_id") == F.col("__label_of")).select("doc_id", "text")
    found = positives.mapInArrow(_count_words(None), "word string, n long").groupBy("word").agg(F.sum("n").alias("in_p")).where(F.col("in_p") >= MIN_POSITIVES)
    in_p = {r["word"]: r["in_p"] for r in found.collect()}  # words of max_fit / 4 texts
    if not in_p:
        return flat

    # Document frequencies of the candidates over all that may be learnt from.
    n_p, n_all = positives.count(), learnt.count()
    totals = learnt.select("text").mapInArrow(_count_words(frozenset(in_p)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = chosen(in_p, {r["word"]: r["n"] for r in totals.collect()}, n_p, n_all)
    if not words:
        return flat
    place = {w: i for i, w in enumerate(words)}

    def features(batches):
        for batch in batches:
            own = [sorted(place[w] for w in words_of(t) & place.keys()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("u"), pa.array(own, pa.list_(pa.int32()))], ["u", "own"])

    def sample(rows: DataFrame, size: int, total: int) -> list[list[int]]:
        """``size`` rows at most; the hash is that of the row, so that rows of one id are not all in or all out."""
        rows = rows.select(F.xxhash64("doc_id", "text").alias("u"), "text")
        if total > size:
            rows = rows.where(F.pmod("u", F.lit(1_000_000)) < int(1_000_000 * 1.1 * size / total) + 1)
        return [r["own"] for r in rows.mapInArrow(features, "u long, own array<int>").orderBy(F.pmod("u", F.lit(1_000_000)), "u").limit(size).collect()]

    # The unlabelled sample is drawn from all text, confirmed or not: the risk estimator's prior is that of the whole.
    xp, xu = sample(positives, max_fit // 4, n_p), sample(learnt, max_fit - max_fit // 4, n_all)
    if not xp or not xu:
        return flat
    return Model(words, *fit_weights(Rows(xp + xu, len(words)), np.arange(len(xp) + len(xu)) < len(xp), prior))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each document."""

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), scores("text").alias("score"))
    return base.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
