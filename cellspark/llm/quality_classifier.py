"""Quality verdicts by hierarchical empirical Bayes over documents, paths and hosts.

A logistic model over text statistics, fitted in numpy on a bounded sample of labelled rows,
gives each document its evidence. The expected share of good documents is then summed by host
(``source``) and by path (host and ``lang``) in grouped aggregations; a path's rate is shrunk
toward its host's and a host's toward the global rate, each with a strength estimated from the
spread between groups, so that sparse sites stay near the global prior. A document's posterior
log odds are its evidence plus what its path's rate adds to the global prior.

Bound (a documented parameter): ``MAX_FIT`` labelled rows are fitted, those of the least hashes.

Defined results: null and empty texts are judged by the features of an empty text; null hosts
and languages are groups of their own; without labels of both kinds every document is kept;
repeated rows each give a row; other columns are carried by :func:`keep` and ignored otherwise.
Very long texts are measured whole; a score equal to the threshold is kept; an empty table gives an empty one. Standardised
features are clipped at 8 spreads and log odds at 12, so that no single document decides a site.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, store

MAX_FIT = 20_000
THRESHOLD = 0.5
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0

_LOWER, _UPPER = bytes(range(97, 123)), bytes(range(65, 91))
_CLASSES = (_LOWER, _UPPER, b"0123456789", b"#*$%&<>=~^@_+{}[]\\/", b"|", b"!?", b".,;:'\"-()", b" \t\n\r\v\f")


def features(text: str | None) -> list[float]:
    """Shares of character classes, of repeated words and lines, word lengths and size, and how far the whole text compresses."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw) + 1
    words = raw.split()
    k = len(words) + 1
    shares = [(len(raw) - len(raw.translate(None, c))) / n for c in _CLASSES]
    lines = [x for x in raw.split(b"\n") if x]
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    squeezed = len(zlib.compress(raw, 1)) / (len(raw) + 20)
    tails = sum(w[-1] in b"#*$%&!|" for w in words) / k
    return [*shares, 1 - distinct / k, 1 - (pairs + 1) / k, 1 - len(set(lines)) / (len(lines) + 1), len(raw) / k / 10, np.log1p(k) / 5, squeezed, tails, float(k < 10)]


class Model:
    """Standardised logistic regression."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 1e-3):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        self.w, self.b = np.zeros(z.shape[1]), 0.0
        m, v = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1)
        for t in range(1, steps + 1):
            r = 1 / (1 + np.exp(-np.clip(z @ self.w + self.b, -30, 30))) - y
            g = np.concatenate([z.T @ r / len(y) + decay * self.w, [r.mean()]])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            self.w, self.b = self.w - step[:-1], self.b - step[-1]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b, -12, 12)


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Model | None:
    """The sample is that of the least hashes, so that a repeated run fits the same rows. Only the ids of its labels are broadcast, ``max_fit`` at most."""
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality is not null and doc_id is not null")
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit).select(F.col("doc_id").alias("__label_of"), F.col("quality").cast("int").alias("__quality"))

    def run(batches):
        for batch in batches:
            rows = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("quality"), pa.array(rows, pa.list_(pa.float64()))], ["u", "quality", "x"])

    base = docs.select(F.col("doc_id").alias("__doc_id"), "text").join(F.broadcast(marks), F.col("__doc_id") == F.col("__label_of"))
    own = base.select(F.xxhash64("__doc_id", "text").alias("u"), "text", F.col("__quality").alias("quality"))
    rows = own.mapInArrow(run, "u long, quality int, x array<double>").orderBy("u").limit(max_fit).collect()
    y = np.array([float(r["quality"]) for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    return Model(np.array([r["x"] for r in rows]), y)


def _evidence(model: Model | None) -> Column:
    """The model's log odds of the column ``text``. Only texts go to Python, and only numbers come back."""
    if model is None:
        return F.lit(12.0)

    @F.arrow_udf("double")
    def evidence(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 1000):
            out.append(model.logits(np.array([features(t) for t in texts.slice(at, 1000).to_pylist()])))
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return evidence(F.col("text"))


def _strength(frame: DataFrame, rate: str) -> Column:
    """Prior strength by the method of moments on the spread of the groups' rates."""
    mean, var = F.avg(rate), F.var_pop(rate)
    spread = F.try_divide(mean * (1 - mean), var) - 1
    return F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), F.coalesce(spread, F.lit(MAX_STRENGTH))))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """``host, path, p_path, shift`` from ``host, path, evidence``: one row for each path."""
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("good")).withColumn("rate", F.col("good") / F.col("n"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n_host"), F.sum("good").alias("good_host"), F.count("*").alias("n_paths")).withColumn("rate_host", F.col("good_host") / F.col("n_host"))
    top = hosts.agg((F.sum("good_host") / F.sum("n_host")).alias("p_all"), _strength(hosts, "rate_host").alias("k_host"))
    inner = paths.agg(_strength(paths, "rate").alias("k_path"))
    hosts = hosts.join(F.broadcast(top)).withColumn("p_host", (F.col("good_host") + F.col("k_host") * F.col("p_all")) / (F.col("n_host") + F.col("k_host")))
    hosts = hosts.select(F.col("host").alias("h"), "p_all", "p_host")
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).join(F.broadcast(inner))  # top and inner are one row each
    p_path = (F.col("good") + F.col("k_path") * F.col("p_host")) / (F.col("n") + F.col("k_path"))
    odds = lambda c: F.log(c / (1 - c))
    inside = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    out = joined.withColumns({"p_path": inside(p_path), "p_all": inside(F.col("p_all"))})
    return out.select(F.col("host").alias("h"), F.col("path").alias("l"), "p_path", (odds(F.col("p_path")) - odds(F.col("p_all"))).alias("shift"))


def _with_verdict(evidence: DataFrame, sites: DataFrame) -> DataFrame:
    """Private columns ``__host, __path, __evidence`` in; ``__p_path, __score`` come along. A path of no site cannot occur."""
    sites = sites.select(*(F.col(c).alias(f"__site_{c}") for c in ("h", "l")), F.col("p_path").alias("__p_path"), F.col("shift").alias("__shift"))
    same = F.col("__host").eqNullSafe(F.col("__site_h")) & F.col("__path").eqNullSafe(F.col("__site_l"))
    return evidence.join(sites, same).withColumn("__score", 1 / (1 + F.exp(-(F.col("__evidence") + F.col("__shift")))))


def _judged(docs: DataFrame, labels: DataFrame, *columns: Column) -> DataFrame:
    """The columns with evidence and verdict beside them; each text goes to Python once."""
    model = fit(docs, labels)
    rows = store(docs.select(*columns, F.col("source").cast("string").alias("__host"), F.col("lang").cast("string").alias("__path"), _evidence(model).alias("__evidence")), "quality-evidence")
    sites = site_posteriors(rows.select(F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__evidence").alias("evidence")))
    return _with_verdict(rows, sites)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, p_doc, p_path, score, kept`` for each document."""
    out = _judged(docs, labels, F.col("doc_id").cast("long").alias("doc_id"))
    return out.select("doc_id", (1 / (1 + F.exp(-F.col("__evidence")))).alias("p_doc"), F.col("__p_path").alias("p_path"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that :func:`judge` keeps."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return _judged(docs, labels, *columns).where(F.col("__score") >= THRESHOLD).select(*columns)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
