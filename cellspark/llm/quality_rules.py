"""Host-level quality rules: rule failures by domain, shrunk by an empirical beta prior.

Every document is measured and judged by the base rules; failures are summed by host (the
column ``source``), the hosts' failure rates give a beta prior by the method of moments, and a
host whose posterior mean rate is over ``max_rate`` loses its passing documents as well.

Defined results: null or empty texts have no words and fail the base rules; documents with a
null host form a host of their own; repeated rows each give a row; one host, or hosts of equal
rates, make a prior of strength ``MAX_STRENGTH``; other columns are ignored.
Very long texts are worked on whole; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, store

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host is refused if its shrunk failure rate is over this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength (pseudo-documents).
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0
WINDOW = 5

_SPACES = re.compile(rb"[\x20\x09-\x0D]")
_SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that are found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    if len(set(windows)) == n:
        return 0
    times = Counter(windows)
    covered, upto = 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered += at + width - max(at, upto)
            upto = at + width
    return covered


def measure_text(text: str | None) -> tuple[int, int, int, int, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    chars = len(text or "") - (len(raw) - len(raw.translate(None, b" \t\n\v\f\r")))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def _measure(batches):
    for batch in batches:
        rows = [measure_text(t.as_py()) for t in batch.column("text")]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "source", *(m.split()[0] for m in MEASURES.split(", "))])


def measure(docs: DataFrame) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return base.mapInArrow(_measure, f"doc_id long, source string, {MEASURES}").withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    )


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``source, n_docs, n_failed, rate, host_failed``: the beta prior's moments are those of the hosts' raw rates."""
    hosts = measured.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.avg(raw).alias("mean"), F.var_pop(raw).alias("var"))
    spread = F.try_divide(F.col("mean") * (1 - F.col("mean")), F.col("var")) - 1
    prior = moments.select("mean", F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), F.coalesce(spread, F.lit(MAX_STRENGTH)))).alias("strength"))
    rate = (F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return hosts.join(F.broadcast(prior)).select("source", "n_docs", "n_failed", rate.alias("rate"), (rate > max_rate).alias("host_failed"))  # one row of prior


def judge(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    measured = store(measure(docs), "quality-measures")
    hosts = host_verdicts(measured, max_rate).select(F.col("source").alias("host"), "host_failed", F.round("rate", 9).alias("host_rate"))
    return measured.join(hosts, measured["source"].eqNullSafe(hosts["host"])).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "host_rate")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT r, i, list_slice(ws, i, i + 4) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT d.doc_id, d.source, CAST(len(w.ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)
),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS k FROM b GROUP BY source),
p AS (SELECT avg(k / n) AS mu, greatest(1.0e0, least(1000.0e0, CASE WHEN var_pop(k / n) > 0 THEN avg(k / n) * (1 - avg(k / n)) / var_pop(k / n) - 1 ELSE 1000.0e0 END)) AS s FROM h),
v AS (SELECT source, (k + mu * s) / (n + s) AS rate FROM h, p)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5e0 AS kept, round(rate, 9) AS host_rate
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
