"""Relational shaping of feature tables."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Columns that describe an object but are no features of it.
META = ("label", "label_id", "centroid-0", "centroid-1", "bbox-0", "bbox-1", "bbox-2", "bbox-3", "image", "orientation", "nuc_id")
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame, drop: tuple[str, ...] = ()) -> list[str]:
    return [c for c, t in df.dtypes if (t in _NUMBERS or t.startswith("decimal")) and c not in drop]


def semi_filter(df: DataFrame, ids: DataFrame, key: str = "nuc_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def filter_inside(df: DataFrame, mask: DataFrame, key: str = "nuc_id", value: str = "int_mean") -> DataFrame:
    """Rows whose object has a positive mask mean."""
    return semi_filter(df, mask.where(F.col(value) > 0), key)


def mark(df: DataFrame, ids: DataFrame, column: str, yes: str = "positive", no: str = "negative", key: str = "nuc_id") -> DataFrame:
    """Existence join: ``yes`` for rows whose key is among the ids."""
    hit = ids.select(F.col(key).alias("_hit")).distinct()
    return df.join(hit, F.col(key) == F.col("_hit"), "left").withColumn(column, F.when(F.col("_hit").isNotNull(), yes).otherwise(no)).drop("_hit")


def attach(df: DataFrame, other: DataFrame, key: str = "nuc_id", how: str = "left") -> DataFrame:
    """Join on the key; columns that both have come from ``other``."""
    return df.drop(*(c for c in other.columns if c in df.columns and c != key)).join(other, key, how)


def clean_data(df: DataFrame, drop: tuple[str, ...] = META, legacy: bool = False) -> tuple[list[str], list[str]]:
    """Numeric columns that stay and those that go: without spread (``legacy``: a single value), or with any null.

    One aggregation over all columns; only its one row reaches the driver.
    """
    names = numeric_columns(df, () if legacy else drop)
    safe = lambda c: F.col(f"`{c}`")
    spread = (lambda c: F.min(safe(c)) < F.max(safe(c))) if legacy else (lambda c: F.coalesce(F.stddev_samp(safe(c)) > 0, F.lit(False)))
    row = df.agg(F.count("*").alias("n"), *(spread(c).alias(f"s{i}") for i, c in enumerate(names)), *(F.count(safe(c)).alias(f"c{i}") for i, c in enumerate(names))).first()
    kept = [c for i, c in enumerate(names) if row[f"s{i}"] and row[f"c{i}"] == row["n"] and c not in drop]
    return kept, [c for c in names if c not in kept]


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """``i, j, r``: absolute Pearson correlation of each pair of columns, i before j. One aggregation of sums."""
    means = df.agg(*(F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns))).first()
    centred = df.select(*((F.col(f"`{c}`").cast("double") - F.lit(means[i] or 0.0)).alias(f"z{i}") for i, c in enumerate(columns)))
    k = len(columns)
    places = [(i, j) for i in range(k) for j in range(i, k)]

    def gram(batches):
        """The sums of products of one task: as many rows as there are pairs of columns, however many rows came in."""
        total = np.zeros((k, k))
        for batch in batches:
            z = np.nan_to_num(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in places], pa.int32()), pa.array([q for _, q in places], pa.int32()), pa.array([total[p, q] for p, q in places], pa.float64())], ["i", "j", "v"])

    sums = centred.mapInArrow(gram, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("s"))
    own = sums.where("i = j")
    a, b = own.select(F.col("i").alias("ai"), F.col("s").alias("si")), own.select(F.col("i").alias("bj"), F.col("s").alias("sj"))
    pairs = sums.where("i < j").join(a, F.col("i") == F.col("ai")).join(b, F.col("j") == F.col("bj"))
    return pairs.select("i", "j", F.abs(F.try_divide("s", F.sqrt(F.col("si") * F.col("sj")))).alias("r"))


def correlated_columns(df: DataFrame, columns: list[str], threshold: float = 0.8) -> list[str]:
    """Columns with an earlier column over the threshold, whether or not that one stays."""
    gone = correlation_pairs(df, columns).where(F.col("r") > threshold).select("j").distinct().collect()
    return [columns[i] for i in sorted(r["j"] for r in gone)]


def align(df: DataFrame, kept: DataFrame, key: str = "nuc_id") -> DataFrame:
    return df.join(kept.select(key).distinct(), key)


def crosstab(df: DataFrame, rows: str, column: str, values: list[str]) -> DataFrame:
    """Counts of each value by row, 0 where there are none; the values are given, so no extra pass looks for them."""
    return df.groupBy(rows).pivot(column, values).count().na.fill(0, values)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def group_medians(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*(F.median(f"`{c}`").alias(c) for c in columns))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact count, mean, sample spread, extremes and quartiles: a row for each column."""
    long = df.select(*columns).unpivot([], columns, "feature", "v")
    out = long.groupBy("feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    # Quartiles by running counts of the distinct values, spread over tasks: no task holds the values of a column.
    counts = long.where("v is not null").groupBy("feature", "v").agg(F.count("*").alias("c"))
    upto = running(counts, [F.col("v").asc()], ("feature",), sums={"upto": F.col("c")}).join(F.broadcast(out.select(F.col("feature").alias("_f"), "n")), F.col("feature") == F.col("_f"))  # a row for each column
    at = lambda q: (F.col("n") - 1) * F.lit(q)
    ends = [F.min(F.when(F.col("upto") > side(at(q)), F.col("v"))).alias(f"{name}{i}") for i, q in enumerate((0.25, 0.5, 0.75)) for name, side in (("lo", F.floor), ("hi", F.ceil))]
    found = upto.groupBy(F.col("feature").alias("_f")).agg(*ends)
    between = lambda i, q: F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).otherwise((F.ceil(at(q)) - at(q)) * F.col(f"lo{i}") + (at(q) - F.floor(at(q))) * F.col(f"hi{i}")).cast("double")
    return out.join(found, F.col("feature") == F.col("_f"), "left").select("feature", "n", "mean", "std", "min", between(0, 0.25).alias("p25"), between(1, 0.5).alias("p50"), between(2, 0.75).alias("p75"), "max")


def group_mean_std_count(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores by the population spread; columns without spread become 0."""
    row = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    return df.withColumns({c: (F.col(c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0) for i, c in enumerate(columns)})


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which driver and executors share. Only where all runs in one process and none is set, a temporary one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cellspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialized(df: DataFrame) -> DataFrame:
    """Computed once and written as Parquet to the shared folder: plans stay short, also in loops, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of :func:`materialized` tables that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def joined_by_shuffle(spark: SparkSession) -> Iterator[None]:
    """No table is broadcast by the size of its files, only where a join asks for it. For the time of writes only."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def by_group(df: DataFrame, keys: list[str], columns: list[str], apply: Callable[..., list], schema: str) -> DataFrame:
    """``apply(key, *columns)`` for each group of rows, numpy arrays in and a list of arrays or numbers out; NaN becomes null.

    ``schema`` names the first keys, which are told of each row that a group returns, and then what ``apply`` returns. Tasks are
    sorted by the keys and run through batch by batch, so a small group costs one call and a task holds no more than a batch and a group.
    """
    fields = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields]

    def record(done: list[tuple[tuple, list]]) -> pa.RecordBatch:
        arrays = [[np.atleast_1d(a) for a in out] for _, out in done]
        n_keys = len(fields) - len(arrays[0])
        of = pa.array(np.repeat(np.arange(len(done)), [len(a[0]) for a in arrays]))
        told = [pa.array([key[i] for key, _ in done], fields[i][1]).take(of) for i in range(n_keys)]
        found = [pa.array(np.concatenate([a[i] for a in arrays]), from_pandas=True).cast(kind) for i, (_, kind) in enumerate(fields[n_keys:])]
        return pa.RecordBatch.from_arrays([*told, *found], [name for name, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple = ()
        parts: list[list[np.ndarray]] = []
        whole = lambda: (key, apply(key, *(np.concatenate(p) for p in zip(*parts, strict=True))))
        for batch in batches:
            if not batch.num_rows:
                continue
            names, values = batch.columns[: len(keys)], [c.to_numpy(zero_copy_only=False) for c in batch.columns[len(keys) :]]
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for k in names:
                codes = k.dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(new)
            done = []
            for name, lo, hi in zip(zip(*(k.take(pa.array(starts)).to_pylist() for k in names), strict=True), starts, [*starts[1:], batch.num_rows], strict=True):
                if parts and name != key:
                    done.append(whole())
                    parts = []
                key = name
                parts.append([c[lo:hi] for c in values])
            if done:
                yield record(done)
        if parts:
            yield record([whole()])

    return df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """``v, label``: the least name of each node's component, by least labels of neighbours and jumps; edges: ``a, b`` of any type that has an order."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("o")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("o")))
    both = materialized(both.distinct())
    labels = both.groupBy("v").agg(F.least("v", F.min("o")).alias("label"))
    while True:
        labels = materialized(labels.select("v", "label"))
        heard = both.join(labels.select(F.col("v").alias("o"), F.col("label").alias("l")), "o").groupBy("v").agg(F.min("l").alias("l"))
        least = labels.join(heard, "v").select("v", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = labels.select(F.col("v").alias("jv"), F.col("label").alias("further"))
        labels = materialized(least.join(jump, F.col("label") == F.col("jv"), "left").select("v", F.least("label", F.coalesce("further", "label")).alias("label"), "old"))
        if not labels.where("label != old").take(1):
            return labels.select("v", "label")


def running(df: DataFrame, order: list[Column], keys: tuple[str, ...] = (), sums: dict[str, Column] | None = None, least: dict[str, Column] | None = None, previous: dict[str, Column] | None = None) -> DataFrame:
    """Running values over one order of all rows (within the keys, for sums): inclusive sums, inclusive minima, and values of the row before.

    Rows are sorted by ranges over all tasks, each range is run through by itself, and only one row of totals for each
    range meets in one place: no window holds the table. ``order`` must tell all rows apart.
    """
    sums, least, previous = sums or {}, least or {}, previous or {}
    columns = [F.col(f"`{c}`") for c in df.columns]
    inputs = {**{f"__s{i}": c for i, c in enumerate(sums.values())}, **{f"__l{i}": c for i, c in enumerate(least.values())}, **{f"__p{i}": c for i, c in enumerate(previous.values())}}
    order = [*(F.col(k).asc() for k in keys), *order]
    placed = df.withColumns(inputs).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialized(placed.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    inside = Window.partitionBy("__part").orderBy("__at")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumns({**{f"__rs{i}": F.sum(f"__s{i}").over(upto) for i in range(len(sums))}, **{f"__rl{i}": F.min(f"__l{i}").over(upto) for i in range(len(least))}, **{f"__rp{i}": F.lag(f"__p{i}").over(inside) for i in range(len(previous))}, "__first": F.row_number().over(inside) == 1})
    totals = placed.groupBy(F.col("__part").alias("__tp")).agg(F.count("*").alias("__n"), *(F.sum(f"__s{i}").alias(f"__ts{i}") for i in range(len(sums))), *(F.min(f"__l{i}").alias(f"__tl{i}") for i in range(len(least))), *(F.max_by(f"__p{i}", "__at").alias(f"__tt{i}") for i in range(len(previous))))
    earlier = Window.orderBy("__tp").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select("__tp", *(F.sum(f"__ts{i}").over(earlier).alias(f"__bs{i}") for i in range(len(sums))), *(F.min(f"__tl{i}").over(earlier).alias(f"__bl{i}") for i in range(len(least))), *(F.lag(f"__tt{i}").over(Window.orderBy("__tp")).alias(f"__bp{i}") for i in range(len(previous))))
    out = local.join(F.broadcast(totals), F.col("__part") == F.col("__tp"))
    out = out.withColumns({**{f"__rs{i}": F.coalesce(f"__bs{i}", F.lit(0)) + F.coalesce(f"__rs{i}", F.lit(0)) for i in range(len(sums))}, **{f"__rl{i}": F.least(f"__rl{i}", f"__bl{i}") for i in range(len(least))}, **{f"__rp{i}": F.when(F.col("__first"), F.col(f"__bp{i}")).otherwise(F.col(f"__rp{i}")) for i in range(len(previous))}})
    if keys and sums:
        start = out.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(*(F.min(F.col(f"__rs{i}") - F.coalesce(f"__s{i}", F.lit(0))).alias(f"__from{i}") for i in range(len(sums))))
        out = out.join(start, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys))))
    own = lambda i: F.col(f"__rs{i}") - F.col(f"__from{i}") if keys else F.col(f"__rs{i}")
    return out.select(*columns, *(own(i).alias(n) for i, n in enumerate(sums)), *(F.col(f"__rl{i}").alias(n) for i, n in enumerate(least)), *(F.col(f"__rp{i}").alias(n) for i, n in enumerate(previous)))


def numbered(df: DataFrame, order: list[Column], keys: tuple[str, ...] = (), name: str = "rn") -> DataFrame:
    """Numbers from 1 by the order, within the keys; a key may hold any share of the rows."""
    return running(df, order, keys, sums={name: F.lit(1).cast("long")})


def with_average_rank(df: DataFrame, value: str, keys: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """Ranks from 1 within the keys, ties sharing their mean: a running sum over the counts of distinct values. Null values have none."""
    ties = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__t"))
    ranks = running(ties, [F.col(value).asc()], keys, sums={"__upto": F.col("__t")})
    ranks = ranks.select(*(F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)), F.col(value).alias("__v"), (F.col("__upto") - F.col("__t") + (F.col("__t") + 1) / 2).alias(name))
    same = reduce(lambda x, y: x & y, [F.col(value) == F.col("__v"), *(F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys))])
    return df.join(ranks, same, "left").drop("__v", *(f"__r{i}" for i in range(len(keys))))


def top_per_group(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rn") <= n)


def group_share(df: DataFrame, group: str, part: str, value: object) -> DataFrame:
    """Share of each group's rows that belong to the part."""
    return df.groupBy(group).agg(F.avg(F.when(F.col(part) == value, 1.0).otherwise(0.0)).alias("share"))


def with_copy(df: DataFrame, column: str, name: str) -> DataFrame:
    """The rows, and all of them again under one name."""
    return df.unionByName(df.withColumn(column, F.lit(name)))


def minmax_by(df: DataFrame, key: str, value: str) -> DataFrame:
    ends = df.groupBy(F.col(key).alias("_k")).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return df.join(ends, F.col(key).eqNullSafe(F.col("_k"))).withColumn("scaled", F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_k", "_lo", "_hi")


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows by the order."""
    return df.orderBy(*order).limit(n)


def significant(df: DataFrame, p: str = "p_adj", alpha: float = 0.05) -> DataFrame:
    return df.where(F.col(p) < alpha)


def n_significant(df: DataFrame, p: str = "p_adj", alpha: float = 0.05) -> DataFrame:
    return df.agg(F.count_if(F.col(p) < alpha).alias("n_significant"))


def centroid_columns(columns: list[str]) -> tuple[str, str]:
    """The two columns of a place: ``centroid-0, centroid-1``, else ``centroid_0, centroid_1``, else the first two whose names hold ``centroid``."""
    for pair in (("centroid-0", "centroid-1"), ("centroid_0", "centroid_1")):
        if set(pair) <= set(columns):
            return pair
    named = [c for c in columns if "centroid" in c.lower()]
    if len(named) < 2:
        raise ValueError("no two columns hold a centroid")
    return named[0], named[1]
