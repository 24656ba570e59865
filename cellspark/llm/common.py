"""Shared helpers: shared-folder tables, row keys and document loading."""

from __future__ import annotations

import functools
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands in for a null doc_id inside joins; results turn it back into null.
NULL_ID = -(2**63)


#: Bytes of an Arrow batch between the JVM and a Python worker, of which both hold several copies at once.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes beside rows, as whole texts differ in size by four orders; a smaller bound of the session's stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and all run in one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cellspark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_in_buckets(rows: DataFrame, n: int, key: str, name: str) -> DataFrame:
    """:func:`store` in ``n`` buckets of a key. Rows that are dealt by it in ``n`` parts make a file each."""
    spark = rows.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/tables/{table}").bucketBy(n, key).saveAsTable(table)
    return spark.table(table)


def store_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """:func:`store` in buckets of a key, so that joins on it move the other side only."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return store_in_buckets(df.repartition(n, key), n, key, name)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`store` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_buckets(df: DataFrame) -> None:
    """:func:`drop` for a table of :func:`store_in_buckets`, and its name with it; of one without rows only the name stays."""
    tables = {f.split("/")[-2] for f in df.inputFiles()}
    drop(df)
    for table in tables:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")


def release(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go when the driver collects the plans that name them; between the phases of a long job this is now, not at some later time."""
    gc.collect()
    spark._jvm.System.gc()


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Rows numbered from 1 within the keys, by the order. DataFrame functions only, and no group is gathered.

    The rows are sorted by ranges over all tasks; a row's number is its place less that of its key's first row. Only
    the sizes of the tasks' ranges meet in one place.
    """
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id())
    ordered = store(ordered, "ordered")  # so that the places stay what they are
    part = F.shiftright("__at", 33)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row for each task
    placed = ordered.withColumn("__of", part).join(F.broadcast(before), F.col("__of") == F.col("__part")).withColumn("__place", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    first = placed.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min("__place").alias("__first"))
    same = functools.reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    return placed.join(first, same).select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__place") - F.col("__first") + 1).alias(name))


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_back(name: str) -> Column:
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name))
