"""Feature tables: CSV and Parquet in, named results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cellspark.functions.scalar import nan_to_null


def read_features(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header, or Parquet by its name or that of its files; no column becomes an index, NaN becomes null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    if path.rstrip("/").endswith(".parquet") or files.load(path).select("path").take(1):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", "true")
        df = (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`").cast("double")) for c in doubles})


def optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that may be absent."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return read_features(spark, path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def rename_by_dictionary(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Columns renamed by ``feature -> long_name``; the dictionary has a row for each column."""
    return df.withColumnsRenamed({r["feature"]: r["long_name"] for r in dictionary.select("feature", "long_name").collect() if r["feature"] in df.columns and r["long_name"]})


def write_by_image(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite").partitionBy("image")
    (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(path)


def write_results(results: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One folder for each named result."""
    for name, df in results.items():
        df.write.mode("overwrite").option("header", "true").format(fmt).save(f"{folder}/{name}")
