"""Views of the driver's tables in the shapes that the operators take, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "pix": "SELECT l_suppkey AS image, l_returnflag || l_linestatus AS label, l_quantity AS v FROM lineitem",
    "grid": "SELECT l_suppkey AS image, CAST(l_partkey % 16 AS INTEGER) AS y, CAST(l_orderkey % 16 AS INTEGER) AS x, floor(avg(l_quantity)) AS v FROM lineitem GROUP BY ALL",
    "obj": "SELECT image, y, x, v, CAST(CASE WHEN v > 15 THEN 1 + 2 * (y // 8) + x // 8 ELSE 0 END AS INTEGER) AS label FROM grid",
    "seeds": "SELECT image, y, x, CAST(CASE WHEN v > 40 THEN 1 + (y * 16 + x) % 5 ELSE 0 END AS INTEGER) AS label FROM grid",
    "cells": "SELECT p_brand AS image, p_partkey AS id, CAST(p_size AS DOUBLE) AS y, (p_retailprice - 900.0e0) * 0.5e0 AS x, CASE WHEN p_type LIKE 'PROMO%' THEN 'T-cells' WHEN p_type LIKE 'STANDARD%' OR p_type LIKE 'SMALL%' OR p_type LIKE 'ECONOMY%' THEN 'DZ B-cells' ELSE 'LZ B-cells' END AS cell_type FROM part",
    "b": "SELECT * FROM cells WHERE cell_type IN ('DZ B-cells', 'LZ B-cells')",
    "feat": "SELECT vec_id AS id, label, i - 1 AS feature, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "scored": "SELECT doc_id AS id, quality AS truth, toxic AS predicted, CAST((doc_id * 7919) % 997 AS DOUBLE) / 997.0e0 AS score FROM labels",
}
#: Views that a view stands on.
NEEDS = {"obj": ["grid"], "seeds": ["grid"], "b": ["cells"]}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """The SQL behind a WITH clause that defines the views."""
    order: list[str] = []
    for n in names:
        order += [m for m in (*NEEDS.get(n, []), n) if m not in order]
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    body = sql.strip()
    joined = ", " + body[5:] if body.startswith("WITH ") else " " + body
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{joined}"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def pix(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_suppkey").alias("image"), F.concat("l_returnflag", "l_linestatus").alias("label"), F.col("l_quantity").alias("v"))

    @property
    def grid(self) -> DataFrame:
        rows = self.table("lineitem").groupBy(F.col("l_suppkey").alias("image"), (F.col("l_partkey") % 16).cast("int").alias("y"), (F.col("l_orderkey") % 16).cast("int").alias("x"))
        return rows.agg(F.floor(F.avg("l_quantity")).cast("double").alias("v"))

    @property
    def obj(self) -> DataFrame:
        return self.grid.withColumn("label", F.when(F.col("v") > 15, F.expr("int(1 + 2 * (y div 8) + x div 8)")).otherwise(0))

    @property
    def seeds(self) -> DataFrame:
        return self.grid.select("image", "y", "x", F.when(F.col("v") > 40, F.expr("int(1 + (y * 16 + x) % 5)")).otherwise(0).alias("label"))

    @property
    def cells(self) -> DataFrame:
        kind = F.when(F.col("p_type").startswith("PROMO"), "T-cells").when(F.col("p_type").rlike("^(STANDARD|SMALL|ECONOMY)"), "DZ B-cells").otherwise("LZ B-cells")
        return self.table("part").select(F.col("p_brand").alias("image"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("y"), ((F.col("p_retailprice") - 900.0) * 0.5).alias("x"), kind.alias("cell_type"))

    @property
    def feat(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), "label", F.posexplode("embedding").alias("feature", "value")).withColumns({"value": F.col("value").cast("double"), "feature": F.col("feature").cast("long")})

    @property
    def scored(self) -> DataFrame:
        return self.table("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("truth"), F.col("toxic").alias("predicted"), (((F.col("doc_id") * 7919) % 997).cast("double") / 997.0).alias("score"))
