"""Means on the very bound of a status, in any order of their rows."""

import random

from cellspark.plans.queries import QUERIES


def test_mean_on_the_bound_is_not_over_it(spark, tmp_path):
    rng, rows = random.Random(1), []
    for image in range(200):
        values = [round(0.01 * rng.randint(0, 10), 2) for _ in range(20)]
        values += [round(0.1 - v, 2) for v in values]
        rng.shuffle(values)
        rows += [(image, 1, 1.0, v) for v in values]
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_quantity double, l_discount double").repartition(7).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.gc_status for r in QUERIES["mark_status"](spark, str(tmp_path)).collect()} == {"negative"}
    assert QUERIES["semi_filter_gc"](spark, str(tmp_path)).count() == 0
