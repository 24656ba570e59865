"""Groups that go over the ends of Arrow batches, and null keys."""

import math

import numpy as np
from cellspark.operators import geometry
from cellspark.operators.frame import by_group


def test_groups_over_batches(spark):
    rng = np.random.default_rng(3)
    rows = [(f"g{i % 7}" if i % 7 else None, int(i) % 3, int(v)) for i, v in enumerate(rng.integers(0, 100, 4000))]
    df = spark.createDataFrame(rows, "image string, label int, v int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        calls = by_group(df, ["image", "label"], ["v"], lambda key, v: [float(v.sum()) if key[1] else math.nan, len(v)], "image string, label int, total double, n long")
        got = {(r.image, r.label): (r.total, r.n) for r in calls.collect()}
        several = by_group(df, ["image", "label"], ["v"], lambda key, v: [np.sort(v)[:2]], "image string, v int").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for image, label, v in rows:
        want.setdefault((image, label), []).append(v)
    assert got == {k: (float(sum(v)) if k[1] else None, len(v)) for k, v in want.items()}
    assert sorted((r.image or "", r.v) for r in several) == sorted((k[0] or "", v) for k, vs in want.items() for v in sorted(vs)[:2])


def test_radii_alone_are_those_of_all(spark):
    rng = np.random.default_rng(5)
    rows = [("a", label, int(y), int(x)) for label in range(30) for y, x in np.argwhere(rng.random((9, 7)) < 0.7)]
    df = spark.createDataFrame(rows, "image string, label int, y int, x int")
    alone, whole = (geometry.geometry(df, *c) for c in ([geometry.RADII], []))
    assert alone.columns == ["image", "label", *geometry.RADII] and "Pandas" not in whole._jdf.queryExecution().toString()
    assert sorted(alone.collect()) == sorted(whole.select(*alone.columns).collect())
