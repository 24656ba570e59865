"""Texture without a copy of each pixel for each step."""

import re

import numpy as np
from cellspark.operators import intensity


def test_texture_moves_each_pixel_once(spark):
    rng = np.random.default_rng(2)
    rows = [(None if label == 3 else "a", label, int(y), int(x), float(rng.integers(0, 50))) for label in range(6) for y, x in np.argwhere(rng.random((8, 9)) < 0.6)]
    rows.append(("wide", 1, 0, 0, 7.0))
    rows.append(("wide", 1, 1 << 20, 1 << 20, 9.0))  # a box of 2^40 pixels
    out = intensity.glcm(spark.createDataFrame(rows, "image string, label int, y int, x int, v double"))
    assert not re.search(r"Generate|Join", out._jdf.queryExecution().optimizedPlan().toString())
    got = {(r.image, r.label, r.d): r for r in out.collect()}
    assert len(got) == 7 * 3 and abs(got["wide", 1, 1].homogeneity - 1) < 1e-6
