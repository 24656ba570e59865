"""Object features on grids with known answers."""

import math

import numpy as np
import pytest
from cellspark.operators import geometry, intensity, pixels


def frame(spark, rows, schema="image string, label int, y int, x int, v double"):
    return spark.createDataFrame(rows, schema)


def square(n, v=5.0, image="a", label=1):
    return [(image, label, y, x, v) for y in range(n) for x in range(n)]


def test_flat_square(spark):
    df = frame(spark, square(4))
    r = pixels.regions(df).first()
    assert (r.area, r.bbox_area, r.centroid_y, r.centroid_x) == (16, 16, 1.5, 1.5)
    s = intensity.intensity_stats(df).first()
    assert (s.int_mean, s.int_sd, s.int_mode, s.int_d25) == (5.0, 0.0, 5.0, 5.0)
    assert intensity.entropy(df).first().entropy == 0
    h = intensity.condensation(df).first()
    assert h.hc_area_nuc_area == 1.0 and h.hc_area_ec_area is None and h.i80_i20 == 1.0


def test_two_levels(spark):
    df = frame(spark, [("a", 1, y, x, 10.0 if x < 2 else 20.0) for y in range(2) for x in range(4)])
    s, h = intensity.intensity_stats(df).first(), intensity.condensation(df).first()
    assert (s.int_mean, s.int_sd) == (15.0, 5.0)
    assert (h.hc_area_ec_area, h.hc_content_ec_content) == (1.0, 2.0)
    assert intensity.entropy(df).first().entropy == pytest.approx(1.0)


def test_l_shape_and_entropy_of_its_box(spark):
    df = frame(spark, [("a", 1, y, x, 7.0) for y in range(3) for x in range(3) if y < 1 or x < 1])
    s = intensity.shape_from_moments(df).first()
    assert s.area == 5 and s.bbox_area == 9 and s.area_bbarea == pytest.approx(5 / 9)
    p = 5 / 9
    assert intensity.entropy(df).first().entropy == pytest.approx(-p * math.log2(p) - (1 - p) * math.log2(1 - p))


def test_one_pixel(spark):
    df = frame(spark, [("a", 1, 3, 4, 7.0)])
    g = geometry.geometry(df).first()
    assert g.min_radius is None and g.min_calliper == 1 and g.solidity == 1
    m = intensity.central_moments(intensity.raw_moments(df)).first()
    assert (m.cy, m.cx, m.mu_00, m.mu_20) == (0, 0, 7, 0)


def test_moments_move_and_turn(spark):
    rng = np.random.default_rng(0)
    spots = [(int(y), int(x), float(v)) for y, x, v in zip(rng.integers(0, 9, 40), rng.integers(0, 9, 40), rng.integers(1, 50, 40), strict=True)]
    spots = list({(y, x): (y, x, v) for y, x, v in spots}.values())
    rows = [("a", 1, y, x, v) for y, x, v in spots] + [("b", 1, y + 30, x + 7, v) for y, x, v in spots] + [("c", 1, x, -y, v) for y, x, v in spots]
    central = intensity.central_moments(intensity.raw_moments(frame(spark, rows)))
    mu = {r.image: r.asDict() for r in central.collect()}
    for k in mu["a"]:
        if k.startswith("mu"):
            assert mu["a"][k] == pytest.approx(mu["b"][k], rel=1e-9, abs=1e-6)
    hu = {r.image: [r[f"hu_{i}"] for i in range(7)] for r in intensity.hu_moments(intensity.normalized_moments(central)).collect()}
    assert hu["a"][:6] == pytest.approx(hu["c"][:6], rel=1e-9, abs=1e-15)


def test_glcm_of_a_checkerboard(spark):
    df = frame(spark, [("a", 1, y, x, 255.0 * ((y + x) % 2) + 0.0) for y in range(4) for x in range(4)])
    r = intensity.glcm(df, (1,)).first()
    # Straight steps always change, diagonal ones never do.
    assert r.contrast == pytest.approx(255 * 255 / 2) and r.dissimilarity == pytest.approx(255 / 2)
    assert r.correlation == pytest.approx((-1 - 1 + 1 + 1) / 4, abs=0.2)


def test_glcm_counts_the_box_outside_the_object(spark):
    rows = [("a", 1, y, x, 10.0) for y in range(6) for x in range(6) if y == x]
    r = intensity.glcm(frame(spark, rows), (1,)).first()
    a = np.diag([255] * 6)
    total = np.mean([((a[:, :-1] - a[:, 1:]) ** 2).mean(), ((a[1:, :] - a[:-1, :]) ** 2).mean(), ((a[1:, 1:] - a[:-1, :-1]) ** 2).mean(), ((a[1:, :-1] - a[:-1, 1:]) ** 2).mean()])
    assert r.contrast == pytest.approx(total)


def test_geometry_of_shapes():
    y, x = np.mgrid[:20, :20]
    values = dict(zip(geometry.COLUMNS, geometry.object_geometry(y.ravel(), x.ravel()), strict=True))
    assert values["perimeter"] == 76 and values["solidity"] == 1 and values["max_calliper"] >= 20
    disk = np.argwhere((np.mgrid[:41, :41][0] - 20) ** 2 + (np.mgrid[:41, :41][1] - 20) ** 2 <= 400)
    values = dict(zip(geometry.COLUMNS, geometry.object_geometry(disk[:, 0], disk[:, 1]), strict=True))
    assert values["feret_max"] == 40 and values["max_radius"] == 20
    assert values["shape_factor"] == pytest.approx(1, abs=0.12) and values["solidity"] > 0.97
    assert values["smallest_largest_calliper"] > 0.9


def test_circumradius():
    a, b, c = np.array([[0.0, 0.0], [0, 0]]), np.array([[0.0, 2.0], [1, 1]]), np.array([[2.0, 0.0], [2, 2]])
    r, centre = geometry.circumradius(a, b, c)
    assert r[0] == pytest.approx(math.sqrt(2)) and centre[0].tolist() == [1, 1] and r[1] == 0


def test_peaks():
    v = np.zeros(60)
    v[10:21] = 1 - np.abs(np.arange(-5, 6)) / 5.0
    v[40] = 0.05
    (rise, width, height), = geometry.peaks(v)
    assert (rise, height) == (1, 1) and width == pytest.approx(5)


def test_expand_labels_never_overlaps(spark):
    grid = frame(spark, [("a", 0, 0, x, 0.0) for x in range(9)])
    labels = spark.createDataFrame([("a", 0, 2, 1), ("a", 0, 6, 2)], "image string, y int, x int, label int")
    got = {r.x: r.label for r in pixels.expand_labels(labels, grid, 1).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 2, 6: 2, 7: 2}
    wide = {r.x: r.label for r in pixels.expand_labels(labels, grid, 5).collect()}
    assert wide == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 2, 8: 2}


def test_normalisation_with_equal_quantiles_and_nulls(spark):
    df = spark.createDataFrame([("a", 0, 0, 3.0), ("a", 0, 1, 3.0), ("b", 0, 0, None), ("b", 0, 1, 2.0), (None, 0, 0, 1.0), (None, 0, 1, 9.0)], "image string, y int, x int, v double")
    got = {(r.image, r.x): r.scaled for r in pixels.quantile_normalize(df).collect()}
    assert len(got) == 6 and got["a", 0] is None and got["b", 0] is None and got[None, 0] == 0 and got[None, 1] == 255
    assert pixels.minmax_normalize(df).count() == 6


def test_channels_count_from_the_end(spark):
    df = spark.createDataFrame([("a", c, 0, 0, float(c)) for c in range(3)], "image string, c int, y int, x int, v double")
    assert [r.v for r in pixels.extract_channel(df, 1).collect()] == [2.0]
    assert [r.v for r in pixels.extract_channel(df, 3).collect()] == [0.0]


def test_connected_objects(spark):
    rows = ["##..#", ".#..#", "....#", "##.##"]
    df = spark.createDataFrame([("a", y, x, 1 if c == "#" else 0) for y, line in enumerate(rows) for x, c in enumerate(line)], "image string, y int, x int, label int")
    got = {(r.y, r.x): r.label for r in pixels.connected_objects(df).collect()}
    assert got[0, 0] == got[1, 1] == 1 and got[0, 4] == got[3, 3] == 2 and got[3, 0] == 3 and len(got) == 10


def test_every_family_of_nuclear_features(spark):
    from cellspark import cli

    rng = np.random.default_rng(3)
    rows = [("i", y, x, float(rng.integers(1, 99)), 1 if x < 6 else 2) for y in range(9) for x in range(12)]
    raw = spark.createDataFrame([r[:4] for r in rows], "image string, y int, x int, v double")
    labels = spark.createDataFrame([(r[0], r[1], r[2], r[4]) for r in rows], "image string, y int, x int, label int")
    out = cli.nuclear_features(raw, labels, ("moments_features", "simple_geometry"), normalize=False)
    r = {x.label: x for x in out.collect()}[2]
    mine = [(y, x - 6, v) for _, y, x, v, lab in rows if lab == 2]
    m = lambda p, q, w: sum(y**p * x**q * (v if w else 1) for y, x, v in mine)
    assert len([c for c in out.columns if "moments" in c or "weighted_centroid" in c]) == 112
    assert r["moments-2-1"] == m(2, 1, 0) and r["weighted_moments-1-3"] == m(1, 3, 1)
    assert abs(r["weighted_centroid-1"] - m(0, 1, 1) / m(0, 0, 1)) < 1e-9
    assert abs(r["moments_central-2-0"] - sum((y - 4) ** 2 for y, _, _ in mine)) < 1e-6 and r["moments_normalized-0-1"] is None
    assert abs(r["moments_hu-0"] - (r["moments_normalized-2-0"] + r["moments_normalized-0-2"])) < 1e-12
    whole = cli.nuclear_features(raw, labels)
    assert {"min_radius", "entropy", "i80_i20", "contrast_20", "avg_curvature", "min_calliper"} <= set(whole.columns) and whole.count() == 2
    levels = cli.protein_levels(raw, labels)
    assert "entropy" in levels.columns and levels.count() == 2


def test_single_images_are_the_dapi_channel(spark, tmp_path):
    from cellspark import cli
    from cellspark.sources import images

    (tmp_path / "in").mkdir()
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.tif").write_bytes(images.write_tiff(a))
    cli.preprocess(spark, f"{tmp_path}/in", f"{tmp_path}/out", {"dapi": 1, "cd3": 2}, [0.0, 1.0])
    got = {(r.image, r.y, r.x): r.v for r in spark.read.parquet(f"{tmp_path}/out/dapi").collect()}
    assert len(got) == 24 and got["b", 2, 3] == 11 and not (tmp_path / "out" / "cd3").exists()
    assert spark.read.parquet(f"{tmp_path}/out/dapi_scaled").agg({"v": "max"}).first()[0] == 255
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="FileNotFoundError"):
        cli.preprocess(spark, f"{tmp_path}/none", f"{tmp_path}/out", {"dapi": 1}, [0.0, 1.0])


def test_texture_at_distances_beyond_the_object(spark):
    from cellspark.operators import intensity

    df = spark.createDataFrame([("a", 1, y, x, float(x + y)) for y in range(3) for x in range(3)], "image string, label int, y int, x int, v double")
    got = {r.d: r for r in intensity.glcm(df).collect()}
    assert set(got) == {1, 5, 20} and got[20].contrast == 0 and got[20].correlation == 1 and got[1].contrast > 0


def test_positive_ids_of_named_images(spark):
    from cellspark.operators import celltype

    rows = [(i, f"{i}{k}", float(k % 10 + (50 if k >= 10 else 0))) for i in "abc" for k in range(20)]
    got = celltype.positive_ids_of_images(spark.createDataFrame(rows, "image string, nuc_id string, int_mean double"), ["a", "c", "none"])
    assert {r.nuc_id for r in got.collect()} == {f"{i}{k}" for i in "ac" for k in range(10, 20)}
