import numpy as np
import pytest
from cellspark import cli
from cellspark.functions.scalar import parse_channels
from cellspark.plans import config
from cellspark.sources import images, tables
from cellspark.streaming.incremental import StepState, process_new_files, unprocessed


def test_config(tmp_path):
    path = str(tmp_path / "c.yaml")
    assert cli.main(["init", "--name", "x", "--output", path]) == 0
    assert config.load_config(path) == config.default_config("x")
    (tmp_path / "bad.yaml").write_text("dataset_name: x\n")
    with pytest.raises(ValueError):
        config.load_config(str(tmp_path / "bad.yaml"))


def test_parse_channels():
    assert parse_channels(["dapi:1", "cd3:2", "aicda:3"]) == {"dapi": 1, "cd3": 2, "aicda": 3}
    with pytest.raises(ValueError):
        parse_channels(["invalid_format"])


def test_parser_defaults():
    args = cli.build_parser().parse_args(["analyze", "--features", "f", "--output", "o"])
    assert (args.correlation_threshold, args.random_seed, args.pixel_size, args.n_permutations) == (0.8, 1234, 0.3225, 10_000)


def test_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    one, two = rng.integers(0, 255, (5, 7, 3)).astype(np.uint8), rng.integers(0, 60_000, (3, 4)).astype(np.uint16)
    (tmp_path / "one.tif").write_bytes(images.write_tiff(one))
    (tmp_path / "two.tif").write_bytes(images.write_tiff(two))
    (tmp_path / "bad.tif").write_bytes(b"no image")
    pixels, failed = images.scan_images(spark, str(tmp_path))
    got = {(r.image, r.c, r.y, r.x): r.v for r in pixels.collect()}
    assert len(got) == 105 + 12 and got["one", 2, 4, 6] == one[4, 6, 2] and got["two", 0, 2, 3] == two[2, 3]
    assert [r.image for r in failed.collect()] == ["bad"]
    listing = images.list_files(spark, str(tmp_path))
    assert [r.stem for r in listing.collect()] == ["bad", "one", "two"]
    assert images.pair_by_stem(listing, listing.where("stem <> 'bad'")).count() == 2
    assert images.label_for_image(listing.where("stem = 'one'"), listing).first().label_path.endswith("one.tif")
    with pytest.raises(FileNotFoundError):
        images.list_files(spark, str(tmp_path / "none"))


def test_feature_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", float("nan"))], "image string, v double")
    tables.write_by_image(df, str(tmp_path / "t"))
    back = tables.read_features(spark, str(tmp_path / "t"), "v double, image string")
    assert {r.image: r.v for r in back.collect()} == {"a": 1.5, "b": None}
    assert tables.optional(spark, str(tmp_path / "none")) is None
    names = spark.createDataFrame([("v", "long name"), ("w", "x")], "feature string, long_name string")
    assert tables.rename_by_dictionary(df, names).columns == ["image", "long name"]


def test_each_file_once(spark, tmp_path):
    src, sink, mark = (str(tmp_path / n) for n in ("src", "sink", "mark"))
    step = lambda: process_new_files(spark, src, "v long", lambda d: d.withColumn("w", d.v * 2), sink, mark)
    spark.range(5).withColumnRenamed("id", "v").write.parquet(src)
    step()
    step()
    assert spark.read.parquet(sink).count() == 5
    spark.range(3).withColumnRenamed("id", "v").write.mode("append").parquet(src)
    step()
    assert spark.read.parquet(sink).count() == 8


def test_states(spark, tmp_path):
    state = StepState(spark, str(tmp_path / "s"))
    assert [r.status for r in state.status().collect()] == ["pending"] * 4
    state.start("preprocess")
    state.complete("preprocess", 3)
    state.fail("segment", "boom")
    assert state.is_completed("preprocess") and state.remaining(["preprocess", "segment"]) == ["segment"]
    state.reset("preprocess")
    assert not state.is_completed("preprocess")
    with pytest.raises(ValueError):
        state.start("dance")
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r.path for r in unprocessed(files, files.where("path = 'a'")).collect()] == ["b"]
