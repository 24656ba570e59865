from collections import Counter

import pytest
from cellspark import cli
from cellspark.functions.scalar import nuc_id
from cellspark.streaming.incremental import FileLog, process_each_file
from pyspark.sql import functions as F

def folder(tmp_path, names):
    (tmp_path / "in").mkdir(exist_ok=True)
    for n in names:
        (tmp_path / "in" / f"{n}.txt").write_text(n)


def test_each_file_once_whatever_happens(spark, tmp_path, monkeypatch):
    folder(tmp_path, "abcdefg")
    log, seen, broken = FileLog(spark, str(tmp_path / "log")), Counter(), {"c"}
    put = FileLog.put

    def work(names):
        if broken & set(names):
            raise ValueError("bad file")
        seen.update(names)

    def run(**kw):
        process_each_file(spark, str(tmp_path / "in"), "extract", work, log, str(tmp_path / "mark"), F.regexp_extract("path", "/([^/]*)[.]txt$", 1), "*.txt", 2, **kw)

    def dies(self, step, files, status, error=None):
        if len(seen) > 3:
            raise RuntimeError("killed before the log was written")
        put(self, step, files, status, error)

    monkeypatch.setattr(FileLog, "put", dies)
    with pytest.raises(Exception, match="killed"):
        run()
    done = {r.file for r in log.status("extract").where("status = 'done'").collect()}
    assert 0 < len(done) < 6
    monkeypatch.setattr(FileLog, "put", put)
    before = Counter(seen)
    run()
    state = {r.file: (r.status, r.error) for r in log.status("extract").collect()}
    assert {f for f, (s, _) in state.items() if s == "done"} == set("abdefg") and state["c"] == ("failed", "ValueError: bad file")
    assert all(seen[f] == before[f] for f in done)  # what was logged isn't worked on again
    run()
    assert seen["c"] == 0
    broken.clear()
    folder(tmp_path, "h")
    run(retry_failed=True)
    assert seen["c"] == 1 and seen["h"] == 1 and log.status("extract").where("status != 'done'").count() == 0
    before = Counter(seen)
    log.reset("extract")
    run()
    assert all(seen[f] == before[f] + 1 for f in "abcdefgh")


def test_extract_by_image(spark, tmp_path, monkeypatch):
    """Images one by one: a bad one is a row, the others are there once, also after a second run."""
    rows = [(i, y, x, float(x + y), 1 + x // 2) for i in ("one", "two", "bad", "a b") for y in range(3) for x in range(4)]
    spark.createDataFrame([r[:4] for r in rows], "image string, y int, x int, v double").write.partitionBy("image").parquet(f"{tmp_path}/raw")
    spark.createDataFrame([(*r[:3], r[4]) for r in rows], "image string, y int, x int, label int").write.partitionBy("image").parquet(f"{tmp_path}/labels")
    calls = []

    def features(picture, labelled):
        names = sorted(r.image for r in labelled.select("image").distinct().collect())
        calls.append(names)
        if "bad" in names:
            raise ValueError("no outline")
        return picture.join(labelled, ["image", "y", "x"]).groupBy("image", "label").agg(F.avg("v").alias("int_mean")).withColumn("nuc_id", nuc_id())

    monkeypatch.setattr(cli, "nuclear_features", features)
    for resume in (False, True):
        cli.extract_by_image(spark, f"{tmp_path}/raw", f"{tmp_path}/labels", f"{tmp_path}/out", [f"{tmp_path}/raw"], f"{tmp_path}/state", per_batch=4, resume=resume)
        found = spark.read.parquet(f"{tmp_path}/out/nuc_features")
        assert sorted((r.image, r.label) for r in found.collect()) == sorted((i, n) for i in ("one", "two", "a b") for n in (1, 2))
        assert spark.read.parquet(f"{tmp_path}/out/raw_levels").count() == 6
        assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/failed_images").collect()] == [("bad", "ValueError: no outline")]
    assert calls.count(["one"]) <= 1 and calls[-1] == ["bad"]
    assert cli.tables.optional(spark, f"{tmp_path}/out/nuc_features").count() == 6
