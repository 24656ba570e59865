"""Incremental processing: each file once, resumable, with a table of step states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = ("preprocess", "segment", "extract", "analyze")
STATE = "step string, status string, at timestamp, processed long, error string, seq long"


def process_new_files(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, fmt: str = "parquet", files_per_batch: int = 64) -> None:
    """Append the transformed rows of files not seen before: the checkpoint takes each file once, also after a crash."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(source)
    transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()


def unprocessed(listing: DataFrame, done: DataFrame) -> DataFrame:
    return listing.join(done.select("path").distinct(), "path", "left_anti")


class FileLog:
    """Which files a step has done and which failed: an append-only table, of which the latest row of a step and file counts."""

    SCHEMA = "step string, file string, status string, error string, at timestamp, seq long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)

    def put(self, step: str, files: list[str], status: str, error: str | None = None) -> None:
        seq = (self.rows().agg(F.max("seq")).first()[0] or 0) + 1
        rows = self.spark.createDataFrame([(step, f, status, error) for f in files], "step string, file string, status string, error string")
        rows.withColumns({"at": F.current_timestamp(), "seq": F.lit(seq).cast("long")}).coalesce(1).write.mode("append").parquet(self.path)

    def status(self, step: str) -> DataFrame:
        """``file, status, error``."""
        last = self.rows().where(F.col("step") == step).groupBy("file").agg(F.max_by(F.struct("status", "error"), F.struct("seq", "at")).alias("s"))
        return last.select("file", "s.*")

    def reset(self, step: str) -> None:
        """Every file of the step is to be worked on again."""
        rows = self.status(step).select(F.lit(step).alias("step"), "file", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"), F.current_timestamp().alias("at"))
        seq = (self.rows().agg(F.max("seq")).first()[0] or 0) + 1
        if rows.take(1):
            rows.withColumn("seq", F.lit(seq).cast("long")).write.mode("append").parquet(self.path)

    def open_files(self, step: str, files: list[str], retry_failed: bool = False) -> list[str]:
        """Of a batch's files those that aren't done, nor failed unless these are to be tried again."""
        closed = ["done"] if retry_failed else ["done", "failed"]
        gone = {r["file"] for r in self.status(step).where(F.col("file").isin(files) & F.col("status").isin(closed)).collect()}
        return [f for f in files if f not in gone]


def process_each_file(spark: SparkSession, source: str, step: str, work: Callable[[list[str]], None], log: FileLog, checkpoint: str, name: Column, pattern: str = "*", per_batch: int = 64, retry_failed: bool = False) -> None:
    """Runs a step over the files below a folder, ``per_batch`` at a time, and logs each as done or failed.

    ``name`` turns the column ``path`` into the file's name in the log (several files may share one). ``work`` gets the names of a
    batch and writes results that a second run replaces. A batch whose work fails is tried file by file, so that only the bad ones
    are marked. After a crash the stream's checkpoint brings the open batch again and the log leaves out what was done; with
    ``retry_failed`` the failed ones are tried once more.
    """

    def attempt(names: list[str], again: bool) -> None:
        todo = log.open_files(step, names, again)
        if not todo:
            return
        error = None
        try:
            work(todo)
        except Exception as e:  # noqa: BLE001  the error becomes a row of the log
            error = f"{type(e).__name__}: {e}"[:500]
        if error is None:
            log.put(step, todo, "done")
        elif len(todo) == 1:
            log.put(step, todo, "failed", error)
        else:
            for one in todo:
                attempt([one], again)

    def batch(df: DataFrame, _: int) -> None:
        attempt(sorted(r["name"] for r in df.select("name").distinct().collect()), False)  # per_batch names at most

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch)
    files.load(source).select(name.alias("name")).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    # What the stream doesn't bring again: files of a log that was reset, and failed ones if asked for.
    waiting: list[str] = []
    for r in log.status(step).where(F.col("status").isin(["pending", "failed"] if retry_failed else ["pending"])).toLocalIterator():
        waiting.append(r["file"])
        if len(waiting) == per_batch:
            attempt(waiting, retry_failed)
            waiting = []
    attempt(waiting, retry_failed)


class StepState:
    """States of the steps as an append-only table; the latest row of a step counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(STATE).parquet(self.path) if there else self.spark.createDataFrame([], STATE)

    def _put(self, step: str, status: str, processed: int = 0, error: str | None = None) -> None:
        if step not in STEPS:
            raise ValueError(f"unknown step {step!r}")
        seq = (self._rows().agg(F.max("seq")).first()[0] or 0) + 1  # two changes in one tick keep their order
        row = self.spark.range(1).select(F.lit(step).alias("step"), F.lit(status).alias("status"), F.current_timestamp().alias("at"), F.lit(processed).cast("long").alias("processed"), F.lit(error).cast("string").alias("error"), F.lit(seq).cast("long").alias("seq"))
        row.write.mode("append").parquet(self.path)

    def start(self, step: str) -> None:
        self._put(step, "in_progress")

    def complete(self, step: str, processed: int = 0) -> None:
        self._put(step, "completed", processed)

    def fail(self, step: str, error: str) -> None:
        self._put(step, "failed", error=error)

    def reset(self, step: str | None = None) -> None:
        for s in (step,) if step else STEPS:
            self._put(s, "pending")

    def status(self) -> DataFrame:
        """One row for each step, pending where nothing is known."""
        last = self._rows().groupBy("step").agg(F.max_by(F.struct("status", "at", "processed", "error"), F.struct("seq", "at")).alias("s")).select(F.col("step").alias("k"), "s.*")
        steps = self.spark.createDataFrame([(i, s) for i, s in enumerate(STEPS)], "place int, step string")
        return steps.join(last, F.col("step") == F.col("k"), "left").select("place", "step", F.coalesce("status", F.lit("pending")).alias("status"), "at", "processed", "error").orderBy("place").drop("place")

    def is_completed(self, step: str) -> bool:
        return bool(self.status().where((F.col("step") == step) & (F.col("status") == "completed")).take(1))

    def remaining(self, steps: list[str]) -> list[str]:
        done = {r["step"] for r in self.status().where("status = 'completed'").collect()}
        return [s for s in steps if s not in done]


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means of events by tumbling window and type; on a stream, events later than ``late`` are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")
