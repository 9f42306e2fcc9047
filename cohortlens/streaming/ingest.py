"""Incremental ingest with Structured Streaming: watch a folder, write once, resume, compact."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import latest_per_key

TERMINAL = ("ok", "not_case_like")


def watch(spark: SparkSession, path: str, schema, fmt: str = "json", files_per_trigger: int = 100, pattern: str | None = None) -> DataFrame:
    """A folder as a stream of its new files (STM-01)."""
    r = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_new(key: Sequence[str], path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows whose key is not yet in the table are appended, each once (STM-04, SNK-02).

    A batch that runs again after a crash finds its rows there and appends none.
    """

    def write(batch: DataFrame, _id: int) -> None:
        new = batch.dropDuplicates(list(key))
        if _exists(batch.sparkSession, path):
            new = new.join(batch.sparkSession.read.parquet(path).select(*key), list(key), "left_anti")
        new.write.mode("append").parquet(path)

    return write


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives as long as the checkpoint does: kept in a file beside Spark's own."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/run-name")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        out = fs.create(at, False)
        out.writeUTF(uuid.uuid4().hex[:16])
        out.close()
    src = fs.open(at)
    try:
        return src.readUTF()
    finally:
        src.close()


def write_once(stream: DataFrame, key: Sequence[str], path: str, checkpoint: str, keep_watching: bool = False, interval: str = "1 second") -> StreamingQuery:
    """Rows of a stream to a table, the first of each key and each once (STM-04, SNK-02).

    Keys that were seen are Spark's streaming state, which a restart finds in the checkpoint; the table isn't read again, so a batch takes as long
    on a large table as on a small one. A batch owns the folder of its number and replaces it as a whole: one that ran half before a crash leaves nothing
    twice. What other runs (another checkpoint, a lost one) have written is looked up by key, and does not grow meanwhile. ``read_once`` reads the table.
    """
    spark = stream.sparkSession
    run = _run_of(spark, checkpoint)
    others = _others(spark, path, run)

    def write(batch: DataFrame, number: int) -> None:
        new = batch
        if others:
            new = batch.join(batch.sparkSession.read.parquet(*others).select(*key), list(key), "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    return ingest(stream.dropDuplicates(list(key)), write, checkpoint, keep_watching, interval)


def _others(spark: SparkSession, path: str, run: str) -> list[str]:
    if not _exists(spark, path):
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    names = [x.getPath().getName() for x in found]
    return [f"{path}/{n}/*" for n in sorted(names) if n.startswith("run=") and n != f"run={run}"]


def read_once(spark: SparkSession, path: str) -> DataFrame:
    """The table of ``write_once``, without the columns of its folders."""
    return spark.read.parquet(path).drop("run", "batch")


def ingest(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, keep_watching: bool = False, interval: str = "1 second") -> StreamingQuery:
    """Runs until what is there is done, or goes on watching (STM-02)."""
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if keep_watching else w.trigger(availableNow=True)).start()


def stop_when(query: StreamingQuery, idle_s: float, done: Callable[[], bool] = lambda: False, poll_s: float = 0.5) -> None:
    """Stops a watching query when it has been idle for so long or its targets are reached (STM-02)."""
    seen, since = -1, time.time()
    while query.isActive:
        last = query.lastProgress
        batch = last["batchId"] if last and last["numInputRows"] else seen
        if batch != seen:
            seen, since = batch, time.time()
        if done() or time.time() - since >= idle_s:
            query.stop()
            return
        time.sleep(poll_s)


def guard(overwrite: bool, resume: bool, run_dir: str | None) -> None:
    """Overwriting and resuming exclude one another; resuming needs a named folder (STM-05)."""
    if overwrite and resume:
        raise ValueError("overwrite and resume exclude each other")
    if resume and not run_dir:
        raise ValueError("resume needs a run folder")


def compact(log: DataFrame, key: Sequence[str], order: Sequence[str] = ("ingest_seq",)) -> DataFrame:
    """Latest row of every key of an append log (STM-06)."""
    return latest_per_key(log, key, order)


def event_windows(events: DataFrame, ts: str, window: str, late: str, group: Sequence[str] = ()) -> DataFrame:
    """Counts by tumbling window with a watermark, for streams of events."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), *group).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *group, "n")
