"""The extraction of a folder of documents as one job: watch, parse, route, choose, guard, extract, log, resume, stop.

A micro-batch writes its blocks and segments under its own run and number and its log rows last: the log is the commit record, and
``committed`` reads nothing else. A batch that dies leaves rows that no log names; its documents are taken up again by the next run.
A batch has a folder of its own in every table and reads back no other, so one takes as long late in a run as early.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources import documents as D
from .ingest import TERMINAL, _exists, guard

#: The binary source's columns.
FILES = "path string, modificationTime timestamp, length long, content binary"
LOG = "pmcid string, status string, path string, article_type string, has_body boolean, error string, n_blocks_total long, n_blocks_body long, n_blocks_abstract long, n_segments long, run string, batch long, at timestamp"

#: Files of a batch that watches, or, for each core, of one that works off a backlog: a batch takes some seconds whatever it holds.
BATCH = 1000


@contextmanager
def _short_listings(spark: SparkSession):
    """What listings send the driver: twice as many tasks as cores, not one for each of up to 10,000 folders or files with 2.5 kB besides what it
    found; and no places of blocks, as documents are small. A stream's source looks this up at every listing, so it goes around the whole run."""
    at, most = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 2 * spark.sparkContext.defaultParallelism
    new = {at: str(min(most, int(spark.conf.get(at)))), "spark.sql.sources.ignoreDataLocality": "true"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)



class Stop(StreamingQueryListener):
    """When a watching job ends (STM-02): after so many documents, when all targets were tried, or when nothing has come for so long.

    Spark tells the listener of every batch and of every idle trigger; why it ended is in ``reason``.
    """

    def __init__(self, most: int | None = None, targets: Sequence[str] | None = None, idle_s: float | None = None):
        self.most, self.targets, self.idle_s = most, None if targets is None else set(targets), idle_s
        self.reason, self.taken, self.since, self.over = None, 0, None, threading.Event()

    def end(self, reason: str) -> None:
        self.reason = self.reason or reason
        self.over.set()

    def room(self) -> int | None:
        return None if self.most is None else max(0, self.most - self.taken)

    def done(self, n: int, tried: int) -> None:
        """A batch was committed: ``n`` documents; ``tried`` of the targets are in the log by now."""
        self.taken += n
        if self.most is not None and self.taken >= self.most:
            self.end("cap")
        elif self.targets is not None and tried >= len(self.targets):
            self.end("targets")

    def _quiet(self, timestamp: str) -> None:
        from datetime import datetime

        now = datetime.fromisoformat(timestamp.replace("Z", "+00:00")).timestamp()
        self.since = self.since or now
        if self.idle_s is not None and now - self.since >= self.idle_s:
            self.end("idle")

    def onQueryStarted(self, event) -> None:
        self._quiet(event.timestamp)

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.since = None
        self._quiet(event.progress.timestamp)

    def onQueryIdle(self, event) -> None:
        self._quiet(event.timestamp)

    def onQueryTerminated(self, event) -> None:
        self.end("error" if event.exception else "finished")


def _log(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(f"{out}/log") if _exists(spark, f"{out}/log") else spark.createDataFrame([], LOG)


def committed(spark: SparkSession, out: str, table: str) -> DataFrame:
    """Rows of ``blocks`` or ``segments`` whose batch is in the log, of each document those of its latest attempt; ``log``: the latest row of each document."""
    latest = _log(spark, out).groupBy("pmcid").agg(F.max_by(F.struct(*(c.split(" ")[0] for c in LOG.split(", ")[1:])), F.struct("at", "batch")).alias("r")).select("pmcid", "r.*")
    if table == "log":
        return latest
    if not _exists(spark, f"{out}/{table}"):
        raise ValueError(f"no {table} have been written")
    return spark.read.option("recursiveFileLookup", True).parquet(f"{out}/{table}").join(latest.select("pmcid", "run", "batch"), ["pmcid", "run", "batch"], "left_semi").drop("run", "batch")


def extract_folder(
    spark: SparkSession,
    folder: str,
    out: str,
    extract: Callable[[DataFrame], DataFrame],
    watch: bool = False,
    stop: Stop | None = None,
    resume: bool = False,
    overwrite: bool = False,
    retry_errors: bool = False,
    interval: str = "1 second",
    files_per_batch: int | None = None,
    pattern: str = "*.xml",
) -> Stop:
    """Documents of ``folder`` to blocks, segments (``extract`` of a batch's blocks) and a log under ``out`` (SRC-07, DOC-06, DOC-09, STM-01 to STM-05).

    Documents whose latest log row is final are passed by, those that failed too unless ``retry_errors`` is set; so a run that was stopped or
    killed is taken up by the next one with ``resume``. Without ``watch`` the job ends with the files that are there. A batch has ``files_per_batch``
    files: unless it is given, ``BATCH`` of them while watching, and ``BATCH`` for each core where the job works off what is there.
    """
    guard(overwrite, resume, out)
    if _exists(spark, f"{out}/log") and not (resume or overwrite):
        raise ValueError(f"{out} holds a run: resume or overwrite it")
    if overwrite:
        at = spark._jvm.org.apache.hadoop.fs.Path(out)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    stop, run = stop or Stop(), uuid.uuid4().hex[:12]
    # what other runs have done, read once: this run's own files are known to its stream
    final = F.lit(not retry_errors) | F.col("status").isin(*TERMINAL)
    # it lies by id as every batch is dealt, so that a batch meets it in place: none of it goes through the driver or is shuffled again; the id's
    # second hash is for files that a Spark job wrote in the order of the first, of which a batch would fall to one task
    parts = spark.sparkContext.defaultParallelism
    deal = F.xxhash64("pmcid").alias("deal")
    most = files_per_batch or (BATCH if watch else BATCH * parts)
    prior = committed(spark, out, "log").where(final).select("pmcid", deal).repartition(parts, "deal", "pmcid").sortWithinPartitions("deal", "pmcid").persist()
    known = prior.count()
    tried = 0 if stop.targets is None else prior.where(F.col("pmcid").isin(*stop.targets)).count()

    def kept(df: DataFrame, path: str) -> DataFrame:
        """Written and read back; its columns are known, so that no job looks for them."""
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        nonlocal tried
        room = stop.room()
        if room == 0 or stop.over.is_set():
            return
        new = batch.withColumn("pmcid", D.pmcid_of(F.col("path"))).select("*", deal).repartition(parts, "deal", "pmcid")
        new = (new.join(prior.hint("merge"), ["deal", "pmcid"], "left_anti") if known else new).dropDuplicates(["deal", "pmcid"])
        if room is not None:
            new = new.orderBy("path").limit(room)
        tag = lambda df: df.withColumn("run", F.lit(run)).withColumn("batch", F.lit(number).cast("long"))
        own = lambda table: f"{out}/{table}/{run}-{number}"
        parsed = kept(D.parse_contents(new), own("parsed"))
        blocks = parsed.where("block_id IS NOT NULL")
        tag(blocks).write.mode("overwrite").parquet(own("blocks"))
        found = kept(tag(extract(blocks)), own("segments")).groupBy("pmcid").agg(F.count("*").alias("n_segments"))
        log = tag(D.parse_log(parsed).join(found, "pmcid", "left").withColumn("n_segments", F.coalesce("n_segments", F.lit(0)).cast("long")))
        status = F.when((F.col("status") == "ok") & (F.col("n_segments") == 0), "not_case_like").otherwise(F.col("status"))
        log = log.withColumn("status", status).withColumn("at", F.current_timestamp()).select(*(c.split(" ")[0] for c in LOG.split(", ")))
        log.coalesce(1).write.mode("overwrite").parquet(own("log"))
        mine = spark.read.schema(LOG).parquet(own("log"))
        seen = F.col("pmcid").isin(*stop.targets) if stop.targets is not None else F.lit(False)
        n = mine.agg(F.count("*").alias("n"), F.count_if(seen).alias("t")).first()
        tried += n.t
        stop.done(n.n, tried)

    with _short_listings(spark):
        files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most).option("maxCachedFiles", 10 * most).load(folder)
        stream = files.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/streams/{run}")
        spark.streams.addListener(stop)
        try:
            query = (stream.trigger(processingTime=interval) if watch else stream.trigger(availableNow=True)).start()
            if stop.targets is not None and tried >= len(stop.targets):
                stop.end("targets")
            while not stop.over.wait(0.2) and query.isActive:
                pass
            if query.isActive:
                query.stop()
            query.awaitTermination()
            stop.end("finished")
        finally:
            spark.streams.removeListener(stop)
            prior.unpersist()
    return stop
