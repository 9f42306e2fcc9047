"""Shared pieces: tables, cutting lineage, connected components, words and hashes.

Lineage is cut with ``checkpoint()`` into the folder that the cluster names in
``spark.checkpoint.dir``, so that a lost executor costs a re-read and not a re-run.
"""

from __future__ import annotations

import contextlib
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd multipliers of the 64-bit finaliser (splitmix64).
MIX_A, MIX_B, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one only where none is configured and all tasks run in this process."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="cohortlens-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; what follows reads it from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data, wherever Spark keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def rows_at_once(spark: SparkSession, rows: int):
    """Rows that a Python task takes over from Spark at once, for the actions inside: keeps tasks over large rows small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component), component the smallest node.

    Alternates large-star and small-star until nothing changes. Every step is a partial
    aggregate and an equi-join, so a hub with very many neighbours is split like any skewed
    join key; neither edges nor components reach the driver. Null ends and loops are ignored.
    An empty input gives an empty output.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    e = cut(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        small = cut(small)
        changed = small.exceptAll(e).isEmpty() and e.exceptAll(small).isEmpty()
        e = small
        if changed:
            break
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_KEEP = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 8)), 0xFFFFFFFFFFFFFFFF], np.uint64)


def word_hashes(texts: list[bytes], apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of each text). A-Z lower-cased; words are [^\\x20\\x09-\\x0D]+, or what the 256 flags ``apart`` (a line end among them) leave between.

    Works on the joined buffer eight bytes at a time, so the cost follows the words.
    """
    data = b"\n".join(texts).lower() + b"\n" + bytes(8)
    raw = np.frombuffer(data, np.uint8)
    space = apart[raw[: len(data) - 8]]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if len(space) and not space[0]:
        start = np.concatenate([[0], start])
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    ends_of = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    upto = np.searchsorted(start, ends_of)
    counts = np.diff(upto, prepend=0)
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    size = end - start
    h = mix((eight[start] & _KEEP[np.minimum(size, 8)]) + size.astype(np.uint64) * GOLDEN)
    at, k = np.flatnonzero(size > 8), 8
    while len(at):
        left = size[at] - k
        h[at] = mix(h[at] * MIX_A + (eight[start[at] + k] & _KEEP[np.minimum(left, 8)]))
        at, k = at[left > 8], k + 8
    return h, counts


def text_chunks(column, most: int = 2_000_000):
    """Split an Arrow column of texts into runs of about ``most`` bytes: (first row, list of UTF-8 texts, null as empty)."""
    run, size, first = [], 0, 0
    for i, x in enumerate(column):
        b = x.as_buffer().to_pybytes() if x.is_valid else b""
        run.append(b)
        size += len(b)
        if size >= most:
            yield first, run
            run, size, first = [], 0, i + 1
    if run:
        yield first, run
