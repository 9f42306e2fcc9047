"""Sampling by hash order: deterministic on any cluster, and the same in any SQL engine with MD5 and SHA-1."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .selection import values_at


def hash_order(seed: int, *key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in key)))


def hash_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement (SMP-01): a distributed top-n, no full sort."""
    return df.orderBy(hash_order(seed, *(F.col(k) for k in key)), *key).limit(n)


def hash_shard(key: Column, shards: int) -> Column:
    """Shard number of a key: the first 32 bits of its SHA-1 modulo shards (SMP-03)."""
    return (F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long") % shards).cast("int")


def allocate(counts: dict[str, int], n: int, order: Sequence[str] | None = None) -> dict[str, int]:
    """Whole numbers per stratum: proportional, at least one where n allows, never above the stratum, n in total.

    What is missing goes to the largest fractions first, what is too much is taken from the largest targets, again and again.
    With n below the number of strata, the first n of ``order`` (a random one, see ``stratum_order``) get one each. Strata are few, so this runs on the driver.
    """
    names = list(order or sorted(counts))
    total = sum(counts.values())
    n = min(n, total)
    if n < len(names):
        return {k: int(i < n) for i, k in enumerate(names)}
    exact = {k: n * counts[k] / total for k in sorted(names)}
    names = sorted(names)
    got = {k: min(counts[k], max(1, int(exact[k]))) for k in names}
    while (gap := n - sum(got.values())) != 0:
        if gap > 0:
            ready = sorted((k for k in names if got[k] < counts[k]), key=lambda k: (-(exact[k] - int(exact[k])), k))
        else:
            ready = sorted((k for k in names if got[k] > 1), key=lambda k: (-got[k], k))
        for k in ready[: abs(gap)]:
            got[k] += 1 if gap > 0 else -1
    return got


def stratum_order(strata: Sequence[str], seed: int) -> list[str]:
    """Strata in hash order: another seed draws others."""
    return sorted(strata, key=lambda s: (hashlib.md5(f"{seed}:{s}".encode()).hexdigest(), s))


def stratified_sample(df: DataFrame, stratum: Column, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """allocate() rows of every stratum, drawn in hash order (SMP-04, SMP-05)."""
    if n < 1:
        raise ValueError("the sample must have a row at least")
    keyed = df.withColumn("_s", F.coalesce(stratum.cast("string"), F.lit("")))
    counts = {r[0]: r[1] for r in keyed.groupBy("_s").count().collect()}
    spark = df.sparkSession
    plan = spark.createDataFrame([(k, v) for k, v in allocate(counts, n, stratum_order(counts, seed)).items()] or [("", 0)], "_s string, _take int")
    rank = F.row_number().over(W.partitionBy("_s").orderBy(hash_order(seed, *(F.col(k) for k in key)), *key))
    # no task sends more than n rows of a stratum to its ranking
    return keyed.withColumn("_n", rank).where(F.col("_n") <= n).join(F.broadcast(plan), "_s").where(F.col("_n") <= F.col("_take")).drop("_s", "_n", "_take")


def draw_order(seed: int, replicate: Column, key: Column) -> Column:
    """The hash by which a replicate orders its rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), key.cast("string")))


def share_of_hash(h: Column) -> Column:
    """The first 52 bits of a hash in hex as a number from 0 to 1, exactly."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long").cast("double") / float(2**52)


def sample_bounds(df: DataFrame, key: str, replicates: int, share: float, least: int = 1, seed: int = 42) -> DataFrame:
    """(replicate, take, bound, below): the hash share of each replicate's last row, and how many rows lie below it.

    Rows meet their replicates in the task that reads them; only counts are shuffled, so a draw costs no sort.
    """
    rows = df.select(F.col(key).alias("_k"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    take = F.least(F.greatest(F.round(F.col("_n") * share), F.lit(least)), F.col("_n")).cast("long")
    found = values_at(rows, ["replicate"], share_of_hash(draw_order(seed, F.col("replicate"), F.col("_k"))), ranks=F.array(take - 1))
    last = F.col("cells")[0]
    return found.select("replicate", (last["rank"] + 1).alias("take"), last["value"].alias("bound"), last["below"].alias("below"))


def bootstrap(df: DataFrame, key: str, replicates: int, share: float, least: int = 1, seed: int = 42) -> DataFrame:
    """Subsamples without replacement of max(round(n * share), least) rows per replicate (SMP-06): the first in hash order."""
    bounds = F.broadcast(sample_bounds(df, key, replicates, share, least, seed))  # a row for each replicate
    h = draw_order(seed, F.col("replicate"), F.col(key))
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).withColumn("_h", share_of_hash(h)).join(bounds, "replicate")
    # rows at the bound itself, one but for equal hashes, in order up to what is to take
    edge = rows.where(F.col("_h") == F.col("bound")).withColumn("_r", F.row_number().over(W.partitionBy("replicate").orderBy(h, key)))
    return rows.where(F.col("_h") < F.col("bound")).select(*df.columns, "replicate").unionByName(edge.where(F.col("_r") <= F.col("take") - F.col("below")).select(*df.columns, "replicate"))
