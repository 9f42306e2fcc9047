"""Co-assignment of cases over many clusterings (ML-12): which cases fall together, and how often.

Cases with the same clusters in every replicate form one profile; copies cost nothing beyond their row. Two profiles that agree
in at least ``need`` of ``n`` replicates agree in at least one of any ``n - need + 1`` of them. So profiles meet only under the
clusters of that many replicates, those whose clusters are smallest, and a pair is given once, under the first replicate in which it agrees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Profiles of a block; a task compares two blocks.
BLOCK = 1_024
#: Replicates whose names are held by every task.
MOST_REPLICATES = 100_000


def profiles(assignments: DataFrame, key: str, replicate: str, cluster: str) -> DataFrame:
    """(key, profile, clusters) of every case: ``profile`` is the smallest key with the same clusters, ``clusters`` the sorted
    (replicate, cluster) pairs. A case may be missing from a replicate. Of a case named twice in a replicate the smallest cluster
    counts; rows with a null are left out.
    """
    whole = assignments.select(F.col(key).alias("_k"), F.col(replicate).cast("string").alias("r"), F.col(cluster).cast("string").alias("c")).dropna()
    # one shuffle: both groupings lie within the case
    per = whole.repartition("_k").groupBy("_k", "r").agg(F.min("c").alias("c")).groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("r", "c"))).alias("clusters"))
    first = per.groupBy("clusters").agg(F.min("_k").alias("profile"))
    return per.join(first, "clusters").select(F.col("_k").alias(key), "profile", "clusters")


def _least_agreements(n: int, least: float) -> int:
    """The smallest number of agreements, at least 1, that makes a share of ``least``."""
    return next((m for m in range(1, n + 1) if m / n >= least), n + 1)


def coassigned(cases: DataFrame, least: float = 0.5) -> DataFrame:
    """(i, j, n_together, coassignment) of all pairs of profiles, i < j, that fall together in at least ``least`` of the replicates,
    and in one at least; ``cases`` comes from ``profiles``. Cases of one profile fall together wherever they occur.

    A cluster's profiles are dealt to blocks, and two blocks meet in one task: a row travels once for each block of its cluster.
    """
    spark = cases.sparkSession
    each = cases.where(F.col("profile") == F.col(cases.columns[0])).select("profile", "clusters")
    held = each.select(F.explode("clusters").alias("x")).select("x.*").groupBy("r", "c").agg(F.count("*").alias("n"))
    by_replicate = [(r["r"], r["w"]) for r in held.groupBy("r").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("w")).limit(MOST_REPLICATES + 1).collect()]
    if len(by_replicate) > MOST_REPLICATES:
        raise ValueError(f"more than {MOST_REPLICATES} replicates")
    n = len(by_replicate)
    need = _least_agreements(n, least)
    kind = cases.schema["profile"].dataType.simpleString()
    schema = f"i {kind}, j {kind}, n_together int, coassignment double"
    if need > n:
        return spark.createDataFrame([], schema)
    meeting = sorted(r for r, _ in sorted(by_replicate, key=lambda x: (x[1], x[0]))[: n - need + 1])

    named = each.select("profile", "clusters", F.explode(F.filter("clusters", lambda x: x["r"].isin(meeting))).alias("x")).select("profile", "clusters", F.col("x.r").alias("r"), F.col("x.c").alias("c"))
    blocks = held.select("r", "c", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("profile"), F.col("blocks")).cast("int")
    placed = named.join(blocks, ["r", "c"]).withColumn("own", mine)
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = met.select("r", "c", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "profile", "clusters")

    def compare(key, pdf):
        import numpy as np
        import pandas as pd

        here, low, high = key[0], key[2], key[3]
        flat = pd.DataFrame([(row, x["r"], x["c"]) for row, pairs in enumerate(pdf["clusters"]) for x in pairs], columns=["row", "r", "c"])
        names, replicate = np.unique(flat["r"].to_numpy(str), return_inverse=True)
        code = np.full((len(names), len(pdf)), -1, np.int32)
        code[replicate, flat["row"]] = pd.factorize(flat["c"])[0]
        at = pdf["own"].to_numpy()
        a, b = np.flatnonzero(at == low), np.flatnonzero(at == high)
        together, before = np.zeros((len(a), len(b)), np.int32), np.zeros((len(a), len(b)), bool)
        earlier = {r for r in meeting if r < here}
        for name, row in zip(names, code):
            same = (row[a][:, None] == row[b][None, :]) & (row[a] >= 0)[:, None]
            together += same
            if name in earlier:
                before |= same
        good = (together >= need) & ~before
        if low == high:
            good = np.triu(good, 1)
        x, y = np.nonzero(good)
        ids, count = pdf["profile"].to_numpy(), together[x, y]
        left, right = ids[a[x]], ids[b[y]]
        swap = left > right
        left, right = np.where(swap, right, left), np.where(swap, left, right)
        return pd.DataFrame({"i": left, "j": right, "n_together": count, "coassignment": count / n})

    return tasks.groupBy("r", "c", "low", "high").applyInPandas(compare, schema)


def consensus_counts(cases: DataFrame, pairs: DataFrame) -> DataFrame:
    """(profile, cases, linked) of every profile: the number of its cases, and of cases in other profiles that ``pairs`` links it to."""
    size = cases.groupBy("profile").agg(F.count("*").alias("cases"))
    both = pairs.select(F.col("i").alias("profile"), F.col("j").alias("other")).union(pairs.select("j", "i"))
    linked = both.join(size.select(F.col("profile").alias("other"), F.col("cases").alias("n")), "other").groupBy("profile").agg(F.sum("n").alias("linked"))
    return size.join(linked, "profile", "left").select("profile", "cases", F.coalesce("linked", F.lit(0)).alias("linked"))
