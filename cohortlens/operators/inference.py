"""Permutation tests, agreement of labelings and of raters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import stats


#: Draws that one task works out at once; standard deviations around the mode that a draw can fall into.
DRAWS_AT_ONCE, SPREAD = 250, 12


def _urn(total: int, marked: int, drawn: int, u: float) -> int:
    """How many marked balls are among ``drawn`` of ``total``: the inverse of the hypergeometric distribution at ``u``.

    Weights of the counts around the mode follow from their ratios; what lies beyond ``SPREAD`` deviations has a chance below 1e-30.
    """
    import numpy as np

    low, high = max(0, drawn - (total - marked)), min(drawn, marked)
    if low == high:
        return low
    mean = drawn * marked / total
    wide = int(SPREAD * (mean * (1 - marked / total) * (total - drawn) / max(1, total - 1)) ** 0.5) + 30
    low, high = max(low, int(mean) - wide), min(high, int(mean) + wide)
    k = np.arange(low, high, dtype=float)
    weight = np.cumprod(np.concatenate([[1.0], (marked - k) * (drawn - k) / ((k + 1) * (total - marked - drawn + k + 1))]))
    upto = np.cumsum(weight)
    return low + int(np.searchsorted(upto, u * upto[-1]))


def _draws(seed: int, draws: int):
    """Rows (group, from, clusters) to rows (group, draw, cluster, n, positives)."""
    import hashlib

    import pandas as pd

    def run(frames):
        for pdf in frames:
            out = []
            for group, start, clusters in zip(pdf["_group"], pdf["_from"], pdf["_clusters"]):
                names = [str(c["name"]) for c in clusters]
                for draw in range(start, min(draws, start + DRAWS_AT_ONCE)):
                    total, marked = sum(c["n"] for c in clusters), sum(c["y"] for c in clusters)
                    for i, c in enumerate(clusters):
                        u = (int(hashlib.md5(f"{seed}:{draw}:{names[i]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                        got = _urn(total, marked, c["n"], u)
                        out.append((group, draw, i, got))
                        total, marked = total - c["n"], marked - got
            yield pd.DataFrame(out, columns=["_group", "draw", "_i", "positives"])

    return run


def cluster_counts(df: DataFrame, cluster: str, positive: Column, group: Sequence[str] = ()) -> DataFrame:
    """(group, cluster, n, positives): all that permutations need of the rows."""
    return df.groupBy(*group, F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"), F.coalesce(F.sum(positive.cast("long")), F.lit(0)).alias("positives"))


def permuted_counts(counts: DataFrame, draws: int, seed: int = 42, group: Sequence[str] = ()) -> DataFrame:
    """Positive cases of every cluster under permutation (STT-05, STT-06, STT-22): (group, draw, cluster, n, positives) from ``cluster_counts``.

    Permuting the endpoint is drawing its positive cases into the clusters without replacement, so a draw takes one hypergeometric
    number for each cluster, in their order, of what the clusters before have left. Number c of draw b is the
    inverse at the hash share of seed:b:c, c the cluster as text. The work is draws times clusters, however many rows were counted.
    """
    clusters = F.array_sort(F.collect_list(F.struct("cluster", F.coalesce(F.col("cluster").cast("string"), F.lit("")).alias("name"), "n", F.col("positives").alias("y")))).alias("_clusters")
    urns = counts.groupBy(*group).agg(clusters).select(F.struct(*group, F.lit(0).alias("_")).alias("_group"), "_clusters")
    slim = F.transform("_clusters", lambda c: F.struct(c["name"].alias("name"), c["n"].alias("n"), c["y"].alias("y")))
    parts = urns.select("_group", slim.alias("_clusters"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(DRAWS_AT_ONCE))).alias("_from"))
    key = F.to_json("_group")
    spread = parts.select(key.alias("_group"), "_clusters", "_from").repartition("_group", "_from")
    drawn = spread.mapInPandas(_draws(seed, draws), "_group string, draw int, _i int, positives long")
    # clusters are few: one row of a group holds them
    named = drawn.join(urns.select(key.alias("_group"), F.col("_group").alias("_g"), "_clusters"), "_group")
    return named.select(*(F.col(f"_g.{g}").alias(g) for g in group), "draw", F.col("_clusters")[F.col("_i")]["cluster"].alias("cluster"), F.col("_clusters")[F.col("_i")]["n"].alias("n"), "positives")


def permuted_shares(df: DataFrame, key: str, cluster: str, positive: Column, draws: int, seed: int = 42, group: Sequence[str] = ()) -> DataFrame:
    """``permuted_counts`` of rows; ``key`` names them and has no part in the draws."""
    return permuted_counts(cluster_counts(df, cluster, positive, group), draws, seed, group)


def max_share_test(df: DataFrame, key: str, cluster: str, positive: Column, draws: int, seed: int = 42) -> DataFrame:
    """Selection-aware test (STT-05, STT-21): (observed_max, n_ge, draws, p, null_mean, null_p95). Shares are compared as exact fractions."""
    observed = cluster_counts(df, cluster, positive)
    best = observed.agg(F.max_by(F.struct("positives", "n"), F.struct(F.col("positives") / F.col("n"), "n")).alias("o"))
    null = permuted_counts(observed, draws, seed)
    per = null.withColumn("o", best.scalar()).withColumn("ge", F.col("positives") * F.col("o.n") >= F.col("o.positives") * F.col("n"))
    draw = per.groupBy("draw").agg(F.max(F.col("ge").cast("int")).alias("ge"), F.max(F.col("positives") / F.col("n")).alias("m"), F.first("o").alias("o"))
    return draw.agg(F.max(F.col("o.positives") / F.col("o.n")).alias("observed_max"), F.sum("ge").alias("n_ge"), F.count("*").alias("draws"), stats.permutation_p(F.sum("ge"), F.count("*")).alias("p"), F.avg("m").alias("null_mean"), F.percentile("m", F.lit(0.95)).alias("null_p95"))


def fixed_cluster_test(df: DataFrame, key: str, cluster: str, positive: Column, draws: int, seed: int = 42) -> DataFrame:
    """Share of every cluster against its permutations, by integer counts (STT-06)."""
    return fixed_cluster_counts(cluster_counts(df, cluster, positive), draws, seed)


def fixed_cluster_counts(counts: DataFrame, draws: int, seed: int = 42, group: Sequence[str] = ()) -> DataFrame:
    """``fixed_cluster_test`` from ``cluster_counts``, for every group: (group, cluster, n_cases, observed, n_ge, p)."""
    null = permuted_counts(counts, draws, seed, group).select(*group, "cluster", "positives")
    seen = counts.select(*(F.col(g).alias(f"_{g}") for g in group), F.col("cluster").alias("_cluster"), F.col("n").alias("n_cases"), F.col("positives").alias("observed"))
    same = null["cluster"].eqNullSafe(seen["_cluster"])
    for g in group:
        same = same & null[g].eqNullSafe(seen[f"_{g}"])
    ge = F.count_if(F.col("positives") >= F.col("observed"))
    return null.join(seen, same).groupBy(*group, "cluster", "n_cases", "observed").agg(ge.alias("n_ge"), stats.permutation_p(ge, F.count("*")).alias("p"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ari (1.0 where the denominator vanishes) (STT-09)."""
    cells = df.select(F.col(a).alias("_a"), F.col(b).alias("_b")).groupBy("_a", "_b").agg(F.count("*").alias("n"))
    g = cells.groupingSets([["_a", "_b"], ["_a"], ["_b"], []], "_a", "_b").agg(F.grouping_id("_a", "_b").alias("g"), F.sum("n").alias("n"))
    part = lambda k: F.sum(F.when(F.col("g") == k, stats.pairs(F.col("n"))))
    s = g.agg(part(0).alias("ij"), part(1).alias("i"), part(2).alias("j"), part(3).alias("t"))
    expected, most = F.col("i") * F.col("j") / F.when(F.col("t") > 0, F.col("t")), (F.col("i") + F.col("j")) / 2
    return s.select(F.coalesce(F.when(most != expected, (F.col("ij") - expected) / F.when(most != expected, most - expected)), F.lit(1.0)).alias("ari"))


def mask_jaccard(df: DataFrame, a: Column, b: Column, empty: float = 1.0) -> DataFrame:
    return df.agg(stats.jaccard(F.count_if(a & b), F.count_if(a | b), empty).alias("jaccard"))


def kappa_report(pairs: DataFrame, fields: Sequence[str], gate: str | None = None) -> DataFrame:
    """Cohen's kappa of <field>_r1 and <field>_r2 (0, 1 or null) for every field; fields other than the gate count where both gates are 1 (STT-12)."""
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_r1").cast("int").alias("x"), F.col(f"{f}_r2").cast("int").alias("y"), (F.lit(True) if gate is None or f == gate else F.coalesce((F.col(f"{gate}_r1") == 1) & (F.col(f"{gate}_r2") == 1), F.lit(False))).alias("on")) for f in fields))
    long = pairs.select(F.explode(rows).alias("r")).select("r.*")
    n = lambda x, y: F.count_if(F.col("on") & (F.col("x") == x) & (F.col("y") == y))
    cells = long.groupBy("field").agg(n(1, 1).alias("a"), n(1, 0).alias("b"), n(0, 1).alias("c"), n(0, 0).alias("d"))
    return cells.select("field", *(v.alias(k) for k, v in stats.cohen_kappa(*(F.col(k) for k in "abcd")).items()))


def adjudication(pairs: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows with a disagreement among non-null pairs, with empty final columns (STT-13)."""
    differs = F.lit(False)
    for f in fields:
        differs = differs | F.coalesce(F.col(f"{f}_r1") != F.col(f"{f}_r2"), F.lit(False))
    return pairs.where(differs).select(*key, *(c for f in fields for c in (F.col(f"{f}_r1"), F.col(f"{f}_r2"), F.lit(None).cast("int").alias(f"{f}_final"))))


def consensus(pairs: DataFrame, adjudicated: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Agreed value, else the adjudicator's, else null (STT-14)."""
    j = pairs.join(adjudicated.select(*key, *(F.col(f"{f}_final") for f in fields)), list(key), "left")
    return j.select(*key, *(F.when(F.col(f"{f}_r1") == F.col(f"{f}_r2"), F.col(f"{f}_r1")).otherwise(F.col(f"{f}_final")).alias(f) for f in fields))


def needs_adjudication(fields: Sequence[str]) -> Column:
    """A pair differs, a null against a value included (STT-15)."""
    out = F.lit(False)
    for f in fields:
        out = out | ~F.col(f"{f}_r1").eqNullSafe(F.col(f"{f}_r2"))
    return out


def direction_consistency(effects: DataFrame, key: str, split: str, direction: str) -> DataFrame:
    """Directions of both splits side by side (STT-18, JN-05)."""
    side = lambda s: F.max(F.when(F.col(split) == s, F.col(direction)))
    g = effects.groupBy(key).agg(side("discovery").alias("direction_discovery"), side("confirmation").alias("direction_confirmation"))
    known = ~F.col("direction_discovery").isin("unknown", "neutral")
    return g.withColumn("consistent", F.coalesce(known & (F.col("direction_discovery") == F.col("direction_confirmation")), F.lit(False)))


def replication_gate(p: float | None, share: float | None, baseline: float | None, alpha: float = 0.05) -> bool:
    """p below alpha, share finite and above the baseline (STT-11)."""
    import math

    known = all(x is not None and math.isfinite(x) for x in (p, share, baseline))
    return bool(known and p < alpha and share > baseline)
