"""Vectors: pooling, centroids, cosine, assignment, matching of clusters, PCA, k-means, co-assignment."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .coassign import coassigned, profiles

EPS = 1e-12
#: Centroids that may be sent to every task.
MAX_CENTROIDS = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def mean_vectors(df: DataFrame, key: Sequence[str], vector: str, normalise: bool = False) -> DataFrame:
    """Mean vector of every key, at length 1 if asked (AGG-16, AGG-17). Sums are combined before the shuffle."""
    per = df.select(*key, F.posexplode(F.col(vector).cast("array<double>")).alias("_p", "_x")).groupBy(*key, "_p").agg(F.avg("_x").alias("_m"))
    rows = F.array_sort(F.collect_list(F.struct("_p", "_m")))
    out = per.groupBy(*key).agg(F.transform(rows, lambda r: r["_m"]).alias(vector))
    if normalise:
        length = F.greatest(norm(F.col(vector)), F.lit(EPS))
        out = out.withColumn("_l", length).withColumn(vector, F.transform(vector, lambda x: x / F.col("_l"))).drop("_l")
    return out


def cosine_matrix(a: DataFrame, b: DataFrame, a_id: str, b_id: str, vector: str) -> DataFrame:
    """Cosine of every pair of two small centroid tables (ML-05, JN-12)."""
    right = b.agg(F.collect_list(F.struct(F.col(b_id).alias("j"), F.col(vector).alias("v"))).alias("r"))
    return a.select(F.col(a_id).alias("discovery_cluster"), F.col(vector).alias("v"), F.explode(right.scalar()).alias("x")).select("discovery_cluster", F.col("x.j").alias("confirmation_cluster"), cosine(F.col("v"), F.col("x.v")).alias("cosine_similarity"))


def nearest_centroid(df: DataFrame, centroids: DataFrame, cluster: str, vector: str, by: str = "cosine") -> DataFrame:
    """Nearest centroid of every row, ties to the smallest cluster (JN-10, JN-11, ML-09).

    Centroids come as one array with every task, after a check of their number.
    """
    few = centroids.limit(MAX_CENTROIDS + 1).count() <= MAX_CENTROIDS
    if not few:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    c = centroids.agg(F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("c"), F.col(vector).cast("array<double>").alias("v")))).alias("a"))
    score = lambda x: F.struct((-cosine(F.col(vector), x["v"]) if by == "cosine" else squared_distance(F.col(vector), x["v"])).alias("d"), x["c"].alias("c"))
    best = df.withColumn("_c", c.scalar()).withColumn("_b", F.array_min(F.transform("_c", score)))
    return best.withColumn("assigned", F.col("_b.c")).withColumn("score", -F.col("_b.d") if by == "cosine" else F.col("_b.d")).drop("_c", "_b")


def best_matching(similarity: dict[tuple, float]) -> dict:
    """One-to-one matching of largest total similarity (ML-06, ML-07), as many pairs as the smaller side has; among equal totals
    the first rows get the smallest columns. A pair that is not given counts 0.

    Shortest augmenting paths, cubic in the number of clusters; then, along edges that any best matching may use, each row
    in turn is moved to the smallest column that leaves the rest matched.
    """
    import numpy as np

    rows, cols = sorted({i for i, _ in similarity}), sorted({j for _, j in similarity})
    size = max(len(rows), len(cols))
    cost = np.zeros((size, size))
    for (i, j), s in similarity.items():
        cost[rows.index(i), cols.index(j)] = -s
    # potentials of rows and columns; the row of each column and the other way round
    u, v, row_of, col_of = np.zeros(size), np.zeros(size), np.full(size, -1), np.full(size, -1)
    for i in range(size):
        shortest, back, done = np.full(size, np.inf), np.full(size, -1), np.zeros(size, bool)
        at, reach, end = i, 0.0, -1
        while end < 0:
            far = reach + cost[at] - u[at] - v
            closer = ~done & (far < shortest)
            shortest[closer], back[closer] = far[closer], at
            j = int(np.where(done, np.inf, shortest).argmin())
            reach, done[j] = shortest[j], True
            if row_of[j] < 0:
                end = j
            else:
                at = int(row_of[j])
        u[i] += reach
        for j in np.flatnonzero(done):
            if row_of[j] >= 0:
                u[row_of[j]] += reach - shortest[j]
            v[j] -= reach - shortest[j]
        j = end
        while j >= 0:
            r = int(back[j])
            row_of[j], col_of[r], j = r, j, int(col_of[r])
    tight = np.abs(cost - u[:, None] - v) <= 1e-9

    def moved(r: int, free: int, barred: set[int]) -> bool:
        """Give row ``r`` another column, moving later rows on until one takes ``free``."""
        for c in np.flatnonzero(tight[r]):
            if int(c) not in barred:
                barred.add(int(c))
                if c == free or moved(int(row_of[c]), free, barred):
                    row_of[c], col_of[r] = r, c
                    return True
        return False

    fixed: set[int] = set()
    for i in range(len(rows)):
        for c in map(int, np.flatnonzero(tight[i])):
            if c in fixed:
                continue
            if c == col_of[i]:
                break
            holder, free, before = int(row_of[c]), int(col_of[i]), (row_of.copy(), col_of.copy())
            if moved(holder, free, fixed | {c}):
                row_of[c], col_of[i] = i, c
                break
            row_of[:], col_of[:] = before
        fixed.add(int(col_of[i]))
    return {r: cols[col_of[i]] for i, r in enumerate(rows) if col_of[i] < len(cols)}


def match_clusters(matrix: DataFrame) -> DataFrame:
    """cosine_matrix with a boolean ``matched`` (ML-08). The k x k table is small by nature."""
    sim = {(r[0], r[1]): r[2] for r in matrix.select("discovery_cluster", "confirmation_cluster", "cosine_similarity").collect()}
    chosen = [(d, c) for d, c in best_matching(sim).items()]
    hit = F.lit(False)
    for d, c in chosen:
        hit = hit | ((F.col("discovery_cluster") == d) & (F.col("confirmation_cluster") == c))
    return matrix.withColumn("matched", hit)


#: Cases of a profile in a block; pairs of cases that a task spreads, and tasks at most.
SPREAD, TASK_PAIRS, MOST_TASKS = 1_024, 16_000_000, 100_000


def coassignment(assignments: DataFrame, key: str, replicate: str, cluster: str) -> DataFrame:
    """Share of replicates in which two cases fall together (ML-12), for pairs of cases that ever do: as many rows as there are such
    pairs. ``coassign.profiles`` and ``coassign.coassigned`` give the same in the size of the distinct profiles.
    """
    cases = profiles(assignments, key, replicate, cluster)
    total = assignments.agg(F.count_distinct(replicate).alias("n"))
    pairs = coassigned(cases, 0.0).select("i", "j", "coassignment")
    within = cases.groupBy("profile").agg(F.first(F.size("clusters")).alias("n")).select(F.col("profile").alias("i"), F.col("profile").alias("j"), (F.col("n") / total.scalar()).alias("coassignment"))
    both = pairs.union(within)
    # a profile's cases go in blocks, and two blocks are one row until they are spread: no task holds all pairs of a profile
    size = cases.groupBy("profile").agg(F.count("*").alias("n"))
    blocks = cases.join(size, "profile").select("profile", key, F.pmod(F.xxhash64(key), F.ceil(F.col("n") / SPREAD)).alias("b")).groupBy("profile", "b").agg(F.collect_list(key).alias("keys"))
    of = lambda table, side, name: table.select(F.col("profile").alias(side), F.col(name).alias("_" + side))
    rows = both.join(of(size, "i", "n"), "i").join(of(size, "j", "n"), "j").agg(F.sum(F.col("_i").cast("double") * F.col("_j"))).first()[0] or 0
    tasks = max(int(assignments.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, ceil(rows / TASK_PAIRS)))
    met = both.join(of(blocks, "i", "keys"), "i").join(of(blocks, "j", "keys"), "j").repartition(tasks)
    spread = met.select("i", "j", F.explode("_i").alias("_i"), "_j", "coassignment").select("i", "j", "_i", F.explode("_j").alias("_j"), "coassignment").where("i < j or _i < _j")
    return spread.select(F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), "coassignment")


def membership(assignments: DataFrame, key: str, chosen: Column, core: float = 0.8) -> DataFrame:
    """Probability of falling into the chosen cluster, and whether a case is core."""
    return assignments.groupBy(key).agg(F.avg(chosen.cast("double")).alias("probability")).withColumn("core", F.col("probability") >= core)


def pca(df: DataFrame, key: str, vector: str, fit_on: Column | None = None, share: float = 0.95, most: int = 50) -> tuple[DataFrame, int]:
    """Centred principal components with the least number that explains ``share`` (ML-02, WIN-08): (key, features array), number."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    fit = v.where(fit_on) if fit_on is not None else v
    first = fit.select(F.size(vector)).first()
    if first is None:
        raise ValueError("no rows to fit on")
    k = max(1, min(most, first[0], fit.count()))
    scaler = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(fit)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(scaler.transform(fit))
    total, n = 0.0, k
    for i, e in enumerate(model.explainedVariance.toArray()):
        total += e
        if total >= share - 1e-12:
            n = i + 1
            break
    out = model.transform(scaler.transform(v)).withColumn(vector, F.slice(vector_to_array("_p"), 1, n))
    return out.drop("_v", "_c", "_p"), n


def kmeans(df: DataFrame, vector: str, k: int, seeds: Sequence[int] = range(10)) -> DataFrame:
    """Best of several seeded runs by cost (ML-03): adds ``cluster``. k is at least 2 and at most the number of rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = df.withColumn("_f", array_to_vector(F.col(vector).cast("array<double>")))
    v.cache()
    try:
        if k < 2 or v.limit(k).count() < k:
            raise ValueError("k must be at least 2 and at most the number of rows")
        models = [KMeans(k=k, seed=s, featuresCol="_f", predictionCol="cluster").fit(v) for s in seeds]
        best = min(models, key=lambda m: m.summary.trainingCost)
    finally:
        v.unpersist()
    return best.transform(v).drop("_f")


def pick_k(df: DataFrame, vector: str, ks: Sequence[int], seed: int = 42) -> int:
    """k with the largest silhouette, ties to the smaller."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    score = {}
    for k in ks:
        c = kmeans(df, vector, k, [seed]).withColumn("_f", array_to_vector(F.col(vector).cast("array<double>")))
        score[k] = ClusteringEvaluator(featuresCol="_f", predictionCol="cluster").evaluate(c)
    return min(score, key=lambda k: (-score[k], k))


def rank_in_cluster(df: DataFrame, cluster: str, probability: str, tie: str) -> DataFrame:
    """Place of every row by cluster, then falling probability (WIN-10): its rank in the cluster after the sizes of the clusters before."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("_n"))
    # as many rows as there are clusters
    before = sizes.select(F.col(cluster).alias("_c"), F.coalesce(F.sum("_n").over(W.orderBy(cluster).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(cluster).orderBy(F.desc(probability), tie)))
    return ranked.join(before, F.col(cluster).eqNullSafe(F.col("_c"))).withColumn("place", F.col("_before") + F.col("_r")).drop("_c", "_before", "_r")
