"""Approximate nearest neighbours by stable projections and a kd-tree, for the largest inner product.

Inner products become distances by one added component: with M the largest norm, a vector x gets sqrt(M^2 - |x|^2) and a query 0, and
the squared distance is M^2 + |q|^2 - 2 q.x. Vectors are projected by a Gaussian (2-stable) matrix to ``PROJECTED`` dimensions: the projected
squared distance over the true one is chi-square with as many degrees of freedom.

Rows are dealt by hash into blocks of about ``ROWS``, queries into blocks of ``QUERIES``; every query meets every block.
In a block a kd-tree holds the projected rows. A query takes its leaves from near to far, so that rows come in order of projected
distance (ring by ring), and verifies them by their true product. It stops as soon as a row nearer than the k-th best so far would, with
probability ``CONFIDENCE``, have had a smaller projected distance than everything still to come. The best k of each block are merged by
a partial top-k, ties to the smaller id.

Vectors that are null, zero, or hold null or non-finite components take no part. A row is never its own neighbour: rows with the query's
id are left out. Repeated rows are candidates each. A query id asks once: of repeated query rows, the smallest vector. Vectors of other lengths than the query's are no candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import common as C
from .vectors import matrix, valid_vectors

PROJECTED, CONFIDENCE, LEAF = 8, 0.97, 64
ROWS, QUERIES = 16_384, 1_024


def chi_square_quantile(p: float, d: int) -> float:
    """By bisection on the distribution function, for an even number of degrees of freedom."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(d // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - tail(mid) < p else (low, mid)
    return high


class Tree:
    """kd-tree over projected points: order of the points, leaf starts, and the leaves' boxes."""

    def __init__(self, p: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(p))
        bounds, stack = [], [(0, len(p))]
        while stack:
            a, z = stack.pop()
            if z - a <= leaf:
                bounds.append((a, z))
                continue
            part = p[self.order[a:z]]
            axis, mid = int((part.max(0) - part.min(0)).argmax()), (z - a) // 2
            self.order[a:z] = self.order[a:z][np.argpartition(part[:, axis], mid)]
            stack += [(a + mid, z), (a, a + mid)]
        bounds.sort()
        self.start = np.array([b[0] for b in bounds] + [len(p)])
        self.points = p[self.order]
        self.low = np.minimum.reduceat(self.points, self.start[:-1]) if len(p) else p
        self.high = np.maximum.reduceat(self.points, self.start[:-1]) if len(p) else p

    def leaf_distances(self, q: np.ndarray) -> np.ndarray:
        d = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (d * d).sum(1)


def search(tree: Tree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, qp: np.ndarray, qid: int, k: int, top: float, stop: float):
    """(ids, products) of the query's k best of a block; x and ids in the tree's order; top: M^2 + |q|^2."""
    far = tree.leaf_distances(qp)
    leaves = np.argsort(far, kind="stable")
    far = far[leaves]
    best_s, best_i, kth, at, run = np.zeros(0), np.zeros(0, np.int64), -math.inf, 0, 8
    while at < len(leaves):
        if len(best_s) == k:
            left = max(top - 2 * kth, 0.0)
            if far[at] > stop * left:
                break
        ring = np.concatenate([np.arange(tree.start[j], tree.start[j + 1]) for j in leaves[at : at + run]])
        at, run = at + run, run * 2
        if len(best_s) == k:
            # within the ring: rows that the test already rules out are left where they are
            d = tree.points[ring] - qp
            ring = ring[(d * d).sum(1) <= stop * left]
        # each row by itself, so that equal vectors get equal products wherever they stand
        s = (x[ring] * q).sum(1)
        use = (ids[ring] != qid) & (s >= kth)
        s, i = np.concatenate([best_s, s[use]]), np.concatenate([best_i, ids[ring][use]])
        o = np.lexsort((i, -s))[:k]
        best_s, best_i = s[o], i[o]
        kth = best_s[-1] if len(best_s) == k else -math.inf
    return best_i, best_s


def _search_cell(k: int, most: float, seed: int, confidence: float):
    def run(key, rows, queries):
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(rows) or not len(queries):
            return none
        x, ids = matrix(rows["v"]), np.array(rows["id"])
        q, qids = matrix(queries["v"]), np.array(queries["id"])
        d = x.shape[1]
        rng = np.random.default_rng(seed)
        project = rng.normal(size=(d + 1, PROJECTED))
        more = np.sqrt(np.maximum(most * most - (x * x).sum(1), 0))
        tree = Tree(np.concatenate([x, more[:, None]], 1) @ project)
        x, ids = x[tree.order], ids[tree.order]
        stop = chi_square_quantile(confidence, PROJECTED)
        qp = q @ project[:d]
        out = ([], [], [])
        for i in range(len(q)):
            near, s = search(tree, x, ids, q[i], qp[i], int(qids[i]), k, most * most + float(q[i] @ q[i]), stop)
            out[0].append(np.full(len(near), qids[i]))
            out[1].append(near)
            out[2].append(s)
        return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("query_id", "vec_id", "score"), out)})

    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 5, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the largest inner product that were found for every query."""
    C.shared_dir(vectors.sparkSession)
    rows = valid_vectors(vectors, id_col, vector_col).where("id IS NOT NULL").withColumn("d", F.size("v"))
    asked = valid_vectors(queries, id_col, vector_col).where("id IS NOT NULL").groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, most = rows.agg(F.count("*"), F.max(norm)).first()
    m = asked.count()
    row_blocks, query_blocks = max(1, -(-n // ROWS)), max(1, -(-m // QUERIES))
    r = rows.withColumn("rb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(row_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    q = asked.withColumn("qb", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(query_blocks)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))
    by = ["d", "rb", "qb"]
    # as many partitions as cells, so that small cells are not put together into a few tasks
    cells = 2 * row_blocks * query_blocks
    found = r.repartition(cells, *by).groupBy(*by).cogroup(q.repartition(cells, *by).groupBy(*by)).applyInArrow(_search_cell(k, float(most or 0) * (1 + 1e-12), seed, confidence), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
