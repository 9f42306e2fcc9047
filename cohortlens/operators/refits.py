"""k-means of many replicates of one cohort at once.

Every round is one pass over the rows: a task adds up, for all replicates and restarts side by side, the rows that each of its
centres is nearest to, and hands on one row of sums for each centre. No row is copied for a replicate and no group
holds a cohort; what reaches the driver are centres, whose number is replicates times restarts times clusters.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bytes of centres that a pass may carry; more runs go in turns. Elements of a task's largest array.
CENTRES, ELEMENTS = 32_000_000, 4_000_000
#: Rounds of the parallel seeding, candidates that each adds for every cluster, and passes of the refinement.
SEEDING, OVERSAMPLING, ROUNDS = 2, 2, 50


def _matrix(column) -> np.ndarray:
    """Arrow lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    """Hash shares of row ids, from 0 to 1, for a salt."""
    x = ids.astype(np.int64).view(np.uint64)
    for s in salt:
        x = x ^ np.uint64((s * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(float) / 2**53


def _batches(batches):
    """(ids, vectors, members or None) in runs of rows."""
    for b in batches:
        x, ids = _matrix(b.column(1)), b.column(0).to_numpy(zero_copy_only=False)
        yield ids, x, _matrix(b.column(2)) if b.num_columns > 2 else None


def _blocks(x: np.ndarray, width: int):
    step = max(1, ELEMENTS // max(1, width))
    return (slice(a, a + step) for a in range(0, len(x), step))


def _sums(centres: np.ndarray, replicate: np.ndarray):
    """One row for each run and cluster: rows, cost and the sum of their vectors."""
    runs, k, dims = centres.shape
    flat, far = centres.reshape(runs * k, dims), (centres * centres).sum(2)

    def run(batches):
        n, cost, total = np.zeros((runs, k)), np.zeros((runs, k)), np.zeros((runs, k, dims))
        for _, x, member in _batches(batches):
            for part in _blocks(x, runs * k):
                y = x[part]
                d = far - 2 * (y @ flat.T).reshape(len(y), runs, k)
                home, near = d.argmin(2), d.min(2) + (y * y).sum(1)[:, None]
                inside = np.ones(home.shape, bool) if member is None else member[part][:, replicate]
                for c in range(k):
                    on = ((home == c) & inside).astype(float)
                    n[:, c] += on.sum(0)
                    cost[:, c] += (on * near).sum(0)
                    total[:, c] += on.T @ y
        at = np.indices((runs, k)).reshape(2, -1)
        columns = [pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(n.ravel()), pa.array(cost.ravel()), *(pa.array(total[:, :, j].ravel()) for j in range(dims))]
        yield pa.RecordBatch.from_arrays(columns, names=["run", "cluster", "n", "cost", *(f"s{j}" for j in range(dims))])

    return run


def batched_lloyd(rows: DataFrame, starts: np.ndarray, replicate: Sequence[int], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(centres, cost) of every run from its start (runs, clusters, dims). ``rows`` has id, vector and, where replicates are
    samples, member (an array of flags); ``replicate`` names the flag of each run. A cluster without rows keeps its centre; a run that has settled is left out."""
    centres, cost = np.array(starts, float), np.zeros(len(starts))
    replicate = np.asarray(replicate)
    runs, k, dims = centres.shape
    turn = max(1, CENTRES // (8 * k * dims))
    for first in range(0, runs, turn):
        open_ = np.arange(first, min(runs, first + turn))
        for _ in range(rounds):
            schema = "run int, cluster int, n double, cost double, " + ", ".join(f"s{j} double" for j in range(dims))
            part = rows.mapInArrow(_sums(centres[open_], replicate[open_]), schema)
            found = part.groupBy("run", "cluster").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *(F.sum(f"s{j}").alias(f"s{j}") for j in range(dims))).toPandas()
            new = centres[open_].copy()
            some = found[found["n"] > 0]
            new[some["run"], some["cluster"]] = some.iloc[:, 4:].to_numpy() / some["n"].to_numpy()[:, None]
            cost[open_] = np.bincount(found["run"], found["cost"], len(open_))
            settled = np.array([np.allclose(a, b) for a, b in zip(new, centres[open_])])
            centres[open_] = np.where(settled[:, None, None], centres[open_], new)
            open_ = open_[~settled]
            if not len(open_):
                break
    return centres, cost


def _candidates(chosen: list[np.ndarray], share: np.ndarray, salts: list[int], step: int, sizes: np.ndarray | None):
    """Rows that the seeding takes up: (replicate, weight, vector). With ``sizes``, rows that are nearest to each candidate instead; with neither, the cost."""

    def run(batches):
        cost = np.zeros(len(chosen))
        near = [np.zeros(len(c)) for c in chosen]
        for ids, x, member in _batches(batches):
            norm = (x * x).sum(1)
            for r, c in enumerate(chosen):
                on = np.ones(len(x), bool) if member is None else member[:, r]
                if len(c):
                    d = np.maximum(0, (c * c).sum(1) - 2 * x @ c.T + norm[:, None])
                    if sizes is not None:
                        near[r] += np.bincount(d.argmin(1)[on], minlength=len(c))
                        continue
                    d = d.min(1)
                    cost[r] += d[on].sum()
                else:
                    d = np.ones(len(x))
                if share is not None:
                    took = on & (_uniform(ids, salts[r], step) < d * share[r])
                    if took.any():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(took.sum(), r), pa.int32()), pa.array(_uniform(ids[took], salts[r], -1)), pa.array(list(x[took]), pa.list_(pa.float64()))], names=["replicate", "weight", "vector"])
        if sizes is not None:
            out = [(r, float(v), [float(i)]) for r, n in enumerate(near) for i, v in enumerate(n)]
        else:
            out = [(r, float(v), None) for r, v in enumerate(cost)] if share is None else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.float64(), pa.list_(pa.float64())))], names=["replicate", "weight", "vector"])

    return run


def parallel_seeds(rows: DataFrame, sizes: np.ndarray, k: int, salts: list[int], restarts: int) -> np.ndarray:
    """Starts (replicates times restarts, clusters, dims) by k-means||: a few passes gather candidates by their distance, weighted by
    the rows near them, and k-means++ picks among these on the driver. ``sizes``: rows of each replicate."""
    schema = "replicate int, weight double, vector array<double>"
    apply = lambda *a: rows.mapInArrow(_candidates(*a), schema)
    # a first row by hash: some twenty are thought of, the least is taken
    empty = [np.zeros((0, 0))] * len(sizes)
    wide, found = 20.0, {}
    while len(found) < len(sizes):
        first = apply(empty, np.minimum(1.0, wide / sizes), salts, 0, None).groupBy("replicate").agg(F.min_by("vector", F.struct("weight", "vector")).alias("v")).collect()
        found = {r.replicate: np.array(r.v) for r in first}
        wide *= 10
    chosen = [found[r][None] for r in range(len(sizes))]
    for step in range(1, SEEDING + 1):
        cost = {r.replicate: r.c for r in apply(chosen, None, salts, step, None).groupBy("replicate").agg(F.sum("weight").alias("c")).collect()}
        share = np.array([OVERSAMPLING * k / cost[r] if cost[r] > 0 else 0.0 for r in range(len(sizes))])
        more = apply(chosen, share, salts, step, None).distinct().collect()
        for r in sorted(more, key=lambda m: (m.replicate, m.weight, m.vector)):
            chosen[r.replicate] = np.concatenate([chosen[r.replicate], [r.vector]])
    near = apply(chosen, None, salts, 0, sizes).groupBy("replicate", F.col("vector")[0].cast("int").alias("i")).agg(F.sum("weight").alias("n")).collect()
    weight = [np.zeros(len(c)) for c in chosen]
    for r in near:
        weight[r.replicate][r.i] = r.n
    return np.array([plus_plus(c, w, k, np.random.default_rng([salt & 0xFFFFFFFF, j])) for c, w, salt in zip(chosen, weight, salts) for j in range(restarts)])


def plus_plus(points: np.ndarray, weight: np.ndarray, k: int, rng) -> np.ndarray:
    """k-means++ over weighted points; points repeat where there are fewer than k different ones."""
    at = [int(np.searchsorted(np.cumsum(weight), rng.random() * weight.sum()))]
    d = ((points - points[at[0]]) ** 2).sum(1)
    while len(at) < k:
        w = np.cumsum(d * weight)
        at.append(int(np.searchsorted(w, rng.random() * w[-1], "right")) if w[-1] > 0 else at[len(at) % len(set(at))])
        d = np.minimum(d, ((points - points[at[-1]]) ** 2).sum(1))
    return points[at]


def assigned(rows: DataFrame, centres: np.ndarray, numbers: list[list[int]], replicates: Sequence[int], kind: str) -> DataFrame:
    """(replicate, key, cluster, baseline) of every row in every replicate: its nearest centre under the number it has there.

    ``rows`` has key, vector, baseline; the output is as long as rows times replicates and is made row by row.
    """
    replicates_, k, dims = centres.shape
    flat, far = centres.reshape(replicates_ * k, dims), (centres * centres).sum(2)
    names = np.array(numbers, "int32")

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1))
            for part in _blocks(x, replicates_ * k):
                y = x[part]
                home = (far - 2 * (y @ flat.T).reshape(len(y), replicates_, k)).argmin(2)
                for r, name in enumerate(replicates):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), name, "int32")), b.column(0).slice(part.start, len(y)), pa.array(names[r][home[:, r]]), b.column(2).slice(part.start, len(y))], names=["replicate", "key", "cluster", "baseline"])

    return rows.mapInArrow(run, f"replicate int, key {kind}, cluster int, baseline int")
