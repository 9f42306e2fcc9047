"""Near-duplicate embeddings by spherical k-means cells and blocked cosine products.

1. Equal vectors form one class; a class is compared once and counts with its members.
2. Spherical k-means, fitted on the driver on at most ``SAMPLE`` classes (those with the smallest hash), gives cells. A class
   is at home in the cell with the largest cosine, and a guest of every cell whose boundary with it is nearer than half the
   threshold's chord. Linked vectors on either side of a boundary are together at most a chord from it, so one of them is a guest of the other's cell.
3. The classes of a cell are packed into blocks, one row each. Blocks of one cell meet, and blocks of two cells where one holds a guest of the
   other's cell: the blocks are read once for each run of blocks that they meet, and written once, so the disk follows the rows, not the guests.
   Of two cells, guests are compared with all of the other block, and nothing else.
   Classes close enough to their cell's centre that any two of them must link (half the threshold's angle) are joined to
   one another and counted without a product.
4. Every task returns the number of links of its blocks' classes, and every block pair a forest of its links, both in proportion to the rows.
   Components of the forests give groups; the smallest id of a group is its representative.

Cosines are of doubles. Null, zero and non-finite vectors link with nothing and are their own component. Vectors of
different lengths never link. Repeated rows are vectors of their own and link with each other; rows with the same id
are counted by their row. A null id names no component. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C
from .vectors import matrix, unit, valid_vectors

SAMPLE, PER_CELL, MAX_CELLS, ROUNDS = 20_000, 1_500, 1_024, 10
#: Vector lengths that get cells of their own, the most frequent first; vectors of any other length share one cell, cut into blocks like all.
LENGTHS = 16
#: Home classes in a block, and rows of a product (guests, or classes of the same cell) at once.
BLOCK, GUESTS = 2_048, 256
#: Blocks that a task reads of either side, and rows that it takes over from Spark at once.
RUN, PAIRS_AT_ONCE = 16, 16
#: Slack for rounding in the distance to a boundary, which is compared with half the chord of a linked pair.
ROUNDING = 1e-9


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """Unit centres; seeds by squared chord, empty cells keep their centre."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    far = 1 - x @ centres[0]
    for _ in range(1, k):
        p = np.maximum(far, 0)
        if p.sum() < 1e-9:
            break
        centres.append(x[rng.choice(len(x), p=p / p.sum())])
        far = np.minimum(far, 1 - x @ centres[-1])
    c = np.array(centres)
    for _ in range(ROUNDS):
        home = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def _near(x: np.ndarray, c: np.ndarray, home: np.ndarray, cells: np.ndarray, chord: float) -> np.ndarray:
    """Which rows of ``x`` are guests of each of ``cells``: their boundary is nearer than half the chord."""
    s = x @ c[cells].T
    own = (x * c[home]).sum(1)
    away = np.sqrt(np.maximum(2 - 2 * (c[home] @ c[cells].T), 1e-12))
    return ((own[:, None] - s) / away <= chord / 2 + ROUNDING) & (home[:, None] != cells[None, :])


def _assign(centres: dict[int, np.ndarray], threshold: float, vectors: bool):
    """Home cell of each class, and whether it is close to the centre; with or without what travels with it."""
    half = np.cos(np.arccos(threshold) / 2) + 1e-9

    def run(batches):
        for b in batches:
            v = b.column(2)
            lens = np.diff(np.asarray(v.offsets))
            cell, core = lens.astype(np.int64) << 32, np.zeros(len(lens), bool)
            for d in np.unique(lens):
                c = centres.get(int(d))
                if c is not None:  # else no sample of this length: one cell, home of all
                    rows = np.flatnonzero(lens == d)
                    s = unit(matrix(v.take(pa.array(rows)))) @ c.T
                    home = s.argmax(1)
                    cell[rows] += home
                    core[rows] = s[np.arange(len(rows)), home] >= half
            columns = [b.column(0), b.column(1), v, pa.array(cell), pa.array(core)]
            yield pa.RecordBatch.from_arrays(columns if vectors else columns[3:4], names=["id", "members", "v", "cell", "core"] if vectors else ["cell"])

    return run


_BLOCKS = "cell long, block int, visits array<long>, ids binary, members binary, core binary, v binary"


def _pack(centres: dict[int, np.ndarray], threshold: float, kind: str):
    """A block as one row, with the cells of which any of its classes is a guest."""
    chord = (2 - 2 * threshold) ** 0.5

    def run(key, t):
        cell, block = (k.as_py() for k in key)
        t = t.sort_by("id")
        v = matrix(t["v"])
        c, visits = centres.get(cell >> 32), np.zeros(0, np.int64)
        if c is not None:
            x, home = unit(v), np.full(GUESTS, cell & 0xFFFFFFFF)
            some = np.zeros(len(c), bool)
            for at in range(0, len(x), GUESTS):
                part = x[at : at + GUESTS]
                some |= _near(part, c, home[: len(part)], np.arange(len(c)), chord).any(0)
            visits = np.flatnonzero(some) + (cell >> 32 << 32)
        raw = lambda name, k: [np.asarray(t[name]).astype(k).tobytes()]
        return pa.table({"cell": [cell], "block": pa.array([block], pa.int32()), "visits": pa.array([visits.tolist()], pa.list_(pa.int64())), "ids": raw("id", "<i8"), "members": raw("members", "<i8"), "core": raw("core", "u1"), "v": [v.astype(kind).tobytes()]})

    return run


_PAIRS = "id long, other long, links long"


def _find(up: np.ndarray, i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


class _Block:
    """One row of the packed blocks, and the links found for its classes."""

    def __init__(self, cell: int, ids, members, core, v, kind: str):
        self.cell, self.own = cell, cell & 0xFFFFFFFF
        self.ids, self.members, self.core = np.frombuffer(ids, "<i8"), np.frombuffer(members, "<i8"), np.frombuffer(core, "u1").astype(bool)
        self.x = unit(np.frombuffer(v, kind).reshape(len(self.ids), -1).astype(np.float64))
        self.x32 = self.x.astype(np.float32)
        self.links = np.zeros(len(self.ids), np.int64)


def _between(p: _Block, q: _Block, centres: dict[int, np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Count the links between two blocks, or within one; returns a forest of them as pairs of ids."""
    same = p is q
    ids = p.ids if same else np.concatenate([p.ids, q.ids])
    shift = 0 if same else len(p.ids)
    up, forest = np.arange(len(ids)), []

    def join(i, j):
        y, z = _find(up, i), _find(up, j)
        if y != z:
            up[y] = z
            forest.append((int(ids[i]), int(ids[j])))

    inside = p.cell == q.cell
    if inside:
        cl, cr = np.flatnonzero(p.core), np.flatnonzero(q.core)
        if len(cl) and len(cr):
            # all of them link: within a block each with every other, between blocks each with all of the other block
            p.links[cl] += q.members[cr].sum() - (p.members[cl] if same else 0)
            if not same:
                q.links[cr] += p.members[cl].sum()
            for i in np.unique(np.concatenate([cl, cr + shift])):
                join(int(i), int(cl[0]))
        products = [(np.arange(len(p.ids)), np.arange(len(q.ids)))]
    else:
        c, chord = centres[p.cell >> 32], (2 - 2 * threshold) ** 0.5
        near = lambda x, y: _near(x.x, c, np.full(len(x.ids), x.own), np.array([y.own]), chord)[:, 0]
        gp, gq = near(p, q), near(q, p)
        products = [(np.flatnonzero(gp), np.arange(len(q.ids))), (np.flatnonzero(~gp), np.flatnonzero(gq))]
    for left, right in products:
        y32 = q.x32[right].T
        for at in range(0, len(left) if len(right) else 0, GUESTS):
            rows = left[at : at + GUESTS]
            # single precision finds what may link, double precision decides
            i, j = np.nonzero(p.x32[rows] @ y32 >= np.float32(threshold - 1e-4))
            i, j = rows[i], right[j]
            if inside:
                use = ~(p.core[i] & q.core[j])
                if same:
                    use &= i < j
                i, j = i[use], j[use]
            for k in range(0, len(i), 50_000):
                a, b = i[k : k + 50_000], j[k : k + 50_000]
                sure = (p.x[a] * q.x[b]).sum(1) >= threshold
                a, b = a[sure], b[sure]
                np.add.at(p.links, a, q.members[b])
                np.add.at(q.links, b, p.members[a])
                b = b + shift
                while len(a):
                    # pairs already in one component need no edge
                    root = np.array([_find(up, n) for n in range(len(up))])
                    apart = np.flatnonzero(root[a] != root[b])[:2_000]
                    if not len(apart):
                        break
                    for n in apart:
                        join(int(a[n]), int(b[n]))
                    a, b = a[apart[-1] + 1 :], b[apart[-1] + 1 :]
    return forest


def _compare(centres: dict[int, np.ndarray], threshold: float, kind: str):
    """(id, null, links) of the classes of a task's blocks, and forests of the links as (id, other, 0)."""

    def table(ids, other, links):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(other, pa.int64()), pa.array(links, pa.int64())], names=["id", "other", "links"])

    def run(batches):
        held: dict[tuple[int, int], _Block] = {}

        def block(row: dict, side: str) -> _Block:
            key = row[f"{side}_cell"], row[f"{side}_block"]
            if key not in held:
                held[key] = _Block(key[0], *(row[f"{side}_{k}"] for k in ("ids", "members", "core", "v")), kind)
            return held[key]

        for b in batches:
            for row in b.to_pylist():
                forest = _between(block(row, "l"), block(row, "r"), centres, threshold)
                if forest:
                    yield table([f[0] for f in forest], [f[1] for f in forest], [0] * len(forest))
        for x in held.values():
            some = np.flatnonzero(x.links)
            yield table(x.ids[some], [None] * len(some), x.links[some])

    return run


def _hashes(v, name: str) -> list:
    return [F.xxhash64(v).alias(f"{name}0"), F.xxhash64(F.lit(1), v).alias(f"{name}1")]


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    C.shared_dir(vectors.sparkSession)
    good = valid_vectors(vectors, id_col, vector_col)
    kind = "<f8"
    if vectors.schema[vector_col].dataType.simpleString() == "array<float>":
        # the same numbers in half the bytes
        good, kind = good.withColumn("v", F.col("v").cast("array<float>")), "<f4"
    # a class is named by its smallest id, or by a hash where no member has one
    classes = C.cut(good.groupBy("v").agg(F.coalesce(F.min("id"), F.xxhash64(F.col("v").cast("array<double>"))).alias("id"), F.min("id").alias("least"), F.count("*").alias("members")))
    kinds = {r[0]: r[1] for r in classes.groupBy(F.size("v")).count().orderBy(F.desc("count"), F.col("size(v)")).limit(LENGTHS).collect()}
    centres = {}
    for d, n in kinds.items():
        hashed = classes.where(F.size("v") == d).select("v", F.xxhash64(F.col("v").cast("array<double>")).alias("h"))
        # the smallest hashes lie below this, so that no others are sorted
        below = min(2**63 - 1, int(-(2**63) + (1.2 * SAMPLE + 100) / n * 2**64))
        rows = hashed.where(F.col("h") <= below).orderBy("h").limit(SAMPLE).select("v")
        x = np.array([r[0] for r in rows.toLocalIterator()], np.float64).reshape(-1, d)
        k = int(min(MAX_CELLS, max(1, n // PER_CELL), max(1, len(x) // 8)))
        centres[d] = spherical_kmeans(unit(x), k)
    # cells are found twice, to count and to pack: cheaper than to write them
    slim = classes.select("id", "members", "v")
    sizes = C.cut(slim.mapInArrow(_assign(centres, threshold, False), "cell long").groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    n = sizes.agg(F.sum("blocks")).first()[0] or 1
    placed = slim.mapInArrow(_assign(centres, threshold, True), f"id long, members long, v array<{'float' if kind == '<f4' else 'double'}>, cell long, core boolean")
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("blocks")
    # runs of blocks: a task for each two of them, at least a few for every core
    runs = max(math.ceil(n / RUN), min(n, math.ceil((4 * vectors.sparkSession.sparkContext.defaultParallelism) ** 0.5)))
    packed = C.cut(dealt.repartition(runs, "cell", "block").groupBy("cell", "block").applyInArrow(_pack(centres, threshold, kind), _BLOCKS)).coalesce(runs)
    side = lambda s: packed.select(*(F.col(c).alias(f"{s}_{c}") for c in packed.columns))
    name = lambda s: F.struct(f"{s}_cell", f"{s}_block")
    # each two blocks once, in the order that a hash of both gives, so that every task has its share
    odd = lambda s: F.pmod(F.xxhash64(f"{s}_cell", f"{s}_block"), F.lit(2))
    even = odd("l") == odd("r")
    meet = (F.col("l_cell") == F.col("r_cell")) | F.array_contains("l_visits", F.col("r_cell")) | F.array_contains("r_visits", F.col("l_cell"))
    pairs = side("l").join(side("r").hint("shuffle_replicate_nl"), (name("l") == name("r")) | ((name("l") != name("r")) & ((name("l") < name("r")) == even) & meet)).drop("l_visits", "r_visits")
    with C.rows_at_once(vectors.sparkSession, PAIRS_AT_ONCE):
        found = C.cut(pairs.mapInArrow(_compare(centres, threshold, kind), _PAIRS))

    links = found.where("other IS NULL").groupBy("id").agg(F.sum("links").alias("links"))
    comp = C.components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = comp.join(classes.select(F.col("id").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("least"))
    of_class = comp.join(named, "component").select(F.col("node").alias("id"), "least")
    slim = classes.select("id", *_hashes(F.col("v").cast("array<double>"), "_b"), "members", F.col("least").alias("own"))
    info = slim.join(links, "id", "left").join(of_class, "id", "left").select("_b0", "_b1", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("least", "own").alias("component_id"))
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), *_hashes(F.col(vector_col).cast("array<double>"), "_a"))
    # 128 bits stand for a vector, so that no vector travels again
    return every.join(info, (F.col("_a0") == F.col("_b0")) & (F.col("_a1") == F.col("_b1")), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
