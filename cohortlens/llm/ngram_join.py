"""N-gram Jaccard join with several global token orders.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Documents with the same
set form one class; classes link when 100 * |intersection| >= 80 * |union|. The result has one row
per document and a component id; no two components that a link joins stay apart. It returns components only: neither
the number of links of a document nor linked pairs, since links within a hub's component are not all verified.

How the work is split:

1. *Repeated shingles.* Every set is cut by hash range and shuffled once, packed to eight bytes a
   shingle. A range keeps the shingles that two classes or more hold and grades them by the
   logarithm of that number. A class that shares fewer than 80 % of its set with anything has no
   partner; this ends the work for nearly all documents. It is the prefix filter under an order
   that puts unshared shingles first. The pass that describes the sets also counts shingles: for
   every million of them a task names the ``HOT`` that most classes hold, and the ``HOT`` largest
   sums over all tasks are taken as shared before the shuffle. They are dealt by class and shingle
   instead of by range, so that the holders of one of them never meet in one group. A shingle that
   stays in its range makes up about two in ``HOT`` of all shingles at most, where tasks hold a million;
   small tasks leave out those that less than ``LEAST_HOT`` of their classes hold. Taking a shingle as shared
   that only one class holds changes no link: it widens a prefix.
2. *Prefixes.* The first global order is (grade, hash). A class lists the shared shingles within
   its prefix. Of the classes that list a shingle, the one that shares most is the hub, and the
   others go to the hub's cell: as many rows as the prefix has, never pairs.
3. *Cells.* Two classes that share a prefix shingle meet in the cell of that shingle's hub. Within
   a cell, the hub is compared first. Only classes that are not in its component are expanded
   against the rest; their candidates come from the postings of their prefix shingles, must share
   a prefix shingle under each of ``ORDERS`` global orders, have fitting sizes and belong to another
   group of the links found so far, and are then verified on whole sets. Large cells are cut into
   blocks; then the classes that their block left outside meet all other blocks.
4. *Components* of the verified links, by star contraction.

Nulls and texts without words have an empty set, link with nothing and keep their doc_id as
component. Repeated rows are separate rows of the same class. A null doc_id never names a
component; a class whose ids are all null has a null one. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

WORDS = 5
#: Global orders that a candidate must pass, the first of them by grade.
ORDERS = 3
#: Shingles in a block of a cell.
BLOCK = 1_500_000
#: Shingles that a task holds before it hands them on.
HELD = 1_000_000
#: Shingles that are dealt by class: the most frequent ones. The others are found by range.
HOT = 4096
#: A shingle that fewer sets of a task hold isn't named as frequent.
LEAST_HOT = 64
_LOW = np.uint64((1 << 56) - 1)


def shingles(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; shorter texts are one shingle, texts without words none."""
    h, counts = C.word_hashes(texts)
    n = len(h)
    s = np.zeros(n, np.uint64)
    for j in range(words):
        s[: max(0, n - j)] += h[j:] * C.mix(np.array([j + 1], np.uint64))[0]
    s = C.mix(s)
    out, at = [], 0
    for c in counts:
        if c >= words:
            out.append(np.unique(s[at : at + c - words + 1]))
        elif c:
            short = np.uint64(0)
            for j in range(c):
                short = C.mix(np.array([short + h[at + j] + C.GOLDEN * np.uint64(c)], np.uint64))[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def _key(s: np.ndarray) -> int:
    """The class of a set: a hash of its content."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        x = C.mix(np.array([np.add.reduce(C.mix(s ^ C.GOLDEN)) + np.uint64(len(s))], np.uint64))
    return int(x.view(np.int64)[0])


def _frequent(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ``HOT`` most frequent shingles of some sets, with the number of sets that hold them."""
    tokens, held = np.unique(np.concatenate(parts), return_counts=True)
    some = held >= LEAST_HOT
    tokens, held = tokens[some], held[some]
    most = np.argsort(-held, kind="stable")[:HOT]
    return tokens[most], held[most]


def _describe(words: int):
    """A row per document; besides, rows without one that name a frequent shingle (key) and the sets that hold it (n_shingles)."""

    def rows(ids, sizes, keys, hot):
        n = len(sizes)
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array([hot] * n, pa.bool_())], names=["doc_id", "n_shingles", "key", "hot"])

    def named(parts):
        tokens, held = _frequent(parts)
        return rows(pa.nulls(len(tokens), pa.int64()), held, tokens.view(np.int64), True)

    def run(batches):
        with np.errstate(over="ignore"):
            parts, seen, total = [], set(), 0
            for b in batches:
                ids, keys, sizes = b.column(0), [], []
                for _, texts in C.text_chunks(b.column(1)):
                    for s in shingles(texts, words):
                        keys.append(k := _key(s))
                        sizes.append(len(s))
                        if not len(s) or k in seen:
                            continue
                        seen.add(k)
                        parts.append(s)
                        total += len(s)
                        if total > HELD:
                            yield named(parts)
                            parts, seen, total = [], set(), 0
                yield rows(ids, sizes, keys, False)
            if parts:
                yield named(parts)

    return run


def _pack(words: int, bits: int, hot: np.ndarray):
    """Sets to (range, classes, sizes, packed shingles). A piece's word holds 48 bits of hash over 16 bits of row.

    Shingles of ``hot`` (sorted) go to as many ranges again, by class and shingle; their words hold the place in ``hot``.
    """

    def flush(keys, sizes, parts):
        if not parts:
            return
        tokens = np.concatenate(parts)
        rows = np.repeat(np.arange(len(parts), dtype=np.uint64), [len(p) for p in parts])
        keys, sizes = np.array(keys, np.int64), np.array(sizes, np.int32)
        which = (tokens >> np.uint64(64 - bits)).astype(np.int64)
        word = ((tokens << np.uint64(bits)) & ~np.uint64(0xFFFF)) | rows
        if len(hot):
            place = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
            at = np.flatnonzero(hot[place] == tokens)
            by = C.mix(tokens[at] ^ keys.view(np.uint64)[rows[at].astype(np.int64)])
            which[at] = (by >> np.uint64(64 - bits)).astype(np.int64) + (1 << bits)
            word[at] = (place[at].astype(np.uint64) << np.uint64(16)) | rows[at]
        order = np.argsort(which, kind="stable")
        word, which, rows = word[order], which[order], rows[order].astype(np.int64)
        ends = np.searchsorted(which, np.arange((2 << bits) + 1))
        out = ([], [], [], [])
        for k in range(2 << bits):
            a, z = ends[k], ends[k + 1]
            if a == z:
                continue
            used, local = np.unique(rows[a:z], return_inverse=True)
            out[0].append(k)
            out[1].append(keys[used].tobytes())
            out[2].append(sizes[used].tobytes())
            out[3].append(((word[a:z] & ~np.uint64(0xFFFF)) | local.astype(np.uint64)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["range", "keys", "sizes", "words"])

    def run(batches):
        with np.errstate(over="ignore"):
            keys, sizes, parts, seen, total = [], [], [], set(), 0
            for b in batches:
                for _, texts in C.text_chunks(b.column(0)):
                    for s in shingles(texts, words):
                        if not len(s) or (k := _key(s)) in seen:
                            continue
                        seen.add(k)
                        keys.append(k)
                        sizes.append(len(s))
                        parts.append(s)
                        total += len(s)
                        if len(parts) == 60_000 or total > HELD:
                            yield from flush(keys, sizes, parts)
                            keys, sizes, parts, seen, total = [], [], [], set(), 0
            yield from flush(keys, sizes, parts)

    return run


def _repeated(bits: int, hot: np.ndarray, hot_held: np.ndarray):
    """Of one range: for every class, its shingles that another class holds too, under their grade. Shingles of ``hot`` are taken as shared."""

    def run(key, t):
        at_range = key[0].as_py()
        known = at_range >= 1 << bits
        words, keys, sizes, base = [], [], [], 0
        for k, s, w in zip(t["keys"], t["sizes"], t["words"]):
            k = np.frombuffer(k.as_buffer(), np.int64)
            w = np.frombuffer(w.as_buffer(), np.uint64)
            words.append((w & ~np.uint64(0xFFFF), (w & np.uint64(0xFFFF)).astype(np.int64) + base))
            keys.append(k)
            sizes.append(np.frombuffer(s.as_buffer(), np.int32))
            base += len(k)
        none = pa.table({"key": pa.array([], pa.int64()), "n": pa.array([], pa.int32()), "tokens": pa.array([], pa.list_(pa.int64()))})
        if not base:
            return none
        h, row = np.concatenate([x[0] for x in words]), np.concatenate([x[1] for x in words])
        keys, sizes = np.concatenate(keys), np.concatenate(sizes)
        keys, first, cls = np.unique(keys, return_index=True, return_inverse=True)
        sizes, row = sizes[first], cls[row]
        order = np.argsort(h)
        h, row = h[order], row[order]
        if not known:
            new = np.concatenate([[True], h[1:] != h[:-1]])
            many = ~new | np.concatenate([~new[1:], [False]])
            h, row = h[many], row[many]
            if not len(h):
                return none
        order = np.lexsort((row, h))
        h, row = h[order], row[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
        h, row = h[fresh], row[fresh]
        if known:
            place = (h >> np.uint64(16)).astype(np.int64)
            held, full = hot_held[place], hot[place]
        else:
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            held = np.diff(np.append(head, len(h)))
            held = np.repeat(held, held)
            h, row, held = h[held > 1], row[held > 1], held[held > 1]
            full = (np.uint64(at_range) << np.uint64(64 - bits)) | (h >> np.uint64(bits))
        grade = np.minimum(np.log2(np.maximum(held, 1)).astype(np.uint64), np.uint64(63))
        token = (grade << np.uint64(56)) | (full >> np.uint64(8))
        order = np.argsort(row, kind="stable")
        row, token = row[order], token[order].view(np.int64)
        used, at = np.unique(row, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)), pa.int32()), pa.array(token))
        return pa.table({"key": pa.array(keys[used]), "n": pa.array(sizes[used]), "tokens": lists})

    return run


def _prefix(tokens: np.ndarray, n: int, order: int, percent: int) -> np.ndarray:
    """The shared shingles within the prefix of a set of ``n`` under global order ``order``; unshared ones come first in each."""
    most = n - -(-percent * n // 100) + 1 - (n - len(tokens))
    if most <= 0:
        return tokens[:0]
    if most >= len(tokens):
        return tokens
    rank = tokens if order == 0 else C.mix((tokens & _LOW) ^ C.mix(np.array([order], np.uint64)))
    return tokens[np.argpartition(rank, most - 1)[:most]]


def _prefixes(percent: int):
    def run(batches):
        for b in batches:
            keys, out, score, made = b.column(0).to_numpy(), [], [], []
            sizes, lists = b.column(1).to_numpy(), b.column(2)
            for i in range(len(keys)):
                t = np.array(lists[i].values, np.int64).view(np.uint64)
                p = _prefix(t, int(sizes[i]), 0, percent)
                out.append(p.view(np.int64))
                made.append(len(p))
                score.append(int((t >> np.uint64(56)).sum() * 1000 // max(1, sizes[i])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(keys, made)), pa.array(np.repeat(np.array(score, np.int64), made)), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))],
                names=["key", "score", "token"],
            )

    return run


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs of the given sizes, one run after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class _Cell:
    """Classes of a cell in flat arrays: candidates come from postings of prefix tokens, overlaps of one class with them in one pass."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, percent: int):
        self.sizes, self.percent = sizes.astype(np.int64), percent
        self.names = np.unique(np.concatenate(sets))
        self.mark = np.zeros(len(self.names), bool)
        self.whole = self._flat(sets)
        self.prefix = [self._flat([_prefix(s, int(n), o, percent) for s, n in zip(sets, sizes)]) for o in range(ORDERS)]
        ids, at = self.prefix[0]
        order = np.argsort(ids, kind="stable")
        #: rows that list a token under the first order, token by token
        self.holders = np.repeat(np.arange(len(sizes)), np.diff(at))[order]
        self.holders_at = np.searchsorted(ids[order], np.arange(len(self.names) + 1))

    def _flat(self, sets):
        return np.searchsorted(self.names, np.concatenate(sets)), np.concatenate([[0], np.cumsum([len(s) for s in sets])])

    def _overlap(self, lists, i: int, rows: np.ndarray) -> np.ndarray:
        """Tokens that row i has in common with each of ``rows``."""
        ids, at = lists
        size = at[rows + 1] - at[rows]
        end = np.cumsum(size)
        self.mark[ids[at[i] : at[i + 1]]] = True
        run = np.concatenate([[0], np.cumsum(self.mark[ids[_runs(at[rows], size)]])])
        self.mark[ids[at[i] : at[i + 1]]] = False
        return run[end] - run[end - size]

    def linked(self, i: int, group: np.ndarray) -> np.ndarray:
        """Rows of other groups that link with row i: candidates of every order, then whole sets."""
        n, (ids, at) = self.sizes[i], self.prefix[0]
        own = ids[at[i] : at[i + 1]]
        rows = np.unique(self.holders[_runs(self.holders_at[own], self.holders_at[own + 1] - self.holders_at[own])])
        m = self.sizes[rows]
        rows = rows[(group[rows] != group[i]) & (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m))]
        for lists in self.prefix[1:]:
            rows = rows[self._overlap(lists, i, rows) > 0]
        both = self._overlap(self.whole, i, rows)
        return rows[100 * both >= self.percent * (n + self.sizes[rows] - both)]


class _Groups:
    """Rows that links join; ``of`` has every row's group. The smaller group takes the name of the larger."""

    def __init__(self, n: int):
        self.of, self.rows = np.arange(n), {}

    def join(self, i: int, j: int) -> bool:
        x, y = int(self.of[i]), int(self.of[j])
        if x == y:
            return False
        a, b = self.rows.pop(x, [x]), self.rows.pop(y, [y])
        if len(a) < len(b):
            x, a, b = y, b, a
        self.of[b] = x
        a.extend(b)
        self.rows[x] = a
        return True


def _read_cell(t: pa.Table, percent: int):
    seen, keys, sets, sizes, outer = {}, [], [], [], []
    for k, n, x, o in zip(t["key"].to_pylist(), t["n"].to_pylist(), t["tokens"], t["outer"].to_pylist()):
        if k in seen:
            outer[seen[k]] |= o
            continue
        seen[k] = len(keys)
        keys.append(k)
        sizes.append(n)
        outer.append(o)
        sets.append(np.array(x.values, np.int64).view(np.uint64))
    return np.array(keys, np.int64), np.array(outer), _Cell(sets, np.array(sizes), percent)


_EDGES = "hub long, a long, b long"


def _edges(hub, keys, pairs):
    return pa.table({"hub": pa.array([hub] * len(pairs), pa.int64()), "a": pa.array([int(keys[i]) for i, _ in pairs], pa.int64()), "b": pa.array([int(keys[j]) for _, j in pairs], pa.int64())})


def _compare_block(percent: int):
    """All components within a block: the hub is expanded first, then every class outside its component. Also an edge (a, a) for every class left outside."""

    def run(key, t):
        hub = key[0].as_py()
        keys, _, cell = _read_cell(t, percent)
        groups, pairs = _Groups(len(keys)), []
        first = int(np.flatnonzero(keys == hub)[0])
        for i in [first, *(i for i in range(len(keys)) if i != first)]:
            if i == first or groups.of[i] != groups.of[first]:
                pairs += [(i, int(j)) for j in cell.linked(i, groups.of) if groups.join(i, int(j))]
        pairs += [(int(i), int(i)) for i in np.flatnonzero(groups.of != groups.of[first])]
        return _edges(hub, keys, pairs)

    return run


def _compare_outer(percent: int):
    """Classes outside the hub's component (outer) against those of another block."""

    def run(key, t):
        keys, outer, cell = _read_cell(t, percent)
        groups, pairs = _Groups(len(keys)), []
        for i in np.flatnonzero(outer):
            pairs += [(int(i), int(j)) for j in cell.linked(int(i), groups.of) if groups.join(int(i), int(j))]
        return _edges(key[0].as_py(), keys, pairs)

    return run


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, key, component_id) of every row of ``docs``; see the module's text."""
    spark = docs.sparkSession
    C.shared_dir(spark)
    parts = C.partitions(spark)
    #: Ranges grow with the partitions that the cluster is set to, so that one holds a few million shingles at most.
    bits = max(6, min(16, int(np.ceil(np.log2(2 * parts)))))
    ids, text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), docs.select(F.col(text_col).cast("string").alias("text"))
    described = C.cut(ids.mapInArrow(_describe(words), "doc_id long, n_shingles long, key long, hot boolean"))
    info = described.where("NOT hot").drop("hot")
    # at most HOT rows
    counted = described.where("hot").groupBy("key").agg(F.sum("n_shingles").alias("held")).orderBy(F.desc("held"), "key").limit(HOT).collect()
    hot = np.array([r.key for r in counted], np.int64).view(np.uint64)
    hot, hot_held = np.sort(hot), np.array([r.held for r in counted], np.int64)[np.argsort(hot)]

    pieces = text.where(F.col("text").isNotNull()).mapInArrow(_pack(words, bits, hot), "range int, keys binary, sizes binary, words binary")
    shared = pieces.groupBy("range").applyInArrow(_repeated(bits, hot, hot_held), "key long, n int, tokens array<long>")
    left = shared.groupBy("key", "n").agg(F.flatten(F.collect_list("tokens")).alias("tokens")).where(F.size("tokens") * 100 >= F.col("n") * percent)
    left = C.cut(left)

    prefix = left.mapInArrow(_prefixes(percent), "key long, score long, token long")
    hubs = prefix.groupBy("token").agg(F.max(F.struct("score", "key")).alias("hub"), F.count("*").alias("held")).where("held > 1").select("token", F.col("hub.key").alias("hub"))
    member = C.cut(prefix.join(hubs, "token").select("hub", "key").distinct())
    load = member.join(left.select("key", F.size("tokens").alias("load")), "key").groupBy("hub").agg(F.ceil(F.sum("load") / block).cast("int").alias("blocks"))
    member = member.join(load, "hub").select("hub", "key", "blocks", F.when(F.col("hub") == F.col("key"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), "blocks").cast("int"))).alias("in"))
    cells = member.select("hub", "key", "blocks", F.explode("in").alias("block")).join(left, "key")
    links = C.cut(cells.withColumn("outer", F.lit(False)).groupBy("hub", "block").applyInArrow(_compare_block(percent), _EDGES))

    large = member.where("blocks > 1 AND hub <> key").select("hub", "key", "blocks", F.col("in")[0].alias("block"))
    if not large.isEmpty():
        out = links.where("a = b").select("hub", F.col("a").alias("key")).join(large, ["hub", "key"])
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        cols = ["hub", "key", "from", "to", "outer"]
        near = out.select("hub", "key", F.col("block").alias("from"), every.alias("to")).where("from <> to").withColumn("outer", F.lit(True)).select(cols)
        groups = near.select("hub", "from", "to").distinct()
        far = large.withColumnRenamed("block", "to").join(groups, ["hub", "to"]).withColumn("outer", F.lit(False)).select(cols)
        more = near.unionByName(far).join(left, "key").groupBy("hub", "from", "to").applyInArrow(_compare_outer(percent), _EDGES)
        links = links.unionByName(more)

    named = info.groupBy("key").agg(F.min("doc_id").alias("first"))
    ends = links.where("a <> b").select("a", "b").distinct()
    comp = C.components(ends).withColumnRenamed("node", "key")
    least = comp.join(named, "key").groupBy("component").agg(F.min("first").alias("least"))
    of_key = comp.join(least, "component").select("key", "least")
    # written, so that the last join has an exchange on either side and a class with very many copies is split
    whole = C.cut(named.join(of_key, "key", "left").select("key", F.coalesce("least", "first").alias("of_key")))
    return info.join(whole, "key").select("doc_id", "n_shingles", "key", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("of_key")).alias("component_id"))
