"""Best-fit packing of documents into fixed-size bins with conflicts.

Documents longer than a bin are cut into pieces of the bin's size and a remainder; nothing is dropped. Pieces
are dealt by hash into shards of about ``SHARD`` pieces (a source or cluster with a third of all rows is spread like any other),
and each shard packs by best fit, longest first, ties by id and piece. Where documents have an order, shards are runs of
it with about the same number of documents, and the bins of a shard are numbered by their first document: read by pack_id,
the documents of the first shards are those that come first.

Open bins stand in order of residual, in arrays with two 64-bit bitmaps each: sources at their quota, and
duplicate clusters inside. The search starts at the successor of the piece's size, and goes on until the tightest bin whose bitmaps
have neither bit set. Where more than 64 sources or clusters share the bits, a set bit is checked against the bin's exact
members, so a bin is never passed over for a bit's sake. A piece without a compatible bin opens one.

Null and empty texts are pieces of length 0. A null source or cluster is a value of its own for sources and no
constraint for clusters. Repeated rows are packed each; they share a cluster and so never a bin.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Characters of a bin: about 4,096 tokens.
CAPACITY = 16_384
#: Documents of one source in a bin.
QUOTA = 2
SHARD = 30_000
_CHUNK = 512


class Bins:
    """Open bins in order of residual."""

    def __init__(self, capacity: int, quota: int, exact_sources: bool, exact_clusters: bool):
        self.capacity, self.quota, self.exact = capacity, quota, (exact_sources, exact_clusters)
        self.n, self.made = 0, 0
        self.residual, self.bin = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.sources, self.clusters = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.count: Counter = Counter()
        self.inside: set = set()

    def _conflict(self, b: int, source: int, cluster: int) -> bool:
        return self.count[b, source] >= self.quota or (cluster >= 0 and (b, cluster) in self.inside)

    def find(self, size: int, source: int, cluster: int) -> int:
        """Place of the tightest compatible bin, or -1."""
        sbit, cbit = _bit(source), _bit(cluster)
        at = int(np.searchsorted(self.residual[: self.n], size))
        while at < self.n:
            end = min(self.n, at + _CHUNK)
            hit = (self.sources[at:end] & sbit) | (self.clusters[at:end] & cbit)
            clear = int(np.argmin(hit != 0)) if not hit.all() else end - at
            if not (self.exact[0] and (self.exact[1] or cluster < 0)):
                for k in range(clear):
                    if not self._conflict(int(self.bin[at + k]), source, cluster):
                        return at + k
            if clear < end - at:
                return at + clear
            at = end
        return -1

    def _move(self, at: int, to: int, row: tuple) -> None:
        for a, v in zip((self.residual, self.bin, self.sources, self.clusters), row):
            if to <= at:
                a[to + 1 : at + 1] = a[to:at].copy()
            a[to] = v

    def add(self, size: int, source: int, cluster: int) -> int:
        """Puts a piece into the tightest compatible bin or a new one; returns the bin."""
        at = self.find(size, source, cluster)
        if at < 0:
            at, row = self.n, [self.capacity, self.made, np.uint64(0), np.uint64(0)]
            self.made, self.n = self.made + 1, self.n + 1
            if self.n > len(self.residual):
                self.residual, self.bin, self.sources, self.clusters = (np.concatenate([a, np.zeros_like(a)]) for a in (self.residual, self.bin, self.sources, self.clusters))
        else:
            row = [int(self.residual[at]), int(self.bin[at]), self.sources[at], self.clusters[at]]
        b = row[1]
        row[0] -= size
        self.count[b, source] += 1
        if self.count[b, source] >= self.quota:
            row[2] |= _bit(source)
        if cluster >= 0:
            self.inside.add((b, cluster))
            row[3] |= _bit(cluster)
        # it moves towards the tight end: before all bins with the same residual
        self._move(at, min(at, int(np.searchsorted(self.residual[:at], row[0]))), tuple(row))
        return b


def _bit(i: int) -> np.uint64:
    return np.uint64(1 << (i % 64)) if i >= 0 else np.uint64(0)


def pack(sizes, sources, clusters, capacity: int = CAPACITY, quota: int = QUOTA) -> list[int]:
    """Bin of each piece, pieces taken in the given order. Clusters that occur once (or are None) conflict with nothing."""
    names: dict = defaultdict(lambda: len(names))
    source_ids = [names[s] for s in sources]
    twice = {c for c, n in Counter(clusters).items() if n > 1 and c is not None}
    labels: dict = defaultdict(lambda: len(labels))
    cluster_ids = [labels[c] if c in twice else -1 for c in clusters]
    bins = Bins(capacity, quota, len(names) <= 64, len(labels) <= 64)
    return [bins.add(int(n), s, c) for n, s, c in zip(sizes, source_ids, cluster_ids)]


def _pack_shard(capacity: int, quota: int):
    def run(key, t):
        t = t.sort_by([("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        local = pack(t["size"].to_pylist(), t["source"].to_pylist(), t["cluster"].to_pylist(), capacity, quota)
        if "place" in t.column_names:
            first = np.full(max(local) + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, local, np.array(t["place"]))
            # bins that start with pieces of the same document keep their order
            number = np.empty(len(first), np.int64)
            number[np.argsort(first, kind="stable")] = np.arange(len(first))
            local = number[local].tolist()
        slot, seen = [], Counter()
        for b in local:
            slot.append(seen[b])
            seen[b] += 1
        pack_id = pa.array([(key[0].as_py() << 32) + b for b in local], pa.int64())
        return pa.table({"pack_id": pack_id, "slot": pa.array(slot, pa.int32()), "doc_id": t["doc_id"], "piece": t["piece"], "start": t["start"], "size": t["size"], "source": t["source"]})

    return run


def text_cluster(text: Column) -> Column:
    """Cluster of texts that are equal but for case and white space; null where there is no text."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(F.length(plain) > 0, F.xxhash64(plain))


def pack_documents(docs: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY, quota: int = QUOTA, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", place: Column | None = None) -> DataFrame:
    """(pack_id, slot, doc_id, piece, start, size, source): one row per piece; characters [start, start + size) of the text.

    ``place`` numbers the documents from 0 in an order that the bins follow.
    """
    text = docs[text_col].cast("string")
    length = F.coalesce(F.length(text), F.lit(0)).cast("long")
    slim = docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), (text_cluster(text) if cluster is None else cluster).alias("cluster"), length.alias("length"), *([] if place is None else [place.cast("long").alias("place")]))
    pieces = slim.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.expr(f"(length - 1) div {capacity}")).cast("long"))))
    pieces = pieces.withColumn("start", F.col("piece") * capacity).withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("length") - F.col("start"))).drop("length")
    n, rows = docs.select(F.greatest(F.lit(1), F.ceil(length / capacity)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-n // SHARD))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards)) if place is None else F.expr(f"place * {shards} div {max(1, rows)}"))
    kind = dealt.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("shard").applyInArrow(_pack_shard(capacity, quota), f"pack_id long, slot int, doc_id {kind}, piece long, start long, size long, source string")
