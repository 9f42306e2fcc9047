"""Ranked lexical search with block-max pruning over a forward index.

**Index.** Documents are cut into blocks of up to ``BLOCK_DOCS`` neighbours, by the partitions of the input: nothing is shuffled. A block
is one row: its documents' lengths, a forward list (document, term, occurrences) and, for every term, what its
largest score in the block can come from: the (occurrences, length) pairs that no other pair beats in both. The
largest of their scores is exactly the block's maximum, whatever the corpus statistics turn out to be.

**Search.** Questions come in blocks of bounded size. (1) Document frequencies of their terms are summed over the index.
(2) Every task bounds each question over each of its blocks by the terms' maxima; those with the highest bounds of all are
scored first, ``SEEDS`` of them, and the k-th score is a threshold that the final result can't fall below. (3) Every task sorts its blocks by
bound, question by question, and scores forward lists, a few at a time, until the bound drops below the threshold, which rises with
what the task finds. (4) The tasks' best are ranked. Equal bounds are scored too, so ties by id are exact.

Terms are known by a 64-bit hash: two terms of one corpus of 10^9 distinct terms share a given question term's hash
with a chance of about 10^-10.

Null and empty texts, and texts without a term, aren't documents: they count nowhere. A null id is a document that sorts after all others.
Repeated rows are documents of their own, each with its own rank. Of questions with one id the smallest text is asked; a null id is a question too. A question without terms, or without a hit,
has no rows. Texts of any length are read whole; one that is longer than a block is a block of its own. Extra columns are ignored. Empty tables give
an empty result.
"""

from __future__ import annotations

import contextlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from . import common as C

#: Documents of a block, and bytes of text after which it ends before that.
BLOCK_DOCS, BLOCK_BYTES = 16, 2_000_000
#: Bounds of a block of questions, and index blocks that a task holds at once.
QUESTIONS, QUESTION_TERMS, HELD = 2_000, 100_000, 256
#: Blocks scored for the threshold, most of them from one task; rows that a task takes over from Spark at once (texts, blocks).
SEEDS, SEEDS_OF_TASK, TEXTS, BLOCKS = 64, 8, 1_000, 64
#: Bytes of the index that are buffered for a row group, and blocks that Spark's reader unpacks at once: a block is tens of kilobytes, not a narrow row.
ROW_GROUP, READ = 16_000_000, 64
#: Bytes that part terms: all ASCII but digits and letters.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

INDEX = "block long, docs int, terms_read long, ids binary, has_id binary, lengths binary, ptr binary, term binary, tf binary, vocab binary, df binary, best_ptr binary, best_tf binary, best_len binary"


def _pack(block: int, ids: list, h: np.ndarray, counts: np.ndarray) -> tuple:
    """A block's row from the term hashes of its documents, one after the other; none is without a term."""
    vocab, local = np.unique(h, return_inverse=True)
    doc = np.repeat(np.arange(len(counts)), counts)
    key, tf = np.unique(doc * len(vocab) + local, return_counts=True)
    doc, term = np.divmod(key, len(vocab))
    ptr = np.searchsorted(doc, np.arange(len(counts) + 1))
    # by term, shorter documents first: a pair counts if it has more occurrences than all shorter ones
    order = np.lexsort((-tf, counts[doc], term))
    t, f = term[order], tf[order]
    high = np.maximum.accumulate((t << np.int64(32)) + f)
    keep = np.concatenate([[True], high[1:] > np.maximum(high[:-1], t[1:] << np.int64(32))])
    best = order[keep]
    best_ptr = np.searchsorted(t[keep], np.arange(len(vocab) + 1))
    raw = lambda x, kind: np.ascontiguousarray(x, kind).tobytes()
    return (
        block, len(counts), int(counts.sum()), raw([0 if i is None else i for i in ids], "<i8"), raw([i is not None for i in ids], "u1"), raw(counts, "<i8"),
        raw(ptr, "<i4"), raw(term, "<i4"), raw(tf, "<i4"), vocab.astype("<u8").tobytes(), raw(np.bincount(term, minlength=len(vocab)), "<i4"),
        raw(best_ptr, "<i4"), raw(tf[best], "<i4"), raw(counts[doc[best]], "<i8"),
    )


def _index(batches):
    block = TaskContext.get().partitionId() << 32
    kinds = [pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 11
    names = [x.split()[0] for x in INDEX.split(", ")]
    for b in batches:
        ids = b.column(0).to_pylist()
        for at, texts in C.text_chunks(b.column(1), BLOCK_BYTES):
            for i in range(0, len(texts), BLOCK_DOCS):
                h, counts = C.word_hashes(texts[i : i + BLOCK_DOCS], APART)
                full = np.flatnonzero(counts)
                if len(full):
                    row = _pack(block, [ids[at + i + int(k)] for k in full], h, counts[full])
                    block += 1
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the blocks of ``docs`` as a table; it can be searched by any number of questions."""
    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).where("text IS NOT NULL")
    with C.rows_at_once(docs.sparkSession, TEXTS):
        slim.mapInArrow(_index, INDEX).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)


def _terms(batches):
    for b in batches:
        rows = []
        for _, texts in C.text_chunks(b.column(1)):
            h, counts = C.word_hashes(texts, APART)
            for part in np.split(h, np.cumsum(counts)[:-1]):
                v, n = np.unique(part, return_counts=True)
                rows.append((v.astype("<u8").tobytes(), n.astype("<i8").tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.binary()) for x in zip(*rows))], names=["item_id", "terms", "counts"])


class Questions:
    """A block of questions: the vocabulary of all, and by question its terms and their weight times occurrences."""

    def __init__(self, rows: list[tuple[int | None, np.ndarray, np.ndarray]]):
        self.ids = [r[0] for r in rows]
        self.vocab = np.unique(np.concatenate([r[1] for r in rows]))
        self.ptr = np.cumsum([0, *(len(r[1]) for r in rows)])
        self.term = np.searchsorted(self.vocab, np.concatenate([r[1] for r in rows]))
        self.times = np.concatenate([r[2] for r in rows])
        self.floor = np.zeros(len(rows), np.int64)

    def weigh(self, found: dict[int, int], docs: int, terms: int) -> None:
        """Weights from document frequencies; a term that no document holds weighs too, but is never met."""
        self.docs, self.terms = docs, terms
        df = [found.get(i, 0) for i in range(len(self.vocab))]
        w = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for d in df], np.int64)
        self.weight = w[self.term] * self.times

    def scores(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """One occurrence's worth of a weight of 1."""
        tf, top = tf.astype(np.int64), int(length.max(initial=0))
        if 25 * top * self.docs < 2**63:
            share = 25 * length.astype(np.int64) * self.docs // self.terms
        else:
            share = np.array([25 * int(n) * self.docs // self.terms for n in length], np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 12 * (75 + share))


class Block:
    """One row of the index, read for a block of questions."""

    def __init__(self, row: dict, q: Questions):
        self.block, self.row = row["block"], row
        vocab = np.frombuffer(row["vocab"], "<u8")
        at = np.minimum(np.searchsorted(vocab, q.vocab), len(vocab) - 1)
        self.has = np.flatnonzero(vocab[at] == q.vocab)
        self.local, self.size = at[self.has], len(vocab)

    def bounds(self, q: Questions) -> np.ndarray:
        """The most that any document of the block can score, by question."""
        top = np.zeros(len(q.vocab), np.int64)
        if len(self.has):
            ptr = np.frombuffer(self.row["best_ptr"], "<i4")
            a, n = ptr[self.local], ptr[self.local + 1] - ptr[self.local]
            first = np.cumsum(n) - n
            pairs = np.repeat(a - first, n) + np.arange(n.sum())
            s = q.scores(np.frombuffer(self.row["best_tf"], "<i4")[pairs], np.frombuffer(self.row["best_len"], "<i8")[pairs])
            top[self.has] = np.maximum.reduceat(s, first)
        return np.add.reduceat(q.weight * top[q.term], q.ptr[:-1])

    def open(self, q: Questions) -> None:
        """Read the forward list, once, as far as the questions' terms go."""
        if "doc" in self.__dict__:
            return
        names = np.full(self.size, -1)
        names[self.local] = self.has
        term = names[np.frombuffer(self.row["term"], "<i4")]
        mine = np.flatnonzero(term >= 0)
        ptr, length = np.frombuffer(self.row["ptr"], "<i4"), np.frombuffer(self.row["lengths"], "<i8")
        doc = np.searchsorted(ptr, mine, "right") - 1
        self.term, self.s = term[mine], q.scores(np.frombuffer(self.row["tf"], "<i4")[mine], length[doc])
        self.first = np.flatnonzero(np.diff(doc, prepend=-1))
        self.doc = doc[self.first]
        self.id, self.has_id = np.frombuffer(self.row["ids"], "<i8")[self.doc], np.frombuffer(self.row["has_id"], "u1")[self.doc]


def score(blocks: list[Block], q: Questions, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, 1 where the id is null, id) of the documents of ``blocks`` that hold a term of question ``k``."""
    for x in blocks:
        x.open(q)
    blocks = [x for x in blocks if len(x.first)]
    if not blocks:
        return (np.zeros(0, np.int64),) * 3
    weight = np.zeros(len(q.vocab), np.int64)
    some = slice(q.ptr[k], q.ptr[k + 1])
    weight[q.term[some]] = q.weight[some]
    join = lambda name: np.concatenate([getattr(x, name) for x in blocks])
    before = np.cumsum([0, *(len(x.term) for x in blocks[:-1])])
    total = np.add.reduceat(weight[join("term")] * join("s"), join("first") + np.repeat(before, [len(x.first) for x in blocks]))
    hit = total > 0
    return total[hit], 1 - join("has_id")[hit].astype(np.int64), join("id")[hit]


def _rows(batches, q: Questions):
    """Runs of at most HELD blocks."""
    held = []
    for b in batches:
        for row in b.to_pylist():
            held.append(Block(row, q))
            if len(held) == HELD:
                yield held
                held = []
    if held:
        yield held


def _frequencies(q: Questions):
    def run(batches):
        total = np.zeros(len(q.vocab), np.int64)
        for b in batches:
            for row in b.to_pylist():
                x = Block(row | {"block": 0}, q)
                total[x.has] += np.frombuffer(row["df"], "<i4")[x.local]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["term", "df"])

    return run


def _highest(q: Questions):
    """(question, bound, block): of a task's blocks those with the highest bounds."""

    def run(batches):
        best, block = np.zeros((len(q.ids), 0), np.int64), np.zeros((len(q.ids), 0), np.int64)
        for held in _rows(batches, q):
            best = np.concatenate([best, np.array([x.bounds(q) for x in held]).T], 1)
            block = np.concatenate([block, np.broadcast_to([x.block for x in held], (len(q.ids), len(held)))], 1)
            top = np.argsort(-best, 1, kind="stable")[:, :SEEDS_OF_TASK]
            best, block = np.take_along_axis(best, top, 1), np.take_along_axis(block, top, 1)
        question, at = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(question, pa.int32()), pa.array(best[question, at], pa.int64()), pa.array(block[question, at], pa.int64())], names=["question", "bound", "block"])

    return run


def _best(q: Questions, k: int, only: dict[int, set[int]] | None = None):
    """(question, score, no_id, id) of a task's best documents. ``only``: questions of a block, and no others."""

    def run(batches):
        found = [(np.zeros(0, np.int64),) * 3] * len(q.ids)
        floor = q.floor.copy()
        for held in _rows(batches, q):
            bound = np.array([x.bounds(q) for x in held])
            for i in range(len(q.ids)):
                mine = np.arange(len(held)) if only is None else np.array([j for j, x in enumerate(held) if i in only.get(x.block, ())], np.int64)
                order, at, step = mine[np.argsort(-bound[mine, i], kind="stable")], 0, 4
                while at < len(order) and bound[order[at], i] >= max(1, floor[i]):
                    some = [j for j in order[at : at + step] if bound[j, i] >= max(1, floor[i])]
                    more = score([held[j] for j in some], q, i)
                    s, null, ids = (np.concatenate(x) for x in zip(found[i], more))
                    on = np.flatnonzero(s >= floor[i])
                    top = on[np.lexsort((ids[on], null[on], -s[on]))[:k]]
                    found[i] = s[top], null[top], ids[top]
                    if len(top) == k:
                        floor[i] = max(floor[i], s[top[-1]])
                    at, step = at + len(some), 2 * step
        n = [len(x[0]) for x in found]
        s, null, ids = (np.concatenate(x) for x in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((np.repeat(np.arange(len(n)), n), pa.int32()), (s, pa.int64()), (null, pa.int8()), (ids, pa.int64()))], names=["question", "score", "no_id", "id"])

    return run


FOUND = "question int, score long, no_id byte, id long"


def _blocks(asked: DataFrame):
    """Questions in blocks of bounded size, in the order of their ids, as they arrive from the tasks."""
    rows, terms = [], 0
    for r in asked.toLocalIterator():
        v = np.frombuffer(r.terms, "<u8")
        if not len(v):
            continue
        if rows and (len(rows) == QUESTIONS or terms + len(v) > QUESTION_TERMS):
            yield Questions(rows)
            rows, terms = [], 0
        rows.append((r.item_id, v, np.frombuffer(r.counts, "<i8")))
        terms += len(v)
    if rows:
        yield Questions(rows)


@contextlib.contextmanager
def _few_blocks_read(spark):
    """The reader's batch (4,096 rows by default) holds few blocks, whatever the size of a file."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    spark.conf.set(name, READ)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def search(index: DataFrame, questions: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each question, best first, ties to smaller ids."""
    spark = index.sparkSession
    texts = questions.groupBy(questions[item_col].cast("long").alias("item_id")).agg(F.min(questions[text_col].cast("string")).alias("text")).where("text IS NOT NULL")
    asked = texts.mapInArrow(_terms, "item_id long, terms binary, counts binary")
    docs, terms = index.agg(F.sum("docs"), F.sum("terms_read")).first()
    at, order = f"{C.shared_dir(spark)}/ranked-{uuid.uuid4().hex}", W.partitionBy("question").orderBy(F.desc("score"), "no_id", "id")
    by_bound = W.partitionBy("question").orderBy(F.desc("bound"), "block")
    schema = "item_id long, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(at)
    for q in _blocks(asked) if docs else ():
        with C.rows_at_once(spark, BLOCKS), _few_blocks_read(spark):
            df = index.select("vocab", "df").mapInArrow(_frequencies(q), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
            q.weigh({r.term: r.df for r in df.collect()}, docs, terms)
            # documents of any blocks give a valid threshold: the k-th of them is in the result or below it
            high = index.select("block", "vocab", "best_ptr", "best_tf", "best_len").mapInArrow(_highest(q), "question int, bound long, block long")
            only: dict[int, set[int]] = {}
            for r in high.withColumn("n", F.row_number().over(by_bound)).where(F.col("n") <= SEEDS).collect():
                only.setdefault(r.block, set()).add(r.question)
            seeds = index.join(F.broadcast(spark.createDataFrame([(x,) for x in only], "block long")), "block", "left_semi").mapInArrow(_best(q, k, only), FOUND)
            ranked = seeds.withColumn("rank", F.row_number().over(order))
            for r in ranked.where(F.col("rank") == k).collect():
                q.floor[r.question] = r.score
            best = index.mapInArrow(_best(q, k), FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            names = spark.createDataFrame([(i, x) for i, x in enumerate(q.ids)], "question int, item_id long")
            named = best.join(F.broadcast(names), "question")
            named.select("item_id", "rank", F.when(F.col("no_id") == 0, F.col("id")).alias("doc_id"), "score").write.mode("append").parquet(at)
    return spark.read.schema(schema).parquet(at)


def ranked_search(docs: DataFrame, questions: DataFrame, k: int = 20) -> DataFrame:
    """Index ``docs`` (doc_id, text), search it for ``questions`` (item_id, text), and drop the index."""
    spark = docs.sparkSession
    at = f"{C.shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    build_index(docs, at)
    found = search(spark.read.parquet(at), questions, k)
    C.remove(spark, at)
    return found
