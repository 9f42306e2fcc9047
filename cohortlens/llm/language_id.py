"""Language identification by a byte convolutional network, in numpy.

Bytes (A-Z lower-cased) fall into 128 classes. Filters of widths 2, 3 and 4 run over one-hot classes of fixed-length
windows, are max-pooled over the window, and a softmax layer reads the pooled values. A text is the batch of
all its windows, end to end; their probabilities are averaged. One-hot convolutions are sums of table rows, so
inference adds two rows of pair tables per byte.

The network is fitted on the driver on a bounded sample: ``PER_LANGUAGE`` documents of each language, or its share of ``SAMPLE`` where that is less, but one of every language (those with the smallest
hash of their id; a repeated row once) and ``WINDOWS`` windows of each. Prediction reads nothing but the text.

A null text, or one without a letter, is ``und`` with score 0; so is every text where nothing can be learned from.
Ties between languages go to the one that sorts first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Bounds of the sample for fitting.
PER_LANGUAGE, WINDOWS, SAMPLE = 800, 4, 160_000
LENGTH, WIDTHS, FILTERS, CLASSES = 128, (2, 3, 4), 16, 128
#: Positions of a window at which every filter starts.
SPAN = LENGTH - max(WIDTHS) + 1
EPOCHS, BATCH, RATE = 8, 64, 0.01


def _classes() -> np.ndarray:
    """Class of each byte: letters, digit, space, other ASCII, continuation bytes one by one, leading bytes by range. 0 is padding."""
    c = np.zeros(256, np.uint8)
    c[:128] = 3
    c[48:58] = 1
    c[[32, *range(9, 14)]] = 2
    c[97:123] = c[65:91] = np.arange(4, 30)
    c[128:192] = np.arange(30, 94)
    c[192:224] = 94 + np.minimum(np.arange(32), 15)
    c[224:240] = 110 + np.arange(16)
    c[240:] = 126
    return c


CLASS_OF = _classes()


@dataclass
class Network:
    languages: list[str]
    tables: list[np.ndarray]  # by width: (width, classes, filters)
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray

    def __post_init__(self):
        self._fast = None

    def _pooled(self, x: np.ndarray):
        """Pooled values and where the maximum was, for windows (n, LENGTH)."""
        best, where = [], []
        for w, t in zip(WIDTHS, self.tables):
            s = t[0][x[:, :SPAN]]
            for j in range(1, w):
                s = s + t[j][x[:, j : j + SPAN]]
            where.append(s.argmax(1))
            best.append(s.max(1))
        return np.concatenate(best, 1) + self.bias, where

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> "Network":
        """Adam on the cross-entropy."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.dense, self.out]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                rows = order[at : at + BATCH]
                xb, yb = x[rows], y[rows]
                z, where = self._pooled(xb)
                a = np.maximum(z, 0)
                p = _softmax(a @ self.dense + self.out)
                p[np.arange(len(rows)), yb] -= 1
                p /= len(rows)
                dz = (p @ self.dense.T) * (z > 0)
                grads = []
                for k, (w, arg) in enumerate(zip(WIDTHS, where)):
                    g, d = np.zeros_like(self.tables[k]), dz[:, k * FILTERS : (k + 1) * FILTERS]
                    f = np.broadcast_to(np.arange(FILTERS), arg.shape)
                    for j in range(w):
                        g[j] += np.bincount((np.take_along_axis(xb, arg + j, 1) * FILTERS + f).ravel(), d.ravel(), CLASSES * FILTERS).reshape(CLASSES, FILTERS)
                    grads.append(g)
                grads += [dz.sum(0), a.T @ p, p.sum(0)]
                step += 1
                for q, g, mm, vv in zip(params, grads, m, v):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    q -= RATE * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
        return self

    def _tables(self):
        if self._fast is None:
            t2, t3, t4 = self.tables
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(CLASSES * CLASSES, FILTERS)
            near = np.concatenate([pair(t2[0], t2[1]), pair(t3[0], t3[1]), pair(t4[0], t4[1])], 1)
            far = np.concatenate([pair(t3[2], np.zeros_like(t3[2])), pair(t4[2], t4[3])], 1)
            self._fast = np.ascontiguousarray(near, np.float32), np.ascontiguousarray(far, np.float32)
        return self._fast

    def window_logits(self, x: np.ndarray) -> np.ndarray:
        """Logits of the windows that start at every SPAN-th class of ``x``, which has a few more classes than windows need."""
        near, far = self._tables()
        n = (len(x) - max(WIDTHS)) // SPAN
        pairs = x[:-1].astype(np.int64) * CLASSES + x[1:]
        z = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        run = 128
        for at in range(0, n, run):
            k = min(run, n - at)
            i = at * SPAN
            s = near.take(pairs[i : i + k * SPAN], axis=0)
            s[:, FILTERS:] += far.take(pairs[i + 2 : i + 2 + k * SPAN], axis=0)
            z[at : at + k] = s.reshape(k, SPAN, -1).max(1)
        return np.maximum(z + self.bias.astype(np.float32), 0) @ self.dense.astype(np.float32) + self.out.astype(np.float32)

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities (texts, languages)."""
        windows = np.array([(len(t) + max(WIDTHS) - 1 + SPAN - 1) // SPAN for t in texts])
        x = np.zeros(int(windows.sum()) * SPAN + 2 * max(WIDTHS), np.uint8)
        first = np.concatenate([[0], np.cumsum(windows)[:-1]])
        for t, a in zip(texts, first):
            x[a * SPAN : a * SPAN + len(t)] = CLASS_OF[np.frombuffer(t, np.uint8)]
        return np.add.reduceat(_softmax(self.window_logits(x).astype(np.float64)), first, axis=0) / windows[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def new_network(languages: list[str], seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    tables = [rng.normal(0, 0.3, (w, CLASSES, FILTERS)) for w in WIDTHS]
    n = len(WIDTHS) * FILTERS
    return Network(languages, tables, np.zeros(n), rng.normal(0, n**-0.5, (n, len(languages))), np.zeros(len(languages)))


def windows_of(text: bytes, most: int = WINDOWS) -> list[np.ndarray]:
    """Up to ``most`` windows spread evenly over a text, padded at its end."""
    c = CLASS_OF[np.frombuffer(text, np.uint8)]
    starts = np.unique(np.linspace(0, max(0, len(c) - LENGTH), most).astype(int)) if len(c) else []
    return [np.pad(c[s : s + LENGTH], (0, max(0, LENGTH - len(c[s : s + LENGTH])))) for s in starts]


def sample_for_fit(train: DataFrame) -> list[tuple[str, str]]:
    """(language, text) of the bounded sample; ``train`` has doc_id, lang, text. Only ids are ranked; texts follow by a join with the chosen ids."""
    # at most SAMPLE ids, and one of every language; rows that repeat an id, or have none, are one
    texts = train.where("text IS NOT NULL").withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    top = texts.groupBy("lang").agg(F.approx_count_distinct("_id", 0.02).alias("_all"))
    languages = top.count()
    wanted = max(1, min(PER_LANGUAGE, SAMPLE // max(1, languages)))
    h = F.xxhash64(F.col("doc_id"))
    order = W.partitionBy("lang").orderBy(h, "doc_id")
    # smallest hashes only: of any number of different ids, about twice what is wanted, and a hundred, reach the ranking
    low = h.cast("double") <= -(2.0**63) + 2.0**64 * F.least(F.lit(1.0), (2.0 * wanted + 100) / F.greatest(F.col("_all"), F.lit(1)))
    few = texts.select("doc_id", "_id", "lang").join(F.broadcast(top) if languages <= SAMPLE else top, "lang").where(low).select("doc_id", "_id", "lang").distinct()
    ids = few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= wanted).select("_id", "lang")
    # a window needs a few hundred characters from its place; the pieces are cut before they travel
    length, w = F.length("text"), LENGTH
    piece = lambda k: F.expr(f"substring(text, 1 + int(greatest(0, length(text) - {w}) * {k} / {WINDOWS - 1}), {w})")
    cut = F.when(length <= 4 * w, F.array("text")).otherwise(F.array(*(piece(k) for k in range(WINDOWS))))
    once = texts.join(F.broadcast(ids), ["_id", "lang"]).groupBy("_id", "lang").agg(F.min(cut).alias("pieces"))
    rows = once.select("lang", F.explode("pieces").alias("text")).collect()
    return sorted((r[0], r[1]) for r in rows)


def fit(train: DataFrame) -> Network | None:
    """A network fitted on a sample of ``train`` (doc_id, lang, text), or None where it holds no labelled text."""
    sample = sample_for_fit(train.where("lang IS NOT NULL"))
    languages = sorted({lang for lang, _ in sample})
    x, y = [], []
    for lang, text in sample:
        for w in windows_of(text.encode("utf-8", "replace"), 1 if len(text) <= LENGTH else WINDOWS):
            x.append(w)
            y.append(languages.index(lang))
    if not x:
        return None
    return new_network(languages).fit(np.array(x, np.int64), np.array(y))


def _apply(net: Network | None, field: str | None):
    from . import common as C

    def run(batches):
        for b in batches:
            names, scores = [], []
            letter = b.column(1).to_pylist()
            for first, texts in C.text_chunks(b.column(0).field(field) if field else b.column(2), 1_000_000):
                some = [i for i, t in enumerate(texts) if letter[first + i] and net]
                got = {}
                if some:
                    p = net.predict([texts[i] for i in some])
                    k = p.argmax(1)
                    got = {i: (net.languages[c], float(q)) for i, c, q in zip(some, k, p[np.arange(len(some)), k])}
                for i in range(len(texts)):
                    name, score = got.get(i, ("und", 0.0))
                    names.append(name)
                    scores.append(min(1.0, max(0.0, score)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])

    return run


def held_out_by_crc(doc_id: Column, parts: int, rest: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == rest


def identify_languages(docs: DataFrame, net: Network | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` as ``row``, with lang_pred and score."""
    text = docs[text_col].cast("string")
    # a text that is kept travels once
    field = text_col if text_col in keep and dict(docs.dtypes)[text_col] == "string" else None
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    slim = docs.select(F.struct(*(docs[c] for c in keep)).alias("row"), letter, *([] if field else [text.alias("_text")]))
    return slim.mapInArrow(_apply(net, field), f"row {slim.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def language_id(docs: DataFrame, parts: int = 5, rest: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learns from rows whose crc32(doc_id) mod ``parts`` is not ``rest``."""
    train = docs.where(~held_out_by_crc(docs["doc_id"], parts, rest)).select("doc_id", "lang", "text")
    found = identify_languages(docs, fit(train), ["doc_id"])
    return found.select("row.doc_id", held_out_by_crc(F.col("row.doc_id"), parts, rest).alias("held_out"), "lang_pred", "score")
