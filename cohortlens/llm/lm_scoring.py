"""Scores of texts under a language model: online logistic context mixing over hashed contexts.

*Predictors.* For each context in ``ORDERS`` (the last bytes, A-Z lower-cased, or those of the word so far), its bytes and the bits seen of the next byte name a slot
of a hashed table with the counts of zero and one bits there. The counts cover every training text: they follow exactly from
counts of byte strings, which tasks gather and one shuffle sums. The context's hash names a range; each range of an order has
as many slots as its own distinct strings ask for, so that tables grow with the corpus, up to ``MOST_BITS`` in all ranges together
(the model is sent to every task); beyond that contexts share slots.

*Mixing.* The predictors' log odds are added with weights; the weight set is chosen by a gate: the bit's place and how much
the two longest contexts have been seen. The probability is then refined by an adaptive map over (bits seen, odds). Weights and map are
learned in two steps, each bit predicted from counts without itself: a start, bit after bit, on ``LANES`` lanes of ``STREAM``
bytes; then every task goes on from there over all bytes of its training texts, as counted strings in small batches, and the
tasks' results are averaged by the bytes and bits each has met, ``FAN`` neighbouring tasks at a time. They are frozen for scoring, so that a score doesn't depend on which task met which text first; the
model's log probability of a byte then depends on the ``max(ORDERS)`` bytes before it only, and is worked out once per distinct string.

*Base.* Words are counted by every task, summed by hash range, and the words that make up at least one of ``FREQUENT`` occurrences
(so at most ``FREQUENT`` words) are sent to every task. Scoring resolves these where they stand; all other words go to hash ranges,
eight bytes and a bit each (hash and place of the document in its batch). A range counts its words and returns, of each batch, one sum
for every document that has a word in it: never more than the words that came in, however many ranges there are.
No vocabulary is held anywhere as a whole, and no frequent word is a hot group.

Batches are named by their task and number; a task that runs again must read the same rows, as it does from files. Cut the
lineage of a shuffled input first (``common.cut``).

Null texts are empty: a probability of 1 and the end token only. Repeated rows are scored each, and count each in training.
A null doc_id is treated as the text ''. With nothing to learn from, all predictors say one half.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C
from .language_id import held_out_by_crc

#: Numbers of bytes; WORD stands for the bytes of the word so far, as far as the longest context shows them.
WORD = 0
ORDERS = (1, 2, 3, 4, 5, WORD)
#: Most slots of each context's table, as powers of two: 70 MB at three bytes a slot. Slots that a range has for each of its strings.
MOST_BITS, PER_STRING = {1: 16, 2: 20, 3: 21, 4: 22, 5: 23, WORD: 23}, 16
#: Contexts whose counts choose the weights.
GATED = (4, WORD)
#: A word with one of so many occurrences is counted where it stands.
FREQUENT = 50_000
LANES, STREAM = 256, 1024
#: Distinct strings that a task counts before it learns from them, strings of a batch, and the longest step of a batch along its mean gradient.
COUNTED, BATCH, STEP = 500_000, 8_192, 0.02
GATES, STEPS = 8 * 4 * 4, 33
PRIOR, CLIP, RATE, MAP_RATE = 0.08, 8.0, 0.0005, 0.02
#: Distinct strings that a task counts before it hands them on.
HELD = 3_000_000
#: The same for words.
HELD_WORDS = 1_000_000
#: Tasks whose weights are averaged at once: 9 MB.
FAN = 64
_PAD = max(ORDERS)
#: A counted string travels as one word: the string above, its number below; larger numbers travel in parts.
_MOST = 0xFFFF


def strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(six-byte strings that end at each byte of each text, oldest byte lowest; bytes of each text)."""
    joined = b"".join(bytes(_PAD) + t for t in texts).lower() + bytes(8)
    eight = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + _PAD)[:-1]]) if len(texts) else sizes
    real = np.ones(int((sizes + _PAD).sum()), bool)
    for k in range(_PAD):
        real[starts + sizes + k] = False
    return eight[: len(real)][real] & np.uint64((1 << 8 * (_PAD + 1)) - 1), sizes


def _count(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their (summed) numbers."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    total = np.diff(np.append(head, len(keys))) if n is None else np.add.reduceat(n, head) if len(head) else n
    return keys[head], total.astype(np.uint64)


def _within(keys: np.ndarray, order: int) -> np.ndarray:
    """Strings with what the context doesn't show set to zero."""
    if order != WORD:
        return keys & ~np.uint64((1 << 8 * (_PAD - order)) - 1)
    inside, keep = np.ones(len(keys), bool), np.full(len(keys), np.uint64(0xFF << 8 * _PAD))
    for k in range(_PAD - 1, -1, -1):
        byte = (keys >> np.uint64(8 * k)) & np.uint64(0xFF)
        inside &= ((byte >= 97) & (byte <= 122)) | (byte >= 128)
        keep[inside] |= np.uint64(0xFF << 8 * k)
    return keys & keep


def _context(keys: np.ndarray, order: int) -> np.ndarray:
    """Hash of what the context shows before the last byte; its top bits name the range."""
    return C.mix((_within(keys, order) & np.uint64((1 << 8 * _PAD) - 1)) * np.uint64(8) + np.uint64(order))


class Layout:
    """Where the slots of every order's ranges lie: ranges by the top bits of the context's hash, each with a power of two of slots."""

    def __init__(self, bits: int, low: dict[int, np.ndarray]):
        """``low``: of each order, the bits of every range's slots."""
        self.bits = bits
        self.mask = {o: (np.uint64(1) << b.astype(np.uint64)) - np.uint64(1) for o, b in low.items()}
        ends = {o: np.cumsum(np.int64(1) << b.astype(np.int64)) for o, b in low.items()}
        self.first = {o: np.concatenate([[0], e[:-1]]) for o, e in ends.items()}
        self.size = {o: int(e[-1]) for o, e in ends.items()}

    def slots(self, keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(slot of each of the eight bits of the last byte, the bits), shaped (n, 8)."""
        h = _context(keys, order)
        part = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        inside, bits = _in_range(keys, h, self.mask[order][part])
        return self.first[order][part][:, None] + inside, bits


def _in_range(keys: np.ndarray, h: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    byte = (keys >> np.uint64(8 * _PAD)).astype(np.int64)
    node = (np.int64(1) << np.arange(8)) | (byte[:, None] >> (8 - np.arange(8)))
    return (C.mix(h[:, None] + node.astype(np.uint64) * C.GOLDEN) & mask[:, None]).astype(np.int64), (byte[:, None] >> (7 - np.arange(8))) & 1


def low_bits(order: int, strings_in_range: int, bits: int) -> int:
    """Bits of the slots of a range that holds so many distinct strings."""
    return max(0, min(MOST_BITS[order] - bits, math.ceil(math.log2(max(1, PER_STRING * strings_in_range)))))


def _nodes(keys: np.ndarray) -> np.ndarray:
    byte = (keys >> np.uint64(8 * _PAD)).astype(np.int64)
    return (np.int64(1) << np.arange(8)) | (byte[:, None] >> (8 - np.arange(8)))


class Mixer:
    """Frozen model: log probability of the last byte of a string."""

    def __init__(self, layout: Layout, odds: dict[int, np.ndarray], seen: dict[int, np.ndarray], weights: np.ndarray, refine: np.ndarray):
        self.layout, self.odds, self.seen, self.weights, self.refine = layout, odds, seen, weights, refine
        self._keys = self._values = None

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """Natural logarithms, by evaluation."""
        out = np.empty(len(keys))
        for at in range(0, len(keys), 50_000):
            k = keys[at : at + 50_000]
            x = np.empty((len(k), 8, len(ORDERS) + 1))
            x[..., -1] = 0.3
            gate = np.broadcast_to(np.arange(8) * 16, (len(k), 8)).copy()
            for i, o in enumerate(ORDERS):
                slot, bits = self.layout.slots(k, o)
                x[..., i] = self.odds[o][slot] / 16.0
                if o in GATED:
                    gate += self.seen[o][slot] * (4 if o == GATED[0] else 1)
            dot = np.clip((x * self.weights[gate]).sum(-1), -CLIP, CLIP)
            p = _refined(dot, self.refine, _nodes(k))[0]
            out[at : at + len(k)] = np.log(np.where(bits == 1, p, 1 - p)).sum(1)
        return out

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The same through a table of strings met before, of fixed size."""
        if self._keys is None:
            self._keys, self._values = np.full(1 << 21, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(1 << 21)
        at = (C.mix(keys + C.GOLDEN) & np.uint64((1 << 21) - 1)).astype(np.int64)
        out = self._values[at]
        miss = np.flatnonzero(self._keys[at] != keys)
        if len(miss):
            new, which = np.unique(keys[miss], return_inverse=True)
            got = self.log_p(new)
            out[miss] = got[which]
            put = (C.mix(new + C.GOLDEN) & np.uint64((1 << 21) - 1)).astype(np.int64)
            self._keys[put], self._values[put] = new, got
        return out


def _refined(dot: np.ndarray, refine: np.ndarray, node: np.ndarray):
    """Probability of a one: that of the mix, averaged with the adaptive map's, which is read between two steps."""
    p = 1 / (1 + np.exp(-dot))
    place = (dot + CLIP) * ((STEPS - 1) / (2 * CLIP))
    low = np.minimum(place.astype(np.int64), STEPS - 2)
    part = place - low
    q = refine[node, low] * (1 - part) + refine[node, low + 1] * part
    return np.clip(0.5 * p + 0.5 * q, 1e-6, 1 - 1e-6), p, low, part


def _level(n: np.ndarray) -> np.ndarray:
    return np.searchsorted([1, 4, 32], n, side="right")


def learn(layout: Layout, tables: dict[int, tuple[np.ndarray, np.ndarray]], lanes: list[bytes]) -> Mixer:
    """Tables of zero and one counts as log odds, with weights and map from the lanes."""
    return begin(layout, {o: log_odds(*both) for o, both in tables.items()}, few(tables), lanes)


def log_odds(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In sixteenths, from full counts."""
    zero, one = zero.astype(np.float32), one.astype(np.float32)
    return np.clip(np.round(np.log((one + PRIOR) / (zero + PRIOR)) * 16), -127, 127).astype(np.int8)


def begin(layout: Layout, odds: dict[int, np.ndarray], counts: dict[int, tuple[np.ndarray, np.ndarray]], lanes: list[bytes]) -> Mixer:
    """Weights and map, learned online on the lanes side by side; ``counts`` as of ``few``."""
    weights = np.full((GATES, len(ORDERS) + 1), 0.2)
    refine = np.broadcast_to(1 / (1 + np.exp(-np.linspace(-CLIP, CLIP, STEPS))), (256, STEPS)).copy()
    lanes = [t for t in lanes if t]
    steps = max((len(t) for t in lanes), default=0)
    if steps:
        keys = np.zeros((len(lanes), steps), np.uint64)
        live = np.zeros((len(lanes), steps), bool)
        for i, t in enumerate(lanes):
            keys[i, : len(t)], live[i, : len(t)] = strings([t])[0], True
        flat = keys.ravel()
        x = np.full((len(flat), 8, len(ORDERS) + 1), 0.3, np.float32)
        gate = np.broadcast_to(np.arange(8, dtype=np.int16) * 16, (len(flat), 8)).copy()
        for i, o in enumerate(ORDERS):
            slot, bits = layout.slots(flat, o)
            zero, one = (a[slot] for a in counts[o])
            x[..., i] = _without(odds[o][slot], zero, one, bits)
            if o in GATED:
                gate += (_seen_before(zero, one) * (4 if o == GATED[0] else 1)).astype(np.int16)
            del slot, zero, one
        node, bits = _nodes(flat).astype(np.int16), bits.astype(np.int8)
        x, gate, node, bits = (a.reshape(len(lanes), steps, *a.shape[1:]) for a in (x, gate, node, bits))
        for t in range(steps):
            rate = max(RATE, 10 * RATE / (1 + t / 20))
            on = np.flatnonzero(live[:, t])
            for b in range(8):
                xs, g, y, c = x[on, t, b], gate[on, t, b], bits[on, t, b], node[on, t, b]
                dot = np.clip((xs * weights[g]).sum(1), -CLIP, CLIP)
                _, p, low, part = _refined(dot, refine, c)
                np.add.at(weights, g, rate * (y - p)[:, None] * xs)
                # lanes that meet in a cell of the map move it together, at most to their mean
                err, held = np.zeros_like(refine), np.zeros_like(refine)
                for k, share in ((low, 1 - part), (low + 1, part)):
                    np.add.at(err, (c, k), share * (y - refine[c, k]))
                    np.add.at(held, (c, k), share)
                at = np.nonzero(held)
                refine[at] += err[at] * (1 - (1 - MAP_RATE) ** held[at]) / held[at]
        refine = np.clip(refine, 1e-5, 1 - 1e-5)
    seen = {o: _level(counts[o][0].astype(np.int16) + counts[o][1]).astype(np.int8) if o in GATED else np.zeros(1, np.int8) for o in odds}
    return Mixer(layout, odds, seen, weights, refine)


def few(tables: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counts up to 255: where there are more, one bit less changes the odds by less than the step in which they are kept."""
    return {o: tuple(np.minimum(a, 255).astype(np.uint8) for a in both) for o, both in tables.items()}


#: Change of the log odds of a bit when one of so many equal bits is taken away.
_LESS = np.append(np.log((np.maximum(np.arange(255) - 1, 0) + PRIOR) / (np.arange(255) + PRIOR)), 0.0).astype(np.float32)


def _without(odds: np.ndarray, zero: np.ndarray, one: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Log odds from counts without the bit itself."""
    less = _LESS[np.where(bits == 1, one, zero)]
    return np.clip(odds / np.float32(16) + np.where(bits == 1, less, -less), -CLIP, CLIP - 1 / 16)


def _seen_before(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    return _level(np.maximum(zero.astype(np.int16) + one - 1, 0))


class Learner:
    """Goes on with a model's weights and map over counted strings of the training texts."""

    def __init__(self, model: Mixer, counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.model, self.counts, self.n = model, counts, 0
        self.weights, self.refine = model.weights.copy(), model.refine.copy()
        self.met = np.zeros_like(self.refine)

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(C.mix(keys), kind="stable")
        for at in range(0, len(keys), BATCH):
            some = order[at : at + BATCH]
            self._batch(keys[some], n[some].astype(np.float64))
        self.n += int(n.sum())

    def _batch(self, keys: np.ndarray, n: np.ndarray) -> None:
        x = np.empty((len(keys), 8, len(ORDERS) + 1))
        x[..., -1] = 0.3
        gate = np.broadcast_to(np.arange(8) * 16, (len(keys), 8)).copy()
        for i, o in enumerate(ORDERS):
            slot, bits = self.model.layout.slots(keys, o)
            zero, one = (a[slot] for a in self.counts[o])
            x[..., i] = _without(self.model.odds[o][slot], zero, one, bits)
            if o in GATED:
                gate += _seen_before(zero, one) * (4 if o == GATED[0] else 1)
        x, g, y, c, m = x.reshape(-1, x.shape[-1]), gate.ravel(), bits.ravel(), _nodes(keys).ravel(), np.repeat(n, 8)
        _, p, low, part = _refined(np.clip((x * self.weights[g]).sum(1), -CLIP, CLIP), self.refine, c)
        held = np.bincount(g, m, GATES)
        slope = np.stack([np.bincount(g, m * (y - p) * x[:, i], GATES) for i in range(x.shape[1])], 1)
        self.weights += slope * (np.minimum(RATE * held, STEP) / np.maximum(held, 1))[:, None]
        err, held = np.zeros(self.refine.size), np.zeros(self.refine.size)
        for k, share in ((low, m * (1 - part)), (low + 1, m * part)):
            cell = c * STEPS + k
            held += np.bincount(cell, share, len(held))
            err += np.bincount(cell, share * (y - self.refine.ravel()[cell]), len(err))
        self.met += held.reshape(self.met.shape)
        # a mean over all bits met, begun with the start's value
        self.refine += err.reshape(self.met.shape) / (self.met + 1 / MAP_RATE)


def _mean(passes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray] | None:
    """The mean of (n, weights, refine, met): weights by bytes, the map by the bits that met a cell."""
    n = 0
    for k, w, r, m in passes:
        if not n:
            weights, refine, met = np.zeros_like(w), np.zeros_like(r), np.zeros_like(r)
        n, weights, refine, met = n + k, weights + k * w, refine + m * r, met + m
    return (n, weights / n, refine / np.maximum(met, 1e-300), met) if n else None


def averaged(start: Mixer, passes) -> Mixer:
    """The start's tables with the mean of what tasks learned; the start's map where no bit met a cell."""
    mean = _mean(passes)
    if mean is None:
        return start
    _, weights, refine, met = mean
    return Mixer(start.layout, start.odds, start.seen, weights, np.clip(np.where(met > 0, refine, start.refine), 1e-5, 1 - 1e-5))


_LEARNED = "task int, n long, weights binary, refine binary, met binary"


def _as_pass(n: int, weights: bytes, refine: bytes, met: bytes):
    return (n, np.frombuffer(weights).reshape(GATES, -1), *(np.frombuffer(a).reshape(256, STEPS) for a in (refine, met)))


def _mean_of_tasks(key, t):
    """The results of up to ``FAN`` tasks as one, in the order of the tasks."""
    n, *arrays = _mean(_as_pass(*r[1:]) for r in sorted(zip(*(t[c].to_pylist() for c in ("task", "n", "weights", "refine", "met"))), key=lambda r: r[0]))
    return pa.table({"task": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), **{c: pa.array([a.tobytes()], pa.binary()) for c, a in zip(("weights", "refine", "met"), arrays)}})


def _few_passes(passes: DataFrame) -> list:
    """What all tasks learned, as at most ``FAN`` passes: means of ``FAN`` neighbours, and means of these."""
    tasks = (passes.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > FAN:
        passes = passes.groupBy(F.floor(F.col("task") / FAN).cast("int").alias("of")).applyInArrow(_mean_of_tasks, _LEARNED)
        tasks = math.ceil(tasks / FAN)
    return [_as_pass(r["n"], *(bytes(r[c]) for c in ("weights", "refine", "met"))) for r in sorted(passes.collect(), key=lambda r: r["task"])]


def _learn_from(shared):
    """Of each task: its number and what it learned from all of its texts."""

    def run(batches):
        from pyspark import TaskContext

        learner, held = Learner(*shared.value), (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        for b in batches:
            for _, texts in C.text_chunks(b.column(0)):
                new = _count(strings(texts)[0])
                held = _count(np.concatenate([held[0], new[0]]), np.concatenate([held[1], new[1]]))
                if len(held[0]) > COUNTED:
                    learner.add(*held)
                    held = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        learner.add(*held)
        if learner.n:
            yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": [learner.n], **{k: [getattr(learner, k).tobytes()] for k in ("weights", "refine", "met")}})

    return run


# ---- what tasks gather ----

_GATHERED = "kind int, part int, place int, a binary, b binary, n long, v long"
_SCORED = "kind int, part int, batch long, a binary, b binary"
_WORDS, _STRINGS, _DOCS = range(3)
_DOC = np.dtype([("id", "<i8"), ("known_id", "?"), ("words", "<i8"), ("n_bytes", "<i8"), ("ln_p", "<f8"), ("logs", "<f8"), ("known", "<i8")])
_SUM = np.dtype([("place", "<u2"), ("known", "<i4"), ("logs", "<f8")])
_COUNTED_WORD = np.dtype([("h", "<u8"), ("all", "<i8"), ("train", "<i8")])


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def _summed(words: np.ndarray) -> np.ndarray:
    """Counted words, each once."""
    h, which = np.unique(words["h"], return_inverse=True)
    out = np.zeros(len(h), _COUNTED_WORD)
    out["h"] = h
    for k in ("all", "train"):
        # whole numbers below 2 ** 53
        out[k] = np.bincount(which, words[k], len(h)).astype(np.int64)
    return out


def _ranges(h: np.ndarray, bits: int):
    """(range, places in it) of hashes, by their top bits."""
    which = (h >> np.uint64(64 - bits)).astype(np.uint16)
    order = np.argsort(which, kind="stable")
    ends = np.searchsorted(which[order], np.arange((1 << bits) + 1))
    for k in range(1 << bits):
        if ends[k] < ends[k + 1]:
            yield k, order[ends[k] : ends[k + 1]]


def _gather(bits: int):
    """From (train, text): counted words by range, counted strings of the training texts by range and order, training texts."""

    def words(held):
        for k, at in _ranges(held["h"], bits):
            yield (_WORDS, k, 0, held[at].tobytes(), None, 0, 0)

    def grams(keys, n):
        for o in ORDERS:
            k, m = _count(_within(keys, o), n) if o < _PAD else (keys, n)
            for r, at in _ranges(_context(k, o), bits):
                key, n_of = k[at] << np.uint64(16), m[at].astype(np.int64)
                both = np.concatenate([np.repeat(key, n_of // _MOST) | np.uint64(_MOST), (key | (n_of % _MOST).astype(np.uint64))[n_of % _MOST > 0]])
                yield (_STRINGS, r, o, both.tobytes(), None, 0, 0)

    def run(batches):
        nothing = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        met, held, docs = np.zeros(0, _COUNTED_WORD), nothing, 0
        for b in batches:
            of_train = b.column(0).to_numpy(zero_copy_only=False)
            docs += int(of_train.sum())
            for first, texts in C.text_chunks(b.column(1)):
                train = of_train[first : first + len(texts)]
                h, n = C.word_hashes(texts)
                new = np.zeros(len(h), _COUNTED_WORD)
                new["h"], new["all"], new["train"] = h, 1, np.repeat(train, n)
                met = _summed(np.concatenate([met, _summed(new)]))
                new = _count(strings([t for t, on in zip(texts, train) if on])[0])
                held = _count(np.concatenate([held[0], new[0]]), np.concatenate([held[1], new[1]]))
                if len(met) > HELD_WORDS:
                    yield _batch(_GATHERED, list(words(met)))
                    met = met[:0]
                if len(held[0]) > HELD:
                    yield _batch(_GATHERED, list(grams(*held)))
                    held = nothing
        yield _batch(_GATHERED, [(_DOCS, 0, 0, None, None, docs, 0), *words(met), *grams(*held)])

    return run


def _sum_strings(part: int, t, bits: int) -> list[tuple]:
    """Of one range: its slots of every order's table, as zero and one counts."""
    out = []
    for o in ORDERS:
        both = [np.frombuffer(a.as_buffer(), np.uint64) for a, p in zip(t["a"], t["place"].to_pylist()) if p == o]
        if not both:
            continue
        both = np.concatenate(both)
        keys, n = _count(both >> np.uint64(16), both & np.uint64(_MOST))
        size = 1 << low_bits(o, len(keys), bits)
        zero, one = np.zeros(size), np.zeros(size)
        for at in range(0, len(keys), 200_000):
            k, m = keys[at : at + 200_000], n[at : at + 200_000].astype(np.float64)
            slot, bit = _in_range(k, _context(k, o), np.full(len(k), size - 1, np.uint64))
            slot, m, bit = slot.ravel(), np.repeat(m, 8), bit.ravel() == 1
            one += np.bincount(slot, m * bit, size)
            zero += np.bincount(slot, m * ~bit, size)
        out.append((_STRINGS, part, o, zero.astype(np.float32).tobytes(), one.astype(np.float32).tobytes(), 0, 0))
    return out


def _as_odds(rows: list[tuple]) -> list[tuple]:
    """Slots as log odds of their full counts, and the few counts: three bytes a slot."""
    out = []
    for kind, part, o, *both, n, v in rows:
        zero, one = (np.frombuffer(a, np.float32) for a in both)
        out.append((kind, part, o, log_odds(zero, one).tobytes(), b"".join(a.tobytes() for a in few({o: (zero, one)})[o]), n, v))
    return out


def _reduce(bits: int):
    def run(key, t):
        kind, part = key[0].as_py(), key[1].as_py()
        if kind == _DOCS:
            return pa.Table.from_batches([_batch(_GATHERED, [(_DOCS, 0, 0, None, None, sum(t["n"].to_pylist()), 0)])])
        if kind == _WORDS:
            words = _summed(np.concatenate([np.frombuffer(a.as_buffer(), _COUNTED_WORD) for a in t["a"]]))
            rows = [(_WORDS, part, 0, words.tobytes(), None, int(words["train"].sum()), int((words["train"] > 0).sum()))]
        else:
            rows = _as_odds(_sum_strings(part, t, bits))
        return pa.Table.from_batches([_batch(_GATHERED, rows)])

    return run


def _occurrences(batches):
    """Of each range of words, the occurrences in all texts."""
    for b in batches:
        yield pa.RecordBatch.from_pydict({"n": pa.array([int(np.frombuffer(a.as_buffer(), _COUNTED_WORD)["all"].sum()) for a in b.column(0)], pa.int64())})


def _frequent(least: float):
    """The words with at least so many occurrences, with their occurrences in training."""

    def run(batches):
        for b in batches:
            words = [w[w["all"] >= least] for w in (np.frombuffer(a.as_buffer(), _COUNTED_WORD) for a in b.column(0))]
            words = np.concatenate(words) if words else np.zeros(0, _COUNTED_WORD)
            yield pa.RecordBatch.from_pydict({"h": pa.array(words["h"].view(np.int64)), "train": pa.array(words["train"])})

    return run


def _score(shared, bits: int):
    """From (doc_id, train, text): the documents of each batch, with their score and the sums of their frequent words; the other words by range."""

    def pack(batch, docs, words, rows, train):
        known = np.array([d[0] is not None for d in docs], bool)
        table = np.zeros(len(docs), _DOC)
        table["id"], table["known_id"] = [d[0] or 0 for d in docs], known
        for k, name in enumerate(("words", "n_bytes", "ln_p", "logs", "known"), 1):
            table[name] = [d[k] for d in docs]
        # tasks have several batches at most: both parts of the name spread them
        yield (_DOCS, ((batch >> 32) + batch) & ((1 << bits) - 1), batch, table.tobytes(), None)
        words, rows = np.concatenate(words), np.concatenate(rows)
        flags = np.array(train, bool)[rows]
        word = ((words << np.uint64(bits)) & ~np.uint64(0xFFFF)) | rows.astype(np.uint64)
        for k, at in _ranges(words, bits):
            yield (_WORDS, k, batch, word[at].tobytes(), np.packbits(flags[at]).tobytes())

    def run(batches):
        from pyspark import TaskContext

        model, often, logs_of, known_of = shared.value
        task, made = TaskContext.get().partitionId(), 0
        docs, words, rows, train, total = [], [], [], [], 0
        for b in batches:
            of_id, of_train = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first, texts in C.text_chunks(b.column(2), 1_000_000):
                keys, size = strings(texts)
                ln_p = _sum_by(model.lookup(keys), size)
                h, n = C.word_hashes(texts)
                at = np.minimum(np.searchsorted(often, h), max(0, len(often) - 1))
                hit = often[at] == h if len(often) else np.zeros(len(h), bool)
                logs, known = np.zeros(len(h)), np.zeros(len(h), np.int64)
                if len(often):
                    logs[hit], known[hit] = logs_of[at[hit]], known_of[at[hit]]
                logs, known = _sum_by(logs, n), _sum_by(known, n)
                row = np.repeat(np.arange(len(texts)), n)
                for low in range(0, len(texts), 30_000):
                    high = min(len(texts), low + 30_000)
                    mine = ~hit & (row >= low) & (row < high)
                    words.append(h[mine])
                    rows.append(row[mine] - low + len(docs))
                    docs += zip(of_id[first + low : first + high], *(a[low:high].tolist() for a in (n, size, ln_p, logs, known)))
                    train += of_train[first + low : first + high]
                    total += len(words[-1])
                    if total > 1_500_000 or len(docs) > 30_000:
                        # the same name whenever this task runs again
                        yield _batch(_SCORED, list(pack((task << 32) + made, docs, words, rows, train)))
                        made += 1
                        docs, words, rows, train, total = [], [], [], [], 0
        if docs:
            yield _batch(_SCORED, list(pack((task << 32) + made, docs, words, rows, train)))

    return run


def _sum_by(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of values."""
    out = np.zeros(len(sizes), values.dtype)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def _sum_words(key, t):
    """Of one range: per batch the sums of log10(count + 1) and the known words of those of its documents that have a word here."""
    if key[0].as_py() == _DOCS:
        return t
    word, place, train = [], [], []
    for i, (a, b) in enumerate(zip(t["a"], t["b"])):
        w = np.frombuffer(a.as_buffer(), np.uint64)
        word.append(w & ~np.uint64(0xFFFF))
        place.append((np.int64(i) << 16) | (w & np.uint64(0xFFFF)).astype(np.int64))
        train.append(np.unpackbits(np.frombuffer(b.as_buffer(), np.uint8), count=len(w)))
    h, place, train = (np.concatenate(x) for x in (word, place, train))
    order = np.argsort(h, kind="stable")
    h, place = h[order], place[order]
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    c = np.add.reduceat(train[order].astype(np.int64), head)
    each = np.repeat(c, np.diff(np.append(head, len(h))))
    met, which = np.unique(place, return_inverse=True)
    sums = np.zeros(len(met), _SUM)
    sums["place"] = met & 0xFFFF
    sums["logs"] = np.bincount(which, np.log10(each + 1.0), len(met))
    sums["known"] = np.bincount(which, each > 0, len(met)).astype(np.int32)
    ends = np.searchsorted(met >> 16, np.arange(t.num_rows + 1))
    return pa.Table.from_batches([_batch(_SCORED, [(_WORDS, key[1].as_py(), b, sums[ends[i] : ends[i + 1]].tobytes(), None) for i, b in enumerate(t["batch"].to_pylist())])])


def _by_document(key, t):
    """Of one batch: its documents with the sums over all ranges, added in the order of the ranges."""
    rows = sorted(zip(t["kind"].to_pylist(), t["part"].to_pylist(), t["a"]), key=lambda x: x[:2])
    docs = next(np.frombuffer(a.as_buffer(), _DOC) for kind, _, a in rows if kind == _DOCS)
    logs, known = docs["logs"].copy(), docs["known"].copy()
    for kind, _, a in rows:
        if kind == _WORDS:
            # a document once in a range
            some = np.frombuffer(a.as_buffer(), _SUM)
            logs[some["place"]] += some["logs"]
            known[some["place"]] += some["known"]
    return pa.table({"doc_id": pa.array(docs["id"], pa.int64(), mask=~docs["known_id"]), "words": docs["words"], "n_bytes": docs["n_bytes"], "ln_p": docs["ln_p"], "known": known, "logs": logs})


def _stream(train: DataFrame) -> list[bytes]:
    """Up to LANES pieces of STREAM bytes from training texts, those with the smallest hash of their id; pieces lie at a place that the hash names."""
    long = train.where(F.length("text") > 0)
    place = F.expr(f"int(pmod(xxhash64(doc_id, 1), greatest(1, length(text) - {STREAM})))")
    rows = long.select(F.xxhash64("doc_id").alias("k"), F.col("doc_id"), F.substring(F.col("text"), place + 1, F.lit(STREAM)).alias("t")).orderBy("k", "doc_id", "t").limit(LANES).collect()
    return [r[2].encode("utf-8", "replace")[:STREAM] for r in rows]


def score_texts(docs: DataFrame, parts: int = 7, rest: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row."""
    spark = docs.sparkSession
    C.shared_dir(spark)
    held_out = held_out_by_crc(docs[id_col], parts, rest)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), (~held_out).alias("train"), text.alias("text"))
    bits = max(4, min(12, math.ceil(math.log2(2 * C.partitions(spark)))))
    gathered = C.cut(rows.select("train", "text").mapInArrow(_gather(bits), _GATHERED).groupBy("kind", "part").applyInArrow(_reduce(bits), _GATHERED))

    words = gathered.where(F.col("kind") == _WORDS)
    ends = gathered.where(F.col("kind") == _DOCS).agg(F.sum("n")).first()[0] or 0
    n_train, v_train = (x or 0 for x in words.agg(F.sum("n"), F.sum("v")).first())
    n_train, v_train = n_train + ends, v_train + (ends > 0)
    n_all = words.select("a").mapInArrow(_occurrences, "n long").agg(F.sum("n")).first()[0] or 0
    # at most FREQUENT words
    often = sorted((r[0] & 0xFFFFFFFFFFFFFFFF, r[1]) for r in words.select("a").mapInArrow(_frequent(max(1, n_all / FREQUENT)), "h long, train long").toLocalIterator())
    frequent = np.array([x[0] for x in often], np.uint64), np.log10(np.array([x[1] for x in often], float) + 1), np.array([x[1] > 0 for x in often], np.int64)

    # tables of a bounded number of slots: 3 bytes for each of at most sum(2 ** MOST_BITS), formed from full counts
    tables = gathered.where(F.col("kind") == _STRINGS).select("part", "place", "a", "b")
    low = {o: np.zeros(1 << bits, np.int64) for o in ORDERS}
    for part, o, size in tables.select("part", "place", F.length("a")).toLocalIterator():
        low[o][part] = size.bit_length() - 1
    layout = Layout(bits, low)
    odds = {o: np.zeros(layout.size[o], np.int8) for o in ORDERS}
    counts = {o: (np.zeros(layout.size[o], np.uint8), np.zeros(layout.size[o], np.uint8)) for o in ORDERS}
    for part, o, a, b in tables.toLocalIterator():
        at = slice(layout.first[o][part], layout.first[o][part] + len(a))
        odds[o][at] = np.frombuffer(bytes(a), np.int8)
        counts[o][0][at], counts[o][1][at] = np.frombuffer(bytes(b), np.uint8).reshape(2, -1)
    start = begin(layout, odds, counts, _stream(rows.where("train")))
    shared = spark.sparkContext.broadcast((start, counts))
    final = averaged(start, _few_passes(C.cut(rows.where("train").select("text").mapInArrow(_learn_from(shared), _LEARNED))))
    shared.destroy()
    del counts
    model = spark.sparkContext.broadcast((final, *frequent))

    scored = rows.mapInArrow(_score(model, bits), _SCORED).groupBy("kind", "part").applyInArrow(_sum_words, _SCORED)
    found = scored.groupBy("batch").applyInArrow(_by_document, "doc_id long, words long, n_bytes long, ln_p double, known long, logs double")
    tokens = F.col("words") + 1
    return found.select(
        "doc_id",
        held_out_by_crc(F.col("doc_id"), parts, rest).alias("held_out"),
        tokens.alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") + math.log10(ends + 1) - tokens * math.log10(n_train + v_train + 1)).alias("base_score"),
        (F.col("ln_p") / math.log(10)).alias("score"),
        F.when(F.col("n_bytes") > 0, -F.col("ln_p") / math.log(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
