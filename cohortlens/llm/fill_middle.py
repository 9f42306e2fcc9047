"""Fill-in-middle transformation by a table-driven byte automaton.

One scan runs a deterministic automaton over the UTF-8 bytes of many texts. Its states are how much of a sentinel
has been read and whether a unit (a line with its end) begins; every transition emits whether a code point begins, a unit
begins or a sentinel ends. Those emissions are counted by text; the second pass finds the bytes of the two cuts
from the counted unit starts. Runs of ``STEP`` bytes advance side by side: a state depends on the last few bytes
only, so that every run starts that many bytes early.

``fill_in_middle`` returns the texts themselves; ``restore`` is the exact inverse, as a Column.

Null and empty texts have no unit and are plain, as are texts that hold a sentinel. A null id is hashed as the
empty string. Rows with one id are cut at the same numbers; repeated rows give repeated results. Texts of any length are cut whole; a batch
returns after about ``BATCH`` bytes. Extra columns travel in ``row`` where ``keep`` names them. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

#: Marks before prefix, suffix and middle. ASCII; none may hold another.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What a transition emits.
POINT, UNIT, SENTINEL = 1, 2, 4
#: Byte between texts (UTF-8 has none of that value), bytes of a run, bytes of text worked on at once.
APART, STEP, BATCH = 0xFF, 512, 2_000_000


class Automaton:
    """Tables ``next`` and ``emit``, one row of 256 bytes for each state; states are stored times 256."""

    def __init__(self, sentinels: list[str]):
        words = [s.encode("ascii") for s in sentinels]
        # states: what of a sentinel has been read, the empty word first; then the start of a unit
        read = sorted({w[:k] for w in words for k in range(len(w))}, key=lambda p: (len(p), p))
        fresh = len(read)
        self.next, self.emit = np.zeros((fresh + 1, 256), np.int64), np.zeros((fresh + 1, 256), np.uint8)
        for state, before in enumerate([*read, b""]):
            for byte in range(256):
                now = before + bytes([byte])
                rest = next(now[k:] for k in range(len(now) + 1) if now[k:] in read)
                self.next[state, byte] = fresh if byte in (0x0A, APART) else read.index(rest)
                self.emit[state, byte] = POINT * (byte & 0xC0 != 0x80) | UNIT * (state == fresh) | SENTINEL * any(now.endswith(w) for w in words)
        self.emit[:, APART] = 0
        self.warm, self.next, self.emit = max(map(len, words), default=1), (self.next * 256).reshape(-1), self.emit.reshape(-1)

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(emission of every byte, first byte of each text and of a next one); texts are parted by a byte that emits nothing."""
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        runs = max(1, -(-int(first[-1]) // STEP))
        data = np.full(self.warm + runs * STEP, APART, np.uint8)
        at = self.warm
        for t in texts:
            data[at : at + len(t)] = np.minimum(np.frombuffer(t, np.uint8), APART - 1)
            at += len(t) + 1
        lanes = np.lib.stride_tricks.as_strided(data, (runs, self.warm + STEP), (STEP, 1))
        out, state = np.empty((runs, STEP), np.uint8), np.zeros(runs, np.int64)
        for k in range(self.warm + STEP):
            i = state + lanes[:, k]
            if k >= self.warm:
                out[:, k - self.warm] = self.emit.take(i)
            state = self.next.take(i)
        return out.reshape(-1)[: int(first[-1])], first


def cut_numbers(key: str, seed: int) -> list[int]:
    """The first four 8-digit groups of the hash of ``seed``:``key``."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def _apply(seed: int, rate: int, spm: int):
    def run(batches):
        dfa = Automaton([PREFIX, SUFFIX, MIDDLE])
        marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
        for b in batches:
            keys = b.column(2).to_pylist()
            for at, texts in C.text_chunks(b.column(1), BATCH):
                emitted, first = dfa.scan(texts)
                points = np.concatenate([[0], np.cumsum(emitted & POINT, dtype=np.int64)])
                # a place after the last text's end stands for its last cut
                starts = np.flatnonzero(emitted & UNIT)
                lower = np.searchsorted(starts, first)
                marked = np.searchsorted(np.flatnonzero(emitted & SENTINEL), first)
                rows = []
                for i, text in enumerate(texts):
                    n = int(lower[i + 1] - lower[i])
                    h1, h2, h3, h4 = cut_numbers(keys[at + i] or "", seed)
                    if n == 0 or marked[i + 1] > marked[i] or h3 % 100 >= rate:
                        rows.append((n, "plain", None, None, text))
                        continue
                    # the second pass: from counted units to bytes
                    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                    a, z = (int(starts[lower[i] + k]) if k < n else int(first[i]) + len(text) for k in (low, high))
                    o = int(first[i])
                    prefix, middle, suffix = text[: a - o], text[a - o : z - o], text[z - o :]
                    p, s, m = marks
                    form, out = ("spm", s + suffix + p + prefix + m + middle) if h4 % 100 < spm else ("psm", p + prefix + s + suffix + m + middle)
                    rows.append((n, form, int(points[a] - points[o]), int(points[z] - points[a]), out))
                n, form, before, inside, out = zip(*rows)
                long = [pa.array(x, pa.int64()) for x in (n, before, inside)]
                text_out = pa.array(out, pa.large_binary()).cast(pa.large_binary()).view(pa.large_string()) if sum(map(len, out)) > 2**30 else pa.array(out, pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), long[0], pa.array(form, pa.string()), long[1], long[2], text_out], names=["row", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, keep: list[str] | None = None, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` as ``row``, with n (units), form, prefix_chars, middle_chars and output (the transformed text).

    ``rate`` of a hundred texts are transformed, ``spm`` of a hundred of those with the suffix first; both by hash of the id.
    """
    row = F.struct(*(docs[c] for c in keep or [id_col]))
    slim = docs.select(row.alias("row"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), docs[id_col].cast("string").alias("key"))
    kind = slim.schema["row"].dataType.simpleString()
    return slim.mapInArrow(_apply(seed, rate, spm), f"row {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` turned into ``output``: no text that it transforms holds a mark, so each mark is found once."""
    part = lambda after, before: F.substring_index(F.substring_index(output, after, -1), before, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(part(PREFIX, SUFFIX), middle, part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), middle, part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
