"""Token counts of a sentencepiece BPE model without encoding whole texts.

A pre-token is a run of spaces with what follows it up to the next space or line feed. When the model
is loaded, its vocabulary is read to prove that no piece has a space mark after another character and
none has a line feed: merges then never cross a pre-token, and counts add up. Vocabulary strings that the
library encodes alone as one token are collected once ("whole tokens"); a pre-token among them counts
one without any merge. Every other pre-token is merged by the library itself; results are kept in a
bounded table. A model without the proof, or a text with a literal space mark, goes to the library whole.

Null and empty texts have 0 tokens. Repeated rows are counted each. Other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Merged pre-tokens that a Python worker keeps; further ones are merged again when met.
KEPT = 300_000
MARK = "▁"
_TOKENS = re.compile(" +[^ ]*|[^ ]+")


class _Kept(dict):
    """Counts by pre-token. ``learn`` merges those that are missing, as one batch; short ones are kept while there is room."""

    def __init__(self, merge, whole=()):
        super().__init__(dict.fromkeys(whole, 1))
        self.merge, self.more = merge, {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        counts = dict(zip(new, self.merge(new))) if new else {}
        room = max(0, KEPT - len(self))
        keep = [w for w in new if len(w) < 64][:room]
        self.update((w, counts.pop(w)) for w in keep)
        self.more = counts

    def __missing__(self, word: str) -> int:
        return self.more[word]


class Counter:
    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.splits = not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces)
        # counts also add up only if texts stay as they are, get one mark in front, and line feeds are single bytes
        self.splits &= sp.encode("\na", out_type=str) == [MARK, "<0x0A>", "a"] and sp.encode("  b", out_type=str) == [MARK * 2, MARK + "b"]
        normal = [p for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        marked = [p[1:] for p in normal if p.startswith(MARK) and len(p) > 1]
        bare = [p for p in normal if MARK not in p]
        #: After one space, and at the start of a line.
        self.spaced = _Kept(self._spaced, [w for w, t in zip(marked, sp.encode(marked)) if len(t) == 1 and MARK not in w])
        self.bare = _Kept(self._bare, [w for w, t in zip(bare, sp.encode(["\n" + w for w in bare])) if len(t) == 3])

    def _spaced(self, words: list[str]) -> list[int]:
        return [len(t) or 1 for t in self.sp.encode(words, num_threads=1)]

    def _bare(self, words: list[str]) -> list[int]:
        return [len(t) - 2 for t in self.sp.encode(["\n" + w for w in words], num_threads=1)]

    def _cut(self, text: str) -> tuple[int, list[str], list[str]]:
        """(line feeds, pre-tokens after one space, pre-tokens without a space in front)."""
        spaced, bare = [], []
        lines = text.split("\n")
        for i, line in enumerate(lines):
            line = " " + line if i == 0 else line
            if "  " in line:
                for w in _TOKENS.findall(line):
                    (spaced if w[0] == " " else bare).append(w[1:] if w[0] == " " else w)
            elif line:
                first, *rest = line.split(" ")
                if first:
                    bare.append(first)
                spaced += rest
        return len(lines) - 1, spaced, bare

    def counts(self, texts: list[str | None]) -> list[int]:
        out, cuts = [0] * len(texts), []
        for i, text in enumerate(texts):
            if text and (not self.splits or MARK in text):
                out[i] = len(self.sp.encode(text))
            elif text:
                cuts.append((i, *self._cut(text)))
        self.spaced.learn({w for c in cuts for w in c[2]})
        self.bare.learn({w for c in cuts for w in c[3]})
        for i, n, spaced, bare in cuts:
            out[i] = n + sum(map(self.spaced.__getitem__, spaced)) + sum(map(self.bare.__getitem__, bare))
        self.spaced.more, self.bare.more = {}, {}
        return out

    def count(self, text: str | None) -> int:
        return self.counts([text])[0]


@lru_cache(maxsize=2)
def counter(model: bytes) -> Counter:
    return Counter(model)


def _runs(column, most: int = 2_000_000):
    """Texts of an Arrow column in runs of about ``most`` characters."""
    run, size = [], 0
    for x in column:
        run.append(x.as_py())
        size += len(run[-1] or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row. The model's file is read on the driver and sent with the task; it is of fixed size."""
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches):
        c = counter(model)
        for b in batches:
            n = []
            for texts in _runs(b.column(2)):
                n += c.counts(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
