"""What stands outside: search, fetching, models, plots. Interfaces with offline, deterministic defaults.

A service is an object that tasks carry; it is called on batches within ``mapInPandas`` or a Python data source, and its errors
become rows. Nothing here opens a connection by itself.
"""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Embedder(Protocol):
    def encode(self, texts: Sequence[str]) -> list[list[float]]: ...


class Labeler(Protocol):
    """Answers a packet with an object or with text that holds one. ``label_more``, where there is one, is asked again
    with more room if the first answer holds no object (it was cut off)."""

    def label(self, packet: str) -> dict | str: ...


class Fetcher(Protocol):
    def fetch(self, key: str) -> bytes: ...


class HashingEmbedder:
    """Signed feature hashing of words, at length 1: the offline default."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts):
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.size] += 1.0 if h >> 16 & 1 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


def embed(df: DataFrame, text: str, embedder: Embedder | None = None, batch: int = 64, out: str = "embedding") -> DataFrame:
    """Adds a vector column; the model is loaded once per task (ML-01)."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    model = embedder or HashingEmbedder()

    def run(frames):
        for pdf in frames:
            vectors = []
            for at in range(0, len(pdf), batch):
                vectors += model.encode(pdf[text].iloc[at : at + batch].tolist())
            yield pdf.assign(**{out: vectors})

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField(out, ArrayType(FloatType()))]))


@dataclass(frozen=True)
class Pace:
    """Times at which tasks may send requests, agreed on without talking to each other (SRC-18).

    Requests have numbered slots, ``rate`` in a second; after every ``batch`` slots comes a break of ``pause`` seconds and up to
    ``jitter`` more, drawn from ``seed`` and the batch's number. A slot's time follows from its number alone. Slot ``s`` belongs to
    lane ``s`` modulo ``lanes``, and a lane is run by one task, so no slot is used twice. A slot that has begun is used within half of
    its length or not at all: late tasks lose slots and never catch up. Any ``w`` seconds hold at most ``w * rate + 2`` requests.

    Lanes that wait for a free core leave their slots unused, so ``lanes`` should be no more than the cores. Clocks of executors must
    agree to within half a slot. A second attempt of a task that still runs would share its slots: leave speculation off.
    """

    rate: float = 3.0
    lanes: int = 4
    batch: int = 25
    pause: float = 10.0
    jitter: float = 2.0
    seed: int = 42
    start: float = field(default_factory=time.time)

    def __post_init__(self):
        if self.rate <= 0 or self.lanes < 1 or self.batch < 1 or self.pause < 0 or self.jitter < 0:
            raise ValueError("rate, lanes and batch must be positive, pause and jitter not negative")

    def at(self, slot: int) -> float:
        """The time of a slot. Breaks last from ``pause`` to ``pause + jitter``."""
        b = slot // self.batch
        return self.start + slot / self.rate + b * (self.pause + self.jitter / 2) + self.jitter / 2 * random.Random(f"{self.seed}:{b}").random()

    def next_slot(self, lane: int, now: float) -> int:
        """The lane's first slot that has not begun at ``now``."""
        each = self.batch / self.rate + self.pause + self.jitter / 2
        slot = max(0, int((now - self.start) / each) - 1) * self.batch
        slot += (lane - slot) % self.lanes
        while self.at(slot) < now:
            slot += self.lanes
        return slot

    def wait(self, lane: int, earliest: float = 0.0) -> float:
        """Sleep until a slot of the lane, not before ``earliest``; returns when it began."""
        while True:
            begin = self.at(self.next_slot(lane, max(earliest, time.time())))
            time.sleep(max(0.0, begin - time.time()))
            if time.time() - begin < 0.5 / self.rate:
                return begin


def _lanes(keys: DataFrame, key: str, pace: Pace | None) -> DataFrame:
    """(key, lane): with a pace, every lane in a partition of its own."""
    if pace is None:
        return keys.select(F.col(key).alias("key"), F.lit(0).alias("lane"))
    dealt = keys.select(F.col(key).alias("key"), F.pmod(F.xxhash64(F.col(key)), F.lit(pace.lanes)).cast("int").alias("lane"))
    return dealt.repartitionById(pace.lanes, "lane")


def _tried(fetcher: Fetcher, key: str, lane: int, tries: int, pause: float, most_pause: float, pace: Pace | None) -> tuple[bytes | None, str | None]:
    """(content, None) or (None, the last error). Every try takes a slot; a pause that the service asks for is kept."""
    wait, earliest, error = pause, 0.0, None
    for n in range(tries):
        if pace is not None:
            pace.wait(lane, earliest)
        elif n:
            time.sleep(max(0.0, earliest - time.time()))
        try:
            return fetcher.fetch(key), None
        except RetryLater as e:
            error, earliest = f"{type(e).__name__}: {e}", time.time() + min(most_pause, e.seconds)
        except Exception as e:
            error, earliest = f"{type(e).__name__}: {e}", time.time() + min(most_pause, wait * (1 + 0.1 * random.random()))
            wait *= 1.7
    return None, error


def fetch_all(keys: DataFrame, key: str, fetcher: Fetcher, tries: int = 10, pause: float = 0.0, most_pause: float = 10.0, pace: Pace | None = None) -> DataFrame:
    """(key, status, content, error): retries with growing pauses, at a pace if one is given; an error is a row (SRC-17, SRC-18)."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for k, lane in zip(pdf["key"], pdf["lane"]):
                content, error = _tried(fetcher, k, lane, tries, pause, most_pause, pace)
                # a frame for each document: contents don't pile up
                yield pd.DataFrame([(k, "ok" if error is None else "error", content, error)], columns=["key", "status", "content", "error"])

    return _lanes(keys, key, pace).mapInPandas(run, "key string, status string, content binary, error string")


class PagedSearch(DataSource):
    """A search service as a source: one partition per page (SRC-15, SRC-16). Register with ``paged_search``."""

    search: Callable[[str, int, int], list[str]] | None = None
    count: Callable[[str], int] | None = None

    @classmethod
    def name(cls):
        return "paged_search"

    def schema(self):
        return "uid string, page int"

    def reader(self, schema):
        return _PagedReader(self.options, type(self).search, type(self).count)


class _PagedReader(DataSourceReader):
    def __init__(self, options, search, count):
        self.term, self.size = options.get("term", ""), int(options.get("pagesize", "5000"))
        self.search, self.n = search, count(options.get("term", "")) if count else 0

    def partitions(self):
        return [InputPartition(i) for i in range(-(-self.n // self.size))] or [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        for uid in self.search(self.term, partition.value * self.size, self.size) if self.search else []:
            yield uid, partition.value


def paged_search(spark: SparkSession, term: str, search, count, page_size: int = 5000) -> DataFrame:
    kind = type("PagedSearchNow", (PagedSearch,), {"search": staticmethod(search), "count": staticmethod(count)})
    spark.dataSource.register(kind)
    return spark.read.format("paged_search").option("term", term).option("pagesize", str(page_size)).load()


def rule_labels(df: DataFrame, text: str, rules: dict[str, Sequence[str]], default: str = "not_reported") -> DataFrame:
    """Rule-based labels (the offline labeller): for each field, present where any of its words occurs."""
    from ..functions.text import contains_any

    return df.select("*", *(F.when(contains_any(F.col(text), words), "present").otherwise(default).alias(f"tag__{name}__status") for name, words in rules.items()))


def reply_text(reply: dict) -> str:
    """Text of a model's reply in any of three shapes (SRC-20): output_text, output with pieces, choices with a message."""
    if isinstance(reply.get("output_text"), str):
        return reply["output_text"]
    pieces = []
    for item in reply.get("output") or []:
        for part in [item, *(item.get("content") or [])] if isinstance(item, dict) else []:
            if isinstance(part, dict) and isinstance(part.get("text"), str):
                pieces.append(part["text"])
    if pieces:
        return "\n".join(pieces)
    for choice in (reply.get("choices") or [])[:1]:
        if isinstance((choice.get("message") or {}).get("content"), str):
            return choice["message"]["content"]
    raise ValueError("the reply holds no text")


class Refused(Exception):
    """A service refuses a setting of the request."""


class RetryLater(Exception):
    """A service asks for a pause, in seconds."""

    def __init__(self, seconds: float):
        super().__init__(f"retry after {seconds} s")
        self.seconds = seconds


class ModelLabeler:
    """A labeller over ``post(request) -> reply`` (SRC-20): tries again after errors, and with the next effort of the list where one is refused."""

    def __init__(self, post: Callable[[dict], dict], request: dict | None = None, efforts: Sequence[str | None] = ("high", "medium", "low", None), tokens: tuple[int, int] = (2000, 4000), tries: int = 3, pause: float = 0.0):
        self.post, self.request, self.efforts, self.tokens, self.tries, self.pause = post, request or {}, efforts, tokens, tries, pause

    def _ask(self, packet: str, tokens: int) -> str:
        error: Exception = ValueError("no effort is left")
        for effort in self.efforts:
            asked = self.request | {"input": packet, "max_output_tokens": tokens} | ({"effort": effort} if effort else {})
            for k in range(self.tries):
                try:
                    reply = self.post(asked)
                    if reply.get("status") not in (None, "completed", "incomplete"):
                        raise RuntimeError(f"status {reply['status']}")
                    return reply_text(reply)
                except Refused as e:
                    error = e
                    break
                except Exception as e:
                    error = e
                    time.sleep(self.pause * 1.7**k)
            else:
                raise error
        raise error

    def label(self, packet: str) -> str:
        return self._ask(packet, self.tokens[0])

    def label_more(self, packet: str) -> str:
        return self._ask(packet, self.tokens[1])


def object_in(text: str) -> dict:
    """The JSON object between the first { and the last } of a model's text (JSN-03)."""
    import json

    got = json.loads(text[text.index("{") : text.rindex("}") + 1])
    if not isinstance(got, dict):
        raise ValueError("no object")
    return got


def ask(model: Labeler, packet: str) -> dict:
    """One label: an answer without an object is asked for again with more room (JSN-10)."""
    answer = model.label(packet)
    if isinstance(answer, dict):
        return answer
    try:
        return object_in(answer)
    except ValueError:
        if not hasattr(model, "label_more"):
            raise
        again = model.label_more(packet)
        return again if isinstance(again, dict) else object_in(again)


def is_weak(label: dict) -> bool:
    """Low confidence, or flagged for a look at the full text."""
    return label.get("label_confidence") == "low" or bool(label.get("needs_fulltext_review"))


class RuleLabeler:
    """The dry run's labeller: an excluded case of low confidence that names the packet's ids."""

    def label(self, packet: str) -> dict:
        return {"ftld_inclusion_tier": "exclude", "label_confidence": "low", "needs_fulltext_review": False, "symptom_tags": [], "notes": "dry run"}


def label_with_escalation(df: DataFrame, text: str, first: Labeler, second: Labeler | None = None, key: str = "case_id") -> DataFrame:
    """(key, label as JSON, error, escalated): a weak label goes to the second model, if that is another one (JSN-10).

    Every model is asked at most once for a case (twice where an answer is cut off): both passes run in one task. Errors are rows.
    """
    import json

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for k, t in zip(pdf[key], pdf[text]):
                escalated = False
                try:
                    label = ask(first, t or "")
                    if second is not None and second is not first and is_weak(label):
                        escalated = True
                        label = ask(second, t or "")
                    rows.append((k, json.dumps(label), None, escalated))
                except Exception as e:
                    rows.append((k, None, f"{type(e).__name__}: {e}", escalated))
            yield pd.DataFrame(rows, columns=[key, "label", "error", "escalated"])

    return df.select(F.col(key).cast("string"), text).mapInPandas(run, f"{key} string, label string, error string, escalated boolean")


# ---- files and records ----


def fetch_files(keys: DataFrame, key: str, fetcher: Fetcher, folder: str, ending: str = ".xml", overwrite: bool = False, tries: int = 10, pause: float = 0.0, most_pause: float = 10.0, pace: Pace | None = None) -> DataFrame:
    """(key, status, path, bytes, error): documents as files in a folder that all tasks share, a path or the address of an
    object store (SRC-17, SRC-18).

    A file that is there is left alone (skipped) and takes no slot of the pace. A new one appears when it is whole: an object
    store shows it when it is closed, elsewhere it is written under another name and moved.
    """

    def run(frames):
        import uuid

        import pandas as pd
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        if store.type_name in ("local", "hdfs"):
            store.create_dir(root, recursive=True)

        def write(path, content):
            part = f"{path}.{uuid.uuid4().hex}.part" if store.type_name in ("local", "hdfs") else path
            with store.open_output_stream(part) as f:
                f.write(content)
            if part != path:
                store.move(part, path)

        def one(k, lane):
            shown, path = f"{folder}/{k}{ending}", f"{root}/{k}{ending}"
            there = store.get_file_info(path)
            if there.type == fs.FileType.File and not overwrite:
                return k, "skipped", shown, there.size, None
            content, error = _tried(fetcher, k, lane, tries, pause, most_pause, pace)
            if error is None:
                try:
                    write(path, content)
                    return k, "ok", shown, len(content), None
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
            return k, "error", shown, None, error

        for pdf in frames:
            rows = [one(k, lane) for k, lane in zip(pdf["key"], pdf["lane"])]
            yield pd.DataFrame(rows, columns=["key", "status", "path", "bytes", "error"]).astype({"bytes": "Int64"})

    return _lanes(keys, key, pace).mapInPandas(run, "key string, status string, path string, bytes long, error string")


def registry_rows(found: DataFrame, summarise: Callable[[list[str]], dict[str, dict]], query_id: str, term: str, total: int, batch: int = 200) -> DataFrame:
    """Registry rows of found ids (SRC-16): summaries in batches; an id without a summary is left out.

    A summary has articleids (idtype, value), pubdate, title, source, fulljournalname, authors (name) and pmclivedate.
    """
    from ..functions import text as S
    from .tables import REGISTRY, registry_urls

    ids = "array<struct<idtype:string,value:string>>"

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows, uids = [], [str(u) for u in pdf["uid"]]
            for at in range(0, len(uids), batch):
                got = summarise(uids[at : at + batch])
                for u in uids[at : at + batch]:
                    r = got.get(u)
                    if isinstance(r, dict):
                        author = next((a.get("name") for a in r.get("authors") or []), None)
                        rows.append((u, [(i.get("idtype"), i.get("value")) for i in r.get("articleids") or []], r.get("pubdate"), r.get("title"), r.get("source"), r.get("fulljournalname"), author, r.get("pmclivedate")))
            yield pd.DataFrame(rows, columns=["uid", "ids", "pubdate", "title", "journal_abbrev", "journal_full", "first_author", "pmclivedate"])

    got = found.select("uid").mapInPandas(run, f"uid string, ids {ids}, pubdate string, title string, journal_abbrev string, journal_full string, first_author string, pmclivedate string")
    named = got.select("*", *(S.id_value(F.col("ids"), k).alias(k) for k in ("pmcid", "pmid", "doi")), S.year_of(F.col("pubdate")).cast("string").alias("year"))
    full = registry_urls(named).select("*", F.lit(query_id).alias("query_id"), F.lit(" ".join(term.split())).alias("query_term"), F.lit(str(total)).alias("ncbi_total_count"))
    return full.select(*REGISTRY.fieldNames())


def resolve_doi(doi: str, search: Callable[[str], list[str]]) -> str:
    """The one record of a DOI (SRC-19): none or several are an error."""
    found = list(dict.fromkeys(search(f"{doi.strip()}[doi]")))
    if len(found) != 1:
        raise LookupError(f"{doi} has {len(found)} records")
    return found[0]


def article_records(data: bytes) -> list[dict]:
    """Reference fields of a set of article records in XML (SRC-19)."""
    import re
    import xml.etree.ElementTree as ET

    def text(e, path):
        x = e.find(path)
        return re.sub(r"\s+", " ", "".join(x.itertext())).strip() or None if x is not None else None

    out = []
    for a in ET.fromstring(data).iter("PubmedArticle"):
        authors = [{"last_name": text(p, "LastName"), "initials": text(p, "Initials"), "collective_name": text(p, "CollectiveName")} for p in a.iterfind(".//AuthorList/Author")]
        year = text(a, ".//JournalIssue/PubDate/Year") or (re.search(r"(19|20)[0-9]{2}", text(a, ".//JournalIssue/PubDate/MedlineDate") or "") or [None])[0]
        doi = next((i.text.strip() for i in a.iterfind(".//ArticleIdList/ArticleId") if i.get("IdType") == "doi" and i.text), None)
        out.append({"pmid": text(a, ".//MedlineCitation/PMID"), "title": text(a, ".//ArticleTitle"), "journal_abbrev": text(a, ".//Journal/ISOAbbreviation"), "year": year, "volume": text(a, ".//JournalIssue/Volume"), "issue": text(a, ".//JournalIssue/Issue"), "pages": text(a, ".//Pagination/MedlinePgn"), "doi": doi, "authors": authors})
    return out
