"""WARC archives: write captures, read them back, assemble transactions.

``write_archives`` makes three records of each capture (request, response or revisit, metadata) as text with
Spark's own writer: the line separator is the blank line pair that ends a WARC record, so the files are plain
WARC 1.1 under gzip and land in any file system that Spark writes to. A file is one gzip member and has no
warcinfo record: the writer sees records, not files. Captures are written by size, long ones in files
of few records, so that the bytes of a file follow ``SIZES`` or one capture. ``read_archives`` reads whole files and frames
records by their Content-Length. ``assemble`` brings the records of a capture together through WARC-Concurrent-To,
in one shuffle, and emits one nested row per capture.

A payload of at least ``MIN_REVISIT`` bytes that another capture holds too is written once: the smallest page_id is
the response and the others are revisits of it, which name its url and date. Null payloads are empty. Repeated rows are captures of their
own; those with the smallest page_id are all responses. Line breaks in urls are percent-encoded; a null url leaves its
field out. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C

MIN_REVISIT = 100
#: Repeated payloads up to this number, with urls up to these bytes, are sent to every task; more are joined by shuffle.
MAX_BROADCAST, MAX_BROADCAST_URLS = 200_000, 32_000_000
#: (most bytes of a capture, records per file): 64 MB of text and one capture alone.
SIZES = [(32 << 10, 6_000), (1 << 20, 180), (1 << 63, 3)]
EOL = "\r\n"


def plan_revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload_digest, payload_bytes, refers_to and refers_to_url (null for a response)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    known = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("payload_digest", F.sha2("html", 256)).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    twice = known.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    twice = C.cut(twice)
    n, urls = twice.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("first_url")), F.lit(0))).first()
    small = n <= MAX_BROADCAST and urls <= MAX_BROADCAST_URLS
    long_enough = F.when(F.col("payload_bytes") >= MIN_REVISIT, F.col("payload_digest"))
    first = twice.withColumnRenamed("payload_digest", "_digest")
    # short payloads have no digest to look up; their ids spread them where the join shuffles
    joined = known.join(F.broadcast(first) if small else first, F.coalesce(long_enough, F.col("page_id").cast("string")) == F.col("_digest"), "left")
    again = F.col("page_id") > F.col("first_id")
    return joined.withColumn("refers_to", F.when(again, F.col("first_id"))).withColumn("refers_to_url", F.when(again, F.col("first_url"))).drop("_digest", "first_id", "first_url")


def _record(kind: Column | str, rid: Column, fields: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record as text: named fields (null ones left out), then the block."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    lines = [F.concat(F.lit("WARC-Type: "), lit(kind)), F.concat(F.lit("WARC-Record-ID: "), rid)]
    lines += [F.concat(F.lit(f"{k}: "), lit(v).cast("string")) for k, v in fields]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(EOL, F.lit("WARC/1.1"), *lines), F.lit(EOL * 2), block)


def _urn(kind: str) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("_row")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archives(planned: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of the captures that ``plan_revisits`` has prepared."""
    # the records hold the url six times at most
    size = F.col("payload_bytes") + 6 * F.coalesce(F.octet_length("url"), F.lit(0)) + F.coalesce(F.octet_length("refers_to_url"), F.lit(0))
    kind = F.lit(len(SIZES) - 1)
    for k in reversed(range(len(SIZES) - 1)):
        kind = F.when(size <= SIZES[k][0], k).otherwise(kind)
    # one row per kind of size; the first is written in any case, if only as an empty folder
    for k in sorted({0, *(r.k for r in planned.select(kind.alias("k")).distinct().collect())}):
        # ids are unique over all kinds
        row = F.concat_ws("-", F.lit(k), F.monotonically_increasing_id())
        _write(planned.where(kind == k).withColumn("_row", row), f"{path}/{k}", SIZES[k][1], date)


def _write(p: DataFrame, path: str, records_per_file: int, date: str) -> None:
    line = lambda url: F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    uri = line("url")
    main, revisit = _urn("capture"), F.col("refers_to").isNotNull()
    digest = F.concat(F.lit("sha256:"), F.col("payload_digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(EOL * 2), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    host = F.regexp_extract(F.coalesce(uri, F.lit("")), "^.*?://([^/?#]*)", 1)
    target = F.regexp_extract(F.coalesce(uri, F.lit("")), "^.*?://[^/?#]*(.*)$", 1)
    profile = F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    get = F.concat(F.lit("GET "), F.when(target == "", F.lit("/")).otherwise(target), F.lit(f" HTTP/1.1{EOL}Host: "), host, F.lit(EOL * 2))
    facts = F.concat_ws(EOL, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.concat(F.lit("payload-bytes: "), F.col("payload_bytes").cast("string")), F.concat(F.lit("refers-to-page: "), F.col("refers_to").cast("string")), F.lit(""))
    common = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    records = F.array(
        _record("request", _urn("request"), [*common, ("WARC-Concurrent-To", main), ("Content-Type", "application/http; msgtype=request")], get),
        _record(kind, main, [*common, ("WARC-Profile", profile), ("WARC-Refers-To-Target-URI", line("refers_to_url")), ("WARC-Refers-To-Date", F.when(revisit, F.lit(date))), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")], http),
        _record("metadata", _urn("metadata"), [*common, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], facts),
    )
    p.select(F.explode(records).alias("value")).write.option("lineSep", EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


RECORD = "record_type string, record_id string, concurrent_to string, target_uri string, date string, payload_digest string, fields map<string,string>, payload binary"


def parse_archive(data: bytes):
    """Records of one archive, plain or gzip, one by one: (fields, block)."""
    f = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8").rstrip("\r\n").partition(":")
            fields[k.lower()] = v.strip()
        block = f.read(int(fields.get("content-length", 0)))
        if len(block) != int(fields.get("content-length", 0)):
            raise ValueError("a record is cut short")
        yield fields, block


def _parse(batches):
    names = ["record_type", "record_id", "concurrent_to", "target_uri", "date", "payload_digest", "fields", "payload"]
    kinds = [pa.string()] * 6 + [pa.map_(pa.string(), pa.string()), pa.binary()]
    for b in batches:
        for content in b.column(0):
            rows, size = [], 0
            for f, block in parse_archive(content.as_buffer().to_pybytes()):
                kind, own = f.get("warc-type"), {}
                if kind == "metadata":
                    own = dict(x.split(": ", 1) for x in block.decode("utf-8").split(EOL) if ": " in x)
                payload = block
                if kind in ("response", "revisit", "request"):
                    payload = block.partition(b"\r\n\r\n")[2]
                rows.append((kind, f.get("warc-record-id"), f.get("warc-concurrent-to"), f.get("warc-target-uri"), f.get("warc-date"), f.get("warc-payload-digest"), list(own.items()), payload))
                size += len(payload)
                if size > 8_000_000 or len(rows) == 4_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(_parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, request, response, metadata); a part that is missing is null.

    Requests and metadata name the capture in concurrent_to, the response is the capture itself.
    """
    rest = [c for c in records.columns if c not in ("record_type", "concurrent_to")]
    key = F.coalesce("concurrent_to", "record_id").alias("capture_id")
    part = lambda *kinds: F.first(F.when(F.col("record_type").isin(*kinds), F.col("r")), ignorenulls=True)
    slim = records.select(key, "record_type", F.struct("record_type", *rest).alias("r"))
    return slim.groupBy("capture_id").agg(part("request").alias("request"), part("response", "revisit").alias("response"), part("metadata").alias("metadata"))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives in the shared folder, reads them back and reports every capture."""
    spark = pages.sparkSession
    path = f"{C.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(plan_revisits(pages), path)
    # digest and size come from the bytes that were read back; payloads are left behind before the shuffle
    records = read_archives(spark, path).withColumn("sha256", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long")).drop("payload")
    r, m = F.col("response"), F.col("metadata.fields")
    whole = r["record_type"] == "response"
    return assemble(records).select(
        F.try_element_at(m, F.lit("page-id")).cast(pages.schema["page_id"].dataType).alias("page_id"),
        F.when(whole, r["size"]).otherwise(F.try_element_at(m, F.lit("payload-bytes")).cast("long")).alias("payload_bytes"),
        F.when(whole, r["sha256"]).otherwise(F.substring_index(r["payload_digest"], ":", -1)).alias("payload_digest"),
        r["record_type"].alias("record_type"),
        F.try_element_at(m, F.lit("refers-to-page")).cast(pages.schema["page_id"].dataType).alias("refers_to"),
        F.col("request.target_uri").alias("target_uri"),
        (~whole | (F.concat(F.lit("sha256:"), r["sha256"]) == r["payload_digest"])).alias("digest_ok"),
    )
