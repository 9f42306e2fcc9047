"""Marked-up documents: files to ordered paragraph blocks, routing, previews, segments.

Parsing is the one step that needs Python: a mixed-content tree has no relational form. It is a table function over Spark's binary source, which
packs files into tasks by their size; it reads a file event by event, and a file that fails becomes a row with its error.
"""

from __future__ import annotations

import hashlib
import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as S
from ..operators import relational as R

SKIPPED = {"fig", "table-wrap", "ref-list", "ack", "notes", "supplementary-material"}
PARSED = "path string, pmcid string, status string, error string, article_type string, title string, has_body boolean, source string, block_index int, block_id string, sec_path array<string>, sec_path_str string, text string, n_chars long"


def _tag(e) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _flat(e) -> str:
    return re.sub(r"\s+", " ", " ".join(e.itertext())).strip()


def _child(e, name: str):
    return next((x for x in e if _tag(x) == name), None)


class _Reader:
    """Events of one document, with elements let go as soon as they end: memory holds the open elements and one paragraph.

    Knows, at every event, the first article, its first abstract and body, and whether the place is under something that is skipped.
    """

    KEPT = {"p", "title", "label", "article-title"}

    def __init__(self, data: bytes):
        self.data = data

    def __iter__(self):
        """(event, tag, element, region) of the first article; regions are ``abstract`` and ``body``, "" elsewhere and None where skipped."""
        stack, article, region, seen, skip, kept = [], None, [""], set(), 0, 0
        for event, e in ET.iterparse(io.BytesIO(self.data), ("start", "end")):
            tag = _tag(e)
            if event == "start":
                stack.append(e)
                if article is None and tag == "article":
                    article = e
                if article is not None and article is not e:
                    if tag in ("abstract", "body") and tag not in seen and article in stack:
                        seen.add(tag)
                        region.append(tag)
                    skip += tag in SKIPPED and len(region) > 1
                kept += tag in self.KEPT
                if article is not None and article in stack:
                    yield event, tag, e, None if skip else region[-1]
            else:
                inside = article is not None and article in stack
                if inside:
                    yield event, tag, e, None if skip else region[-1]
                kept -= tag in self.KEPT
                stack.pop()
                if inside and article is not e:
                    skip -= tag in SKIPPED and len(region) > 1
                    if len(region) > 1 and tag == region[-1] and not any(_tag(x) == tag for x in stack):
                        region.pop()
                if not kept and stack:
                    stack[-1].remove(e)


def _facts(data: bytes) -> tuple[dict, list[list[str]]]:
    """Facts of a document, and by section in their order the parts of its name; raises on a file that isn't whole."""
    facts, names, open_, title = None, [], [], None
    for event, tag, e, region in _Reader(data):
        if event == "start":
            facts = facts or {"article_type": e.get("article-type"), "title": None, "has_body": False}
            facts["has_body"] |= tag == "body"
            if tag == "article-title" and title is None:
                title = e
            if tag == "sec":
                names.append(["", ""])
            open_.append((e, len(names) - 1 if tag == "sec" else None))
        else:
            open_.pop()
            if e is title:
                facts["title"] = _flat(e)
            above = open_[-1][1] if open_ else None
            if tag in ("label", "title") and above is not None and not names[above][tag == "title"]:
                names[above][tag == "title"] = _flat(e) or " "
    if facts is None:
        raise ValueError("no article element")
    return facts, [[x for x in map(str.strip, n) if x] for n in names]


def _paragraphs(data: bytes, source: str, names: list[list[str]]):
    """(path, text) of every paragraph of the abstract or the body, as they end."""
    n, path, within = 0, [], 0
    for event, tag, e, region in _Reader(data):
        mine = region == source
        if event == "start":
            if tag == "sec":
                n += 1
                path.append(" ".join(names[n - 1]) if mine and not within else None)
            within += tag == "p"
        else:
            within -= tag == "p"
            if tag == "sec":
                path.pop()
            elif tag == "p" and mine and not within:
                text = _flat(e)
                if text:
                    yield [x for x in path if x], text


def stream_document(data: bytes, pmcid: str):
    """Blocks of one document, one after the other, each with the document's facts: the first article, also inside a wrapper; abstract first,
    then body (DOC-01 to DOC-05). The first pass reads to the end, so a broken file gives no block."""
    facts, names = _facts(data)
    index = 0
    for source in ("abstract", "body"):
        for path, text in _paragraphs(data, source, names):
            joined = " > ".join(path)
            digest = hashlib.sha1("\n".join((pmcid, source, joined, text)).encode()).hexdigest()[:16]
            yield facts | {"source": source, "block_index": index, "block_id": f"{pmcid}__{source}__{digest}", "sec_path": path, "sec_path_str": joined, "text": text, "n_chars": len(text)}
            index += 1
    if not index:
        yield facts


def parse_document(data: bytes, pmcid: str) -> tuple[dict, list[dict]]:
    """(facts, blocks) of one document, at once."""
    rows = list(stream_document(data, pmcid))
    facts = {k: rows[0][k] for k in ("article_type", "title", "has_body")}
    return facts, [{k: v for k, v in r.items() if k not in facts} for r in rows if "block_id" in r]


class ParseBlocks:
    """The table function ``parse_blocks(path, content)``: a row for each block; a document without blocks, or that can't be read, is one row."""

    def eval(self, path: str, content: bytes):
        pmcid = _name_of(path)
        columns = [c.split(" ")[0] for c in BLOCKS.split(", ")]
        row = lambda **r: tuple(({"pmcid": pmcid, "status": "ok"} | r).get(c) for c in columns)
        try:
            for r in stream_document(bytes(content or b""), pmcid):
                yield row(**r)
        except Exception as e:  # a bad file is a row, never the end of the job
            yield row(status="error", error=f"{type(e).__name__}: {e}")


BLOCKS = PARSED.removeprefix("path string, ")
parse_blocks = F.udtf(ParseBlocks, returnType=BLOCKS)


def register(spark: SparkSession) -> None:
    """Makes ``parse_blocks`` known to SQL: SELECT b.* FROM files, LATERAL parse_blocks(path, content) b."""
    spark.udtf.register("parse_blocks", parse_blocks)


def _name_of(path: str) -> str:
    folder = re.search(r"/pmcid=([^/]+)/", path)
    return folder[1] if folder else re.sub(r"\.[A-Za-z]+$", "", path.rpartition("/")[2])


def parse_files(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """One row per block; files without blocks or with errors are one row each (SRC-07, SRC-08, DOC-06)."""
    return parse_contents(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path))


def _parsed(files: DataFrame) -> DataFrame:
    return files.select("path", "content").lateralJoin(parse_blocks(F.col("path").outer(), F.col("content").outer())).select(*(c.split(" ")[0] for c in PARSED.split(", ")))


def parse_contents(files: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """As parse_files, from rows of (path, content). Documents whose id is among ``done`` (pmcid) aren't parsed again: one row with status skipped."""
    if done is None:
        return _parsed(files)
    named = files.select("path", "content", pmcid_of(F.col("path")).alias("pmcid"))
    known = done.select("pmcid").distinct()
    new = _parsed(named.join(known, "pmcid", "left_anti"))
    old = named.join(known, "pmcid", "left_semi").select("path", "pmcid", F.lit("skipped").alias("status"))
    return new.unionByName(old, allowMissingColumns=True)


def pmcid_of(path):
    """Id of a document: the folder ``pmcid=...`` where it lies in one, else its file name without the ending."""
    return F.coalesce(F.nullif(F.regexp_extract(path, "/pmcid=([^/]+)/", 1), F.lit("")), F.regexp_replace(F.substring_index(path, "/", -1), r"\.[A-Za-z]+$", ""))


def parse_log(parsed: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("source") == s)
    return parsed.groupBy("pmcid", "status", "path", "article_type", "has_body", "error").agg(F.count("block_id").alias("n_blocks_total"), n("body").alias("n_blocks_body"), n("abstract").alias("n_blocks_abstract"))


def routed_sections(blocks: DataFrame, most_must: int = 20, most_candidates: int = 40) -> DataFrame:
    """Body sections with route, size and order; caps by size (AGG-03, STR-07, TOP-04)."""
    sections = blocks.where(F.col("source") == "body").groupBy("pmcid", "sec_path_str").agg(F.sum("n_chars").alias("n_chars"), F.count("*").alias("n_blocks")).withColumn("route", S.route_section(F.col("sec_path_str"))).where("route IS NOT NULL")
    order = [F.desc("n_chars"), "sec_path_str"]
    must = R.first_rows(sections.where("route = 'must'"), ["pmcid"], order, most_must)
    return must.unionByName(R.first_rows(sections.where("route = 'candidate'"), ["pmcid"], order, most_candidates))


def section_previews(blocks: DataFrame, key: Sequence[str] = ("pmcid", "sec_path_str"), order: str = "block_index", n: int = 2, most: int = 450) -> DataFrame:
    """First blocks of each section joined and cut, with counts (DOC-07)."""
    size = blocks.groupBy(*key).agg(F.sum("n_chars").alias("n_chars"), F.count("*").alias("n_blocks"))
    head = R.ordered_text(R.first_rows(blocks, key, [order], n), key, order, "text", " ")
    return head.join(size, list(key)).withColumn("preview", F.left("text", F.lit(most))).drop("text")


def select_blocks(blocks: DataFrame, sections: DataFrame, most_blocks: int = 140, most_chars: int = 60_000) -> DataFrame:
    """Abstract and routed blocks in order within the caps (WIN-02)."""
    keep = blocks.join(sections.select("pmcid", "sec_path_str"), ["pmcid", "sec_path_str"], "left_semi").unionByName(blocks.where(F.col("source") == "abstract"))
    return R.prefix_cap(keep.dropDuplicates(["block_id"]), ["pmcid"], ["block_index", "block_id"], "n_chars", most_blocks, most_chars)


def extra_snippets(blocks: DataFrame, chosen: DataFrame, key: str = "pmcid", most: int = 8) -> DataFrame:
    """Blocks with a diagnostic trigger outside the chosen ones: abstract first, shortest, earliest (TOP-03)."""
    hits = blocks.where(S.diagnosis_trigger(F.col("text"))).join(chosen.select("block_id"), "block_id", "left_anti")
    return R.first_rows(hits, [key], [F.when(F.col("source") == "abstract", 0).otherwise(1), "n_chars", "block_index", "block_id"], most)


def section_order(sections: DataFrame) -> list:
    """Columns that order selected sections: their place where they have one, else must before candidate, the longest first."""
    if "place" in sections.columns:
        return ["place", "sec_path_str"]
    return [F.when(F.col("route") == "must", 0).otherwise(1), F.desc("n_chars"), "sec_path_str"] if {"route", "n_chars"} <= set(sections.columns) else ["sec_path_str"]


def guardrail(blocks: DataFrame, sections: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(pmcid, passed, markers) of every document: the first selected strict section with a narrative anchor (STR-09).

    ``documents`` (pmcid) adds those that have neither blocks nor sections.
    """
    order = section_order(sections)
    placed = sections.withColumn("_place", F.row_number().over(W.partitionBy("pmcid").orderBy(*order))).select("pmcid", "sec_path_str", "_place")
    strict = placed.where(S.strict_section(F.col("sec_path_str")))
    body = blocks.where(F.col("source") == "body")
    text = R.ordered_text(body.join(strict, ["pmcid", "sec_path_str"]), ["pmcid", "sec_path_str", "_place"], "block_index", "text", " ")
    hit = text.withColumn("names", S.narrative_anchors(F.col("text"))).where(F.size("names") > 0)
    marked = hit.select("pmcid", F.transform("names", lambda n: F.concat(n, F.lit("@"), F.col("sec_path_str"))).alias("found"), "_place")
    first = R.first_per_key(marked, ["pmcid"], ["_place"]).select("pmcid", "found")
    chosen = sections.groupBy("pmcid").agg(F.lit(True).alias("_chosen"))
    have = blocks.groupBy("pmcid").agg(F.bool_or(F.col("source") == "body").alias("_body"))
    every = chosen.select("pmcid").union(have.select("pmcid"))
    every = (every if documents is None else every.union(documents.select("pmcid"))).distinct()
    why = F.when(F.col("_chosen").isNull(), "no_selected_sections").when(F.col("_body").isNull(), "no_blocks").when(~F.col("_body"), "no_body_blocks").otherwise("no_narrative_anchor")
    return every.join(first, "pmcid", "left").join(chosen, "pmcid", "left").join(have, "pmcid", "left").select("pmcid", F.col("found").isNotNull().alias("passed"), F.coalesce("found", F.array(why)).alias("markers"))


def final_sections(must, selected, allowed, most: int = 12):
    """must, then the model's choice among the allowed (DOC-08)."""
    return F.slice(F.array_union(must, F.array_intersect(selected, allowed)), 1, most)


def segments(blocks: DataFrame, lists: DataFrame, terms: Sequence[str], by: str = " ") -> DataFrame:
    """Segment rows from lists of block ids (pmcid, case_id, segment_type, block_ids): texts raw and clean, counts, leakage (DOC-10, HSH-02)."""
    unknown = lists.select(F.explode("block_ids").alias("block_id")).join(blocks.select("block_id"), "block_id", "left_anti")
    if not unknown.isEmpty():
        raise ValueError("segments name unknown blocks")
    e = lists.select("pmcid", "case_id", "segment_type", F.posexplode("block_ids").alias("_p", "block_id"))
    j = e.join(blocks.select("block_id", "text", "sec_path_str"), "block_id")
    rows = F.array_sort(F.collect_list(F.struct("_p", "block_id", "text", "sec_path_str")))
    g = j.groupBy("pmcid", "case_id", "segment_type").agg(rows.alias("r"))
    pick = lambda f: F.transform("r", lambda x: x[f])
    g = g.select("pmcid", "case_id", "segment_type", pick("block_id").alias("block_ids"), F.array_distinct(pick("sec_path_str")).alias("sec_paths"), F.array_join(pick("text"), "\n").alias("text_raw"))
    g = g.withColumn("text_clean", S.normalize_whitespace(S.redact(F.col("text_raw"), terms, by)))
    uid = S.short_sha1(F.col("pmcid"), F.col("case_id"), F.col("segment_type"), F.array_join("block_ids", "|"))
    return g.select(uid.alias("segment_uid"), "*", F.size("block_ids").alias("n_blocks"), F.length("text_raw").alias("n_chars_raw"), F.length("text_clean").alias("n_chars_clean"), S.leak_count(F.col("text_raw"), terms).alias("leakage_n_matches_raw"), S.leak_count(F.col("text_clean"), terms).alias("leakage_n_matches_clean"))


def case_packets(segments: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Markdown of a case's ordered segments (DOC-12)."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "segment_type", "text_clean")))
    md = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("## "), r["segment_type"], F.lit("\n\n"), r["text_clean"])), "\n\n")
    return segments.groupBy(*key).agg(md.alias("packet"), F.count("*").alias("n_segments"))
