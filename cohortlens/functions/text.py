"""Text, hash, number and JSON functions as Column expressions; all stay in whole-stage code."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import fixed as X

_CI = "(?iuU)"


def normalize_whitespace(c: Column) -> Column:
    """Runs of Unicode white space become one space; ends are trimmed (STR-01)."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column) -> Column:
    return F.lower(normalize_whitespace(c))


def blacklist_pattern(terms: Sequence[str]) -> str | None:
    """One whole-word, case-insensitive, Unicode pattern in list order; None where no term is left (STR-03)."""
    kept = [t.strip() for t in terms if t and t.strip()]
    return "(?iuU)\\b(" + "|".join(re.sub(r"([\\\[\](){}.*+?^$|#&~\-])", r"\\\1", t) for t in kept) + ")\\b" if kept else None


def redact(c: Column, terms: Sequence[str], by: str = "[REDACTED]") -> Column:
    p = blacklist_pattern(terms)
    return F.regexp_replace(c, p, by.replace("\\", "\\\\").replace("$", "\\$")) if p else c


def leak_count(c: Column, terms: Sequence[str]) -> Column:
    p = blacklist_pattern(terms)
    return F.coalesce(F.regexp_count(c, F.lit(p)), F.lit(0)) if p else F.lit(0)


def leak_matches(c: Column, terms: Sequence[str]) -> Column:
    """Lower-cased matches in order of occurrence (STR-05)."""
    p = blacklist_pattern(terms)
    found = F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(1)), F.lower) if p else F.array().cast("array<string>")
    return F.coalesce(found, F.array().cast("array<string>"))


def text_for_embedding(c: Column) -> Column:
    return normalize_whitespace(F.replace(normalize_text(c), F.lit("[redacted]"), F.lit(" ")))


def route_section(path: Column) -> Column:
    """'must' before exclusion before 'candidate'; null where the path is empty or excluded (STR-07)."""
    return F.when(F.coalesce(path, F.lit("")) == "", None).when(path.rlike(_CI + X.MUST_SECTION), "must").when(path.rlike(_CI + X.EXCLUDE_SECTION), None).when(path.rlike(_CI + X.CANDIDATE_SECTION), "candidate")


def diagnosis_trigger(c: Column) -> Column:
    return F.coalesce(c.rlike(_CI + X.DIAGNOSIS_TRIGGER), F.lit(False))


def strict_section(path: Column) -> Column:
    return F.coalesce(path.rlike(_CI + X.STRICT_SECTION), F.lit(False))


def narrative_anchors(text: Column, most: int = 12_000) -> Column:
    """Names of the narrative anchors that a section's first characters hold (STR-09)."""
    head = F.left(text, F.lit(most))
    return F.filter(F.array(*(F.when(head.rlike(_CI + p), F.lit(n)) for n, p in X.ANCHORS)), lambda x: x.isNotNull())


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Case-insensitive substring of any word (PRJ-02, STR-10)."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower(c).contains(w.lower())
    return F.coalesce(hit, F.lit(False))


def year_of(c: Column) -> Column:
    """First four-digit year of 19xx or 20xx (STR-11)."""
    return F.nullif(F.regexp_extract(c.cast("string"), r"(19|20)\d{2}", 0), F.lit("")).try_cast("int")


def file_name(parts: Sequence[Column], most: int = 120, default: str = "document") -> Column:
    """Safe file name of parts joined by two underscores (STR-12)."""
    joined = F.concat_ws("__", *parts)
    clean = F.btrim(F.regexp_replace(joined, r"[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    cut = F.left(clean, F.lit(most))
    return F.when(F.coalesce(cut, F.lit("")) == "", default).otherwise(cut)


def tag_name(c: Column, default: str = "run") -> Column:
    clean = F.btrim(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]", "_"), F.lit("._"))
    return F.when(F.coalesce(clean, F.lit("")) == "", default).otherwise(clean)


def truncate(c: Column, most: int, marker: str = "…") -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(marker))).otherwise(c)


def pathology(c: Column) -> Column:
    """Spelling of a pathology: tdp43, tau, fus or other (STR-19)."""
    p = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return F.when(p.contains("tdp"), "tdp43").when(p.contains("tau"), "tau").when(p.contains("fus"), "fus").otherwise("other")


def pathologies(c: Column) -> Column:
    return F.array_distinct(F.transform(c, pathology))


def gene(c: Column) -> Column:
    """Upper-cased; the C9ORF72 spellings become one (STR-20)."""
    up = F.upper(F.trim(c))
    return F.when(F.translate(up, "-_", "").isin("C9ORF", "C9ORF72"), "C9ORF72").otherwise(up)


def redact_key(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)(api_key=)[^&\s]+", "$1REDACTED")


def head_metrics(c: Column, most: int = 200_000) -> Column:
    """(article_type, has_body, n_sec_tags) of the head of a document (STR-22)."""
    head = F.left(c, F.lit(most))
    kind = F.nullif(F.regexp_extract(head, r"""<article\b[^>]*\barticle-type=["']([^"']+)["']""", 1), F.lit(""))
    return F.struct(kind.alias("article_type"), head.contains("<body").alias("has_body"), F.regexp_count(head, F.lit(r"<sec\b")).alias("n_sec_tags"))


def tag_of_column(name: str) -> str:
    return name.split("__", 2)[1]


def short_sha1(*parts: Column, sep: str = "\n") -> Column:
    """First 16 hex digits of the SHA-1 of the parts (HSH-01, HSH-02)."""
    return F.substring(F.sha1(F.concat_ws(sep, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 16)


def block_id(doc: Column, source: Column, path: Column, text: Column) -> Column:
    return F.concat_ws("__", doc, source, short_sha1(doc, source, path, text))


def to_number(c: Column) -> Column:
    return c.try_cast("double")


def to_binary(c: Column) -> Column:
    """1 and 0 (also as 1.0, '0'); everything else is null (NUM-02)."""
    x = F.trim(c.cast("string")).try_cast("double")
    return F.when(x.isin(0.0, 1.0), x.cast("int"))


def to_bool(c: Column) -> Column:
    """Words for yes and no; null is false and other text is true (NUM-03)."""
    w = F.lower(F.trim(c.cast("string")))
    return F.when(w.isNull() | w.isin(*X.FALSE_WORDS), False).otherwise(True)


def category(c: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("missing")))


def direction(effect: Column, baseline: Column, eps: float = 0.0) -> Column:
    """enriched, depleted, neutral or unknown (NUM-06)."""
    d = effect - baseline
    return F.when(d.isNull() | F.isnan(d), "unknown").when(d > eps, "enriched").when(d < -eps, "depleted").otherwise("neutral")


def tag_present(status: Column) -> Column:
    return (F.coalesce(status, F.lit("")) == "present").cast("int")


def run_slug(at: Column | None = None) -> Column:
    """Time in UTC, whatever the session's zone (DAT-01)."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp() if at is None else at, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")


def error_type(c: Column) -> Column:
    """What stands before the first colon of an error (AGG-27)."""
    return F.substring_index(c, ":", 1)


def number_text(c: Column, digits: int = 3) -> Column:
    """A number with fixed digits, or n/a (STR-23)."""
    return F.when(c.isNull() | F.isnan(c.cast("double")), "n/a").otherwise(F.format_string(f"%.{digits}f", c.cast("double")))


def percent_text(c: Column, digits: int = 1) -> Column:
    return F.when(c.isNull() | F.isnan(c.cast("double")), "n/a").otherwise(F.format_string(f"%.{digits}f%%", c.cast("double") * 100))


def json_list(c: Column) -> Column:
    """Strings of a JSON list without blanks and nulls; malformed gives an empty list (JSN-01)."""
    got = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    return F.filter(got, lambda x: x.isNotNull() & (F.trim(x) != ""))


def json_object(c: Column) -> Column:
    """The text between the first { and the last } where that parses as an object (JSN-03)."""
    body = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(F.from_json(body, "map<string,string>", {"mode": "PERMISSIVE"}).isNotNull() & (body != ""), body)


def id_value(ids: Column, kind: str) -> Column:
    """Value of an array of (idtype, value) structs, case-insensitive (JSN-09)."""
    return F.try_element_at(F.filter(ids, lambda x: F.lower(x["idtype"]) == kind.lower()), F.lit(1))["value"]


def allowed_only(c: Column, allowed: Sequence[str]) -> Column:
    return F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isin(*allowed)))


def cite_keys(md: Column) -> Column:
    return F.regexp_extract_all(md, F.lit(r"\{\{cite:([A-Za-z0-9_.-]+)\}\}"), F.lit(1))


def expand_pages(c: Column) -> Column:
    """1672-82 becomes 1672-1682 and S112-S5 becomes S112-S115: missing leading digits and a missing prefix are the start's; lists are kept, blank parts go (CIT-05)."""
    span = r"^([A-Za-z]*)([0-9]+)\s*[-–]\s*([A-Za-z]*)([0-9]+)$"

    def one(p: Column) -> Column:
        letters, start, other, end = (F.regexp_extract(p, span, k) for k in range(1, 5))
        full = F.concat(F.left(start, F.greatest(F.length(start) - F.length(end), F.lit(0))), end)
        return F.when(start == "", p).otherwise(F.concat(letters, start, F.lit("-"), F.when(other == "", letters).otherwise(other), full))

    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(F.transform(parts, one), ", ")


def ama_reference(r: dict[str, Column]) -> Column:
    """Reference of authors array<struct<last_name,initials,collective_name>>, title, journal_abbrev, year, volume, issue, pages, doi (CIT-04)."""
    name = lambda a: F.coalesce(F.nullif(F.trim(a["collective_name"]), F.lit("")), F.trim(F.concat_ws(" ", a["last_name"], a["initials"])))
    names = F.transform(r["authors"], name)
    by = F.when(F.size(names) > 6, F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.lit(", et al"))).otherwise(F.array_join(names, ", "))
    blank = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    volume = F.concat(F.coalesce(F.concat(F.lit(";"), blank(r["volume"])), F.lit("")), F.coalesce(F.concat(F.lit("("), blank(r["issue"]), F.lit(")")), F.lit("")))
    pages = F.coalesce(F.concat(F.lit(":"), expand_pages(blank(r["pages"]))), F.lit(""))
    doi = F.coalesce(F.concat(F.lit(" doi:"), blank(r["doi"])), F.lit(""))
    return F.concat(by, F.lit(". "), F.regexp_replace(F.trim(r["title"]), r"\.+$", ""), F.lit(". "), F.coalesce(r["journal_abbrev"], F.lit("")), F.lit(". "), F.coalesce(r["year"].cast("string"), F.lit("")), volume, pages, F.lit("."), doi)
