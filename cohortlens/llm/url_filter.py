"""URL filters: host and path rules over a blocked Bloom filter with an exact join behind it. Native throughout.

Rules come first: a rule fits its host and every subdomain if the path starts with the rule's; the longest
wins (host, then path, then the rule's text). A url without a rule is looked up in the list:

* its canonical form is hashed; the hash names a block of four 64-bit words and one to two bits in each;
* ``bloom`` has one row per block (``bit_or`` of the members' bits), at most ``MAX_BLOCKS`` of them, so its
  size has a bound that does not depend on the list;
* rows whose bits are all set are possible hits; an equi-join with the list keeps the true ones.

Null urls and urls without ``://`` have empty host and path, fit no rule and are not listed. Repeated rows are
judged each. Columns of the input that clash with the result's are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Blocks of 256 bits: 8 MB at most.
MAX_BLOCKS = 1 << 18
BITS_PER_URL = 12
#: Rules written as one expression; more are joined by host suffix.
MAX_INLINE = 200


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without trailing slashes, query kept, scheme and fragment dropped; null where there is no ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host, path, query))


def _bits(url: Column) -> list[Column]:
    h = F.xxhash64(url, F.lit(7))
    one = F.lit(1).cast("long")
    bit = lambda k: F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(4)]


def bloom(listed: DataFrame, url_col: str, blocks: int) -> DataFrame:
    """One row per block with members: (block, w0..w3)."""
    block = F.pmod(F.xxhash64(F.col(url_col)), F.lit(blocks)).alias("block")
    return listed.select(block, *(b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(url_col))))).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)))


def is_listed(urls: DataFrame, listed: DataFrame, url_col: str = "canonical") -> DataFrame:
    """``urls`` with a boolean ``listed``: the Bloom filter first, then an exact hash join of the possible hits."""
    # written once: it is counted, hashed into the filter and joined
    listed = C.cut(listed.select(F.col(url_col)).where(F.col(url_col).isNotNull()).distinct())
    n = listed.count()
    blocks = 64
    while blocks < MAX_BLOCKS and blocks * 256 < n * BITS_PER_URL:
        blocks *= 2
    sieve = bloom(listed, url_col, blocks)
    probe = urls.withColumn("block", F.pmod(F.xxhash64(F.col(url_col)), F.lit(blocks)))
    # MAX_BLOCKS rows of 40 bytes is the most that this sends
    hit = probe.join(F.broadcast(sieve), "block", "left")
    may = F.lit(True)
    for i, b in enumerate(_bits(F.col(url_col))):
        may = may & (F.col(f"w{i}").bitwiseAND(b) == b)
    hit = hit.withColumn("may", F.coalesce(may & F.col(url_col).isNotNull(), F.lit(False))).drop("block", "w0", "w1", "w2", "w3")
    # only possible hits carry a key into the exact join; the others get none and stay where they are
    exact = listed.select(F.col(url_col).alias("_listed"))
    sure = hit.where("may").join(exact, F.col(url_col) == F.col("_listed"), "left").withColumn("listed", F.col("_listed").isNotNull()).drop("_listed", "may")
    return sure.unionByName(hit.where("NOT may").withColumn("listed", F.lit(False)).drop("may"))


def _split(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), "/" + path


def match_rules(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` (null where none fits) to rows with host and path; rules: (verdict, host/path)."""
    order = sorted(rules, key=lambda r: (-len(_split(r[1])[0]), -len(_split(r[1])[1]), r[1]))
    if len(order) <= MAX_INLINE:
        rule = verdict = None
        for what, text in order:
            host, path = _split(text)
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            rule = F.when(fits, text) if rule is None else rule.when(fits, text)
            verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
        none = F.lit(None).cast("string")
        return urls.withColumn("rule", none if rule is None else rule).withColumn("rule_verdict", none if verdict is None else verdict)
    spark = urls.sparkSession
    rows = [(*_split(text), text, what, i) for i, (what, text) in enumerate(order)]
    known = spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, rule_verdict string, place int")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    # by value, not by a number of the row, so that a task that runs again finds the same rules
    places = urls.select("host", "path").distinct()
    found = places.select("host", "path", F.explode(suffixes).alias("rule_host")).join(known, "rule_host").where("startswith(path, rule_path)")
    best = found.groupBy("host", "path").agg(F.min(F.struct("place", "rule", "rule_verdict")).alias("b")).select("host", "path", "b.rule", "b.rule_verdict")
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, "rule", "rule_verdict")


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, listed, verdict) of every row. ``listed`` has a column ``canonical``."""
    url = F.col(url_col).cast("string")
    slim = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    judged = is_listed(match_rules(slim, rules), listed)
    return judged.select("page_id", "host", "path", "rule", "listed", F.coalesce("rule_verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
