"""Queries over the shared tables, one or more for every operator group, each with the SQL that must give the same rows.

Stand-ins: orders and customers are cases (cluster = market segment, endpoint = order status F, split by year), conversations
are blocks, events an append log, embeddings vectors with a cluster label, labels two raters. Floats are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import stats, text as S
from ..operators import coassign as G, inference as I, relational as R, sampling as P, vectors as V
from ..sources import tables as T
from . import cohort as K, raters as A

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
TERMS = ["the", "ting", "and", "thand", "license", "erin"]


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


def _cases(spark, d):
    """Orders as cases: (case, cluster, split, positive)."""
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("k"), F.col("c_mktsegment").alias("cluster"), T.split_of_year(F.year("o_orderdate"), 1997).alias("split"), (F.col("o_orderstatus") == "F").alias("y"), "o_totalprice", "o_orderpriority", "c_nationkey", "o_custkey")


CASES = """cases AS (SELECT o_orderkey AS k, c_mktsegment AS cluster, CASE WHEN year(o_orderdate) <= 1997 THEN 'discovery' ELSE 'confirmation' END AS split,
  o_orderstatus = 'F' AS y, o_totalprice, o_orderpriority, c_nationkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey)"""
CELLS = CASES + """, per AS (SELECT split, cluster, CAST(count(*) FILTER (WHERE y) AS BIGINT) AS a, CAST(count(*) FILTER (WHERE NOT y) AS BIGINT) AS b FROM cases GROUP BY ALL),
cells AS (SELECT *, CAST(sum(a) OVER (PARTITION BY split) AS BIGINT) - a AS c, CAST(sum(b) OVER (PARTITION BY split) AS BIGINT) - b AS d FROM per)"""


@query(f"WITH {CELLS} SELECT * FROM cells")
def two_by_two(spark, d):
    return R.two_by_two(_cases(spark, d), ["split"], "cluster", F.col("y"))


EFFECTS = """SELECT split, cluster, a, b, c, d, round(a / (a + b), 6) AS share_cluster, round((a + c) / (a + b + c + d), 6) AS share_split,
  round(rr, 6) AS rr, round(exp(ln(rr) - 1.959963984540054 * s1), 6) AS rr_low, round(exp(ln(rr) + 1.959963984540054 * s1), 6) AS rr_high,
  round(o, 6) AS odds_ratio, round(exp(ln(o) - 1.959963984540054 * s2), 6) AS or_low, round(exp(ln(o) + 1.959963984540054 * s2), 6) AS or_high
FROM (SELECT *, (x / (x + y)) / ((x + u) / n) AS rr, (x * v) / (y * u) AS o, sqrt(1 / x - 1 / (x + y) + 1 / (x + u) - 1 / n) AS s1, sqrt(1 / x + 1 / y + 1 / u + 1 / v) AS s2
  FROM (SELECT *, x + y + u + v AS n FROM (SELECT *, CAST(a AS DOUBLE) + 0.5 AS x, CAST(b AS DOUBLE) + 0.5 AS y, CAST(c AS DOUBLE) + 0.5 AS u, CAST(d AS DOUBLE) + 0.5 AS v FROM cells)))"""


@query(f"WITH {CELLS} {EFFECTS}")
def effect_sizes(spark, d):
    e = R.enrichment(_cases(spark, d), ["split"], "cluster", F.col("y"))
    return e.select("split", "cluster", "a", "b", "c", "d", *(r6(c).alias(c) for c in e.columns[6:]))


@query(f"""WITH {CASES}, g AS (SELECT CASE WHEN grouping(split) = 1 THEN 'pooled' ELSE split END AS split, cluster, count(*) AS n_cases, count(*) FILTER (WHERE y) AS k
  FROM cases GROUP BY GROUPING SETS ((split, cluster), (cluster))), h AS (SELECT *, k / n_cases AS p, CAST(n_cases AS DOUBLE) AS n, 1.959963984540054 AS z FROM g)
SELECT split, cluster, n_cases, k, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n))), 6) AS wilson_low,
  round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n))), 6) AS wilson_high FROM h""")
def split_vs_pooled(spark, d):
    g = R.split_and_pooled(_cases(spark, d), "split", "cluster", [F.count("*").alias("n_cases"), F.count_if("y").alias("k")])
    low, high = stats.wilson(F.col("k"), F.col("n_cases"))
    return g.select("split", "cluster", "n_cases", "k", r6(low).alias("wilson_low"), r6(high).alias("wilson_high"))


@query(f"""WITH {CELLS}, z AS (SELECT *, CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN 0.5 ELSE 0 END AS h FROM cells),
x AS (SELECT split, cluster, CAST((a + h) * (d + h) AS DOUBLE) / ((b + h) * (c + h)) AS o, sqrt(1.0 / CAST(a + h AS DOUBLE) + 1.0 / CAST(b + h AS DOUBLE) + 1.0 / CAST(c + h AS DOUBLE) + 1.0 / CAST(d + h AS DOUBLE)) AS se FROM z)
SELECT split, cluster, round(o, 6) AS odds_ratio, round(exp(ln(o) - 1.96 * se), 6) AS or_low, round(exp(ln(o) + 1.96 * se), 6) AS or_high, row_number() OVER (ORDER BY split, cluster) AS place FROM x""")
def odds_on_zero(spark, d):
    c = R.two_by_two(_cases(spark, d), ["split"], "cluster", F.col("y"))
    e = stats.odds_ratio_on_zero(*(F.col(k) for k in "abcd"))
    return c.select("split", "cluster", *(r6(v).alias(k) for k, v in e.items())).withColumn("place", F.row_number().over(W.orderBy("split", "cluster")).cast("long"))


@query(f"""WITH {CELLS}, e AS (SELECT cluster, split, a / (a + b) - (a + c) / (a + b + c + d) AS x FROM cells),
v AS (SELECT cluster, split, CASE WHEN x > 0 THEN 'enriched' WHEN x < 0 THEN 'depleted' ELSE 'neutral' END AS dir FROM e)
SELECT cluster, max(dir) FILTER (WHERE split = 'discovery') AS direction_discovery, max(dir) FILTER (WHERE split = 'confirmation') AS direction_confirmation,
  coalesce(max(dir) FILTER (WHERE split = 'discovery') <> 'neutral' AND max(dir) FILTER (WHERE split = 'discovery') = max(dir) FILTER (WHERE split = 'confirmation'), false) AS consistent FROM v GROUP BY cluster""")
def direction_consistency(spark, d):
    e = R.enrichment(_cases(spark, d), ["split"], "cluster", F.col("y"))
    return I.direction_consistency(e.withColumn("dir", S.direction(F.col("share_cluster"), F.col("share_split"))), "cluster", "split", "dir")


@query(f"""WITH {CASES}, s AS (SELECT split, cluster, avg(CAST(y AS INT)) AS share, count(*) AS n_cases FROM cases GROUP BY ALL)
SELECT split, cluster, round(share, 6) AS share, n_cases FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY share DESC, cluster) AS r FROM s) WHERE r = 1""")
def language_cluster(spark, d):
    return R.top_cluster(_cases(spark, d), ["split"], "cluster", F.col("y")).withColumn("share", r6("share"))


@query(f"""WITH {CASES}, c AS (SELECT cluster, o_orderpriority, count(*) AS n FROM cases GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster) AS prop FROM c)
SELECT cluster, o_orderpriority, n, round(prop, 6) AS prop FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY prop DESC, n DESC, o_orderpriority) AS r FROM p) WHERE r <= 3""")
def top_k_per_cluster(spark, d):
    n = _cases(spark, d).groupBy("cluster", "o_orderpriority").agg(F.count("*").alias("n"))
    p = n.withColumn("prop", F.col("n") / F.sum("n").over(W.partitionBy("cluster")))
    return R.first_rows(p, ["cluster"], [F.desc("prop"), F.desc("n"), "o_orderpriority"], 3).withColumn("prop", r6("prop"))


@query(f"""WITH {CASES} SELECT split, count(*) FILTER (WHERE cluster = 'AUTOMOBILE') AS "AUTOMOBILE", count(*) FILTER (WHERE cluster = 'BUILDING') AS "BUILDING",
  count(*) FILTER (WHERE cluster = 'MACHINERY') AS "MACHINERY" FROM cases GROUP BY split""")
def pivot_profile(spark, d):
    return R.pivot_counts(_cases(spark, d), ["split"], "cluster", ["AUTOMOBILE", "BUILDING", "MACHINERY"])


FAMILY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "none"]


@query(f"""WITH {CASES}, v AS (SELECT unnest({FAMILY}) AS value), n AS (SELECT split, cluster, count(*) AS n_cases FROM cases GROUP BY ALL),
g AS (SELECT n.split, n.cluster, value, n_cases, (SELECT count(*) FROM cases c WHERE c.split = n.split AND c.cluster = n.cluster AND c.o_orderpriority = v.value) AS value_n FROM n, v),
w AS (SELECT *, CAST(value_n + 0.5 AS DOUBLE) AS x, CAST(n_cases - value_n + 0.5 AS DOUBLE) AS y,
  CAST(sum(value_n) OVER (PARTITION BY split, value) - value_n + 0.5 AS DOUBLE) AS u, CAST(sum(n_cases - value_n) OVER (PARTITION BY split, value) - (n_cases - value_n) + 0.5 AS DOUBLE) AS z FROM g)
SELECT split, cluster, 'o_orderpriority' AS family, value, n_cases, value_n, round(value_n / n_cases, 6) AS value_prop, round((x + u - 1) / (x + y + u + z - 2), 6) AS value_prop_split,
  round((x / (x + y)) / ((x + u) / (x + y + u + z)), 6) AS rr_vs_split, round(x * z / (y * u), 6) AS or_vs_rest FROM w""")
def characterization(spark, d):
    c = R.characterization(_cases(spark, d), "split", "cluster", {"o_orderpriority": FAMILY})
    return c.select(*c.columns[:6], *(r6(x).alias(x) for x in c.columns[6:]))


@query(f"""WITH {CASES} SELECT cluster, count(*) AS n_cases, count(o_totalprice) AS n_nonmissing, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS sd,
  round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.25), 6) AS p25, round(quantile_cont(o_totalprice, 0.75), 6) AS p75 FROM cases GROUP BY cluster""")
def numeric_summary(spark, d):
    n = R.numeric_summary(_cases(spark, d), ["cluster"], "o_totalprice")
    return n.select("cluster", "n_cases", "n_nonmissing", *(r6(c).alias(c) for c in n.columns[3:]))


@query("""SELECT c_mktsegment AS cluster, round(quantile_cont(c_acctbal, 0.5), 6) AS median, round(quantile_cont(c_acctbal, 0.1), 6) AS p10, round(quantile_cont(c_acctbal, 0.9), 6) AS p90, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer GROUP BY 1""")
def quantile_summary(spark, d):
    q = R.quantile_summary(t(spark, d, "customer").withColumnRenamed("c_mktsegment", "cluster"), ["cluster"], "c_acctbal")
    return q.select("cluster", *(r6(c).alias(c) for c in q.columns[1:]))


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n_papers, CAST(sum(count(*)) OVER (ORDER BY year(o_orderdate)) AS BIGINT) AS running FROM orders GROUP BY year(o_orderdate)")
def year_counts(spark, d):
    return R.running_total(T.year_counts(t(spark, d, "orders"), F.year("o_orderdate")), "year", "n_papers", "running")


@query("""WITH y AS (SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT year, CAST(sum(n) OVER (ORDER BY year) AS BIGINT) AS a, CAST(sum(n) OVER () AS BIGINT) AS t FROM y)
SELECT year AS cutoff_year, a AS n_discovery, t - a AS n_confirmation, 200 AS min_per_split, 'earlier' AS tie_breaker,
  CASE WHEN a >= 200 AND t - a >= 200 THEN 'Balanced split (meets min_per_split).' ELSE 'Best-effort split (min_per_split not met).' END AS note
FROM c ORDER BY (a >= 200 AND t - a >= 200) DESC, abs(a - (t - a)), year LIMIT 1""")
def split_recommend(spark, d):
    return T.recommend_split(T.year_counts(t(spark, d, "orders"), F.year("o_orderdate")))


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) <= 1997 THEN 'discovery' ELSE 'confirmation' END AS split FROM orders")
def split_assign(spark, d):
    return t(spark, d, "orders").select("o_orderkey", T.split_of_year(S.year_of(F.col("o_orderdate")), 1997).alias("split"))


@query("""WITH n AS (SELECT p_partkey, regexp_replace(trim(p_type), '[^A-Za-z0-9._-]+', '_', 'g') AS s FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_partkey) - 1 AS i FROM n)
SELECT p_partkey, CASE WHEN i = 0 THEN s ELSE s || '__dup' || i END || '.pdf' AS file_name FROM k""")
def dup_suffix(spark, d):
    p = t(spark, d, "part").select("p_partkey", S.file_name([F.col("p_type")]).alias("s"))
    return R.duplicate_suffix(p, "s", ["p_partkey"]).select("p_partkey", F.concat("unique_name", F.lit(".pdf")).alias("file_name"))


@query("SELECT conv_id, role, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) AS n_blocks FROM conversations GROUP BY ALL")
def section_rollup(spark, d):
    return t(spark, d, "conversations").groupBy("conv_id", "role").agg(F.sum(F.length("text")).cast("long").alias("n_chars"), F.count("*").alias("n_blocks"))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS cum FROM conversations)
SELECT conv_id, turn, role FROM c WHERE rn = 1 OR (rn <= 4 AND cum <= 600)""")
def prefix_cap_blocks(spark, d):
    c = t(spark, d, "conversations").withColumn("n_chars", F.length("text"))
    return R.prefix_cap(c, ["conv_id"], ["turn"], "n_chars", 4, 600).select("conv_id", "turn", "role")


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations)
SELECT conv_id, role, left(string_agg(text, ' ' ORDER BY turn), 450) AS preview FROM f WHERE r <= 2 GROUP BY ALL""")
def section_preview(spark, d):
    head = R.first_rows(t(spark, d, "conversations"), ["conv_id", "role"], ["turn"], 2)
    return R.ordered_text(head, ["conv_id", "role"], "turn", "text", " ").select("conv_id", "role", F.left("text", F.lit(450)).alias("preview"))


@query("SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS packet, count(*) AS n_segments FROM conversations GROUP BY conv_id")
def case_packet(spark, d):
    from ..sources.documents import case_packets

    c = t(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("segment_type"), F.col("text").alias("text_clean"))
    return case_packets(c, ["conv_id"], ["turn"])


@query("""WITH f AS (SELECT conv_id, role, min(turn) AS o FROM conversations GROUP BY ALL) SELECT conv_id, string_agg(role, ',' ORDER BY o) AS roles FROM f GROUP BY conv_id""")
def ordered_distinct_roles(spark, d):
    return R.ordered_distinct(t(spark, d, "conversations"), ["conv_id"], "turn", "role").select("conv_id", F.array_join("role", ",").alias("roles"))


@query("""WITH h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS r FROM conversations WHERE role <> 'user' AND regexp_matches(text, '(?i)tion'))
SELECT conv_id, turn FROM h WHERE r <= 2""")
def extra_snippets(spark, d):
    h = t(spark, d, "conversations").where((F.col("role") != "user") & F.col("text").rlike("(?i)tion"))
    return R.first_rows(h, ["conv_id"], [F.length("text"), "turn"], 2).select("conv_id", "turn")


@query("""WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS r FROM conversations) SELECT conv_id, turn FROM c WHERE r = 1""")
def first_use_dedupe(spark, d):
    return R.first_rows(t(spark, d, "conversations"), ["text"], ["conv_id", "turn"], 1).select("conv_id", "turn")


@query("SELECT CAST(0 AS BIGINT) AS leaks, count(*) AS n FROM documents")
def leak_zero_after_redact(spark, d):
    x = t(spark, d, "documents").select(S.leak_count(S.redact(F.col("text"), TERMS, " "), TERMS).alias("n"))
    return x.agg(F.sum("n").cast("long").alias("leaks"), F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS text_sha256, left(sha1(CAST(doc_id AS VARCHAR) || chr(10) || source || chr(10) || text), 16) AS uid FROM documents")
def content_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"), S.short_sha1(F.col("doc_id"), F.col("source"), F.col("text")).alias("uid"))


@query(r"SELECT page_id, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title, nullif(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), '') AS lang FROM pages")
def page_title(spark, d):
    return t(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), F.lit("")).alias("title"), F.nullif(F.regexp_extract("html", r'<html lang="([a-z]+)"', 1), F.lit("")).alias("lang"))


@query(r"""SELECT page_id, position('<body' IN left(html, 200000)) > 0 AS has_body, CAST(len(regexp_extract_all(left(html, 200000), '<p\b')) AS INT) AS n_p FROM pages""")
def page_head_metrics(spark, d):
    head = F.left("html", F.lit(200_000))
    return t(spark, d, "pages").select("page_id", head.contains("<body").alias("has_body"), F.regexp_count(head, F.lit(r"<p\b")).alias("n_p"))


@query()
def page_blocks(spark, d):
    """Paragraph blocks of marked-up pages by the tree parser (no SQL form)."""
    import re
    from html import escape, unescape

    from ..sources.documents import parse_document

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for i, html in zip(pdf["page_id"], pdf["html"]):
                plain = [unescape(re.sub(r"<[^>]*>", " ", p)) for p in re.findall(r"(?s)<p\b[^>]*>(.*?)</p>", re.sub(r"(?s)<(script|style).*?</\1>", "", html or ""))]
                body = "".join(f"<p>{escape(p, quote=False)}</p>" for p in plain)
                try:
                    _, blocks = parse_document(f"<article><body>{body}</body></article>".encode(), str(i))
                    rows += [(i, b["block_index"], b["block_id"], b["text"]) for b in blocks]
                except Exception:
                    rows.append((i, -1, None, None))
            yield pd.DataFrame(rows, columns=["page_id", "block_index", "block_id", "text"])

    return t(spark, d, "pages").select("page_id", "html").mapInPandas(run, "page_id long, block_index int, block_id string, text string")


LABELS = "l AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM labels JOIN documents USING (doc_id))"


def _labels(spark, d):
    return t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


@query(f"WITH {LABELS} SELECT doc_id, lang IN ('fr', 'de') AS by_set, contains(lower(source), 'src1') AS by_substring, CAST(quality AS INT) AS tag FROM l")
def is_positive(spark, d):
    return _labels(spark, d).select("doc_id", F.coalesce(F.col("lang").isin("fr", "de"), F.lit(False)).alias("by_set"), S.contains_any(F.col("source"), ["SRC1"]).alias("by_substring"), S.tag_present(F.when(F.col("quality") == 1, "present").otherwise("not_reported")).alias("tag"))


@query("""SELECT * FROM (SELECT 0 AS step_no, 'documents' AS step, count(DISTINCT doc_id) AS n_total, count(DISTINCT doc_id) FILTER (WHERE doc_id % 2 = 0) AS n_discovery, count(DISTINCT doc_id) FILTER (WHERE doc_id % 2 = 1) AS n_confirmation FROM documents
UNION ALL SELECT 1, 'labelled', count(DISTINCT doc_id), count(DISTINCT doc_id) FILTER (WHERE doc_id % 2 = 0), count(DISTINCT doc_id) FILTER (WHERE doc_id % 2 = 1) FROM documents SEMI JOIN labels USING (doc_id)
UNION ALL SELECT 2, 'english', count(DISTINCT doc_id), count(DISTINCT doc_id) FILTER (WHERE doc_id % 2 = 0), count(DISTINCT doc_id) FILTER (WHERE doc_id % 2 = 1) FROM documents SEMI JOIN labels USING (doc_id) WHERE lang = 'en')""")
def flow_table(spark, d):
    a = t(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, "discovery").otherwise("confirmation").alias("split"))
    b = a.join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return R.flow_table([("documents", a), ("labelled", b), ("english", b.where("lang = 'en'"))], ["doc_id"], "split")


@query(f"WITH {LABELS} SELECT lang, source, count(*) AS n_cases, CAST(sum(count(*)) OVER (PARTITION BY lang) AS BIGINT) AS cluster_n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS prop_within_cluster FROM l GROUP BY lang, source")
def composition(spark, d):
    return R.share_of_parent(_labels(spark, d), ["lang"], "source").withColumn("prop_within_cluster", r6("prop_within_cluster"))


@query("SELECT lang, count(*) AS n, round(avg(CAST(n_chars > 1000 AS INT)), 6) AS long_rate FROM documents GROUP BY lang")
def value_counts(spark, d):
    return R.rates(t(spark, d, "documents"), ["lang"], F.col("n_chars") > 1000, "long_rate").withColumn("long_rate", r6("long_rate"))


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def one_case_per_source(spark, d):
    return R.first_per_key(t(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"])


@query(f"""WITH {LABELS}, u AS (SELECT lang, 'quality' AS tag, CASE WHEN quality = 1 THEN 'present' ELSE 'not_reported' END AS s FROM l UNION ALL SELECT lang, 'toxic', CASE WHEN toxic = 1 THEN 'present' ELSE 'explicitly_absent' END FROM l)
SELECT lang, tag, count(*) AS n_cases, count(*) FILTER (WHERE s = 'present') AS present_n, round(avg(CAST(s = 'present' AS INT)), 6) AS present_prop, count(*) FILTER (WHERE s = 'explicitly_absent') AS explicitly_absent_n,
  count(*) FILTER (WHERE s = 'uncertain') AS uncertain_n, count(*) FILTER (WHERE s = 'not_reported') AS not_reported_n FROM u GROUP BY ALL""")
def tag_summary(spark, d):
    x = _labels(spark, d).select("lang", F.when(F.col("quality") == 1, "present").otherwise("not_reported").alias("tag__quality__status"), F.when(F.col("toxic") == 1, "present").otherwise("explicitly_absent").alias("tag__toxic__status"))
    return R.tag_summary(x, ["lang"]).withColumn("present_prop", r6("present_prop"))


VEC = "v AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings), c AS (SELECT label, p, avg(CAST(x AS DOUBLE)) AS m FROM v GROUP BY ALL)"


@query(f"WITH {VEC} SELECT label, CAST(p - 1 AS INT) AS pos, round(m, 6) AS m FROM c")
def centroids(spark, d):
    c = V.mean_vectors(t(spark, d, "embeddings"), ["label"], "embedding")
    return c.select("label", F.posexplode("embedding").alias("pos", "m")).withColumn("m", r6("m"))


@query(f"WITH {VEC}, n AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY 1) SELECT c.label, CAST(p - 1 AS INT) AS pos, round(m / n, 6) AS m FROM c JOIN n USING (label)")
def pool_vectors(spark, d):
    c = V.mean_vectors(t(spark, d, "embeddings"), ["label"], "embedding", True)
    return c.select("label", F.posexplode("embedding").alias("pos", "m")).withColumn("m", r6("m"))


COS = f"""{VEC}, h AS (SELECT label, vec_id % 2 AS s, p, avg(CAST(x AS DOUBLE)) AS m FROM v GROUP BY ALL), hn AS (SELECT label, s, sqrt(sum(m * m)) AS n FROM h GROUP BY ALL),
sim AS (SELECT a.label AS discovery_cluster, b.label AS confirmation_cluster, sum(a.m * b.m) / (any_value(an.n) * any_value(bn.n)) AS cos FROM h a JOIN h b ON a.p = b.p AND a.s = 0 AND b.s = 1
  JOIN hn an ON an.label = a.label AND an.s = 0 JOIN hn bn ON bn.label = b.label AND bn.s = 1 GROUP BY ALL)"""


def _halves(spark, d):
    e = t(spark, d, "embeddings").withColumn("s", F.col("vec_id") % 2)
    c = V.mean_vectors(e, ["s", "label"], "embedding")
    return V.cosine_matrix(c.where("s = 0"), c.where("s = 1"), "label", "label", "embedding")


@query(f"WITH {COS} SELECT discovery_cluster, confirmation_cluster, round(cos, 6) AS cosine_similarity FROM sim")
def cosine_matrix(spark, d):
    return _halves(spark, d).withColumn("cosine_similarity", r6("cosine_similarity"))


#: The best one-to-one matching over all sets of taken clusters; among equal totals the first rows get the smallest.
MATCHED = f"""WITH RECURSIVE {COS}, m AS (SELECT dense_rank() OVER (ORDER BY discovery_cluster) - 1 AS i, dense_rank() OVER (ORDER BY confirmation_cluster) - 1 AS j, discovery_cluster, confirmation_cluster, cos FROM sim),
dp AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS taken, CAST(0 AS DOUBLE) AS total, CAST([] AS BIGINT[]) AS path UNION ALL
  SELECT i, taken, total, path FROM (SELECT dp.i + 1 AS i, dp.taken + (1::BIGINT << m.j::INT) AS taken, total + cos AS total, list_append(path, m.j) AS path, row_number() OVER (PARTITION BY dp.taken + (1::BIGINT << m.j::INT) ORDER BY total + cos DESC, list_append(path, m.j)) AS r
    FROM dp JOIN m ON m.i = dp.i AND (dp.taken >> m.j::INT) % 2 = 0) WHERE r = 1),
best AS (SELECT path FROM dp ORDER BY i DESC LIMIT 1)
SELECT discovery_cluster, confirmation_cluster, round(cos, 6) AS cosine_similarity, path[i + 1] = j AS matched FROM m, best"""


@query(MATCHED)
def cluster_match(spark, d):
    """One-to-one matching of the halves' clusters."""
    return V.match_clusters(_halves(spark, d)).withColumn("cosine_similarity", r6("cosine_similarity"))


NEAR = f"""{VEC}, cn AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY 1), s AS (SELECT vec_id, v.label, c.label AS k, sum(CAST(x AS DOUBLE) * m) / any_value(cn.n) AS dp FROM v JOIN c ON v.p = c.p JOIN cn ON cn.label = c.label GROUP BY ALL),
near AS (SELECT vec_id, label, k AS assigned FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dp DESC, k) AS r FROM s) WHERE r = 1)"""


def _assigned(spark, d):
    e = t(spark, d, "embeddings")
    return V.nearest_centroid(e, V.mean_vectors(e, ["label"], "embedding"), "label", "embedding")


@query(f"WITH {NEAR} SELECT * FROM near")
def nearest_centroid(spark, d):
    return _assigned(spark, d).select("vec_id", "label", "assigned")


@query(f"""WITH {VEC}, s AS (SELECT vec_id, c.label AS k, sum((CAST(x AS DOUBLE) - m) * (CAST(x AS DOUBLE) - m)) AS dist FROM v JOIN c ON v.p = c.p GROUP BY ALL)
SELECT vec_id, k AS assigned FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, k) AS r FROM s) WHERE r = 1""")
def nearest_by_distance(spark, d):
    e = t(spark, d, "embeddings")
    return V.nearest_centroid(e, V.mean_vectors(e, ["label"], "embedding"), "label", "embedding", "distance").select("vec_id", "assigned")


@query(f"""WITH {NEAR}, cn2 AS (SELECT label, assigned, count(*) AS n FROM near GROUP BY ALL), tot AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cn2) AS ij, (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(n) AS t FROM cn2 GROUP BY label)) AS i,
  (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(n) AS t FROM cn2 GROUP BY assigned)) AS j, (SELECT sum(n) * (sum(n) - 1) / 2 FROM cn2) AS t)
SELECT round((ij - i * j / t) / ((i + j) / 2 - i * j / t), 6) AS ari FROM tot""")
def ari(spark, d):
    return I.adjusted_rand(_assigned(spark, d), "label", "assigned").select(r6("ari").alias("ari"))


@query(f"WITH {NEAR} SELECT round(count(*) FILTER (WHERE label = 1 AND assigned = 1) / count(*) FILTER (WHERE label = 1 OR assigned = 1), 6) AS jaccard FROM near")
def jaccard(spark, d):
    return I.mask_jaccard(_assigned(spark, d), F.col("label") == 1, F.col("assigned") == 1).select(r6("jaccard").alias("jaccard"))


@query("""WITH a AS (SELECT vec_id, r, (label + CASE WHEN r = 1 THEN vec_id % 2 ELSE 0 END) % 10 AS cl FROM embeddings, (SELECT unnest([0, 1]) AS r))
SELECT x.vec_id AS i, y.vec_id AS j, count(*) / 2 AS coassignment FROM a x JOIN a y ON x.r = y.r AND x.cl = y.cl AND x.vec_id < y.vec_id GROUP BY ALL""")
def coassignment(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "label", F.explode(F.array(F.lit(0), F.lit(1))).alias("r"))
    a = e.select("vec_id", "r", ((F.col("label") + F.when(F.col("r") == 1, F.col("vec_id") % 2).otherwise(0)) % 10).alias("cl"))
    return V.coassignment(a, "vec_id", "r", "cl")


# eight clusterings of all vectors by the signs of two components
SIGNS = """s AS (SELECT vec_id, r, CAST(embedding[r + 1] > 0 AS INT) * 2 + CAST(embedding[r + 9] > 0 AS INT) AS cl FROM embeddings, (SELECT unnest(range(8)) AS r)),
 p AS (SELECT vec_id, string_agg(cl, '' ORDER BY r) AS f FROM s GROUP BY vec_id), q AS (SELECT f, min(vec_id) AS profile, count(*) AS cases FROM p GROUP BY f),
 g AS (SELECT a.f, a.profile, a.cases, b.cases AS n, (SELECT count(*) FROM range(1, 9) AS k(k) WHERE a.f[k.k] = b.f[k.k]) AS same FROM q a JOIN q b ON a.profile != b.profile)"""


@query(f"""WITH {SIGNS} SELECT q.profile, q.cases, CAST(coalesce(sum(g.n) FILTER (WHERE g.same >= 6), 0) AS BIGINT) AS linked, count(*) FILTER (WHERE g.same >= 6) AS partners
 FROM q LEFT JOIN g ON q.profile = g.profile GROUP BY q.profile, q.cases""")
def coassigned_profiles(spark, d):
    """Vectors that fall together in at least three of four clusterings, by profile."""
    v = F.col("embedding")
    cl = lambda r: (F.get(v, r) > 0).cast("int") * 2 + (F.get(v, r + 8) > 0).cast("int")
    a = t(spark, d, "embeddings").select("vec_id", F.posexplode(F.array(*(cl(r) for r in range(8)))).alias("r", "cl"))
    cases = G.profiles(a, "vec_id", "r", "cl")
    pairs = G.coassigned(cases, 0.75)
    partners = pairs.select(F.col("i").alias("profile")).union(pairs.select("j")).groupBy("profile").agg(F.count("*").alias("partners"))
    return G.consensus_counts(cases, pairs).join(partners, "profile", "left").select("profile", "cases", "linked", F.coalesce("partners", F.lit(0)).alias("partners"))


DRAWS = 100
#: The urn's number of marked balls for every draw and cluster, in the order of clusters; weights from the gamma function.
URN = """urn AS (SELECT {group}, cluster, n, y, row_number() OVER (PARTITION BY {group} ORDER BY cluster) AS i, sum(n) OVER (PARTITION BY {group}) AS total, sum(y) OVER (PARTITION BY {group}) AS marked FROM counts),
step AS (
  SELECT {group}, draw, 1 AS i, CAST(total AS BIGINT) AS total, CAST(marked AS BIGINT) AS marked, CAST(NULL AS BIGINT) AS got FROM (SELECT DISTINCT {group}, total, marked FROM urn), (SELECT unnest(range({draws})) AS draw)
  UNION ALL
  SELECT {group}, draw, i + 1, total - n, marked - got, got FROM (
    SELECT s.{group}, draw, s.i, s.total, s.marked, n,
      list_filter(range(greatest(0, n - (s.total - s.marked)), least(n, s.marked) + 1), lambda k: list_sum(list_transform(range(greatest(0, n - (s.total - s.marked)), k + 1), lambda j:
        exp(lgamma(s.marked + 1) - lgamma(j + 1) - lgamma(s.marked - j + 1) + lgamma(s.total - s.marked + 1) - lgamma(n - j + 1) - lgamma(s.total - s.marked - n + j + 1) - lgamma(s.total + 1) + lgamma(n + 1) + lgamma(s.total - n + 1))))
        >= (CAST('0x' || substr(md5('42:' || draw || ':' || cluster), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496)[1] AS got
    FROM step s JOIN urn u ON u.{group} = s.{group} AND u.i = s.i)),
null_ AS (SELECT s.{group}, draw, cluster, n, got AS positives FROM step s JOIN urn u ON u.{group} = s.{group} AND u.i = s.i - 1)"""
PERM = f"""RECURSIVE b AS (SELECT vec_id AS k, label AS cluster, quality = 1 AS y FROM labels JOIN embeddings ON vec_id = doc_id JOIN documents USING (doc_id)),
counts AS (SELECT 0 AS one, cluster, count(*) AS n, count(*) FILTER (WHERE y) AS y FROM b GROUP BY ALL),
{URN.format(group="one", draws=DRAWS)},
obs AS (SELECT cluster, n AS n_cases, y AS observed FROM counts)"""


def _perm(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("k"), F.col("label").alias("cluster"))
    return e.join(t(spark, d, "labels").select(F.col("doc_id").alias("k"), (F.col("quality") == 1).alias("y")), "k")


@query(f"""WITH {PERM}, m AS (SELECT draw, max(positives / n) AS m FROM null_ GROUP BY draw), o AS (SELECT max(observed / n_cases) AS o FROM obs)
SELECT round(o, 6) AS observed_max, CAST(count(*) FILTER (WHERE m >= o) AS BIGINT) AS n_ge, count(*) AS draws, round((1 + count(*) FILTER (WHERE m >= o)) / (1 + count(*)), 6) AS p, round(avg(m), 6) AS null_mean, round(quantile_cont(m, 0.95), 6) AS null_p95 FROM m, o GROUP BY o""")
def perm_max_share(spark, d):
    x = I.max_share_test(_perm(spark, d), "k", "cluster", F.col("y"), DRAWS)
    return x.select(r6("observed_max").alias("observed_max"), "n_ge", "draws", r6("p").alias("p"), r6("null_mean").alias("null_mean"), r6("null_p95").alias("null_p95"))


@query(f"WITH {PERM} SELECT cluster, n_cases, observed, count(*) FILTER (WHERE positives >= observed) AS n_ge, round((1 + count(*) FILTER (WHERE positives >= observed)) / (1 + count(*)), 6) AS p FROM null_ JOIN obs USING (cluster) GROUP BY ALL")
def perm_fixed_cluster(spark, d):
    return I.fixed_cluster_test(_perm(spark, d), "k", "cluster", F.col("y"), DRAWS).withColumn("p", r6("p"))


@query(f"WITH {PERM} SELECT CAST(draw AS INT) AS draw, cluster, n, positives FROM null_")
def perm_null(spark, d):
    return I.permuted_shares(_perm(spark, d), "k", "cluster", F.col("y"), DRAWS)


@query(f"""WITH {PERM}, p AS (SELECT cluster, (1 + count(*) FILTER (WHERE positives >= observed)) / (1 + count(*)) AS p FROM null_ JOIN obs USING (cluster) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (ORDER BY p, cluster) AS r, count(*) OVER () AS m FROM p), q AS (SELECT cluster, p, least(1, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM k)
SELECT cluster, round(p, 6) AS p, round(q, 6) AS q, q <= 0.05 AS reject FROM q""")
def endpoint_fdr(spark, d):
    x = I.fixed_cluster_test(_perm(spark, d), "k", "cluster", F.col("y"), DRAWS).select("cluster", "p")
    return R.bh_fdr(x, "p", "cluster").select("cluster", r6("p").alias("p"), r6("q").alias("q"), "reject")


@query("""WITH p AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS a, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS b, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS c, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS d FROM labels),
q AS (SELECT *, a + b + c + d AS n FROM p), r AS (SELECT n, (a + d) / n AS po, (a + b) / n AS r1, (a + c) / n AS r2 FROM q), s AS (SELECT *, r1 * r2 + (1 - r1) * (1 - r2) AS pe FROM r)
SELECT 'endpoint' AS field, n AS n_pairs, round((po - pe) / (1 - pe), 6) AS kappa, round(po, 6) AS agreement, round(r1, 6) AS r1_positive_rate, round(r2, 6) AS r2_positive_rate FROM s""")
def kappa(spark, d):
    p = t(spark, d, "labels").select(F.col("quality").alias("endpoint_r1"), F.col("toxic").alias("endpoint_r2"))
    k = I.kappa_report(p, ["endpoint"])
    return k.select("field", "n_pairs", *(r6(c).alias(c) for c in k.columns[2:]))


def _raters(spark, d):
    return t(spark, d, "labels").select("doc_id", F.col("quality").alias("e_r1"), F.col("toxic").alias("e_r2"))


@query("SELECT doc_id, quality AS e_r1, toxic AS e_r2, CAST(NULL AS INT) AS e_final FROM labels WHERE quality <> toxic")
def adjudication(spark, d):
    return I.adjudication(_raters(spark, d), ["doc_id"], ["e"])


@query("SELECT doc_id, CASE WHEN quality = toxic THEN quality WHEN doc_id % 3 = 0 THEN CAST(doc_id % 2 AS INT) END AS e FROM labels")
def consensus(spark, d):
    judge = _raters(spark, d).where("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("e_final"))
    return I.consensus(_raters(spark, d), judge, ["doc_id"], ["e"])


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS quality, CASE WHEN doc_id % 5 = 0 THEN 'override' ELSE 'base' END AS label_source FROM labels")
def relabel(spark, d):
    base = t(spark, d, "labels").select("doc_id", "quality")
    return R.apply_overrides(base, base.where("doc_id % 5 = 0").withColumn("quality", 1 - F.col("quality")), ["doc_id"], ["quality"])


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def hash_sample(spark, d):
    return P.hash_sample(t(spark, d, "documents").select("doc_id"), ["doc_id"], 100)


@query("SELECT c_custkey, CAST(CAST('0x' || left(sha1(CAST(c_custkey AS VARCHAR)), 8) AS BIGINT) % 16 AS INT) AS shard FROM customer")
def hash_shard(spark, d):
    return t(spark, d, "customer").select("c_custkey", P.hash_shard(F.col("c_custkey").cast("string"), 16).alias("shard"))


def sample_sql(rows: str, n: int, name: str) -> str:
    """Common table expressions up to ``name``: the sample of ``rows``, which has s (stratum) and k (key as text). One pass gives or takes what is missing or too much."""
    return f"""{name}_c AS (SELECT s, count(*) AS c, sum(count(*)) OVER () AS total FROM {rows} GROUP BY s), {name}_e AS (SELECT *, {n} * c / total AS x, CAST(least(c, greatest(1, floor({n} * c / total))) AS BIGINT) AS got FROM {name}_c),
{name}_g AS (SELECT *, CAST({n} - sum(got) OVER () AS BIGINT) AS gap FROM {name}_e), {name}_r AS (SELECT *, row_number() OVER (PARTITION BY got < c ORDER BY -(x - floor(x)), s) AS up, row_number() OVER (PARTITION BY got > 1 ORDER BY -got, s) AS down FROM {name}_g),
{name}_t AS (SELECT s, got + CASE WHEN gap > 0 AND got < c AND up <= gap THEN 1 WHEN gap < 0 AND got > 1 AND down <= -gap THEN -1 ELSE 0 END AS take FROM {name}_r),
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5('42:' || k), k) AS o FROM {rows}), {name} AS (SELECT {name}_o.* EXCLUDE (o) FROM {name}_o JOIN {name}_t USING (s) WHERE o <= take)"""


@query(f"WITH d AS (SELECT doc_id, lang, source, concat_ws('|', lang, source) AS s, CAST(doc_id AS VARCHAR) AS k FROM documents), {sample_sql('d', 200, 'z')} SELECT doc_id, lang, source FROM z")
def stratified_sample(spark, d):
    """200 documents over language and source."""
    docs = t(spark, d, "documents").select("doc_id", "lang", "source")
    return P.stratified_sample(docs, F.concat_ws("|", "lang", "source"), ["doc_id"], 200)


@query("""WITH b AS (SELECT doc_id, r AS replicate, row_number() OVER (PARTITION BY r ORDER BY md5('42:' || r || ':' || doc_id), doc_id) AS n, greatest(round(count(*) OVER (PARTITION BY r) * 0.8), 1) AS k FROM labels, (SELECT unnest(range(5)) AS r))
SELECT CAST(replicate AS INT) AS replicate, doc_id FROM b WHERE n <= k""")
def bootstrap_sample(spark, d):
    return P.bootstrap(t(spark, d, "labels").select("doc_id"), "doc_id", 5, 0.8).select("replicate", "doc_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_status(spark, d):
    return R.latest_per_key(t(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT user_id, arg_min(v, event_id) FILTER (WHERE v IS NOT NULL) AS v FROM (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events) GROUP BY user_id")
def first_nonnull(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return R.first_non_null(e, ["user_id"], ["v"], "event_id")


@query("""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s FROM events GROUP BY user_id) SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM l WHERE s IN ('purchase', 'click'))""")
def pending_antijoin(spark, d):
    keys = t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return R.pending(keys, t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", ["purchase", "click"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def events_json_extract(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def top_n_registry(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def left_join_counts(spark, d):
    return R.left_counts(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], "n_orders")


@query("""SELECT s_suppkey, CASE WHEN n_name IS NULL THEN 'missing' ELSE lower(trim(n_name)) END AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def map_lookup(spark, d):
    return R.map_values(t(spark, d, "supplier"), "s_nationkey", t(spark, d, "nation"), "n_nationkey", "n_name", "nation").select("s_suppkey", S.category(F.col("nation")).alias("nation"))


@query("SELECT doc_id, 'toxic' AS origin FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'quality' FROM labels WHERE quality = 1")
def union_forced(spark, d):
    x = t(spark, d, "labels")
    return R.union_tagged({"toxic": x.where("toxic = 1").select("doc_id"), "quality": x.where("quality = 1").select("doc_id")})


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, d):
    return t(spark, d, "documents").select("doc_id").subtract(t(spark, d, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersection(spark, d):
    return t(spark, d, "documents").select("doc_id").intersect(t(spark, d, "labels").select("doc_id"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '…' ELSE text END AS cut FROM documents")
def truncate_text(spark, d):
    return t(spark, d, "documents").select("doc_id", S.truncate(F.col("text"), 100).alias("cut"))


@query()
def pca_kmeans(spark, d):
    """Reduced and clustered vectors (no SQL form; invariants in the tests)."""
    x, _ = V.pca(t(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    return V.kmeans(x, "embedding", 4, range(3)).select("vec_id", "cluster")


@query()
def stability_bootstrap(spark, d):
    """Adjusted Rand index of refits on subsamples (no SQL form)."""
    e = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    return K.stability(K.resampled(e, "vec_id", "embedding", "label", 5, 0.8, 4))


@query()
def cohort_analysis(spark, d):
    """Entry A over documents with labels and vectors: effects of matched clusters in both splits."""
    cases = t(spark, d, "labels").select(F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, "discovery").otherwise("confirmation").alias("split"), (F.col("quality") == 1).alias("is_ppa"))
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return K.analyse_splits(cases, v, seeds=range(2), draws=50)["effects"]


from . import catalog_cohort, catalog_documents  # noqa: E402, F401 (registers its queries)
