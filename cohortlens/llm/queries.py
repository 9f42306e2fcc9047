"""Queries of this subpackage, each over its whole table, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C


#: Target weights of the query, by the number at the end of a source's name modulo five; a name without one has none and comes last.
TARGETS = [40, 25, 10, 5, 1]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    docs = C.table(spark, sf_dir, "documents", "doc_id", "source")
    number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("long")
    weights = docs.select("source").distinct().select("source", F.element_at(F.array(*map(F.lit, TARGETS)), (number % len(TARGETS) + 1).cast("int")).alias("weight"))
    mixed = mix_sources(docs, weights.where("weight IS NOT NULL"))
    return mixed.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "block", "slot", "position", "on_target")


#: One source after the other in every slot, without the classes of equal weights.
OP1_SQL = """
WITH RECURSIVE src AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
t AS (SELECT source, n, CAST([40, 25, 10, 5, 1][1 + TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 5] AS BIGINT) AS w FROM src),
g AS (SELECT list_reduce(list(w), lambda a, b: gcd(a, b)) AS unit FROM t WHERE w > 0),
z AS (SELECT source, n, CAST(w / unit AS BIGINT) AS c, row_number() OVER (ORDER BY w DESC, source) - 1 AS i, CAST(sum(CAST(w / unit AS BIGINT)) OVER () AS BIGINT) AS d FROM t, g WHERE w > 0),
arr AS (SELECT list(c ORDER BY i) AS c, any_value(d) AS d, count(*) AS k FROM z),
s AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(c, lambda x: CAST(0 AS BIGINT)) AS done, CAST(-1 AS BIGINT) AS pick, c, d, k FROM arr
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, j: x + CASE WHEN j - 1 = p THEN 1 ELSE 0 END), p, c, d, k FROM (
    SELECT *, list_min(list_filter(list_transform(c, lambda x, j: CASE WHEN done[j] < x AND (done[j] * d) // x <= t
      THEN (((done[j] + 1) * d + x - 1) // x) * k + j - 1 END), lambda y: y IS NOT NULL)) % k AS p
    FROM s WHERE t < d)),
plan AS (SELECT z.source, z.c, z.d, s.t - 1 AS slot, row_number() OVER (PARTITION BY z.source ORDER BY s.t) - 1 AS turn FROM s JOIN z ON z.i = s.pick),
r AS (SELECT doc_id, source, coalesce(source, '') AS src, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank FROM documents),
ends AS (SELECT coalesce((SELECT max(((n - 1) // 16 // plan.c) * plan.d + slot) + 1 FROM z JOIN plan ON plan.source = z.source AND plan.turn = ((n - 1) // 16) % z.c), 0) AS slots,
  (SELECT min((((n // 16) // plan.c) * plan.d + slot) * 16 + n % 16) FROM z JOIN plan ON plan.source = z.source AND plan.turn = (n // 16) % z.c) AS e),
late AS (SELECT source, CAST(coalesce(sum((n + 15) // 16) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS skip FROM t WHERE w IS NULL),
p AS (SELECT doc_id, r.source, rank, plan.source IS NOT NULL AS on_plan, CASE WHEN plan.source IS NULL THEN ends.slots + skip + rank // 16 ELSE ((rank // 16) // plan.c) * plan.d + plan.slot END AS slot
  FROM r LEFT JOIN z ON z.source = r.src LEFT JOIN plan ON plan.source = r.src AND plan.turn = (rank // 16) % z.c LEFT JOIN late ON late.source = r.src, ends)
SELECT doc_id, source, rank // 16 AS block, slot, slot * 16 + rank % 16 AS position, coalesce(on_plan AND slot * 16 + rank % 16 < e, false) AS on_target FROM p, ends
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import token_counts

    return token_counts(C.table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(C.table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


#: All pairs, for the scale of the check.
OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS node, vec_id AS comp FROM v UNION SELECT l.b, r.comp FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(comp) AS comp FROM r GROUP BY node)
SELECT vec_id, coalesce(n, 0) AS n_links, comp AS component_id, vec_id = comp AS kept FROM v JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest_neighbours

    vectors = C.table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


#: Fixed values of the contract, as (verdict, host/path).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Pages that carry a telephone number put their url on the list.
PHONE = r"\+1 \([0-9]{3}\) 555-"


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the canonical urls of all pages with a telephone number: it grows with the table."""
    from .url_filter import canonical, filter_urls

    pages = C.table(spark, sf_dir, "pages", "page_id", "url", "html")
    listed = pages.where(F.col("html").rlike(PHONE)).select(canonical(F.col("url")).alias("canonical"))
    return filter_urls(pages.select("page_id", "url"), listed, RULES)


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, html, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
    || regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1) END AS canonical,
    CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
         WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM p),
l AS (SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND regexp_matches(html, '\+1 \([0-9]{3}\) 555-'))
SELECT page_id, host, path, rule, l.canonical IS NOT NULL AS listed,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM c LEFT JOIN l ON c.canonical = l.canonical
""".replace("\\\\", "\\")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(C.table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_join

    docs = C.table(spark, sf_dir, "documents", "doc_id", "text")
    return ngram_jaccard_join(docs).select("doc_id", "n_shingles", "component_id")


#: All pairs with a shingle in common, for the scale of the check.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS node, doc_id AS comp FROM documents UNION SELECT l.b, r.comp FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(comp) AS comp FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, comp AS component_id FROM w JOIN c ON node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(C.table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(C.table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_texts

    return score_texts(C.table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import ranked_search

    return ranked_search(C.table(spark, sf_dir, "documents", "doc_id", "text"), C.table(spark, sf_dir, "benchmark", "item_id", "text"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
f AS (SELECT doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM f),
p AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM f) GROUP BY ALL),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal_data import personal_data

    return personal_data(C.table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_in_middle, restore

    cut = fill_in_middle(C.table(spark, sf_dir, "documents", "doc_id", "text"))
    hashes = [F.sha2(x, 256).alias(n) for n, x in (("output_sha256", F.col("output")), ("restored_sha256", restore(F.col("output"), F.col("form"))))]
    return cut.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS k FROM d),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN k[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
x AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS z FROM c),
y AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:z], '') AS middle, array_to_string(u[z + 1:], '') AS suffix FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM y
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op3_embedding_dedup": OP3_SQL, "op5_url_filter": OP5_SQL, "op7_ngram_jaccard_join": OP7_SQL, "op8_warc": OP8_SQL, "op11_ranked_search": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
