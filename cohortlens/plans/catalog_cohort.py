"""Queries over cohorts, raters, sources and sinks, each with its SQL.

Stand-ins: labelled documents are cases (cluster = label of the vector with the same number, endpoint = quality, split by parity), their language the reported
syndrome; conversations are papers. Sinks are written to a new folder and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X, text as S
from ..operators import inference as I, relational as R, vectors as V
from ..sources import config as C, services, tables as T
from ..streaming import ingest as N
from . import api, cohort as K, raters as A
from .catalog import CELLS, TERMS, URN, _cases, query, r6, sample_sql, t
from .catalog_documents import LEAK, _guarded, sql_turns, turns

CASE = """c AS (SELECT doc_id, e.label AS cluster, CASE WHEN doc_id % 2 = 0 THEN 'discovery' ELSE 'confirmation' END AS split, quality = 1 AS y, lang AS syndrome, toxic FROM labels JOIN embeddings e ON vec_id = doc_id JOIN documents USING (doc_id))"""


def _labelled(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster"))
    x = t(spark, d, "labels").join(e, "doc_id").join(t(spark, d, "documents").select("doc_id", F.col("lang").alias("syndrome")), "doc_id")
    return x.select("doc_id", "cluster", F.when(F.col("doc_id") % 2 == 0, "discovery").otherwise("confirmation").alias("split"), (F.col("quality") == 1).alias("y"), "syndrome", "toxic")


# ---- cohorts ----


@query(f"""WITH {CASE}, k AS (SELECT unnest(range(12)) AS cluster), s AS (SELECT split, avg(CAST(y AS INT)) AS share FROM c GROUP BY split)
SELECT s.split, CAST(k.cluster AS INT) AS cluster, count(c.doc_id) AS n_cases, CAST(count(*) FILTER (WHERE y) AS BIGINT) AS ppa_cases, round(avg(CAST(y AS INT)), 6) AS ppa_share, round(any_value(share), 6) AS ppa_share_split
FROM s CROSS JOIN k LEFT JOIN c ON c.split = s.split AND c.cluster = k.cluster GROUP BY s.split, k.cluster""")
def cluster_summary(spark, d):
    s = K.cluster_summary(_labelled(spark, d).withColumn("cluster", F.col("cluster").cast("int")), "split", "cluster", F.col("y"), 12)
    return s.withColumn("ppa_share", r6("ppa_share")).withColumn("ppa_share_split", r6("ppa_share_split"))


WILSON = """round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n))), 6) AS wilson_low,
  round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n))), 6) AS wilson_high"""
RATIO = "round(((a + 0.5e0) / (a + b + 1)) / ((a + c + 1) / (a + b + c + d + 2)), 6) AS rr, round(((a + 0.5e0) * (d + 0.5e0)) / ((b + 0.5e0) * (c + 0.5e0)), 6) AS odds_ratio"


@query(f"""WITH {CASE}, u AS (SELECT * FROM c UNION ALL SELECT * REPLACE ('pooled' AS split) FROM c), g AS (SELECT split, cluster, count(*) AS m, count(*) FILTER (WHERE y) AS a FROM u GROUP BY ALL),
h AS (SELECT *, m - a AS b, CAST(sum(a) OVER w AS BIGINT) - a AS c, CAST(sum(m - a) OVER w AS BIGINT) - (m - a) AS d, a / m AS p, CAST(m AS DOUBLE) AS n, 1.959963984540054 AS z FROM g WINDOW w AS (PARTITION BY split))
SELECT split, cluster, m AS n_cases, a AS positive_n, round(p, 6) AS share, {WILSON}, {RATIO} FROM h""")
def precision(spark, d):
    p = K.precision(_labelled(spark, d), "split", "cluster", F.col("y"))
    return p.select("split", "cluster", "n_cases", "positive_n", *(r6(c).alias(c) for c in ("share", "wilson_low", "wilson_high", "rr", "odds_ratio")))


ENDPOINTS = ["de", "en", "es", "fr"]


@query(f"""WITH RECURSIVE {CASE}, e AS (SELECT unnest({ENDPOINTS}) AS endpoint), s AS (SELECT endpoint, cluster, avg(CAST(coalesce(syndrome = endpoint, false) AS INT)) AS share FROM c, e WHERE split = 'discovery' GROUP BY ALL),
top AS (SELECT endpoint, cluster, share FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY share DESC, cluster) AS r FROM s) WHERE r = 1), f AS (SELECT doc_id, cluster, syndrome FROM c WHERE split = 'confirmation'),
counts AS (SELECT endpoint, cluster, count(*) AS n, count(*) FILTER (WHERE syndrome = endpoint) AS y FROM f, e GROUP BY ALL),
{URN.format(group="endpoint", draws=40)},
obs AS (SELECT endpoint, cluster, n AS n_cases, y AS observed FROM counts),
p AS (SELECT endpoint, cluster, n_cases, observed, share, count(*) FILTER (WHERE positives >= observed) AS n_ge, (1 + count(*) FILTER (WHERE positives >= observed)) / 41 AS p FROM null_ JOIN obs USING (endpoint, cluster) JOIN top USING (endpoint, cluster) GROUP BY ALL),
q AS (SELECT *, row_number() OVER (ORDER BY p, endpoint) AS r, count(*) OVER () AS m FROM p)
SELECT endpoint, cluster, n_cases, observed, round(share, 6) AS discovery_share, n_ge, round(p, 6) AS p, round(least(1, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM q""")
def endpoint_tests(spark, d):
    e = K.endpoint_tests(_labelled(spark, d), "doc_id", "split", "cluster", "syndrome", ENDPOINTS, 40)
    return e.select("endpoint", "cluster", "n_cases", "observed", r6("discovery_share").alias("discovery_share"), "n_ge", r6("p").alias("p"), r6("confirmation_q_bh_fdr").alias("q"))


#: Endpoints with their clusters as after the tests; the third one does not pass.
PASSED = [("en", 3, 0.01, 0.02, True), ("fr", 0, 0.02, 0.02, True), ("de", 1, 0.5, 0.5, False)]


@query(f"""WITH {CASE}, u AS (SELECT * FROM c UNION ALL SELECT * REPLACE ('pooled' AS split) FROM c), e AS (SELECT * FROM (VALUES ('en', 3), ('fr', 0)) AS x(endpoint, target)),
g AS (SELECT endpoint, split, target, count(*) AS n_total, count(*) FILTER (WHERE cluster = target) AS n_cluster, count(*) FILTER (WHERE syndrome = endpoint) AS pos_total, count(*) FILTER (WHERE cluster = target AND syndrome = endpoint) AS a FROM u, e GROUP BY ALL),
h AS (SELECT *, n_cluster - a AS b, pos_total - a AS c, n_total - n_cluster - pos_total + a AS d, a / n_cluster AS p, CAST(n_cluster AS DOUBLE) AS n, 1.959963984540054 AS z FROM g)
SELECT endpoint, split, target AS target_matched_cluster, n_total, n_cluster, pos_total, a AS pos_cluster, {WILSON}, {RATIO} FROM h""")
def secondary_precision(spark, d):
    tests = spark.createDataFrame(PASSED, "endpoint string, cluster int, p double, confirmation_q_bh_fdr double, confirmation_reject_bh_fdr boolean")
    p = K.secondary_precision(_labelled(spark, d), tests, "split", "cluster", "syndrome")
    return p.select("endpoint", "split", "target_matched_cluster", "n_total", "n_cluster", "pos_total", "pos_cluster", *(r6(c).alias(c) for c in ("wilson_low", "wilson_high", "rr", "odds_ratio")))


@query(f"""WITH {CELLS}, z AS (SELECT *, split || ' ' || cluster AS scenario, CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN 0.5e0 ELSE 0e0 END AS h FROM cells), x AS (SELECT scenario, (a + h) * (d + h) / ((b + h) * (c + h)) AS o FROM z)
SELECT scenario, round(o, 6) AS odds_ratio, CAST(row_number() OVER (ORDER BY o, scenario) AS INT) AS place FROM x""")
def specification_curve(spark, d):
    c = R.two_by_two(_cases(spark, d), ["split"], "cluster", F.col("y")).withColumn("scenario", F.concat_ws(" ", "split", "cluster"))
    return K.specification_curve(c, "scenario").select("scenario", r6("odds_ratio").alias("odds_ratio"), "place")


@query(f"""WITH {CASE}, s AS (SELECT split, cluster, avg(CAST(y AS INT)) AS share, count(*) AS n_cases FROM c GROUP BY ALL), m AS (SELECT *, max(share) OVER (PARTITION BY split) AS best FROM s)
SELECT split, cluster, round(share, 6) AS share, n_cases FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY cluster) AS r FROM m WHERE share >= best - 0.2 * abs(best)) WHERE r = 1""")
def top_cluster_near(spark, d):
    return R.top_cluster(_labelled(spark, d), ["split"], "cluster", F.col("y"), (0.0, 0.2)).withColumn("share", r6("share"))


@query("SELECT event_type AS run, count(*) FILTER (WHERE value > 10) AS n_rr_above_1, count(value) AS n_rr, min(value) AS min_q FROM events GROUP BY 1")
def direction_summary(spark, d):
    e = t(spark, d, "events").select(F.col("event_type").alias("run"), (F.col("value") / 10).alias("rr"), F.col("value").alias("q"))
    return R.direction_summary(e, "run", "rr", "q")


@query(f"SELECT {sql_turns('event_id', ['ValueError', 'TimeoutError', 'bare'])} AS error_type, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def error_counts(spark, d):
    e = t(spark, d, "events").withColumn("error", F.when(F.col("event_type") == "error", turns("event_id", ["ValueError: a", "TimeoutError: b: c", "bare"])))
    return R.error_counts(e, "error", S.error_type)


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def combination_counts(spark, d):
    return R.value_counts(t(spark, d, "documents"), ["lang", "source"])


@query("""WITH g AS (SELECT label AS patient, avg(CAST(vec_id % 3 = 0 AS INT)) >= 0.5 AS flag, count(*) AS n_notes, min(vec_id) AS first_note, bool_or(vec_id % 3 = 0) AND NOT bool_and(vec_id % 3 = 0) AS mixed_labels FROM embeddings GROUP BY label),
v AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings), m AS (SELECT label, p, avg(CAST(x AS DOUBLE)) AS m FROM v GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1)
SELECT patient, flag, n_notes, first_note, mixed_labels, round(m / n, 6) AS second FROM g JOIN m ON m.label = patient AND p = 2 JOIN n ON n.label = patient""")
def pooled_notes(spark, d):
    notes = t(spark, d, "embeddings").select(F.col("label").alias("patient"), "embedding", (F.col("vec_id") % 3 == 0).alias("flag"), F.col("vec_id").alias("note"))
    p = K.pooled_notes(notes, "patient", "embedding", "flag", "note")
    return p.select("patient", "flag", "n_notes", F.col("first_note").alias("first_note"), "mixed_labels", r6(F.col("embedding")[1]).alias("second"))


@query("SELECT vec_id, row_number() OVER (ORDER BY label, embedding[1] DESC, vec_id) AS place FROM embeddings")
def rank_in_cluster(spark, d):
    e = t(spark, d, "embeddings").withColumn("p", F.col("embedding")[0])
    return V.rank_in_cluster(e, "label", "p", "vec_id").select("vec_id", "place")


REPLICATES = "a AS (SELECT r AS replicate, vec_id, CAST(CASE WHEN vec_id % (5 + r) = 0 THEN (label + 1) % 10 ELSE label END AS INT) AS cluster, CAST(label AS INT) AS baseline FROM embeddings, (SELECT unnest(range(4)) AS r))"


def _replicates(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("replicate"))
    return e.select("replicate", "vec_id", F.when(F.col("vec_id") % (5 + F.col("replicate")) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int").alias("cluster"), F.col("label").cast("int").alias("baseline"))


@query(f"""WITH {REPLICATES}, y AS (SELECT a.*, vec_id % 4 = 0 AS y FROM a), n AS (SELECT replicate, cluster, baseline, count(*) AS n FROM a GROUP BY ALL),
i AS (SELECT replicate, sum(n * (n - 1) / 2) AS ij FROM n GROUP BY 1), j AS (SELECT replicate, sum(s * (s - 1) / 2) AS i FROM (SELECT replicate, cluster, sum(n) AS s FROM n GROUP BY ALL) GROUP BY 1),
k AS (SELECT replicate, sum(s * (s - 1) / 2) AS j FROM (SELECT replicate, baseline, sum(n) AS s FROM n GROUP BY ALL) GROUP BY 1), w AS (SELECT replicate, sum(n) * (sum(n) - 1) / 2 AS t FROM n GROUP BY 1),
g AS (SELECT replicate, count(*) FILTER (WHERE cluster = 2 AND baseline = 2) / count(*) FILTER (WHERE cluster = 2 OR baseline = 2) AS jac, count(*) FILTER (WHERE cluster = 2) AS size, count(*) FILTER (WHERE cluster = 2 AND y) AS a,
  count(*) FILTER (WHERE cluster = 2 AND NOT y) AS b, count(*) FILTER (WHERE cluster <> 2 AND y) AS c, count(*) FILTER (WHERE cluster <> 2 AND NOT y) AS d FROM y GROUP BY 1)
SELECT CAST(replicate AS INT) AS replicate, round((ij - i * j / t) / ((i + j) / 2 - i * j / t), 6) AS ari_vs_baseline, round(jac, 6) AS jaccard_language_membership, size AS language_cluster_size, round(a / (a + b), 6) AS share_language_cluster,
  round(((a + 0.5e0) / (a + b + 1)) / ((a + c + 1) / (a + b + c + d + 2)), 6) AS rr FROM i JOIN j USING (replicate) JOIN k USING (replicate) JOIN w USING (replicate) JOIN g USING (replicate)""")
def stability_report(spark, d):
    """Agreement, overlap and ratio of given replicates."""
    y = t(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 4 == 0).alias("y"))
    s = K.stability_report(_replicates(spark, d), y, "vec_id", "y", 2)
    return s.select("replicate", r6("ari_vs_baseline").alias("ari_vs_baseline"), r6("jaccard_language_membership").alias("jaccard_language_membership"), "language_cluster_size", r6("share_language_cluster").alias("share_language_cluster"), r6("rr").alias("rr"))


@query(f"WITH {REPLICATES} SELECT vec_id, round(avg(CAST(cluster = 2 AS INT)), 6) AS probability, avg(CAST(cluster = 2 AS INT)) >= 0.8 AS core FROM a GROUP BY vec_id")
def membership(spark, d):
    return V.membership(_replicates(spark, d), "vec_id", F.col("cluster") == 2).withColumn("probability", r6("probability"))


LABELLED = """lab AS (SELECT conv_id AS pmcid, 'case_' || turn % 2 AS case_id, turn AS ingest_seq, CASE (conv_id + turn) % 3 WHEN 0 THEN 'exclude' WHEN 1 THEN 'ftld_strict' ELSE 'ftld_broad' END AS tier, CASE conv_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'confirmation' ELSE 'discovery' END AS split FROM conversations),
latest AS (SELECT pmcid, case_id, arg_max(tier, ingest_seq) AS tier, any_value(split) AS split FROM lab GROUP BY ALL), tier AS (SELECT * FROM latest WHERE tier = 'ftld_strict' AND split IS NOT NULL),
seg AS (SELECT conv_id AS pmcid, 'case_' || turn % 2 AS case_id, count(*) AS n FROM conversations WHERE role <> 'system' AND (conv_id + turn) % 4 > 0 GROUP BY ALL),
txt AS (SELECT tier.*, coalesce(n, 0) AS n_segments FROM tier LEFT JOIN seg USING (pmcid, case_id)), enough AS (SELECT * FROM txt WHERE n_segments >= 2), cases AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pmcid ORDER BY case_id) AS r FROM enough) WHERE r = 1)"""


def _eligible(spark, d):
    c = t(spark, d, "conversations").select("*", F.col("conv_id").alias("pmcid"), F.concat(F.lit("case_"), F.col("turn") % 2).alias("case_id"))
    k = (F.col("conv_id") + F.col("turn")).alias("k")
    labels = c.withColumn("k", k).select("pmcid", "case_id", F.col("turn").alias("ingest_seq"), turns("k", ["exclude", "ftld_strict", "ftld_broad"]).alias("ftld_inclusion_tier"), F.lit("svPPA").alias("ftld_syndrome_reported"), turns("conv_id", [None, "confirmation", "discovery", "discovery", "discovery"]).alias("split"))
    segments = c.withColumn("k", k).select("pmcid", "case_id", (F.col("role") != "system").alias("include_for_embedding"), F.when(F.col("k") % 4 == 0, " ").otherwise(F.col("text")).alias("text_clean"), F.lit(0).alias("leakage_n_matches_clean"))
    return K.eligible_cases(labels, segments, min_segments=2)


@query(f"WITH {LABELLED} SELECT pmcid, case_id, split, n_segments FROM cases")
def eligible_cases(spark, d):
    return _eligible(spark, d)[0].select("pmcid", "case_id", "split", "n_segments")


@query(f"""WITH {LABELLED}, s AS (SELECT 0 AS step_no, 'labelled' AS step, split FROM latest UNION ALL SELECT 1, 'tier_and_split', split FROM tier UNION ALL SELECT 2, 'with_text', split FROM txt WHERE n_segments > 0
  UNION ALL SELECT 3, 'enough_segments', split FROM enough UNION ALL SELECT 4, 'analysed', split FROM cases)
SELECT step_no, step, count(*) AS n_total, count(*) FILTER (WHERE split = 'discovery') AS n_discovery, count(*) FILTER (WHERE split = 'confirmation') AS n_confirmation FROM s GROUP BY ALL""")
def eligible_flow(spark, d):
    return _eligible(spark, d)[1]


# ---- raters ----


RELABELLED = """c AS (SELECT CASE WHEN length(text) % 2 = 0 THEN 'discovery' ELSE 'confirmation' END AS split, doc_id % 5 AS cluster,
  CASE WHEN length(text) % 7 > 0 THEN toxic = 1 ELSE quality = 1 END AS y FROM labels JOIN documents USING (doc_id) WHERE text IS NOT NULL AND NOT (length(text) % 7 > 0 AND length(text) % 3 = 0)),
 k AS (SELECT split, cluster, count(*) AS n, count(*) FILTER (WHERE y) AS a FROM c GROUP BY ALL), l AS (SELECT cluster FROM k WHERE split = 'discovery' ORDER BY a / n DESC, cluster LIMIT 1),
 s AS (SELECT split, sum(n) AS m, sum(a) AS p, sum(n) FILTER (WHERE cluster = (FROM l)) AS n, sum(a) FILTER (WHERE cluster = (FROM l)) AS a FROM k GROUP BY split),
 e AS (SELECT split, m, a / n AS share, ((a + 0.5) / (n + 1)) / ((p + 1) / (m + 2)) AS rr, (a + 0.5) * (m - n - p + a + 0.5) / ((n - a + 0.5) * (p - a + 0.5)) AS o FROM s)"""


@query(f"""WITH {RELABELLED} SELECT (FROM l) AS language_cluster, CAST(d.m AS BIGINT) AS discovery_n, CAST(f.m AS BIGINT) AS confirmation_n, round(d.share, 6) AS discovery_share, round(f.share, 6) AS confirmation_share,
 round(d.rr, 6) AS discovery_rr, round(f.rr, 6) AS confirmation_rr, round(d.o, 6) AS discovery_or, round(f.o, 6) AS confirmation_or FROM e d, e f WHERE d.split = 'discovery' AND f.split = 'confirmation'""")
def relabelled_summary(spark, d):
    """Documents as cases, one label as the endpoint and the other as its rating, split and adequacy by the text's length."""
    x = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "text"), "doc_id").where("text IS NOT NULL")
    size = F.length("text")
    cases = x.select("doc_id", F.when(size % 2 == 0, "discovery").otherwise("confirmation").alias("split"), (F.col("doc_id") % 5).alias("cluster"), (F.col("quality") == 1).alias("is_ppa"))
    ratings = x.select("doc_id", (size % 7 > 0).cast("int").alias("text_adequate"), F.col("toxic").alias("is_ppa"), (size % 3 > 0).cast("int").alias("is_ftld_spectrum"))
    s = A.relabel_study(cases, ratings, ["doc_id"], "split", "cluster", exclude_non_spectrum=True, draws=100)["summary"]
    both = [(f"{p}_{a}", f"{p}_{b}") for p in ("discovery", "confirmation") for a, b in (("share_cluster", "share"), ("rr", "rr"), ("odds_ratio", "or"))]
    return s.select("language_cluster", "discovery_n", "confirmation_n", *(F.round(F.col(a), 6).alias(b) for a, b in both))


@query(f"""WITH d AS (SELECT doc_id, coalesce(lang, 'missing') || '|' || quality AS s, CAST(doc_id AS VARCHAR) AS k FROM labels JOIN documents USING (doc_id)), {sample_sql('d', 100, 'z')}
SELECT doc_id, printf('RAT%04d', row_number() OVER (ORDER BY md5('42:' || k), k)) AS case_uid FROM z""")
def rater_sample(spark, d):
    x = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return A.rater_sample(x, ["lang", "quality"], ["doc_id"], 100).select("doc_id", "case_uid")


@query(f"""WITH {CASE}, d AS (SELECT doc_id, split || '|' || cluster AS s, doc_id || ':case_1' AS k FROM c), {sample_sql('d', 200, 'z')}, y AS (SELECT * FROM z), {sample_sql('y', 120, 'w')}
SELECT doc_id, printf('RAT%04d', row_number() OVER (ORDER BY md5('42:' || k), k)) AS case_uid FROM w""")
def rater_subset(spark, d):
    c = _labelled(spark, d).select("doc_id", "split", "cluster", F.col("doc_id").cast("string").alias("pmcid"), F.lit("case_1").alias("case_id"))
    return api.subset_rater_sample(A.rater_sample(c, ["split", "cluster"], ["pmcid", "case_id"], 200)).select("doc_id", "case_uid")


RATERS = "p AS (SELECT 'C' || doc_id AS case_uid, CASE WHEN doc_id % 4 > 0 THEN 1 ELSE 0 END AS t1, CASE WHEN doc_id % 5 > 0 THEN 1 ELSE 0 END AS t2, CASE WHEN doc_id % 7 > 0 THEN quality END AS e1, toxic AS e2 FROM labels)"
_COUNT = "count(*) FILTER (WHERE x = 1 AND y = 1) AS a, count(*) FILTER (WHERE x = 1 AND y = 0) AS b, count(*) FILTER (WHERE x = 0 AND y = 1) AS c, count(*) FILTER (WHERE x = 0 AND y = 0) AS d"


def _two_raters(spark, d):
    x = t(spark, d, "labels").withColumn("case_uid", F.concat(F.lit("C"), "doc_id"))
    side = lambda m, e: x.select("case_uid", F.when(F.col("doc_id") % m > 0, "1").otherwise("0.0").alias("text_adequate"), e.cast("string").alias("is_ppa"))
    return side(4, F.when(F.col("doc_id") % 7 > 0, F.col("quality"))), side(5, F.col("toxic"))


@query(f"""WITH {RATERS}, l AS (SELECT 'text_adequate' AS field, t1 AS x, t2 AS y FROM p UNION ALL SELECT 'is_ppa', e1, e2 FROM p WHERE t1 = 1 AND t2 = 1), g AS (SELECT field, {_COUNT} FROM l GROUP BY field),
r AS (SELECT field, a + b + c + d AS n, (a + d) / (a + b + c + d) AS po, (a + b) / (a + b + c + d) AS r1, (a + c) / (a + b + c + d) AS r2 FROM g), s AS (SELECT *, r1 * r2 + (1 - r1) * (1 - r2) AS pe FROM r)
SELECT field, n AS n_pairs, round((po - pe) / (1 - pe), 6) AS kappa, round(po, 6) AS agreement, round(r1, 6) AS r1_positive_rate, round(r2, 6) AS r2_positive_rate FROM s""")
def rater_scores(spark, d):
    k = A.score(*_two_raters(spark, d), ["text_adequate", "is_ppa"])[0]
    return k.select("field", "n_pairs", *(r6(c).alias(c) for c in k.columns[2:]))


@query(f"WITH {RATERS} SELECT case_uid, t1 AS text_adequate_r1, t2 AS text_adequate_r2, e1 AS is_ppa_r1, e2 AS is_ppa_r2 FROM p WHERE t1 <> t2 OR coalesce(e1 <> e2, false)")
def rater_sheet(spark, d):
    return A.score(*_two_raters(spark, d), ["text_adequate", "is_ppa"])[1].select("case_uid", "text_adequate_r1", "text_adequate_r2", "is_ppa_r1", "is_ppa_r2")


@query(f"WITH {RATERS} SELECT case_uid FROM p WHERE t1 <> t2 OR e1 IS DISTINCT FROM e2")
def needs_adjudication(spark, d):
    f = ["text_adequate", "is_ppa"]
    return A.paired(*_two_raters(spark, d), f).where(I.needs_adjudication(f)).select("case_uid")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN toxic = 1 ELSE quality = 1 END AS is_ppa, CASE WHEN doc_id % 3 > 0 THEN 'override' ELSE 'base' END AS label_source FROM labels WHERE NOT (doc_id % 3 > 0 AND doc_id % 7 = 0)""")
def rater_relabel(spark, d):
    x = t(spark, d, "labels")
    cases = x.select("doc_id", (F.col("quality") == 1).alias("is_ppa"))
    ratings = x.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("text_adequate"), F.col("toxic").alias("is_ppa"), (F.col("doc_id") % 7 > 0).cast("int").alias("is_ftld_spectrum"))
    return A.relabel(cases, ratings, ["doc_id"], True)


@query(f"""WITH d AS (SELECT doc_id, coalesce(lang, 'missing') || '|' || quality AS s, lang, quality, CAST(doc_id AS VARCHAR) AS k FROM labels JOIN documents USING (doc_id)), {sample_sql('d', 100, 'z')}
SELECT d.lang, d.quality, count(*) AS population_n, count(z.k) AS sample_n FROM d LEFT JOIN z USING (doc_id) GROUP BY ALL""")
def rater_coverage(spark, d):
    x = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return A.coverage(A.rater_sample(x, ["lang", "quality"], ["doc_id"], 100), x, ["lang", "quality"])


# ---- curated tables and registry ----


@query(f"""WITH d AS (SELECT doc_id, text, regexp_replace(text, '[^\\x00-\\x7F]', 'z', 'g') AS plain FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(plain, '{LEAK}')) AS INT) AS leakage_n_matches_raw, CAST(0 AS INT) AS leakage_n_matches_clean, CAST(len(regexp_extract_all(plain, '{LEAK}')) AS INT) AS n_listed FROM d""")
def leakage_audit(spark, d):
    a = api.audit(t(spark, d, "documents").withColumnRenamed("text", "Description"), TERMS)
    return a.select("doc_id", "leakage_n_matches_raw", "leakage_n_matches_clean", F.size("leakage_matches").alias("n_listed"))


@query(f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace({_guarded('text')}, '{LEAK}', ' ', 'g'), '_([^\\x00-\\x7F])_', '\\1', 'g'), '\\s+', ' ', 'g'))) AS text_md5 FROM documents WHERE doc_id % 9 > 0""")
def make_curated(spark, d):
    """Derived columns go, blank texts go, terms are redacted."""
    x = t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.col("text")).alias("Description"), F.lit(1).alias("derived_flag"))
    return api.make_curated(x, TERMS, ["derived_"]).withColumn("text_md5", F.md5("Description")).drop("Description")


@query("""SELECT p_partkey, left(sha1(p_type || chr(10) || p_brand || chr(10) || p_name), 16) AS row_id FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') AND p_partkey % 7 > 0 AND p_partkey % 5 > 0""")
def load_curated(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_type").alias("Temporal_Stage"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_brand")).alias("Subtype"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")).otherwise("  ").alias("Description"))
    return T.load_curated(p, ["ECONOMY", "STANDARD"]).select("p_partkey", "row_id")


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def resolved_columns(spark, d):
    c = t(spark, d, "customer")
    found = C.resolve_columns(c.columns, {"id": ["custkey", "C_CUSTKEY"], "name": ["c_name"], "balance": ["none", "c_AcctBal"]}, ["id", "name"])
    return c.select(*(F.col(v).alias(k) for k, v in found.items()))


def _registry(spark, d):
    c = t(spark, d, "customer")
    return c.select(F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit("PMC"), F.col("c_custkey") % 900)).otherwise("").alias("pmcid"), "c_custkey", F.when(F.col("c_custkey") % 3 > 0, 2000 + F.col("c_custkey") % 20).alias("year"), F.when(F.col("c_custkey") % 6 > 0, F.concat("c_mktsegment", F.lit(" A"))).alias("first_author"), F.concat(F.lit(" On: "), "c_mktsegment", F.lit(" (a note)?")).alias("title"))


@query("""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN 'PMC' || c_custkey % 900 ELSE 'PMC-' || c_custkey END AS pmcid, CASE WHEN c_custkey % 3 > 0 THEN CAST(2000 + c_custkey % 20 AS VARCHAR) ELSE 'YEAR_UNKNOWN' END AS y, CASE WHEN c_custkey % 6 > 0 THEN c_mktsegment ELSE 'Author' END AS a, 'On_' || c_mktsegment || '_a_note' AS t FROM customer),
s AS (SELECT *, pmcid || '__' || left(y, 10) || '__' || a || '__' || t AS stem FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY pmcid, c_custkey) - 1 AS i FROM s)
SELECT stem || CASE WHEN i > 0 THEN '__dup' || i ELSE '' END || '.pdf' AS file, count(*) AS n FROM k GROUP BY 1""")
def manifest(spark, d):
    r = _registry(spark, d).withColumn("pmcid", F.when(F.col("pmcid") == "", F.concat(F.lit("PMC-"), "c_custkey")).otherwise(F.col("pmcid")))
    return T.manifest(r).groupBy(F.col("suggested_pdf_filename").alias("file")).agg(F.count("*").alias("n"))


_REGISTRY = "r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN 'PMC' || c_custkey END AS pmcid, CASE WHEN c_custkey % 3 > 0 THEN 2000 + c_custkey % 20 END AS year FROM customer)"


@query(f"WITH {_REGISTRY} SELECT * FROM (SELECT pmcid, 'latest' AS how FROM r WHERE pmcid IS NOT NULL ORDER BY year DESC NULLS LAST, pmcid LIMIT 50) UNION ALL SELECT * FROM (SELECT pmcid, 'random' FROM r WHERE pmcid IS NOT NULL ORDER BY md5('7:' || pmcid), pmcid LIMIT 50)")
def to_fetch(spark, d):
    """Fifty of the registry, by either choice (a sampling operator)."""
    r = _registry(spark, d).withColumn("pmcid", F.when(F.col("pmcid") != "", F.concat(F.lit("PMC"), "c_custkey")).otherwise(""))
    return R.union_tagged({"latest": api.to_fetch(r, 50).select("pmcid"), "random": api.to_fetch(r, 50, "random", 7).select("pmcid")}, "how")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS uid, 'PMC' || c_custkey AS pmcid, CASE WHEN c_custkey % 2 = 0 THEN '10.1/' || c_custkey END AS doi, CAST(1990 + c_custkey % 30 AS VARCHAR) AS year, 'q one' AS query_term,
  CASE WHEN c_custkey % 3 > 0 THEN 'First ' || c_custkey END AS first_author, 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || c_custkey || '/pdf/' AS pdf_url, CAST((SELECT count(*) FROM customer) AS VARCHAR) AS ncbi_total_count FROM customer WHERE c_custkey % 10 > 0""")
def registry_search(spark, d):
    """A paged search that finds as many records as there are customers, and their summaries; every tenth has none."""
    n = t(spark, d, "customer").count()

    def summaries(ids):
        return {u: {"articleids": [{"idtype": "PmcId", "value": f"PMC{u}"}] + ([{"idtype": "doi", "value": f"10.1/{u}"}] if int(u) % 2 == 0 else []), "pubdate": f"{1990 + int(u) % 30} Jan", "authors": [{"name": f"First {u}"}, {"name": "Second"}] if int(u) % 3 else []} for u in ids if int(u) % 10}

    found = services.paged_search(spark, "q", lambda term, at, size: [str(i) for i in range(at, min(n, at + size))], lambda term: n, 400)
    rows = services.registry_rows(found, summaries, "q1", " q  one ", n, 100)
    return rows.select("uid", "pmcid", "doi", "year", "query_term", "first_author", "pdf_url", "ncbi_total_count")


@query("""WITH p AS (SELECT page_id, split_part(split_part(url, '://', 2), '?', 1) AS u FROM pages), n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'results/' WHEN 1 THEN 'manuscript/' ELSE '' END || u || CASE WHEN length(u) % 3 = 0 THEN '/Rater.CSV' WHEN length(u) % 3 = 1 THEN '.pkl' ELSE '/x.txt' END AS path FROM p)
SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'manuscript' WHEN regexp_matches(path, '[^/][.]pkl$') THEN 'file type' WHEN page_id % 4 = 0 THEN 'data or results' ELSE 'ratings' END AS rule
FROM n WHERE path IS NOT NULL AND (page_id % 4 < 2 OR regexp_matches(path, '[^/][.]pkl$') OR path LIKE '%.CSV')""")
def disclosure_audit(spark, d):
    """Paths made of the pages' urls, with folders and endings; a name that is an ending only, like ``.pkl``, has none."""
    u = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1))
    folder = F.when(F.col("page_id") % 4 == 0, "results/").when(F.col("page_id") % 4 == 1, "manuscript/").otherwise("")
    ending = F.when(F.length(u) % 3 == 0, "/Rater.CSV").when(F.length(u) % 3 == 1, ".pkl").otherwise("/x.txt")
    p = t(spark, d, "pages").select("page_id", F.concat(folder, u, ending).alias("path"))
    return p.join(T.disclosure_audit(p.select("path").distinct()), "path").select("page_id", "rule")


PATHS = ["data/raw/a.csv", "docs/a.XLSX", "src/segments.csv", "results/README.md", "src/a.py", "x/model.pkl"]


@query(f"SELECT c_custkey, {sql_turns('c_custkey', ['data or results', 'forbidden extension', 'forbidden name', None, None, 'forbidden extension'])} AS reason FROM customer WHERE c_custkey % 6 NOT IN (3, 4)")
def disclosure_findings(spark, d):
    p = t(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey", F.lit("/"), turns("c_custkey", PATHS)).alias("path"))
    return T.disclosure_findings(p).select(F.regexp_extract("path", "^c([0-9]+)/", 1).cast("long").alias("c_custkey"), "reason")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn DESC) AS text FROM conversations WHERE turn < 3 GROUP BY conv_id")
def looked_up_texts(spark, d):
    c = t(spark, d, "conversations").withColumn("id", F.concat_ws("_", "conv_id", "turn"))
    lists = c.where("turn < 3").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "id")), False), lambda x: x["id"]).alias("ids"))
    return R.lookup_rows(lists, ["conv_id"], "ids", c.drop("conv_id"), "id", "text")


@query("SELECT c_custkey, c_mktsegment, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 10000 END AS INT) AS number FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')")
def restricted_order(spark, d):
    """Listed segments only, as all of them are there; a list with one that isn't leaves the table as it is."""
    c = t(spark, d, "customer")
    kept = R.restrict_to(R.restrict_to(c, "c_mktsegment", ["MACHINERY", "BUILDING"]), "c_mktsegment", ["BUILDING", "NONE"])
    return kept.select("c_custkey", "c_mktsegment", R.case_number(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("case_"), "c_custkey")).otherwise("case_x")).alias("number"))


@query("SELECT c_mktsegment, c_custkey FROM customer ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, c_mktsegment, c_custkey LIMIT 1")
def first_in_order(spark, d):
    """The first row in an explicit order (a top-1 report)."""
    c = t(spark, d, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("c_custkey"))
    return R.reorder_by(c, "c_mktsegment", ["MACHINERY", "BUILDING"]).limit(1)


# ---- sinks, read back ----


@query("SELECT CAST(c_custkey AS VARCHAR) AS uid, 'PMC' || c_custkey AS pmcid, c_name || ', \"A\"' || chr(10) || 'b' AS title FROM customer")
def csv_round_trip(spark, d):
    """Quotes, commas and line ends survive; only the declared columns that are asked for come back."""
    at = T.scratch(spark)
    names = T.REGISTRY.fieldNames()
    row = {"uid": F.col("c_custkey").cast("string"), "pmcid": F.concat(F.lit("PMC"), "c_custkey"), "title": F.concat("c_name", F.lit(', "A"\nb'))}
    df = t(spark, d, "customer").select(*(row.get(c, F.lit(None).cast("string")).alias(c) for c in names))
    df.write.option("header", True).option("escape", '"').csv(at)
    T.assert_columns(T.csv_header(spark, at), names, "registry")
    return T.read_csv(spark, at, T.REGISTRY, ["uid", "pmcid", "title", "none such"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0")
def published_table(spark, d):
    """A tag points at the run that was published last."""
    at = T.scratch(spark)
    n = t(spark, d, "nation").select("n_nationkey", "n_name")
    C.publish(n, at, "run1")
    C.publish(n.where("n_nationkey % 2 = 0"), at, "run2")
    return C.published(spark, at)


@query("SELECT 'PMC' || conv_id % 20 AS pmcid, conv_id, turn FROM conversations")
def blocks_written_once(spark, d):
    """Documents that are there already are left out when the rest is written."""
    at = T.scratch(spark)
    b = t(spark, d, "conversations").select(F.concat(F.lit("PMC"), F.col("conv_id") % 20).alias("pmcid"), "conv_id", "turn")
    T.write_blocks(b.where("conv_id % 20 < 7"), None, at)
    T.write_blocks(b, spark.read.json(at), at)
    return spark.read.schema("conv_id long, turn long, pmcid string").json(at).select("pmcid", "conv_id", "turn")


@query("SELECT CAST(octet_length(encode(n_name)) + 1 AS BIGINT) AS bytes, sha256(n_name || chr(10)) AS sha256, count(*) AS n FROM nation GROUP BY ALL")
def file_checksums(spark, d):
    at = T.scratch(spark)
    n = t(spark, d, "nation")
    n.select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("k")).write.partitionBy("k").text(at)
    return T.checksums(spark, at).groupBy("bytes", "sha256").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, role FROM conversations")
def stream_once(spark, d):
    """A folder as a stream: what comes twice, again after a restart, or again after a lost checkpoint, is written once."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    at = T.scratch(spark)
    c = t(spark, d, "conversations").select("conv_id", "turn", "role")
    kind = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType())])
    for part, name in ((c.where("conv_id % 3 = 0"), "run1"), (c.where("conv_id % 3 < 2"), "run1"), (c, "run2")):
        part.union(part).write.mode("append").json(f"{at}/in")
        N.write_once(N.watch(spark, f"{at}/in", kind), ["conv_id", "turn"], f"{at}/out", f"{at}/{name}").awaitTermination()
    return N.read_once(spark, f"{at}/out")


@query("WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s FROM events GROUP BY user_id) SELECT user_id, s FROM l")
def compacted_log(spark, d):
    e = t(spark, d, "events").select("user_id", F.col("event_type").alias("s"), F.struct("ts", "event_id").alias("ingest_seq"))
    return N.compact(e, ["user_id"]).select("user_id", "s")


@query("""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s FROM events GROUP BY user_id) SELECT 'again' AS how, c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM l WHERE s = 'purchase')
UNION ALL SELECT 'new', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM l)""")
def resumed_keys(spark, d):
    keys = t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    rest = lambda again: R.pending(keys, t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", ["purchase"], again)
    return R.union_tagged({"again": rest(True), "new": rest(False)}, "how")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def event_windows(spark, d):
    return N.event_windows(t(spark, d, "events"), "ts", "1 hour", "1 day", ["event_type"])


@query("""SELECT 'PMC' || n_nationkey AS key, CASE WHEN n_nationkey % 5 = 0 THEN 'error' WHEN n_nationkey % 2 = 0 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN n_nationkey % 5 > 0 THEN CAST(octet_length(encode('PMC' || n_nationkey)) AS BIGINT) END AS bytes FROM nation""")
def fetched_files(spark, d):
    """Files that are there stay, errors are rows, a requested pause is kept."""
    class Service:
        def fetch(self, key):
            if int(key[3:]) % 5 == 0:
                raise services.RetryLater(0.001)
            return key.encode()

    at = T.scratch(spark)
    keys = t(spark, d, "nation").select(F.concat(F.lit("PMC"), "n_nationkey").alias("pmcid"), "n_nationkey")
    services.fetch_files(keys.where("n_nationkey % 2 = 0"), "pmcid", Service(), at, tries=2).write.format("noop").mode("overwrite").save()
    return services.fetch_files(keys, "pmcid", Service(), at, tries=2).select("key", "status", "bytes")


@query("SELECT '| n | name |' || chr(10) || '| - | - |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS md FROM region")
def markdown_report(spark, d):
    md = T.markdown_table(t(spark, d, "region").select(F.col("r_regionkey").alias("n"), F.col("r_name").alias("name")).orderBy("n"))
    return spark.createDataFrame([(md,)], "md string")
