"""Queries over documents, text, JSON, labels and citations, each with its SQL.

Stand-ins: conversations are papers (a turn is a block, its number names a section), labelled documents are model labels. Where a function takes
text in many spellings, rows take turns through a list of spellings, and the SQL names the expected value of each.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import fixed as X, text as S
from ..operators import labels as L, relational as R, schemas
from ..sources import documents as D, tables as T
from ..streaming import extraction as E
from . import api, raters as A
from .catalog import TERMS, query, r6, t


def turns(column, values):
    """The value whose turn it is: number ``column`` modulo their number."""
    lit = lambda v: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")
    return F.element_at(F.array(*map(lit, values)), (F.col(column) % len(values) + 1).cast("int"))


def sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list):
        return "[" + ", ".join(map(sql, v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def sql_turns(column: str, values, kind: str = "") -> str:
    """The same in SQL."""
    cases = " ".join(f"WHEN {i} THEN {sql(v)}" for i, v in enumerate(values) if v is not None)
    out = f"CASE {column} % {len(values)} {cases} END"
    return f"CAST({out} AS {kind})" if kind else out


# ---- text ----


@query(r"""SELECT doc_id, md5(trim(regexp_replace(replace(lower(trim(regexp_replace(text || ' [REDACTED]  End', '\s+', ' ', 'g'))), '[redacted]', ' '), '\s+', ' ', 'g'))) AS text_md5 FROM documents""")
def text_for_embedding(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(S.text_for_embedding(F.concat("text", F.lit(" [REDACTED]  End")))).alias("text_md5"))


@query(r"""SELECT p_partkey, trim(regexp_replace(trim(' .' || p_name || '/ ' || p_brand || '_ '), '[^A-Za-z0-9._-]', '_', 'g'), '._') AS tag FROM part""")
def tag_name(spark, d):
    return t(spark, d, "part").select("p_partkey", S.tag_name(F.concat(F.lit(" ."), "p_name", F.lit("/ "), "p_brand", F.lit("_ "))).alias("tag"))


@query("""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN 'PMC' || c_custkey END AS p FROM customer)
SELECT c_custkey, 'https://pmc.ncbi.nlm.nih.gov/articles/' || p || '/' AS pmc_url, 'https://www.ncbi.nlm.nih.gov/pmc/articles/' || p || '/' AS ncbi_pmc_url, 'https://pmc.ncbi.nlm.nih.gov/articles/' || p || '/pdf/' AS pdf_url FROM r""")
def record_urls(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("PMC"), "c_custkey")).otherwise("").alias("pmcid"))
    return T.registry_urls(c).drop("pmcid")


@query(r"""SELECT page_id, 'case-' || page_id % 3 AS article_type, position('<body' IN left(h, 200000)) > 0 AS has_body, CAST(len(regexp_extract_all(left(h, 200000), '<sec\b')) AS INT) AS n_sec_tags
FROM (SELECT page_id, '<article id="1" article-type="case-' || page_id % 3 || '"><sec>' || html AS h FROM pages)""")
def article_head_metrics(spark, d):
    h = F.concat(F.lit('<article id="1" article-type="case-'), F.col("page_id") % 3, F.lit('"><sec>'), "html")
    return t(spark, d, "pages").select("page_id", S.head_metrics(h).alias("m")).select("page_id", "m.*")


NUMBERS = ["1", "0", "1.0", " 0 ", "yes", "No", "", None, "x", "2.5", "F", "nan"]


@query(f"""SELECT doc_id, {sql_turns('doc_id', [1.0, 0.0, 1.0, 0.0, None, None, None, None, None, 2.5, None, None], 'DOUBLE')} AS number, {sql_turns('doc_id', [1, 0, 1, 0, None, None, None, None, None, None, None, None], 'INT')} AS flag,
  {sql_turns('doc_id', [True, False, True, False, True, False, False, False, True, True, False, True])} AS truth FROM documents""")
def coerced_numbers(spark, d):
    x = t(spark, d, "documents").select("doc_id", turns("doc_id", NUMBERS).alias("x"))
    number = S.to_number(F.col("x"))
    return x.select("doc_id", F.when(~F.isnan(number), number).alias("number"), S.to_binary(F.col("x")).alias("flag"), S.to_bool(F.col("x")).alias("truth"))


@query(f"""SELECT doc_id, {sql_turns('doc_id', ['tdp43', 'tdp43', 'tau', 'fus', 'other', 'other'])} AS pathology, {sql_turns('doc_id', ['C9ORF72', 'C9ORF72', 'MAPT', 'GRN', 'C9ORF72'])} AS gene,
  {sql_turns('doc_id', ['https://x/?api_key=REDACTED&db=pmc', 'https://x/?API_KEY=REDACTED', 'https://x/?db=pmc'])} AS url FROM documents""")
def domain_spellings(spark, d):
    x = t(spark, d, "documents")
    return x.select(
        "doc_id",
        S.pathology(turns("doc_id", ["TDP-43", "tdp 43 type A", "Tauopathy", "FUS", "none", ""])).alias("pathology"),
        S.gene(turns("doc_id", ["c9orf72", " C9-ORF72 ", "mapt", "GRN", "C9_ORF72"])).alias("gene"),
        S.redact_key(turns("doc_id", ["https://x/?api_key=abc&db=pmc", "https://x/?API_KEY=z9", "https://x/?db=pmc"])).alias("url"),
    )


@query(f"""SELECT event_id, {sql_turns('event_id', ['ValueError', 'TimeoutError', 'bare', None])} AS error_type, printf('%.3f', value) AS value_text, printf('%.1f%%', value / 10 * 100) AS percent,
  strftime(ts, '%Y%m%dT%H%M%SZ') AS slug FROM events""")
def report_texts(spark, d):
    e = t(spark, d, "events").withColumn("error", turns("event_id", ["ValueError: a: b", "TimeoutError:", "bare", None]))
    return e.select("event_id", S.error_type(F.col("error")).alias("error_type"), S.number_text(F.col("value")).alias("value_text"), S.percent_text(F.col("value") / 10).alias("percent"), S.run_slug(F.col("ts")).alias("slug"))


# ---- JSON and labels ----

LISTS = ['["a", " ", null, "b"]', "[]", "not json", None, '["x"]', '{"a": 1}']
OBJECTS = ['```json\n{"a": 1}\n```', 'so: {"a": {"b": 2}} done', "no object", "", None, '{"a": 1', '{"a": "}"}']


@query(f"""SELECT doc_id, {sql_turns('doc_id', ['a,b', '', '', '', 'x', ''])} AS items, {sql_turns('doc_id', ['{"a": 1}', '{"a": {"b": 2}}', None, None, None, None, '{"a": "}"}'])} AS object,
  {sql_turns('doc_id', ['PMC1', 'PMC2', None])} AS pmcid, {sql_turns('doc_id', ['mri,ct', '', 'ct'])} AS kept FROM documents""")
def json_fields(spark, d):
    x = t(spark, d, "documents")
    pair = lambda k, v: F.struct(F.lit(k).alias("idtype"), F.lit(v).alias("value"))
    ids = F.element_at(F.array(F.array(pair("doi", "10.1"), pair("PMCID", "PMC1")), F.array(pair("pmcid", "PMC2"), pair("pmcid", "PMC3")), F.array(pair("doi", "10.2"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return x.select(
        "doc_id",
        F.array_join(S.json_list(turns("doc_id", LISTS)), ",").alias("items"),
        S.json_object(turns("doc_id", OBJECTS)).alias("object"),
        S.id_value(ids, "pmcid").alias("pmcid"),
        F.array_join(S.allowed_only(turns("doc_id", [["mri", "mri", "x", "ct"], [], ["ct"]]), X.IMAGING_MODALITIES), ",").alias("kept"),
    )


_LABEL = {"label_schema_version": "1", "pmcid": "P", "case_id": "1", "ftld_inclusion_tier": "ftld_broad", "label_confidence": "low", "evidence_block_ids": ["b"]}
#: Model answers, and what of them is kept: tier, basis, first diagnosis, other category, modalities, regions, pathologies, status of two tags; or the errors.
ANSWERS = [
    (_LABEL, ("ftld_broad", '["unclear_basis"]', None, None, "[]", "[]", "[]", "not_reported", "not_reported")),
    (_LABEL | {"initial_dx_category": "other_neurologic", "pathology_types": ["TDP-43", "tdp43", "Odd", "mixed"], "imaging_regions": ["Frontal", "moon", "sun"], "imaging_modalities": ["MRI", "x", " ct "]}, ("ftld_broad", '["unclear_basis"]', "other_neuro", None, '["mri","ct"]', '["frontal","other"]', '["tdp43","other","mixed"]', "not_reported", "not_reported")),
    (_LABEL | {"ftld_inclusion_tier": "exclude", "ftld_inclusion_basis": ["neuropath_confirmed"], "non_ftld_primary_category": "none such"}, ("exclude", "[]", None, "unclear", "[]", "[]", "[]", "not_reported", "not_reported")),
    (_LABEL | {"ftld_inclusion_tier": "ftld_strict", "ftld_inclusion_basis": ["neuropath_confirmed", "x", "neuropath_confirmed"], "initial_dx_category": "ad", "symptom_tags": [{"tag": "agrammatism", "status": "present", "evidence_block_ids": ["b"]}, {"tag": "mnd_signs", "status": "uncertain"}]}, ("ftld_strict", '["neuropath_confirmed"]', "ad", None, "[]", "[]", "[]", "present", "uncertain")),
    (_LABEL | {"evidence_block_ids": []}, "evidence_block_ids is empty"),
    (_LABEL | {"label_confidence": "sure", "age_at_onset_years": -1}, "label_confidence is not allowed,age_at_onset_years is negative"),
    (_LABEL | {"symptom_tags": [{"tag": "x", "status": "present"}], "case_id": None}, "case_id is missing,a symptom tag is not allowed"),
    ("no object", "not a JSON object"),
]
_KEPT = ["ftld_inclusion_tier", "ftld_inclusion_basis_json", "initial_dx_category", "non_ftld_primary_category", "imaging_modalities_json", "imaging_regions_json", "pathology_types_json", "tag__agrammatism__status", "tag__mnd_signs__status"]


def _answers(spark, d):
    # the ids' few bytes lie in a task or two; an answer is hundreds of bytes to be made, parsed and checked, so every core gets its share
    ids = t(spark, d, "labels").select("doc_id").repartition(2 * spark.sparkContext.defaultParallelism, "doc_id")
    return ids.select("doc_id", turns("doc_id", ["so:\n" + (json.dumps(a) if isinstance(a, dict) else a) for a, _ in ANSWERS]).alias("answer"))


@query("SELECT doc_id, " + ", ".join(f"{sql_turns('doc_id', [w[i] if isinstance(w, tuple) else None for _, w in ANSWERS], 'VARCHAR')} AS {c}" for i, c in enumerate(_KEPT)) + f" FROM labels WHERE doc_id % {len(ANSWERS)} < 4")
def label_rows(spark, d):
    return L.label_table(_answers(spark, d), "answer", ["doc_id"])[0].select("doc_id", *_KEPT)


@query(f"SELECT doc_id, {sql_turns('doc_id', [w if isinstance(w, str) else None for _, w in ANSWERS])} AS errors FROM labels WHERE doc_id % {len(ANSWERS)} >= 4")
def label_quarantine(spark, d):
    return L.label_table(_answers(spark, d), "answer", ["doc_id"])[1].select("doc_id", F.array_join("errors", ",").alias("errors"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'exclude' WHEN 1 THEN 'ftld_strict' WHEN 2 THEN 'ftld_broad' END AS tier, doc_id % 4 = 1 AS escalated, CASE WHEN doc_id % 4 = 3 THEN 'ValueError' END AS error_type FROM labels""")
def escalated_labels(spark, d):
    """A first model that is unsure about every fourth case, cuts every fourth answer off and fails on every fourth; a second one that is sure."""
    from ..sources import services

    class First:
        def label(self, packet):
            n = int(packet)
            if n % 4 == 3:
                raise ValueError("failed")
            if n % 4 == 2:
                return '{"ftld_inclusion_tier": "ftl'
            return {"ftld_inclusion_tier": "exclude", "label_confidence": "low" if n % 4 == 1 else "high", "needs_fulltext_review": False}

        def label_more(self, packet):
            return 'Here: {"ftld_inclusion_tier": "ftld_broad", "label_confidence": "high"}'

    class Second:
        def label(self, packet):
            return {"ftld_inclusion_tier": "ftld_strict", "label_confidence": "low"}

    packets = t(spark, d, "labels").select(F.col("doc_id").alias("case_id"), F.col("doc_id").cast("string").alias("packet"))
    got = services.label_with_escalation(packets, "packet", First(), Second())
    return got.select(F.col("case_id").cast("long").alias("doc_id"), F.get_json_object("label", "$.ftld_inclusion_tier").alias("tier"), "escalated", S.error_type(F.col("error")).alias("error_type"))


RATED = ["1", "0", None, "2", "1.0"]


@query(f"""SELECT doc_id, {sql_turns('doc_id', [1, 0, 0, 0, 1], 'INT')} AS text_adequate, CASE WHEN doc_id % 5 IN (0, 4) THEN toxic END AS is_ppa, CASE WHEN doc_id % 5 IN (2, 3) THEN 'text_adequate missing' END AS error FROM labels""")
def coerced_ratings(spark, d):
    x = t(spark, d, "labels").select("doc_id", turns("doc_id", RATED).alias("text_adequate"), F.col("toxic").cast("string").alias("is_ppa"))
    return A.coerce_rating(x, ["text_adequate", "is_ppa"])


MODALITIES = [["mri", "ct"], [], None, ["mri"], ["fdg_pet", "mri", "other"]]


@query(f"""WITH a AS (SELECT lang, CASE doc_id % 5 WHEN 0 THEN ['mri', 'ct'] WHEN 1 THEN [] WHEN 3 THEN ['mri'] WHEN 4 THEN ['fdg_pet', 'mri', 'other'] END AS m FROM documents),
v AS (SELECT unnest({X.IMAGING_MODALITIES}) AS value), n AS (SELECT lang, count(*) AS n_cases FROM a GROUP BY lang)
SELECT n.lang, value, n_cases, (SELECT count(*) FROM a WHERE a.lang IS NOT DISTINCT FROM n.lang AND list_contains(a.m, v.value)) AS value_n FROM n, v""")
def array_counts(spark, d):
    x = t(spark, d, "documents").withColumn("m", turns("doc_id", MODALITIES))
    return R.array_skeleton_counts(x, ["lang"], "m", X.IMAGING_MODALITIES).drop("value_prop")


# ---- papers ----

SECTIONS = ["Case report", "Methods", "Clinical history", "Discussion", "Patient 1 > Course", "Description of the case"]
ENDINGS = ["", " A 54-year-old man was seen.", " The patient presented with aphasia.", " Diagnosed with PSP.", " Case 2 was a proband.", " He met criteria for bvFTD."]


def _blocks(spark, d):
    c = t(spark, d, "conversations")
    k = (F.col("conv_id") + F.col("turn")).alias("k")
    b = c.select("*", k).select(F.concat(F.lit("PMC"), "conv_id").alias("pmcid"), F.when(F.col("role") == "system", "abstract").otherwise("body").alias("source"), turns("turn", SECTIONS).alias("sec_path_str"), F.col("turn").cast("int").alias("block_index"), F.concat(F.lit("PMC"), "conv_id", F.lit("__"), "turn").alias("block_id"), F.concat("text", turns("k", ENDINGS)).alias("text"))
    return b.select("*", F.array("sec_path_str").alias("sec_path"), F.length("text").cast("long").alias("n_chars"))


#: Letters outside ASCII, the only such characters in the texts, become 'z', so that word boundaries are where Unicode has them.
BLOCKS = f"""b AS (SELECT 'PMC' || conv_id AS pmcid, CASE WHEN role = 'system' THEN 'abstract' ELSE 'body' END AS source, {sql_turns('turn', SECTIONS)} AS sec, turn, 'PMC' || conv_id || '__' || turn AS block_id,
  text || {sql_turns('(conv_id + turn)', ENDINGS)} AS text FROM conversations), blocks AS (SELECT *, length(text) AS n_chars, regexp_replace(text, '[^\\x00-\\x7F]', 'z', 'g') AS plain FROM b)"""
_ci = lambda p: "'(?i)" + p.replace("'", "''") + "'"
ROUTED = f"""routed AS (SELECT pmcid, sec, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(*) AS n_blocks, CASE WHEN regexp_matches(sec, {_ci(X.MUST_SECTION)}) THEN 'must' WHEN regexp_matches(sec, {_ci(X.EXCLUDE_SECTION)}) THEN NULL
  WHEN regexp_matches(sec, {_ci(X.CANDIDATE_SECTION)}) THEN 'candidate' END AS route FROM blocks WHERE source = 'body' GROUP BY pmcid, sec)"""


@query(f"""WITH {BLOCKS}, {ROUTED}, n AS (SELECT *, row_number() OVER (PARTITION BY pmcid, route ORDER BY n_chars DESC, sec) AS r FROM routed WHERE route IS NOT NULL)
SELECT pmcid, sec AS sec_path_str, n_chars, n_blocks, route FROM n WHERE r <= CASE route WHEN 'must' THEN 2 ELSE 1 END""")
def routed_sections(spark, d):
    return D.routed_sections(_blocks(spark, d), 2, 1)


_ANCHORS = ", ".join(f"CASE WHEN regexp_matches(left(plain, 12000), {_ci(p)}) THEN '{n}' END" for n, p in X.ANCHORS)


@query(f"""WITH {BLOCKS} SELECT block_id, regexp_matches(plain, {_ci(X.DIAGNOSIS_TRIGGER)}) AS trigger, regexp_matches(sec, {_ci(X.STRICT_SECTION)}) AS strict,
  array_to_string(list_filter([{_ANCHORS}], lambda x: x IS NOT NULL), ',') AS anchors FROM blocks""")
def block_signals(spark, d):
    return _blocks(spark, d).select("block_id", S.diagnosis_trigger(F.col("text")).alias("trigger"), S.strict_section(F.col("sec_path_str")).alias("strict"), F.array_join(S.narrative_anchors(F.col("text")), ",").alias("anchors"))


@query(f"""WITH {BLOCKS}, f AS (SELECT *, row_number() OVER (PARTITION BY pmcid, sec ORDER BY turn) AS r FROM blocks)
SELECT pmcid, sec AS sec_path_str, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(*) AS n_blocks, left(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE r <= 2), 450) AS preview FROM f GROUP BY pmcid, sec""")
def section_previews(spark, d):
    return D.section_previews(_blocks(spark, d))


#: Sections to read, in order: must, then candidates, the longest first; the model's choice is every candidate but a made-up one.
CHOSEN = f"""{ROUTED}, chosen AS (SELECT pmcid, sec, row_number() OVER (PARTITION BY pmcid ORDER BY route DESC, n_chars DESC, sec) - 1 AS place FROM routed WHERE route IS NOT NULL)"""


@query(f"WITH {BLOCKS}, {CHOSEN} SELECT pmcid, sec AS sec_path_str, CAST(place AS INT) AS place FROM chosen")
def chosen_sections(spark, d):
    b = _blocks(spark, d)
    routed = D.routed_sections(b).where("route = 'candidate'")
    names = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n_chars")).alias("o"), "sec_path_str"))), lambda x: x["sec_path_str"])
    choice = routed.groupBy("pmcid").agg(F.concat(F.array(F.lit("Made up")), names).alias("selected"))
    return api.chosen_sections(b, choice)


GUARD = f"""texts AS (SELECT c.pmcid, c.sec, place, string_agg(plain, ' ' ORDER BY turn) AS plain FROM chosen c JOIN blocks ON blocks.pmcid = c.pmcid AND blocks.sec = c.sec AND source = 'body'
  WHERE regexp_matches(c.sec, {_ci(X.STRICT_SECTION)}) GROUP BY ALL),
hits AS (SELECT pmcid, place, list_transform(list_filter([{_ANCHORS}], lambda x: x IS NOT NULL), lambda x: x || '@' || sec) AS m FROM texts),
first AS (SELECT pmcid, arg_min(m, place) AS m FROM hits WHERE len(m) > 0 GROUP BY pmcid),
guarded AS (SELECT pmcid, first.m IS NOT NULL AS passed, coalesce(array_to_string(first.m, ','), CASE WHEN pmcid NOT IN (SELECT pmcid FROM chosen) THEN 'no_selected_sections' WHEN bool_or(source = 'body') THEN 'no_narrative_anchor'
  WHEN bool_or(source = 'abstract') THEN 'no_body_blocks' ELSE 'no_blocks' END) AS markers
  FROM (SELECT pmcid, source FROM blocks UNION ALL SELECT 'PMC-1', NULL) LEFT JOIN first USING (pmcid) GROUP BY pmcid, first.m)"""


@query(f"WITH {BLOCKS}, {CHOSEN}, {GUARD} SELECT * FROM guarded")
def guardrail(spark, d):
    b = _blocks(spark, d)
    g = D.guardrail(b, api.chosen_sections(b), spark.createDataFrame([("PMC-1",)], "pmcid string"))
    return g.select("pmcid", "passed", F.array_join("markers", ",").alias("markers"))


SELECTED = """kept AS (SELECT blocks.* FROM blocks JOIN chosen USING (pmcid, sec) UNION SELECT * FROM blocks WHERE source = 'abstract'),
capped AS (SELECT *, row_number() OVER (PARTITION BY pmcid ORDER BY turn) AS rn, sum(n_chars) OVER (PARTITION BY pmcid ORDER BY turn ROWS UNBOUNDED PRECEDING) AS cum FROM kept),
selected AS (SELECT * FROM capped WHERE rn = 1 OR (rn <= 3 AND cum <= 2000))"""


@query(f"WITH {BLOCKS}, {CHOSEN}, {SELECTED} SELECT block_id FROM selected")
def selected_blocks(spark, d):
    b = _blocks(spark, d)
    return D.select_blocks(b, api.chosen_sections(b), 3, 2000).select("block_id")


@query(f"""WITH {BLOCKS}, {CHOSEN}, {SELECTED}, h AS (SELECT *, row_number() OVER (PARTITION BY pmcid ORDER BY source, n_chars, turn) AS r FROM blocks WHERE block_id NOT IN (SELECT block_id FROM selected) AND regexp_matches(plain, {_ci(X.DIAGNOSIS_TRIGGER)}))
SELECT block_id FROM h WHERE r <= 2""")
def trigger_snippets(spark, d):
    b = _blocks(spark, d)
    return D.extra_snippets(b, D.select_blocks(b, api.chosen_sections(b), 3, 2000), most=2).select("block_id")


#: Lists of block ids that overlap: a case's presentation is every block, its course every block but the first, the summary the last one.
@query("""WITH m AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
u AS (SELECT conv_id, turn, CASE WHEN turn = last THEN 'b_summary' WHEN turn > 0 THEN 'c_course' ELSE 'd_presentation' END AS seg FROM m)
SELECT conv_id, seg, string_agg(turn, ',' ORDER BY turn) AS blocks FROM u GROUP BY ALL""")
def first_use_wins(spark, d):
    ids = F.array_sort(F.collect_list("turn"))
    c = t(spark, d, "conversations").groupBy("conv_id").agg(ids.alias("ids"))
    lists = c.select("conv_id", F.explode(F.array(F.struct(F.lit("d_presentation").alias("seg"), F.col("ids").alias("b")), F.struct(F.lit("c_course").alias("seg"), F.filter("ids", lambda x: x > 0).alias("b")), F.struct(F.lit("b_summary").alias("seg"), F.slice("ids", -1, 1).alias("b")))).alias("x")).select("conv_id", "x.*")
    got = R.first_use_wins(lists, "conv_id", "b", ["seg"])
    return got.select("conv_id", "seg", F.array_join("b", ",").alias("blocks"))


#: Words that redaction takes out, with boundaries where Unicode has them: letters outside ASCII stand between underscores meanwhile.
def _guarded(text: str) -> str:
    return f"regexp_replace({text}, '([^\\x00-\\x7F])', '_\\1_', 'g')".replace("\\\\", "\\")


LEAK = r"(?i)\b(" + "|".join(TERMS) + r")\b"


@query(f"""WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', 'z', 'g'), '{LEAK}') AS m FROM documents)
SELECT doc_id, CAST(coalesce(len(m), 0) AS INT) AS n_matches, list_aggregate(list_transform(m, lambda x: lower(x)), 'string_agg', ',') AS matches FROM d""")
def leakage_counts(spark, d):
    return t(spark, d, "documents").select("doc_id", S.leak_count(F.col("text"), TERMS).alias("n_matches"), F.nullif(F.array_join(S.leak_matches(F.col("text"), TERMS), ","), F.lit("")).alias("matches"))


@query(f"""SELECT doc_id, md5(regexp_replace(regexp_replace({_guarded('text')}, '{LEAK}', '[REDACTED]', 'g'), '_([^\\x00-\\x7F])_', '\\1', 'g')) AS redacted_md5 FROM documents""")
def redact_text(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(S.redact(F.col("text"), TERMS)).alias("redacted_md5"))


@query(r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS normal_md5 FROM documents")
def normalize_text(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(S.normalize_text(F.col("text"))).alias("normal_md5"))


@query(f"""WITH {BLOCKS}, s AS (SELECT pmcid, CASE WHEN turn < 3 THEN 'case_presentation' ELSE 'other' END AS segment_type, string_agg(block_id, '|' ORDER BY turn) AS ids, string_agg(text, chr(10) ORDER BY turn) AS raw, CAST(count(*) AS INT) AS n_blocks FROM blocks GROUP BY ALL),
c AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace({_guarded('raw')}, '{LEAK}', ' ', 'g'), '_([^\\x00-\\x7F])_', '\\1', 'g'), '\\s+', ' ', 'g')) AS clean FROM s)
SELECT left(sha1(pmcid || chr(10) || 'case_1' || chr(10) || segment_type || chr(10) || ids), 16) AS segment_uid, pmcid, segment_type, n_blocks, CAST(length(raw) AS INT) AS n_chars_raw, CAST(length(clean) AS INT) AS n_chars_clean, md5(clean) AS clean_md5,
  CAST(len(regexp_extract_all(regexp_replace(raw, '[^\\x00-\\x7F]', 'z', 'g'), '{LEAK}')) AS INT) AS leakage_n_matches_raw, CAST(0 AS INT) AS leakage_n_matches_clean FROM c""")
def segments(spark, d):
    b = _blocks(spark, d)
    kind = F.when(F.col("block_index") < 3, "case_presentation").otherwise("other").alias("segment_type")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("block_index", "block_id"))), lambda x: x["block_id"])
    lists = b.groupBy("pmcid", kind).agg(ids.alias("block_ids")).withColumn("case_id", F.lit("case_1"))
    s = D.segments(b, lists, TERMS)
    return s.select("segment_uid", "pmcid", "segment_type", "n_blocks", "n_chars_raw", "n_chars_clean", F.md5("text_clean").alias("clean_md5"), "leakage_n_matches_raw", "leakage_n_matches_clean")


PARSED_SQL = f"""WITH {BLOCKS}, x AS (SELECT pmcid, CASE WHEN source = 'abstract' THEN 0 ELSE 1 END AS o, source, CASE WHEN source = 'body' THEN sec ELSE '' END AS path, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM blocks)
SELECT pmcid, CAST(row_number() OVER (PARTITION BY pmcid ORDER BY o, turn) - 1 AS INT) AS block_index, source, path AS sec_path_str, pmcid || '__' || source || '__' || left(sha1(pmcid || chr(10) || source || chr(10) || path || chr(10) || text), 16) AS block_id,
  CAST(length(text) AS BIGINT) AS n_chars, 'case-report' AS article_type, 'Title of ' || pmcid AS title, 'ok' AS status FROM x"""


def _marked_up(spark, d):
    """Every paper as marked-up text; with figures, which are left out, and nested titles, which are joined."""
    esc = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = F.split("sec_path_str", " > ")
    opened = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<sec><title>"), p, F.lit("</title>"))), "")
    closed = F.array_join(F.transform(parts, lambda p: F.lit("</sec>")), "")
    p = F.concat(F.lit("<p>"), esc, F.lit("</p>"))
    one = F.when(F.col("source") == "abstract", p).otherwise(F.concat(opened, p, F.lit("<fig><p>left out</p></fig>"), closed))
    rows = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("source") == s, F.struct("block_index", one.alias("x"))))), lambda r: r["x"]), "\n")
    xml = F.concat(F.lit('<wrap xmlns:m="urn:m"><article article-type="case-report"><front><article-title>Title of <i>'), F.col("pmcid"), F.lit("</i></article-title><abstract>"), rows("abstract"), F.lit("</abstract></front><body>"), rows("body"), F.lit("</body></article></wrap>"))
    return _blocks(spark, d).groupBy("pmcid").agg(xml.alias("x"))


@query(PARSED_SQL)
def parsed_documents(spark, d):
    files = _marked_up(spark, d).select(F.concat(F.lit("/in/"), "pmcid", F.lit(".xml")).alias("path"), F.encode("x", "UTF-8").alias("content"))
    return D.parse_contents(files).select("pmcid", "block_index", "source", "sec_path_str", "block_id", "n_chars", "article_type", "title", "status")


#: Documents whose file comes in the first run; the others come in the second.
FIRST = "pmcid < 'PMC5'"


@query(f"""WITH parsed AS ({PARSED_SQL}), n AS (SELECT pmcid, count(*) AS n FROM parsed GROUP BY pmcid)
SELECT p.pmcid, block_index, source, block_id, article_type, title, log.status, n AS n_blocks_total FROM parsed p JOIN n USING (pmcid), (SELECT 'ok' AS status) log""")
def extracted_folder(spark, d):
    """A folder of marked-up files through the extraction job, in two runs: the second takes up what the first hasn't seen."""
    at = T.scratch(spark)
    papers = _marked_up(spark, d)
    first_block = lambda blocks: blocks.where("block_index = 0").select("pmcid", F.col("block_id").alias("segment_uid"))
    for rows in (papers.where(FIRST), papers.where(f"NOT ({FIRST})")):
        T.write_files(rows.select(F.concat("pmcid", F.lit(".xml")).alias("name"), F.encode("x", "UTF-8").alias("content")), f"{at}/in")
        E.extract_folder(spark, f"{at}/in", f"{at}/out", first_block, resume=True, pattern="*")
    log = E.committed(spark, f"{at}/out", "log").select("pmcid", "status", "n_blocks_total")
    blocks = E.committed(spark, f"{at}/out", "blocks").drop("status")
    return blocks.join(log, "pmcid").select("pmcid", "block_index", "source", "block_id", "article_type", "title", "status", "n_blocks_total")


BAD = ["<article><body><p>x</p></body></article>", "<article>", "<html/>", "<article/>"]


@query(f"""SELECT 'D' || doc_id AS pmcid, CASE WHEN doc_id % 3 = 0 THEN 'skipped' ELSE {sql_turns('doc_id', ['ok', 'error', 'error', 'ok'])} END AS status, {sql_turns('doc_id', [1, 0, 0, 0], 'BIGINT')} * CAST(doc_id % 3 > 0 AS BIGINT) AS n_blocks_total FROM labels""")
def parse_log(spark, d):
    """Bad files and files that were done before are rows of the log."""
    x = t(spark, d, "labels").select(F.concat(F.lit("/in/D"), "doc_id", F.lit(".xml")).alias("path"), F.encode(turns("doc_id", BAD), "UTF-8").alias("content"), "doc_id")
    done = x.where("doc_id % 3 = 0").select(D.pmcid_of(F.col("path")).alias("pmcid"))
    return D.parse_log(D.parse_contents(x, done)).select("pmcid", "status", "n_blocks_total")


@query("""WITH e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) - 50 AS n, value FROM events)
SELECT event_id, CASE WHEN event_type = 'view' THEN '$: not a JSON object' ELSE concat_ws(',', CASE event_type WHEN 'error' THEN '$.is_case_like: not a flag' WHEN 'signup' THEN '$.is_case_like: missing' WHEN 'click' THEN '$.is_case_like: null' END,
  CASE WHEN n < 1 THEN '$.n_cases_est: less than 1' END, CASE WHEN value > 50 THEN '$.selected_sec_paths[1]: not text' END) END AS errors FROM e""")
def route_schema(spark, d):
    """Answers of the first pass made of events; what is wrong with each follows from its row."""
    e = t(spark, d, "events").withColumn("n", F.get_json_object("props", "$.k").cast("long") - 50)
    kind = F.col("event_type")
    flag = F.when(kind == "error", ', "is_case_like": "maybe"').when(kind == "signup", "").when(kind == "click", ', "is_case_like": null').otherwise(', "is_case_like": true')
    paths = F.when(F.col("value") > 50, '["Case", 7]').otherwise('["Case"]')
    answer = F.concat(F.lit('so: {"n_cases_est": '), F.when(F.col("n") % 2 == 0, F.concat(F.lit('"'), "n", F.lit('"'))).otherwise(F.col("n").cast("string")), F.lit(', "selected_sec_paths": '), paths, flag, F.lit("}"))
    x = e.select("event_id", F.when(kind == "view", F.substring_index(answer, "}", 0)).otherwise(answer).alias("text"))
    return schemas.checked(x, "text", schemas.ROUTE).select("event_id", F.array_join("errors", ",").alias("errors"))


@query("""WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, turn, role, text FROM conversations)
SELECT conv_id, coalesce(string_agg(e, ',' ORDER BY i), '') AS errors FROM (SELECT conv_id, i, nullif(concat_ws(',', CASE WHEN turn % 4 = 1 THEN '$.segments[' || i || '].case_id: not text' END, CASE WHEN role = 'assistant' THEN '$.segments[' || i || '].segment_type: not allowed' END,
  CASE WHEN turn % 3 = 0 THEN '$.segments[' || i || '].block_ids: fewer than 1' END, CASE WHEN length(text) % 2 = 0 THEN '$.segments[' || i || '].include_for_embedding: missing' END), '') AS e FROM s) GROUP BY conv_id""")
def segment_schema(spark, d):
    """Answers of the second pass made of conversations: every turn a segment, in their order."""
    c = t(spark, d, "conversations")
    case = F.when(F.col("turn") % 4 == 1, F.lit("1")).otherwise(F.lit('"case_1"'))
    kind = F.when(F.col("role") == "assistant", "assistant").otherwise("other")
    one = F.concat(F.lit('{"case_id": '), case, F.lit(', "segment_type": "'), kind, F.lit('", "block_ids": '), F.when(F.col("turn") % 3 == 0, "[]").otherwise('["b"]'), F.when(F.length("text") % 2 == 0, "").otherwise(', "include_for_embedding": 1'), F.lit("}"))
    all_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("x")))), lambda r: r["x"]), ", ")
    x = c.groupBy("conv_id").agg(F.concat(F.lit('```json\n{"n_cases_est": null, "segments": ['), all_, F.lit("]}\n```")).alias("text"))
    return schemas.checked(x, "text", schemas.SEGMENTS).select("conv_id", F.array_join("errors", ",").alias("errors"))


# ---- citations ----

PAGES = ["1672-82", "S112-S5", "45", "e12-e15", "1-3, 5-9", "120–5", None]


@query(f"SELECT c_custkey, {sql_turns('c_custkey', ['1672-1682', 'S112-S115', '45', 'e12-e15', '1-3, 5-9', '120-125', None])} AS pages FROM customer")
def page_ranges(spark, d):
    return t(spark, d, "customer").select("c_custkey", S.expand_pages(turns("c_custkey", PAGES)).alias("pages"))


#: A text per customer that cites the priorities of its orders in order.
CITED = "c AS (SELECT o_custkey, o_orderkey, 'K' || left(o_orderpriority, 1) AS k FROM orders), f AS (SELECT o_custkey, k, min(o_orderkey) AS o FROM c GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o) AS number FROM f)"


def _cited(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("see {{cite:K"), F.left("o_orderpriority", F.lit(1)), F.lit("}}")).alias("x"))
    return R.ordered_text(o, ["o_custkey"], "o_orderkey", "x", "; ")


@query(f"WITH {CITED} SELECT o_custkey, k AS cite_key, CAST(number AS INT) AS number FROM n")
def cite_numbers(spark, d):
    return A.cite_numbers(_cited(spark, d), "o_custkey", "x").select("o_custkey", "cite_key", "number")


@query(f"WITH {CITED} SELECT o_custkey, string_agg('see ^' || number || '^', '; ' ORDER BY o_orderkey) AS x FROM c JOIN n USING (o_custkey, k) GROUP BY o_custkey")
def cited_texts(spark, d):
    known = spark.createDataFrame([(f"K{i}",) for i in range(1, 6)], "cite_key string")
    return A.apply_citations(_cited(spark, d), "o_custkey", "x", known)


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 8 = 0 THEN 'The Group' WHEN c_custkey % 8 <= 6 THEN array_to_string(list_transform(range(c_custkey % 8), lambda i: 'Name' || i || ' A'), ', ') ELSE 'Name0 A, Name1 A, Name2 A, et al' END
  || '. On ' || c_mktsegment || '. J Test. 2020' || {sql_turns('c_custkey', [';12', '', ';12'])} || {sql_turns('c_custkey', ['(3)', ''])} || coalesce(':' || {sql_turns('c_custkey', ['1672-1682', 'S112-S115', '45', 'e12-e15', '1-3, 5-9', '120-125', None])}, '') || '.' || {sql_turns('c_custkey', [' doi:10.1/x', ''])} AS reference FROM customer""")
def references(spark, d):
    person = lambda i: F.struct(F.concat(F.lit("Name"), i).alias("last_name"), F.lit("A").alias("initials"), F.lit(None).cast("string").alias("collective_name"))
    group = F.array(F.struct(F.lit(None).cast("string").alias("last_name"), F.lit(None).cast("string").alias("initials"), F.lit("The Group").alias("collective_name")))
    authors = F.when(F.col("c_custkey") % 8 == 0, group).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("c_custkey") % 8 - 1), person))
    return t(spark, d, "customer").select("c_custkey", S.ama_reference({"authors": authors, "title": F.concat(F.lit("On "), "c_mktsegment", F.lit("..")), "journal_abbrev": F.lit("J Test"), "year": F.lit(2020), "volume": turns("c_custkey", ["12", " ", "12"]), "issue": turns("c_custkey", ["3", None]), "pages": turns("c_custkey", PAGES), "doi": turns("c_custkey", ["10.1/x", ""])}).alias("reference"))
