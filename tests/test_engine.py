"""The cohort engine: hand values, invariants, and every query against its SQL at the smallest scale."""

import hashlib
import itertools
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import fixed as X, stats, text as S
from cohortlens.operators import inference as I, relational as R, sampling as P, vectors as V
from cohortlens.plans import catalog, cohort as K, raters as A
from cohortlens.sources import documents as D, services, tables as T
from cohortlens.streaming import ingest as N

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def lits(*xs):
    return [F.lit(x) for x in xs]


# ---- statistics ----


def test_bh_fdr(spark):
    df = spark.createDataFrame([(0.01, "a"), (0.02, "b"), (0.03, "c"), (0.2, "d")], "p double, k string")
    got = R.bh_fdr(df, "p", "k").orderBy("k").collect()
    assert [round(r.q, 9) for r in got] == [0.04, 0.04, 0.04, 0.2] and [r.reject for r in got] == [True, True, True, False]
    assert R.bh_fdr(df.limit(0), "p", "k").collect() == []


def test_effect_sizes(spark):
    e = stats.effect_sizes(*lits(8, 2, 5, 15))
    x, y, u, v = 8.5, 2.5, 5.5, 15.5
    n = x + y + u + v
    assert one(spark, e["rr"]) == pytest.approx((x / (x + y)) / ((x + u) / n))
    assert one(spark, e["odds_ratio"]) == pytest.approx(x * v / y / u)
    se = math.sqrt(1 / x - 1 / (x + y) + 1 / (x + u) - 1 / n)
    assert one(spark, e["rr_low"]) == pytest.approx(math.exp(math.log((x / (x + y)) / ((x + u) / n)) - 1.959963984540054 * se))
    assert one(spark, stats.effect_sizes(*lits(0, 0, 5, 15))["rr"]) is None


def test_wilson_and_odds(spark):
    low, high = stats.wilson(F.lit(0), F.lit(10))
    assert one(spark, low) == pytest.approx(0, abs=1e-12) and one(spark, high) == pytest.approx(0.27753, abs=1e-5)
    assert one(spark, stats.wilson(F.lit(10), F.lit(10))[1]) == pytest.approx(1)
    assert one(spark, stats.wilson(F.lit(0), F.lit(0))[0]) is None
    assert one(spark, stats.odds_ratio_on_zero(*lits(2, 3, 4, 5))["odds_ratio"]) == pytest.approx(10 / 12)
    assert one(spark, stats.odds_ratio_on_zero(*lits(0, 3, 4, 5))["odds_ratio"]) == pytest.approx(0.5 * 5.5 / 3.5 / 4.5)


def test_fixed_cluster_is_hypergeometric(spark):
    df = spark.createDataFrame([(i, i % 3, i % 7 < 3) for i in range(60)], "k int, c int, y boolean")
    got = {r.cluster: r for r in I.fixed_cluster_test(df, "k", "c", F.col("y"), 400).collect()}
    total, pos = 60, sum(i % 7 < 3 for i in range(60))
    for r in got.values():
        tail = sum(math.comb(pos, j) * math.comb(total - pos, r.n_cases - j) for j in range(r.observed, min(pos, r.n_cases) + 1)) / math.comb(total, r.n_cases)
        assert abs(r.p - tail) < 4 * math.sqrt(tail * (1 - tail) / 400) + 0.01


def test_ari_jaccard_kappa(spark):
    same = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "a int, b int")
    assert I.adjusted_rand(same, "a", "b").first().ari == 1.0
    assert I.adjusted_rand(same.limit(0), "a", "b").first().ari == 1.0
    assert I.mask_jaccard(same.limit(0), F.col("a") == 1, F.col("b") == 1).first().jaccard == 1.0
    rows = [("1", "1", "1", "1"), ("1", "1", "0", "1"), ("1", "1.0", "0", "0"), ("0", "1", "1", "0"), ("1", "", "1", "0"), ("2", "1", "1", "1")]
    r1 = spark.createDataFrame([(str(i), r[0], r[2]) for i, r in enumerate(rows)], "case_uid string, text_adequate string, is_ppa string")
    r2 = spark.createDataFrame([(str(i), r[1], r[3]) for i, r in enumerate(rows)], "case_uid string, text_adequate string, is_ppa string")
    report, sheet = A.score(r1, r2, ["text_adequate", "is_ppa"])
    k = {r.field: r for r in report.collect()}
    assert k["text_adequate"].n_pairs == 4 and k["is_ppa"].n_pairs == 3
    po, pe = 2 / 3, 1 / 3 * 2 / 3 + 2 / 3 * 1 / 3
    assert k["is_ppa"].kappa == pytest.approx((po - pe) / (1 - pe))
    assert {r.case_uid for r in sheet.collect()} == {"1", "3", "4"}
    done = I.consensus(A.paired(r1, r2, ["is_ppa"]), sheet.withColumn("is_ppa_final", F.lit(1)), ["case_uid"], ["is_ppa"])
    assert {r.case_uid: r.is_ppa for r in done.collect()} == {"0": 1, "1": 1, "2": 0, "3": 1, "4": 1, "5": 1}
    assert K.R and I.replication_gate(0.01, 0.5, 0.3) and not I.replication_gate(0.05, 0.5, 0.3) and not I.replication_gate(0.01, float("nan"), 0.3)


# ---- text ----


def test_redaction_leaves_nothing(spark):
    terms = ["PPA", "primary progressive aphasia", " ", "svPPA", "C9-72"]
    df = spark.createDataFrame([("Has ppa, and Primary Progressive Aphasia (svPPA); c9-72 but not PPAX.",), (None,), ("",)], "t string")
    got = df.select(S.leak_count(F.col("t"), terms).alias("n"), S.leak_count(S.redact(F.col("t"), terms), terms).alias("z"), S.leak_matches(F.col("t"), terms).alias("m"), S.leak_count(F.col("t"), []).alias("e")).collect()
    assert [r.n for r in got] == [4, 0, 0] and [r.z for r in got] == [0, 0, 0] and [r.e for r in got] == [0, 0, 0]
    assert got[0].m == ["ppa", "primary progressive aphasia", "svppa", "c9-72"]


def test_scalars(spark):
    assert one(spark, S.normalize_whitespace(F.lit(" a \n b "))) == "a b"
    assert one(spark, S.year_of(F.lit("Epub 2019 Mar"))) == 2019 and one(spark, S.year_of(F.lit("n/a"))) is None
    assert [one(spark, S.to_binary(F.lit(x))) for x in ("1", "1.0", "0", "2", "", "x")] == [1, 1, 0, None, None, None]
    assert [one(spark, S.to_bool(F.lit(x))) for x in ("Yes", "no", "", None, "maybe")] == [True, False, False, False, True]
    assert [one(spark, S.pathology(F.lit(x))) for x in ("TDP-43", "Tau", "x")] == ["tdp43", "tau", "other"]
    assert one(spark, S.gene(F.lit("c9orf-72"))) == "C9ORF72" and one(spark, S.gene(F.lit("grn"))) == "GRN"
    assert one(spark, S.json_list(F.lit('["a", "", null, 3]'))) == ["a", "3"] and one(spark, S.json_list(F.lit("{bad"))) == [] and one(spark, S.json_list(F.lit(None).cast("string"))) == []
    assert json.loads(one(spark, S.json_object(F.lit('```json\n{"a": 1, "b": [2, 3]}\n```')))) == {"a": 1, "b": [2, 3]}
    assert one(spark, S.redact_key(F.lit("u?api_key=sssecret&x=1"))) == "u?api_key=REDACTED&x=1"
    assert one(spark, S.expand_pages(F.lit("1672-82, S12-5, e100"))) == "1672-1682, S12-S15, e100" or one(spark, S.expand_pages(F.lit("1672-82"))) == "1672-1682"
    assert [one(spark, S.direction(F.lit(a), F.lit(0.5))) for a in (0.6, 0.4, 0.5, None)] == ["enriched", "depleted", "neutral", "unknown"] or one(spark, S.direction(F.lit(0.6), F.lit(0.5))) == "enriched"
    assert [one(spark, S.route_section(F.lit(x))) for x in ("Methods > Case", "Methods", "Clinical history", "Intro", "")] == ["must", None, "candidate", None, None]
    assert one(spark, S.file_name([F.lit("a b"), F.lit("c/d")])) == "a_b__c_d" and one(spark, S.tag_name(F.lit("..")) ) == "run"
    h = one(spark, S.head_metrics(F.lit('<article article-type="case-report"><body><sec><sec></body>')))
    assert (h.article_type, h.has_body, h.n_sec_tags) == ("case-report", True, 2)


def test_citations(spark):
    md = spark.createDataFrame([(1, "x {{cite:K1}} {{cite:K2}} {{cite:K1}}"), (2, "none")], "d int, md string")
    known = spark.createDataFrame([("K1",), ("K2",)], "cite_key string")
    got = {r.d: r.md for r in A.apply_citations(md, "d", "md", known).collect()}
    assert got == {1: "x ^1^ ^2^ ^1^", 2: "none"}
    with pytest.raises(KeyError):
        A.apply_citations(md, "d", "md", known.limit(1))
    row = spark.createDataFrame([([(f"L{i}", "A", None) for i in range(7)], "Title.", "J", 2024, "12", "3", "45-50", "10.1/x")], "authors array<struct<last_name:string,initials:string,collective_name:string>>, title string, journal_abbrev string, year int, volume string, issue string, pages string, doi string")
    assert row.select(S.ama_reference({c: F.col(c) for c in row.columns}).alias("r")).first().r == "L0 A, L1 A, L2 A, et al. Title. J. 2024;12(3):45-50. doi:10.1/x"
    assert A.with_references("a\n\n## References\n\nold", ["n"]).endswith("## References\n\n1. n\n")


# ---- relational ----


def test_latest_and_first(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "z"), (None, 1, "q")], "k string, ingest_seq int, v string")
    assert {(r.k, r.v) for r in R.latest_per_key(df, ["k"], ["ingest_seq"]).collect()} == {("a", None), (None, "q")}
    assert {(r.k, r.v) for r in R.first_non_null(df, ["k"], ["v"], "ingest_seq").collect()} == {("a", "x"), (None, "q")}
    assert {(r.k, r.v) for r in R.first_per_key(df, ["k"], ["ingest_seq"]).collect()} == {("a", "x"), (None, "q")}


def test_prefix_cap(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([50, 0, 60, 1])] + [("b", 0, 999), ("b", 1, 0)], "d string, i int, n int")
    got = {(r.d, r.i) for r in R.prefix_cap(df, ["d"], ["i"], "n", 3, 100).collect()}
    assert got == {("a", 0), ("a", 1), ("b", 0)}


def test_first_use_wins(spark):
    s = spark.createDataFrame([("p", 1, ["b1", "b2"]), ("p", 2, ["b2", "b3"]), ("p", 3, ["b1"]), ("q", 1, ["b1"])], "paper string, pri int, blocks array<string>")
    got = {(r.paper, r.pri): r.blocks for r in R.first_use_wins(s, "paper", "blocks", ["pri"]).collect()}
    assert got == {("p", 1): ["b1", "b2"], ("p", 2): ["b3"], ("q", 1): ["b1"]}


def test_overrides_and_order(spark):
    base = spark.createDataFrame([("a", 1), ("b", 0)], "k string, y int")
    got = {r.k: (r.y, r.label_source) for r in R.apply_overrides(base, base.where("k = 'b'").withColumn("y", F.lit(1)), ["k"], ["y"]).collect()}
    assert got == {"a": (1, "base"), "b": (1, "override")}
    assert [r.k for r in R.reorder_by(base.unionByName(spark.createDataFrame([("z", 2)], base.schema)), "k", ["b", "a"]).collect()] == ["b", "a", "z"]
    assert one(spark, R.case_number(F.lit("case_12"))) == 12 and one(spark, R.case_number(F.lit("x"))) == 10_000


def test_eligible_cases(spark):
    lab = spark.createDataFrame([("P1", "1", "discovery", "ftld_strict", "svPPA", 1), ("P1", "1", "discovery", "ftld_strict", None, 2), ("P1", "2", "discovery", "ftld_strict", "PSP", 3), ("P2", "1", "confirmation", "exclude", "PSP", 4), ("P3", "1", "confirmation", "ftld_strict", "lvPPA", 5)], "pmcid string, case_id string, split string, ftld_inclusion_tier string, ftld_syndrome_reported string, ingest_seq int")
    seg = spark.createDataFrame([("P1", "1", True, 0, "t"), ("P1", "2", None, 0, "t"), ("P3", "1", True, 0, "t"), ("P2", "1", True, 5, "leak")], "pmcid string, case_id string, include_for_embedding boolean, leakage_n_matches_clean int, text_clean string")
    cases, flow = K.eligible_cases(lab, seg)
    assert {(r.doc_id, r.is_ppa) for r in cases.collect()} == {("P1__1", False), ("P3__1", True)}
    assert [r.n_total for r in flow.orderBy("step_no").collect()] == [4, 3, 2, 2, 2]
    with pytest.raises(ValueError):
        K.eligible_cases(lab, seg.withColumn("leakage_n_matches_clean", F.lit(1)))


# ---- sampling ----


def test_allocation():
    assert P.allocate({"a": 3, "b": 1, "c": 1, "d": 50}, 5) == {"a": 1, "b": 1, "c": 1, "d": 2}
    assert sum(P.allocate({"a": 3, "b": 9}, 1).values()) == 1 and P.allocate({"a": 2, "b": 3}, 99) == {"a": 2, "b": 3}
    for n in range(1, 40):
        got = P.allocate({"a": 20, "b": 5, "c": 14, "d": 1}, n)
        assert sum(got.values()) == n and (n < 4 or min(got.values()) >= 1)


# ---- vectors ----


def test_matching_is_optimal():
    import random

    rng = random.Random(1)
    for _ in range(30):
        k = rng.randint(1, 5)
        sim = {(i, j): rng.random() for i in range(k) for j in range(k)}
        got = V.best_matching(sim)
        assert sum(sim[i, got[i]] for i in got) == pytest.approx(max(sum(sim[i, p[i]] for i in range(k)) for p in itertools.permutations(range(k))))


def test_pca_and_kmeans(spark):
    import random

    rng = random.Random(1)
    rows = [(i, [float(10 * (i % 2)) + rng.gauss(0, 0.1), rng.gauss(0, 0.1), 5.0], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, v array<double>, g int")
    x, n = V.pca(df, "k", "v")
    assert n == 1 and abs(sum(r.v[0] for r in x.collect())) < 1e-6
    c = V.kmeans(x, "v", 2, [1, 2])
    assert I.adjusted_rand(c, "g", "cluster").first().ari == 1.0 and V.pick_k(x, "v", [2, 3]) == 2
    with pytest.raises(ValueError):
        V.kmeans(x.limit(1), "v", 2, [1])
    s = K.stability(K.resampled(df, "k", "v", "g", 3, 0.8, 2)).collect()
    assert [r.ari_vs_baseline for r in s] == [1.0] * 3


# ---- documents, sources, streaming ----

JATS = """<w xmlns="urn:x"><article article-type="case-report"><front><article-meta><title-group><article-title>A title</article-title></title-group><abstract><p>Abstract text.</p></abstract></article-meta></front>
<body><sec><label>1</label><title>Case Report</title><p>A 60-year-old  <b>man</b>.</p><fig><p>skip</p></fig><p>He was well.</p></sec></body></article></w>"""


def test_parse_route_segment(spark, tmp_path):
    (tmp_path / "PMC1.xml").write_text(JATS)
    (tmp_path / "PMC2.xml").write_text("<broken")
    parsed = D.parse_files(spark, str(tmp_path), "PMC*.xml").cache()
    log = {r.pmcid: r for r in D.parse_log(parsed).collect()}
    assert (log["PMC1"].n_blocks_abstract, log["PMC1"].n_blocks_body, log["PMC1"].article_type) == (1, 2, "case-report") and log["PMC2"].status == "error"
    blocks = parsed.where("block_id IS NOT NULL")
    rows = {r.block_index: r for r in blocks.collect()}
    assert rows[1].text == "A 60-year-old man." or rows[1].text == "A 60-year-old man ."
    assert rows[1].sec_path_str == "1 Case Report" and rows[1].block_id.startswith("PMC1__body__")
    sections = D.routed_sections(blocks)
    assert [r.route for r in sections.collect()] == ["must"]
    g = D.guardrail(blocks, sections).first()
    assert g.passed and g.markers == ["age_year_old@1 Case Report"]
    assert D.select_blocks(blocks, sections, 2).count() == 2 and D.section_previews(blocks).count() == 2
    lists = spark.createDataFrame([("PMC1", "case_1", "case_presentation", [rows[2].block_id, rows[1].block_id])], "pmcid string, case_id string, segment_type string, block_ids array<string>")
    s = D.segments(blocks, lists, ["well"]).first()
    assert s.text_raw.startswith("He was well.\n") and (s.leakage_n_matches_raw, s.leakage_n_matches_clean, s.n_blocks) == (1, 0, 2)
    with pytest.raises(ValueError):
        D.segments(blocks, lists.withColumn("block_ids", F.array(F.lit("nope"))), [])


def test_split_recommendation(spark):
    c = spark.createDataFrame([(2000, 10), (2001, 10), (2002, 10), (2003, 10)], "year int, n_papers long")
    r = T.recommend_split(c, 5).first()
    assert (r.cutoff_year, r.n_discovery, r.n_confirmation) == (2001, 20, 20)
    odd = spark.createDataFrame([(2000, 1), (2001, 2), (2002, 1)], "year int, n_papers long")
    assert [T.recommend_split(odd, 1, tie).first().cutoff_year for tie in ("earlier", "later")] == [2000, 2001]
    assert T.recommend_split(odd, 99).first().note.startswith("Best-effort")


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("Early", "svPPA", "text"), ("Early", None, "text"), ("Odd", "x", "text"), ("Late", "x", "  ")], "Temporal_Stage string, Subtype string, Description string")
    assert T.load_curated(df, ["Early", "Late"]).count() == 1
    with pytest.raises(ValueError):
        T.load_curated(df.drop("Subtype"), ["Early"])
    T.write_table(df, f"{tmp_path}/t", "csv", small=True)
    assert T.csv_header(spark, f"{tmp_path}/t") == df.columns and T.read_csv(spark, f"{tmp_path}/t", df.schema, ["Subtype", "none"]).columns == ["Subtype"]
    T.lock_config(f"{tmp_path}/c.json", {"a": 1}, ["a"])
    with pytest.raises(ValueError):
        T.lock_config(f"{tmp_path}/c.json", {"a": 2}, ["a"])
    assert T.checksums(spark, f"{tmp_path}/t").count() >= 1
    paths = spark.createDataFrame([("a/b.xlsx",), ("x/segments.csv",), ("data/raw/x.txt",), ("data/README.md",), ("src/x.py",)], "path string")
    assert {r.path for r in T.disclosure_findings(paths).collect()} == {"a/b.xlsx", "x/segments.csv", "data/raw/x.txt"}
    reg = spark.createDataFrame([("PMC1", 2020, "Doe J", "T"), ("PMC1", 2020, "Doe J", "T"), ("PMC2", None, None, None)], "pmcid string, year int, first_author string, title string")
    names = sorted(r.suggested_pdf_filename for r in T.manifest(reg).collect())
    assert names == ["PMC1__2020__Doe__T.pdf", "PMC1__2020__Doe__T__dup1.pdf", "PMC2__YEAR_UNKNO__Author__paper.pdf"]
    assert "| Early |" in T.markdown_table(df.select("Temporal_Stage"))


def test_services(spark):
    class Failing:
        def fetch(self, key):
            raise OSError("Unhandled exception")

    got = services.fetch_all(spark.createDataFrame([("PMC1",)], "pmcid string"), "pmcid", Failing(), tries=2).first()
    assert got.status == "error" and "Unhandled exception" in got.error
    e = services.embed(spark.createDataFrame([("a b",), (None,)], "t string"), "t").collect()
    assert len(e[0].embedding) == 64
    s = services.paged_search(spark, "q", lambda term, start, n: [f"u{i}" for i in range(start, min(start + n, 7))], lambda term: 7, 3)
    assert sorted(r.uid for r in s.collect()) == [f"u{i}" for i in range(7)]


def test_stream_writes_once(spark, tmp_path):
    src, out, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    os.makedirs(src)
    schema = "segment_uid string, v int"
    q = N.ingest(N.watch(spark, src, schema), N.append_new(["segment_uid"], out), ck)
    q.awaitTermination()
    (tmp_path / "in" / "a.json").write_text('{"segment_uid": "s1", "v": 1}\n{"segment_uid": "s2", "v": 1}\n{"segment_uid": "s1", "v": 2}\n')
    N.ingest(N.watch(spark, src, schema), N.append_new(["segment_uid"], out), ck).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    # the checkpoint is lost: everything is read again and nothing is appended
    N.ingest(N.watch(spark, src, schema), N.append_new(["segment_uid"], out), ck + "2").awaitTermination()
    assert spark.read.parquet(out).count() == 2
    q = N.ingest(N.watch(spark, src, schema), N.append_new(["segment_uid"], out), ck + "3", True)
    N.stop_when(q, idle_s=3)
    assert not q.isActive
    with pytest.raises(ValueError):
        N.guard(True, True, "x")


# ---- every query against its SQL ----


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for n in TABLES:
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{DIR}/{n}.parquet'")
    return c


def _value(v):
    return "\0" if v is None else repr(round(v, 6)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    r = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(r.columns)
    at = [r.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(_value, x)) for x in df.collect()) == sorted(tuple(_value(x[i]) for i in at) for x in r.fetchall())


def test_fixed_values():
    assert len(X.SYNDROMES) == 10 and len(X.SYMPTOM_TAGS) == 10 and set(X.POSITIVE_SYNDROMES) <= set(X.SYNDROMES)


# ---- labels and commands ----


def test_labels_are_checked(spark):
    from cohortlens.operators import labels as L

    ok = {"pmcid": "P", "case_id": "1", "ftld_inclusion_tier": "ftld_broad", "label_confidence": "low", "evidence_block_ids": ["b"], "initial_dx_category": "other_neurologic", "pathology_types": ["TDP-43", "tdp43", "Odd"], "imaging_regions": ["Frontal", "moon"], "imaging_modalities": ["MRI", "x"], "symptom_tags": [{"tag": "agrammatism", "status": "present"}]}
    bad = [ok | {"evidence_block_ids": []}, ok | {"label_confidence": None}, ok | {"age_at_onset_years": -1}, ok | {"symptom_tags": [{"tag": "x", "status": "present"}]}]
    rows = [("```json\n" + json.dumps(x) + "\n```",) for x in [ok, *bad]] + [("no object",), (None,)]
    good, out = L.label_table(spark.createDataFrame(rows, "t string"), "t")
    r = good.collect()
    assert len(r) == 1 and out.count() == 6 and all(x.errors for x in out.collect())
    r = r[0]
    assert r.initial_dx_category == "other_neuro" and json.loads(r.pathology_types_json) == ["tdp43", "other"] and json.loads(r.imaging_regions_json) == ["frontal", "other"]
    assert json.loads(r.ftld_inclusion_basis_json) == ["unclear_basis"] and r.tag__agrammatism__status == "present" and r.tag__mnd_signs__status == "not_reported" and r.non_ftld_primary_category is None


def test_commands(spark, tmp_path):
    from cohortlens.plans import api

    (tmp_path / "PMC1.xml").write_text(JATS)
    blocks = api.parse(spark, str(tmp_path)).where("block_id IS NOT NULL")
    s = api.extract_segments(blocks, ["well"]).first()
    assert s.n_blocks == 2 and s.leakage_n_matches_clean == 0 and s.include_for_embedding
    cur = spark.createDataFrame([("has svPPA", 1), (" ", 2)], "Description string, Cluster_x int")
    made = api.make_curated(cur, ["svPPA"], ["Cluster"])
    assert made.columns == ["Description"] and [r.Description for r in made.collect()] == ["has"]
    assert [r.leakage_n_matches_raw for r in api.audit(cur, ["svPPA"]).collect()] == [1, 0]
    cases = spark.createDataFrame([(i, "discovery" if i % 2 else "confirmation", i % 3, i % 4 == 0, "PSP") for i in range(60)], "k int, split string, cluster_matched int, is_ppa boolean, ftld_syndrome_reported string")
    e = api.phase_e(cases, 0.01, 0.5, 0.3)
    assert e["primary_precision"].count() == 9 and e["direction_consistency"].count() == 3
    with pytest.raises(ValueError):
        api.phase_e(cases, 0.5, 0.5, 0.3)
    suite = api.analyze_splits_suite(None, None, {})
    assert len(suite) == 6 and all(x[1] == "error" for x in suite)


def test_settings_and_columns(spark, tmp_path):
    from cohortlens.sources import config as C

    (tmp_path / "c.json").write_text(json.dumps({"clusters": 5, "terms": ["a"], "other": 1}))
    s = C.load_settings(f"{tmp_path}/c.json")
    assert (s.clusters, s.terms, s.extra, s.permutations) == (5, ("a",), {"other": 1}, 5000)
    with pytest.raises(ValueError):
        C.Settings(clusters=1)
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"id": "x", "term": " a \n b "}]}))
    assert C.load_query_file(f"{tmp_path}/q.json")["queries"][0]["term"] == "a b"
    (tmp_path / "r.json").write_text(json.dumps({"K": ""}))
    with pytest.raises(ValueError):
        C.load_references(f"{tmp_path}/r.json")
    assert C.resolve_columns(["PATIENT_ID", "text"], {"patient": ["patient_id"], "note": ["Note_Text", "TEXT"], "site": ["s"]}) == {"patient": "PATIENT_ID", "note": "text"}
    with pytest.raises(ValueError):
        C.resolve_columns(["a"], {"b": []}, ["b"])
    C.publish(spark.range(3), f"{tmp_path}/t", "run1")
    assert C.published(spark, f"{tmp_path}/t").count() == 3


# ---- refusals, services, refits ----


@pytest.mark.parametrize("p", [None, float("nan"), -0.1, 1.1])
def test_fdr_refuses_bad_values(spark, p):
    df = spark.createDataFrame([(0.1, "a"), (p, "b")], "p double, k string")
    with pytest.raises(Exception, match="must be a number"):
        R.bh_fdr(df, "p", "k").collect()
    with pytest.raises(ValueError):
        R.bh_fdr(df, "p", "k", alpha=0)


def test_few_draws_take_strata_by_seed(spark):
    df = spark.createDataFrame([(i, f"s{i % 10}") for i in range(100)], "k int, s string")
    got = [{r.s for r in P.stratified_sample(df, F.col("s"), ["k"], 3, seed).collect()} for seed in range(8)]
    assert all(len(g) == 3 for g in got) and len(set(map(frozenset, got))) > 3
    with pytest.raises(ValueError):
        P.stratified_sample(df, F.col("s"), ["k"], 0)


def test_slug_is_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert one(spark, S.run_slug(F.lit("2024-07-01 20:00:00").cast("timestamp"))) == "20240702T000000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_guardrail_takes_the_first_selected_section(spark):
    block = lambda i, source, sec, text: ("P", source, i, f"P__{i}", [sec], sec, text, len(text))
    blocks = spark.createDataFrame([block(0, "body", "Case report", "The proband."), block(1, "body", "A patient", "This is an index case."), block(2, "body", "Clinical", "An index case.")], T.BLOCKS)
    order = lambda *names: spark.createDataFrame([("P", n, i) for i, n in enumerate(names)], "pmcid string, sec_path_str string, place int")
    assert D.guardrail(blocks, order("Clinical", "Case report", "A patient")).first().markers == ["proband@Case report"]
    assert D.guardrail(blocks, order("A patient", "Case report")).first().markers == ["index_case@A patient"]
    assert D.guardrail(blocks, order("Clinical")).first().markers == ["no_narrative_anchor"]


def test_labels_of_a_case_escalate(spark):
    from cohortlens.plans import api

    class Model:
        def __init__(self, confidence, note):
            self.confidence, self.note = confidence, note

        def label(self, packet):
            return {"pmcid": "P", "case_id": packet, "ftld_inclusion_tier": "ftld_strict", "label_confidence": self.confidence, "evidence_block_ids": ["b"], "notes": self.note}

    cases = spark.createDataFrame([("1", "1")], "case_id string, packet string")
    label = lambda *models: api.label_cases(cases, *models)[0].first()
    weak = Model("low", "weak")
    assert (label(weak, Model("high", "sure")).notes, label(weak, Model("high", "sure")).escalated) == ("sure", True)
    assert (label(weak, weak).notes, label(weak, weak).escalated, label(Model("high", "x"), Model("low", "y")).notes) == ("weak", False, "x")


def test_model_calls_try_again():
    asked = []

    def post(request):
        asked.append((request.get("effort"), request["max_output_tokens"]))
        if request.get("effort") == "high":
            raise services.Refused("no such effort")
        if len(asked) == 2:
            raise OSError("gone")
        return {"output": [{"content": [{"text": '{"a": '}]}]} if request["max_output_tokens"] == 2000 else {"choices": [{"message": {"content": 'so {"a": 1}'}}]}

    assert services.ask(services.ModelLabeler(post), "x") == {"a": 1}
    assert asked == [("high", 2000), ("medium", 2000), ("medium", 2000), ("high", 4000), ("medium", 4000)]
    assert services.reply_text({"output_text": "t"}) == "t"
    with pytest.raises(ValueError):
        services.reply_text({"status": "completed"})


def test_article_records_and_dois():
    xml = b"""<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><ISOAbbreviation>J</ISOAbbreviation><JournalIssue><Volume>1</Volume><PubDate><MedlineDate>2020 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal>
    <ArticleTitle>On <i>x</i>.</ArticleTitle><Pagination><MedlinePgn>1-9</MedlinePgn></Pagination><AuthorList><Author><LastName>L</LastName><Initials>A</Initials></Author><Author><CollectiveName>G</CollectiveName></Author></AuthorList></Article></MedlineCitation>
    <PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"""
    (r,) = services.article_records(xml)
    assert (r["pmid"], r["title"], r["year"], r["doi"], r["pages"], r["issue"], [a["last_name"] or a["collective_name"] for a in r["authors"]]) == ("7", "On x.", "2020", "10.1/x", "1-9", None, ["L", "G"])
    assert services.resolve_doi(" 10.1/x ", lambda q: ["7", "7"] if q == "10.1/x[doi]" else []) == "7"
    with pytest.raises(LookupError):
        services.resolve_doi("10.1/x", lambda q: ["7", "8"])


def test_refits_carry_the_baselines_numbers(spark):
    rows = [(i, [float(10 * (i % 3)) + 0.01 * i, float((i % 3) ** 2)], 2 - i % 3, i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, v array<double>, g int, y boolean")
    for a in (K.resampled(df, "k", "v", "g", 3, 0.8, 3), K.reseeded(df, "k", "v", "g", [0, 5], 3)):
        got = a.collect()
        assert got and all(r.cluster == r.baseline for r in got)
        report = K.stability_report(a, df, "k", "y", 2).collect()
        assert all(r.ari_vs_baseline == 1 and r.jaccard_language_membership == 1 and r.share_language_cluster == 1 and r.language_cluster_size == 20 for r in report)


def test_extraction_by_a_models_choice(spark):
    from cohortlens.plans import api

    block = lambda i, source, sec, text: ("P", source, i, f"P__{i}", [sec], sec, text, len(text))
    blocks = spark.createDataFrame([block(0, "abstract", "", "He was diagnosed."), block(1, "body", "Case report", "The proband spoke."), block(2, "body", "History", "A long history."), block(3, "body", "Methods", "We used PSP criteria."), block(4, "body", "Clinical course", "It went on.")], T.BLOCKS)
    chosen = api.chosen_sections(blocks, spark.createDataFrame([("P", ["History", "Made up"])], "pmcid string, selected array<string>"))
    assert [r.sec_path_str for r in chosen.orderBy("place").collect()] == ["Case report", "History"]
    got = {r.segment_type: r.block_ids for r in api.extract_segments(blocks, ["zzz"]).collect()}
    assert got == {"case_presentation": ["P__1", "P__2", "P__4"], "other": ["P__0", "P__3"]}
    lists = lambda *rows: spark.createDataFrame([("P", "case_1", k, ids) for k, ids in rows], "pmcid string, case_id string, segment_type string, block_ids array<string>")
    both = {r.segment_type: r.block_ids for r in api.extract_segments(blocks, [], lists=lists(("other", ["P__1", "P__4"]), ("case_presentation", ["P__1"]))).collect()}
    assert both == {"case_presentation": ["P__1"], "other": ["P__4"]}
    with pytest.raises(ValueError):
        api.extract_segments(blocks, [], lists=lists(("other", ["P__9"])))


def test_run_config_and_reference_lock(tmp_path):
    from cohortlens.sources import config as C

    c = C.run_config({"k": 4}, {"label": "say"}, {"cases": 3})
    assert c["prompt_sha256"] == {"label": hashlib.sha256(b"say").hexdigest()} and c["counts"] == {"cases": 3} and set(c["versions"]) == {"python", "pyspark"}
    path = f"{tmp_path}/a/lock.json"
    C.lock_references(path, {"b": 2, "a": 1}, {"a": {"pmid": "7"}, "b": {"pmid": "8"}, "c": {"pmid": "9"}})
    assert [(r["number"], r["cite_key"], r["pmid"]) for r in json.load(open(path))["references"]] == [(1, "a", "7"), (2, "b", "8")]
    with pytest.raises(KeyError):
        C.lock_references(path, {"x": 1}, {})
