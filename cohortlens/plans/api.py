"""The commands of the workflow as functions on tables. Each takes and returns DataFrames; writing is the caller's."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed as X, text as S
from ..operators import inference as I, labels as L, relational as R, sampling as P, vectors as V
from ..sources import documents as D, services, tables as T
from . import cohort as K, raters as A


def audit(curated: DataFrame, terms: Sequence[str], text: str = "Description") -> DataFrame:
    """Leakage of every row before and after redaction; never aborts (STT-25)."""
    clean = S.redact(F.col(text), terms, " ")
    return curated.select("*", S.leak_count(F.col(text), terms).alias("leakage_n_matches_raw"), S.leak_count(clean, terms).alias("leakage_n_matches_clean"), S.leak_matches(F.col(text), terms).alias("leakage_matches"))


def make_curated(df: DataFrame, terms: Sequence[str], derived: Sequence[str] = (), text: str = "Description") -> DataFrame:
    """Without derived columns and blank texts, redacted; raises where a term is left (PRJ-04)."""
    kept = df.drop(*[c for c in df.columns if any(c.startswith(p) for p in derived)]).where(F.trim(F.coalesce(text, F.lit(""))) != "")
    out = kept.withColumn(text, S.normalize_whitespace(S.redact(F.col(text), terms, " ")))
    if out.agg(F.sum(S.leak_count(F.col(text), terms))).first()[0]:
        raise ValueError("a term is left")
    return out


def search(spark: SparkSession, term: str, find: Callable, count: Callable, page_size: int = 5000) -> DataFrame:
    return T.registry_urls(services.paged_search(spark, term, find, count, page_size), "uid")


def recommend_split(registry: DataFrame, min_per_split: int = 200, tie: str = "earlier") -> DataFrame:
    return T.recommend_split(T.year_counts(registry, S.to_number(F.col("year")).cast("int")), min_per_split, tie)


make_manifest = T.manifest


def to_fetch(registry: DataFrame, n: int | None = None, how: str = "latest", seed: int = X.SEED) -> DataFrame:
    """Rows with an id that can be fetched (FLT-06): all, the latest n, or n at random (SMP-02)."""
    if how not in ("latest", "random"):
        raise ValueError(f"no such choice: {how}")
    rows = registry.where(F.col("pmcid").startswith("PMC"))
    if n is None:
        return rows
    return rows.orderBy(F.desc_nulls_last("year"), "pmcid").limit(n) if how == "latest" else P.hash_sample(rows, ["pmcid"], n, seed)


def fetch(registry: DataFrame, fetcher: services.Fetcher, n: int | None = None, how: str = "latest", folder: str | None = None, overwrite: bool = False, pace: services.Pace | None = None) -> DataFrame:
    """Documents of the registry, as rows or as files of a shared folder; errors are rows. ``pace`` holds all tasks to one rate."""
    rows = to_fetch(registry, n, how)
    return services.fetch_all(rows, "pmcid", fetcher, pace=pace) if folder is None else services.fetch_files(rows, "pmcid", fetcher, folder, overwrite=overwrite, pace=pace)


parse = D.parse_files


def chosen_sections(blocks: DataFrame, choice: DataFrame | None = None, most: int = 12) -> DataFrame:
    """(pmcid, sec_path_str, place) of the sections to read: must, then a model's choice (pmcid, selected) among the routed; without a model, all routed (DOC-08)."""
    routed = D.routed_sections(blocks)
    names = lambda route: F.transform(F.array_sort(F.collect_list(F.when(F.col("route") == route, F.struct((-F.col("n_chars")).alias("o"), "sec_path_str")))), lambda x: x["sec_path_str"])
    per = routed.groupBy("pmcid").agg(names("must").alias("must"), names("candidate").alias("candidates"))
    allowed = F.concat("must", "candidates")
    per = per.withColumn("selected", F.col("candidates")) if choice is None else per.join(choice.select("pmcid", "selected"), "pmcid", "left")
    final = D.final_sections(F.col("must"), F.coalesce("selected", F.array().cast("array<string>")), allowed, most)
    return per.select("pmcid", F.posexplode(final).alias("place", "sec_path_str")).select("pmcid", "sec_path_str", "place")


def extract_segments(blocks: DataFrame, terms: Sequence[str], most_blocks: int = 140, most_chars: int = 60_000, choice: DataFrame | None = None, lists: DataFrame | None = None) -> DataFrame:
    """Chosen, guarded, capped blocks of each document as its segments (DOC-08, DOC-09, TOP-03, WIN-09).

    ``lists`` (pmcid, case_id, segment_type, block_ids) is a model's extraction: unknown ids are refused, and a block stays with the first
    segment that uses it. Without one, the first four chosen blocks are the case's presentation, and blocks with a trigger elsewhere its other segment.
    """
    sections = chosen_sections(blocks, choice)
    passed = D.guardrail(blocks, sections).where("passed").select("pmcid")
    read = blocks.join(passed, "pmcid", "left_semi")
    chosen = D.select_blocks(read.where(F.col("source") == "body"), sections, most_blocks, most_chars)
    if lists is None:
        ids = F.transform(F.array_sort(F.collect_list(F.struct("block_index", "block_id"))), lambda x: x["block_id"])
        case = lambda df, kind: df.groupBy("pmcid").agg(ids.alias("block_ids")).select("pmcid", F.lit("case_1").alias("case_id"), F.lit(kind).alias("segment_type"), "block_ids")
        first = R.first_rows(chosen, ["pmcid"], ["block_index", "block_id"], 4)
        lists = case(first, "case_presentation").unionByName(case(D.extra_snippets(read, chosen), "other"))
    place = F.array_position(F.lit(X.SEGMENT_TYPES), F.col("segment_type"))
    lists = R.first_use_wins(lists.join(passed, "pmcid", "left_semi").withColumn("_place", place), "pmcid", "block_ids", ["case_id", "_place"]).drop("_place")
    return D.segments(blocks, lists, terms).withColumn("include_for_embedding", F.col("segment_type").isin("case_presentation", "disease_course", "clinical_features_summary"))


def label_cases(packets: DataFrame, first: services.Labeler, second: services.Labeler | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid labels, quarantine) of packets (case_id, packet)."""
    return L.label_table(services.label_with_escalation(packets, "packet", first, second), "label", ["escalated"])


def analyze_splits(labels: DataFrame, segments: DataFrame, vectors: DataFrame, include_broad: bool = False, **options) -> dict[str, DataFrame]:
    cases, flow = K.eligible_cases(labels, segments, ["ftld_strict", "ftld_broad"] if include_broad else ["ftld_strict"])
    return K.analyse_splits(cases, vectors, **options) | {"flow_table": flow}


def analyze_splits_suite(labels: DataFrame, segments: DataFrame, embeddings: dict[str, DataFrame], **options) -> list[tuple[str, str, object]]:
    """The fixed scenarios; errors become rows."""
    runs = {name: (lambda b=broad, p=fit, k=k, e=model: analyze_splits(labels, segments, embeddings[e], b, k=k, fit_on=None if p == "all" else p, **options)) for name, broad, fit, k, model in X.SCENARIOS}
    return K.scenario_suite(runs)


def stability_splits(cases: DataFrame, key: str, vector: str, cluster: str, k: int = X.CLUSTERS, replicates: int = X.BOOTSTRAPS, share: float = X.BOOTSTRAP_SHARE, positive: str | None = None, language: int | None = None) -> dict[str, DataFrame]:
    """Refits on subsamples and under other seeds (ML-10, ML-11); the report needs the endpoint and the language cluster."""
    a = K.resampled(cases, key, vector, cluster, replicates, share, k)
    more = {}
    if positive is not None and language is not None:
        y = cases.select(key, positive)
        more = {"stability_bootstrap": K.stability_report(a, y, key, positive, language), "stability_seed": K.stability_report(K.reseeded(cases, key, vector, cluster, range(X.SEEDS), k), y, key, positive, language)}
    return more | {"assignments": a, "ari": K.stability(a), "summary": R.quantile_summary(K.stability(a).withColumn("all", F.lit(1)), ["all"], "ari_vs_baseline")}


make_rater_sample, score_raters, relabel = A.rater_sample, A.score, A.relabel


def subset_rater_sample(sample: DataFrame, strata: Sequence[str] = ("split", "cluster"), n: int = 120, seed: int = X.SEED) -> DataFrame:
    """A locked subset over split and cluster (RAT-02)."""
    return A.rater_sample(sample.drop("case_uid"), strata, ["pmcid", "case_id"], n, seed)


def rater_study(cases: DataFrame, a: DataFrame, b: DataFrame, judge: DataFrame, key: Sequence[str] = ("case_uid",), fields: Sequence[str] = A.FIELDS) -> dict[str, DataFrame]:
    """Two raters, adjudication, consensus, agreement, relabelled cases (RAT-06)."""
    pairs = A.paired(a, b, fields)
    done = I.consensus(pairs, judge.select("case_uid", *(F.col(f).alias(f"{f}_final") for f in fields)), ["case_uid"], fields)
    return {"kappa": I.kappa_report(pairs, fields, "text_adequate"), "to_adjudicate": pairs.where(I.needs_adjudication(fields)), "consensus": done, "cases": A.relabel(cases, done, list(key))}


def virtual_rater_study(cases: DataFrame, packets: DataFrame, first: services.Labeler, second: services.Labeler, judge: services.Labeler, out: str, fields: Sequence[str] = A.FIELDS, force: bool = True, **gate) -> dict[str, DataFrame]:
    """Two virtual raters, a third for what they disagree on, consensus, agreement, relabelled cases and pooled estimation on these (RAT-05, RAT-06).

    ``cases`` has case_uid, the endpoint and the clusters, ``packets`` case_uid and packet. Every stage keeps its answers under ``out``, so a study that was
    killed asks nothing twice. ``gate`` (p, share, baseline) is that of the replication; a forced study goes on where it is not passed.
    """
    found = A.rate_cases(packets, {"first": first, "second": second}, f"{out}/raters")
    a, b = (A.filled_sheet(found, who, fields) for who in ("first", "second"))
    open_ = A.paired(a, b, fields).where(I.needs_adjudication(fields)).select("case_uid")
    judged = A.filled_sheet(A.rate_cases(packets.join(open_, "case_uid", "left_semi"), {"judge": judge}, f"{out}/judge"), "judge", fields)
    study = rater_study(cases, a, b, judged, fields=fields)
    passed = {"p": None, "share": None, "baseline": None} | gate
    return {"first": a, "second": b, "judge": judged} | study | {f"pooled_{k}": v for k, v in phase_e(study["cases"], **passed, force=force).items()}


def phase_e(cases: DataFrame, p: float, share: float, baseline: float, split: str = "split", cluster: str = "cluster_matched", positive: str = "is_ppa", alpha: float = 0.05, force: bool = False, tests: DataFrame | None = None) -> dict[str, DataFrame]:
    """Pooled estimation behind the replication gate (STT-11, STT-18 to STT-20); ``tests`` as of ``endpoint_tests``."""
    if not (force or I.replication_gate(p, share, baseline, alpha)):
        raise ValueError("the replication gate is not passed")
    e = R.enrichment(cases, [split], cluster, F.col(positive))
    directed = e.withColumn("direction", S.direction(F.col("share_cluster"), F.col("share_split")))
    tags = R.tag_summary(cases, [split, cluster]) if R.tag_columns(cases) else None
    out = {"primary_precision": K.precision(cases, split, cluster, F.col(positive)), "direction_consistency": I.direction_consistency(directed, cluster, split, "direction"), "composition": R.share_of_parent(cases, [split, cluster], "ftld_syndrome_reported")}
    if tests is not None:
        out["secondary_precision"] = K.secondary_precision(cases, tests, split, cluster, "ftld_syndrome_reported")
    return out | ({"symptom_tags": tags} if tags is not None else {})


def results_packet(found: dict[str, DataFrame], wanted: Sequence[str]) -> dict[str, str]:
    """Markdown of the wanted tables that exist (SNK-11)."""
    return {k: T.markdown_table(found[k]) for k in wanted if k in found}


def external_notes(notes: DataFrame, vectors: DataFrame, centroids: DataFrame, patient: str, note: str, label: str, draws: int = 1000) -> dict[str, DataFrame]:
    """Notes pooled by patient against frozen centroids (ML-15)."""
    joined = notes.withColumn(label, S.to_bool(F.col(label))).join(vectors, note)
    pooled = K.pooled_notes(joined, patient, "embedding", label, note)
    near = V.nearest_centroid(pooled, centroids, "cluster", "embedding")
    return {"patients": near.drop("embedding"), "effects": R.enrichment(near.withColumn("_all", F.lit("all")), ["_all"], "assigned", F.col(label)), "tests": I.fixed_cluster_test(near, patient, "assigned", F.col(label), draws)}


cite_numbers, apply_citations = A.cite_numbers, A.apply_citations
