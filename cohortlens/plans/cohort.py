"""Cohort plans: split analysis, pooled estimation, stage pipeline, robustness. Compositions of operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as X, stats, text as S
from ..operators import inference as I, refits as N, relational as R, sampling as P, vectors as V

KEY = ["pmcid", "case_id"]


def eligible_cases(labels: DataFrame, segments: DataFrame, tiers: Sequence[str] = ("ftld_strict",), min_segments: int = 1, one_per_paper: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cases, flow table): latest labels of the tiers with clean text. Raises if any included text still leaks (FLT-09)."""
    latest = R.latest_per_key(labels, KEY, ["ingest_seq"])
    tier = latest.where(F.col("ftld_inclusion_tier").isin(*tiers) & F.col("split").isin("discovery", "confirmation"))
    used = segments.where(F.coalesce("include_for_embedding", F.lit(False)) & F.col("text_clean").isNotNull() & (F.trim("text_clean") != ""))
    used = used.join(tier.select(*KEY), KEY, "left_semi")
    if used.agg(F.sum("leakage_n_matches_clean")).first()[0]:
        raise ValueError("text for embedding holds terms that it must not")
    counts = used.groupBy(*KEY).agg(F.count("*").alias("n_segments"))
    with_text = tier.join(counts, KEY, "left").withColumn("n_segments", F.coalesce("n_segments", F.lit(0)))
    enough = with_text.where(F.col("n_segments") >= min_segments)
    cases = R.first_per_key(enough, ["pmcid"], ["case_id"]) if one_per_paper else enough
    flow = R.flow_table([("labelled", latest), ("tier_and_split", tier), ("with_text", with_text.where("n_segments > 0")), ("enough_segments", enough), ("analysed", cases)], KEY, "split")
    return cases.withColumn("doc_id", F.concat_ws("__", *KEY)).withColumn("is_ppa", F.coalesce(F.col("ftld_syndrome_reported").isin(*X.POSITIVE_SYNDROMES), F.lit(False))), flow


def analyse_splits(cases: DataFrame, vectors: DataFrame, key: str = "doc_id", split: str = "split", positive: str = "is_ppa", k: int = X.CLUSTERS, seeds: Sequence[int] = range(10), draws: int = X.PERMUTATIONS, seed: int = X.SEED, fit_on: str | None = "discovery") -> dict[str, DataFrame]:
    """Entry A: pool, reduce, cluster each split, match, test, estimate. ``vectors`` has (key, embedding), several rows per key."""
    pooled = cases.join(V.mean_vectors(vectors, [key], "embedding", True), key)
    reduced, _ = V.pca(pooled.select(key, split, "embedding").withColumn("full", F.col("embedding")), key, "embedding", (F.col(split) == fit_on) if fit_on else None)
    parts = [V.kmeans(reduced.where(F.col(split) == s), "embedding", k, seeds) for s in ("discovery", "confirmation")]
    clustered = parts[0].unionByName(parts[1])
    full = V.mean_vectors(clustered.select(split, "cluster", "full"), [split, "cluster"], "full")
    side = lambda s: full.where(F.col(split) == s)
    matrix = V.match_clusters(V.cosine_matrix(side("discovery"), side("confirmation"), "cluster", "cluster", "full"))
    map_ = matrix.where("matched").select(F.col("discovery_cluster").alias("_d"), F.col("confirmation_cluster").alias("cluster"))
    table = cases.join(clustered.select(key, "cluster"), key)
    aligned = table.join(F.broadcast(map_), "cluster", "left").withColumn("cluster_matched", F.when(F.col(split) == "discovery", F.col("cluster")).otherwise(F.col("_d"))).drop("_d")
    return {"cases": aligned, "cluster_similarity_matrix": matrix, "cluster_summary": cluster_summary(aligned, split, "cluster", F.col(positive), k), **replication(aligned, key, split, "cluster_matched", F.col(positive), draws, seed)}


def cluster_summary(cases: DataFrame, split: str, cluster: str, positive: Column, k: int) -> DataFrame:
    """Every cluster of every split, empty ones as zeros (AGG-29)."""
    per = cases.groupBy(split, cluster).agg(F.count("*").alias("n_cases"), F.sum(positive.cast("long")).alias("ppa_cases"))
    base = cases.groupBy(split).agg(F.avg(positive.cast("double")).alias("ppa_share_split"))
    every = base.select(split, "ppa_share_split", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(cluster))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(per, [split, cluster], "left").select(split, cluster, zero("n_cases"), zero("ppa_cases"), F.when(F.col("n_cases") > 0, F.col("ppa_cases") / F.col("n_cases")).alias("ppa_share"), "ppa_share_split")


def replication(cases: DataFrame, key: str, split: str, cluster: str, positive: Column, draws: int, seed: int) -> dict[str, DataFrame]:
    """Selection-aware test in discovery, fixed-cluster test in confirmation, effects in both."""
    disc, conf = cases.where(F.col(split) == "discovery"), cases.where(F.col(split) == "confirmation")
    top = R.top_cluster(disc, [split], cluster, positive).select(F.col(cluster).alias("language_cluster"))
    effects = R.enrichment(cases, [split], cluster, positive)
    return {"discovery_test": I.max_share_test(disc, key, cluster, positive, draws, seed), "confirmation_test": I.fixed_cluster_test(conf, key, cluster, positive, draws, seed), "effects": effects, "language_cluster": top}


def endpoint_tests(cases: DataFrame, key: str, split: str, cluster: str, endpoint: str, endpoints: Sequence[str], draws: int, seed: int = X.SEED) -> DataFrame:
    """For each endpoint value: its top cluster in discovery tested in confirmation, with FDR over endpoints (STT-08)."""
    wanted = F.array(*(F.struct(F.lit(e).alias("endpoint")) for e in endpoints))
    # one count by split, cluster and value; endpoints only look at it
    cells = cases.groupBy(F.col(split).alias("_split"), F.col(cluster).alias("cluster"), F.col(endpoint).alias("_value")).agg(F.count("*").alias("_n"))
    hit = F.when(F.coalesce(F.col("_value") == F.col("endpoint"), F.lit(False)), F.col("_n")).otherwise(0)
    counts = cells.select("*", F.explode(wanted).alias("_e")).select("*", "_e.endpoint").groupBy("_split", "endpoint", "cluster").agg(F.sum("_n").alias("n"), F.sum(hit).alias("positives"))
    share = F.col("positives") / F.col("n")
    top = R.first_per_key(counts.where("_split = 'discovery'").select("*", share.alias("discovery_share"), (-share).alias("_low")), ["endpoint"], ["_low", "cluster"]).select("endpoint", "cluster", "discovery_share")
    tests = I.fixed_cluster_counts(counts.where("_split = 'confirmation'").select("endpoint", "cluster", "n", "positives"), draws, seed, ["endpoint"])
    out = tests.join(top, ["endpoint", "cluster"])
    return R.bh_fdr(out, "p", "endpoint").withColumnsRenamed({"q": "confirmation_q_bh_fdr", "reject": "confirmation_reject_bh_fdr"})


def precision(cases: DataFrame, split: str, cluster: str, positive: Column) -> DataFrame:
    """Shares with Wilson intervals and ratios by split and pooled (STT-19)."""
    n = R.split_and_pooled(cases, split, cluster, [F.count("*").alias("n_cases"), F.sum(positive.cast("long")).alias("a")])
    from pyspark.sql import Window as W

    w = W.partitionBy(split)
    a, m = F.col("a"), F.col("n_cases")
    c, d = F.sum("a").over(w) - a, F.sum(m - a).over(w) - (m - a)
    t = n.withColumn("_c", c).withColumn("_d", d)
    low, high = stats.wilson(a, m)
    e = stats.effect_sizes(a, m - a, F.col("_c"), F.col("_d"))
    return t.select(split, cluster, "n_cases", F.col("a").alias("positive_n"), (a / m).alias("share"), low.alias("wilson_low"), high.alias("wilson_high"), e["rr"].alias("rr"), e["rr_low"].alias("rr_low"), e["rr_high"].alias("rr_high"), e["odds_ratio"].alias("odds_ratio"))


def secondary_precision(cases: DataFrame, tests: DataFrame, split: str, cluster: str, endpoint: str) -> DataFrame:
    """Precision of the endpoints that pass FDR, in the cluster that discovery named, by split and pooled (STT-20)."""
    kept = tests.where("confirmation_reject_bh_fdr").select("endpoint", F.col("cluster").alias("target_matched_cluster"), F.col("p").alias("confirmation_p"), "confirmation_q_bh_fdr")
    rows = cases.select(F.col(split).alias("split"), F.col(cluster).alias("_c"), F.col(endpoint).alias("_e"))
    # one aggregate by split, cluster and endpoint; endpoints are few
    n = rows.groupBy("split", "_c", "_e").agg(F.count("*").alias("n"))
    sides = n.unionByName(n.withColumn("split", F.lit("pooled")))
    inside, hit = F.col("_c").eqNullSafe(F.col("target_matched_cluster")), F.coalesce(F.col("_e") == F.col("endpoint"), F.lit(False))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    t = sides.crossJoin(F.broadcast(kept)).groupBy("endpoint", "split", "target_matched_cluster", "confirmation_p", "confirmation_q_bh_fdr").agg(F.sum("n").alias("n_total"), count(inside).alias("n_cluster"), count(hit).alias("pos_total"), count(inside & hit).alias("pos_cluster"))
    a, b = F.col("pos_cluster"), F.col("n_cluster") - F.col("pos_cluster")
    c, d = F.col("pos_total") - F.col("pos_cluster"), F.col("n_total") - F.col("n_cluster") - F.col("pos_total") + F.col("pos_cluster")
    low, high = stats.wilson(a, F.col("n_cluster"))
    return t.select("endpoint", "split", "target_matched_cluster", "n_total", "n_cluster", "pos_total", "pos_cluster", low.alias("wilson_low"), high.alias("wilson_high"), *(v.alias(k) for k, v in stats.effect_sizes(a, b, c, d).items()), "confirmation_p", "confirmation_q_bh_fdr")


def stage_pipeline(curated: DataFrame, vectors: DataFrame, key: str, stage: str, subtype: str, markers: Sequence[str], k: int = X.CLUSTERS, seeds: Sequence[int] = range(10), draws: int = 1000, seed: int = X.SEED) -> dict[str, DataFrame]:
    """Entry C: for every stage cluster, composition and enrichment of a marker-defined endpoint."""
    joined = curated.join(vectors.select(key, "embedding"), key).withColumn("is_ppa", S.contains_any(F.col(subtype), markers))
    stages = [r[0] for r in joined.select(stage).distinct().orderBy(stage).collect()]
    parts = [V.kmeans(joined.where(F.col(stage) == s), "embedding", k, seeds) for s in stages]
    cases = parts[0]
    for p in parts[1:]:
        cases = cases.unionByName(p)
    tests = None
    for s in stages:
        t = I.max_share_test(cases.where(F.col(stage) == s), key, "cluster", F.col("is_ppa"), draws, seed).withColumn(stage, F.lit(s))
        tests = t if tests is None else tests.unionByName(t)
    return {"cluster_assignments": cases.drop("embedding"), "cluster_composition_by_stage": R.share_of_parent(cases, [stage, "cluster"], subtype), "ppa_enrichment_stage": R.bh_fdr(tests, "p", stage), "effects": R.enrichment(cases, [stage], "cluster", F.col("is_ppa"))}


def prototypes(cases: DataFrame, later: DataFrame, key: str, cluster: str, vector: str, positive: Column, draws: int = 1000, seed: int = X.SEED) -> dict[str, DataFrame]:
    """Cases assigned to the centroids of other, clustered cases, and tested there (ML-13 to ML-15)."""
    centres = V.mean_vectors(later, [cluster], vector)
    assigned = V.nearest_centroid(cases, centres, cluster, vector)
    return {"assigned": assigned, "effects": R.enrichment(assigned.withColumn("_all", F.lit(1)), ["_all"], "assigned", positive), "tests": I.fixed_cluster_test(assigned, key, "assigned", positive, draws, seed)}


def pooled_notes(notes: DataFrame, patient: str, text_vector: str, label: str, order: str) -> DataFrame:
    """Notes to patients: mean vector, majority label, number of notes, mixed-label flag (AGG-18, STT-24)."""
    v = V.mean_vectors(notes, [patient], text_vector, True)
    y = F.col(label).cast("int")
    g = notes.groupBy(patient).agg((F.avg(y) >= 0.5).alias(label), F.count("*").alias("n_notes"), F.min_by(order, order).alias("first_note"), ((F.sum(y) > 0) & (F.sum(y) < F.count("*"))).alias("mixed_labels"))
    return g.join(v, patient)


#: Restarts of every refit.
RESTARTS = 5


def resampled(cases: DataFrame, key: str, vector: str, baseline: str, replicates: int, share: float, k: int, seed: int = X.SEED) -> DataFrame:
    """Assignments of all cases by k-means on each subsample: (replicate, key, cluster, baseline) (ML-10).

    A refit's clusters carry the numbers of the baseline's clusters that their centres match one to one. Subsamples are those of
    ``sampling.bootstrap``; rows of one key are in or out together. All replicates are refitted side by side, see ``operators.refits``.
    """
    bounds = {r.replicate: r.bound for r in P.sample_bounds(cases.where(F.col(vector).isNotNull()), key, replicates, share, k, seed).collect()}
    if not bounds:
        return cases.sparkSession.createDataFrame([], f"replicate int, {key} {dict(cases.dtypes)[key]}, cluster int, baseline int")
    # the k-th hash of a replicate is its bound: a row knows by itself where it belongs
    limits = F.array(*(F.lit(bounds[b]) for b in range(replicates)))
    member = F.transform(limits, lambda limit, b: P.share_of_hash(P.draw_order(seed, b, F.col(key))) <= limit)
    return _refitted(cases, key, vector, baseline, k, list(range(replicates)), [seed + b for b in range(replicates)], member)


def reseeded(cases: DataFrame, key: str, vector: str, baseline: str, seeds: Sequence[int], k: int) -> DataFrame:
    """The same for k-means on all cases under other seeds; the replicate is the seed (ML-11)."""
    return _refitted(cases, key, vector, baseline, k, list(seeds), list(seeds), None)


def _refitted(cases: DataFrame, key: str, vector: str, baseline: str, k: int, names: list[int], salts: list[int], member: Column | None) -> DataFrame:
    """Of every replicate: k-means on the rows that are in, all rows assigned, clusters named after the baseline's."""
    import numpy as np
    from pyspark import StorageLevel

    kind = dict(cases.dtypes)[key]
    empty = cases.sparkSession.createDataFrame([], f"replicate int, {key} {kind}, cluster int, baseline int")
    known = cases.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), F.col(baseline).cast("int").alias("baseline"), F.xxhash64(F.col(key)).alias("id"), *([] if member is None else [member.alias("member")]))
    known = known.persist(StorageLevel.MEMORY_AND_DISK)
    rows = known.select("id", "vector", *([] if member is None else ["member"]))
    try:
        if member is None:
            sizes = np.full(len(names), known.count(), float)
        else:
            one = known.agg(*(F.count_if(F.col("member")[b]).alias(str(b)) for b in range(len(names)))).first()
            sizes = np.array(one, float)
        if not sizes.all():
            return empty
        starts = N.parallel_seeds(rows, sizes, k, salts, RESTARTS)
        run = np.repeat(np.arange(len(names)), RESTARTS)
        centres, cost = N.batched_lloyd(rows, starts, run if member is not None else np.zeros(len(run), int))
        best = [r * RESTARTS + int(cost[r * RESTARTS : (r + 1) * RESTARTS].argmin()) for r in range(len(names))]
        base = {r.baseline: np.array(r.vector) for r in V.mean_vectors(known.where("baseline IS NOT NULL"), ["baseline"], "vector").collect()}
    finally:
        known.unpersist()
    old = sorted(base)
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), V.EPS)
    numbers = []
    for b in best:
        like = unit(centres[b]) @ unit(np.stack([base[n] for n in old])).T if old else np.zeros((k, 0))
        to = V.best_matching({(i, j): float(like[i, j]) for i in range(k) for j in range(len(old))})
        # clusters beyond the baseline's get numbers after its largest
        numbers.append([old[to[i]] if i in to else (old[-1] if old else -1) + 1 + i for i in range(k)])
    out = N.assigned(known.select("key", "vector", "baseline"), centres[best], numbers, names, kind)
    return out.withColumnRenamed("key", key)


def stability_report(assignments: DataFrame, positives: DataFrame, key: str, positive: str, language: int) -> DataFrame:
    """Of every replicate: ARI against the baseline, overlap of the language cluster with the baseline's, its size, share and ratio (ML-10, ML-11)."""
    rows = assignments.join(positives.select(key, F.col(positive).cast("boolean").alias("_y")), key)
    now, then, y = F.col("cluster") == language, F.col("baseline") == language, F.coalesce("_y", F.lit(False))
    per = rows.groupBy("replicate").agg(F.count_if(now & then).alias("both"), F.count_if(now | then).alias("either"), F.count_if(now).alias("language_cluster_size"), F.count_if(now & y).alias("a"), F.count_if(y).alias("_pos"), F.count("*").alias("_n"))
    b, c = F.col("language_cluster_size") - F.col("a"), F.col("_pos") - F.col("a")
    e = stats.effect_sizes(F.col("a"), b, c, F.col("_n") - F.col("language_cluster_size") - c)
    found = per.select("replicate", stats.jaccard(F.col("both"), F.col("either")).alias("jaccard_language_membership"), F.lit(language).alias("language_cluster"), "language_cluster_size", e["share_cluster"].alias("share_language_cluster"), e["rr"].alias("rr"))
    return stability(assignments).join(found, "replicate")


def stability(assignments: DataFrame) -> DataFrame:
    """Adjusted Rand index of every replicate against the baseline."""
    cells = assignments.groupBy("replicate", "cluster", "baseline").agg(F.count("*").alias("n"))
    g = cells.groupingSets([["replicate", "cluster", "baseline"], ["replicate", "cluster"], ["replicate", "baseline"], ["replicate"]], "replicate", "cluster", "baseline").agg(F.grouping_id("replicate", "cluster", "baseline").alias("g"), F.sum("n").alias("n"))
    part = lambda k: F.sum(F.when(F.col("g") == k, stats.pairs(F.col("n"))))
    s = g.groupBy("replicate").agg(part(0).alias("ij"), part(1).alias("i"), part(2).alias("j"), part(3).alias("t"))
    e, m = F.col("i") * F.col("j") / F.when(F.col("t") > 0, F.col("t")), (F.col("i") + F.col("j")) / 2
    return s.select("replicate", F.coalesce(F.when(m != e, (F.col("ij") - e) / F.when(m != e, m - e)), F.lit(1.0)).alias("ari_vs_baseline"))


def scenario_suite(scenarios: dict[str, callable]) -> list[tuple[str, str, object]]:
    """Runs named scenarios; an error is a row, not the end (specification curve, robustness suite)."""
    out = []
    for name, run in scenarios.items():
        try:
            out.append((name, "ok", run()))
        except Exception as e:
            out.append((name, "error", f"{type(e).__name__}: {e}"))
    return out


def specification_curve(effects: DataFrame, scenario: str) -> DataFrame:
    """Odds ratios of scenarios in order, with correction only on zero cells (STT-23)."""
    from pyspark.sql import Window as W

    e = stats.odds_ratio_on_zero(*(F.col(k) for k in "abcd"))
    t = effects.select(scenario, *(v.alias(k) for k, v in e.items()))
    return t.withColumn("place", F.row_number().over(W.orderBy("odds_ratio", scenario)))
