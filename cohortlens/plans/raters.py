"""Rater validation and citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import fixed as X, text as S
from ..operators import inference as I, relational as R, sampling as P

FIELDS = ["text_adequate", "is_ftld_spectrum", "is_ppa", *(f"tag__{t}" for t in X.SYMPTOM_TAGS)]


def rater_sample(cases: DataFrame, strata: Sequence[str], key: Sequence[str], n: int = 200, seed: int = X.SEED) -> DataFrame:
    """Stratified sample with a sequential blinded id (RAT-01, PRJ-06)."""
    stratum = F.concat_ws("|", *(F.coalesce(F.col(s).cast("string"), F.lit("missing")) for s in strata))
    got = P.stratified_sample(cases, stratum, key, n, seed)
    number = F.row_number().over(W.orderBy(P.hash_order(seed, *(F.col(k) for k in key)), *key))
    return got.withColumn("case_uid", F.format_string("RAT%04d", number))


def templates(sample: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    return sample.select("case_uid", *(F.lit(None).cast("int").alias(f) for f in fields), F.lit(None).cast("string").alias("notes"))


def coverage(sample: DataFrame, population: DataFrame, strata: Sequence[str]) -> DataFrame:
    p = population.groupBy(*strata).agg(F.count("*").alias("population_n"))
    s = sample.groupBy(*strata).agg(F.count("*").alias("sample_n"))
    same = None
    for c in strata:
        e = p[c].eqNullSafe(s[c])
        same = e if same is None else same & e
    return p.join(s, same, "left").select(*(p[c] for c in strata), "population_n", F.coalesce("sample_n", F.lit(0)).alias("sample_n"))


def paired(r1: DataFrame, r2: DataFrame, fields: Sequence[str] = FIELDS, key: str = "case_uid") -> DataFrame:
    """Both raters' fields as 0, 1 or null side by side (JN-04, NUM-02)."""
    side = lambda d, s: d.select(key, *(S.to_binary(F.col(f)).alias(f"{f}_{s}") for f in fields))
    return side(r1, "r1").join(side(r2, "r2"), key)


def score(r1: DataFrame, r2: DataFrame, fields: Sequence[str] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """(kappa report, adjudication sheet)."""
    p = paired(r1, r2, fields)
    return I.kappa_report(p, fields, "text_adequate" if "text_adequate" in fields else None), I.adjudication(p, ["case_uid"], fields)


def relabel(cases: DataFrame, ratings: DataFrame, key: Sequence[str], exclude_non_spectrum: bool = False) -> DataFrame:
    """Consensus ratings of adequate texts override the endpoint (STT-16); cases that raters put outside the spectrum may go."""
    ok = ratings.where(S.to_binary(F.col("text_adequate")) == 1)
    over = ok.select(*key, S.to_binary(F.col("is_ppa")).cast("boolean").alias("is_ppa"))
    out = R.apply_overrides(cases, over, key, ["is_ppa"])
    if exclude_non_spectrum:
        out = out.join(ok.where(S.to_binary(F.col("is_ftld_spectrum")) == 0).select(*key), list(key), "left_anti")
    return out


def relabel_study(cases: DataFrame, ratings: DataFrame, key: Sequence[str], split: str, cluster: str, source: str = "raters", exclude_non_spectrum: bool = False, draws: int = X.PERMUTATIONS, seed: int = X.SEED) -> dict[str, DataFrame]:
    """The primary summary again under ratings, clusters as they are (STT-16): ``cases``, ``counts`` of what changed, ``summary`` of one row.

    ``cluster`` names clusters as discovery does, in both splits. A rating counts where its text is adequate; of a case rated more than
    once a field counts if all its ratings agree. ``cases`` keeps the endpoint as ``is_ppa_llm`` and says whose it is in
    ``is_ppa_source``. The cluster with the largest share in discovery, ties to the smallest, is tested there with its selection in
    mind and in confirmation as it is; a cluster that confirmation lacks has nulls there. A split without cases is an error.
    """
    from ..functions import stats

    ok = ratings.where(S.to_binary(F.col("text_adequate")) == 1).select(*key, S.to_binary(F.col("is_ppa")).alias("_ppa"), S.to_binary(F.col("is_ftld_spectrum")).alias("_spectrum"))
    agreed = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    rated = cases.join(ok.groupBy(*key).agg(agreed("_ppa"), agreed("_spectrum")), list(key), "left")
    out_of = F.coalesce(F.col("_spectrum") == 0, F.lit(False)) if exclude_non_spectrum else F.lit(False)
    counts = rated.agg(F.count("_ppa").alias("n_overrides"), F.count_if(out_of).alias("n_excluded"))
    base = F.coalesce(F.col("is_ppa"), F.lit(False))
    named = {"is_ppa": F.coalesce(F.col("_ppa") == 1, base), "is_ppa_llm": base, "is_ppa_source": F.when(F.col("_ppa").isNotNull(), source).otherwise("llm")}
    final = rated.where(~out_of).withColumns(named).drop("_ppa", "_spectrum")

    cells = final.where(F.col(split).isin("discovery", "confirmation")).groupBy(F.col(split).alias("split"), F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"), F.count_if("is_ppa").alias("yes"))
    totals = cells.groupBy("split").agg(F.sum("n").alias("all_n"), F.sum("yes").alias("all_yes"))
    if totals.count() < 2:
        raise ValueError("discovery or confirmation has no case left")
    language = cells.where("split = 'discovery' AND cluster IS NOT NULL").agg(F.min(F.struct((-F.col("yes") / F.col("n")).alias("low"), "cluster"))["cluster"].alias("cluster"))
    inside = cells.where(F.col("cluster") == language.scalar())
    sides = totals.join(inside, "split", "left")
    effects = stats.effect_sizes(F.col("yes"), F.col("n") - F.col("yes"), F.col("all_yes") - F.col("yes"), F.col("all_n") - F.col("n") - F.col("all_yes") + F.col("yes"))
    sides = sides.select("split", F.col("all_n").alias("n"), *(v.alias(k) for k, v in effects.items() if k != "share_split"))
    of = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}")
    row = sides.agg(*(of(s, c) for s in ("discovery", "confirmation") for c in sides.columns if c != "split"))

    part = lambda s: final.where(F.col(split) == s)
    first = I.max_share_test(part("discovery"), key[0], cluster, F.col("is_ppa"), draws, seed).agg(F.max("p"))
    fixed = I.fixed_cluster_test(part("confirmation"), key[0], cluster, F.col("is_ppa"), draws, seed)
    second = fixed.where(F.col("cluster") == language.select(F.col("cluster").cast("string")).scalar()).agg(F.max("p"))
    summary = row.select(language.scalar().alias("language_cluster"), "*", first.scalar().alias("discovery_p"), second.scalar().alias("confirmation_p"), F.lit(draws).alias("permutations"))
    return {"cases": final, "counts": counts, "summary": summary}


def coerce_rating(df: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """A model's rating: adequacy missing counts as 0 with an error; at 0 the other fields are blank (JSN-08)."""
    ok = S.to_binary(F.col("text_adequate"))
    rest = [f for f in fields if f != "text_adequate"]
    return df.select(*(c for c in df.columns if c not in fields), F.coalesce(ok, F.lit(0)).alias("text_adequate"), *(F.when(ok == 1, S.to_binary(F.col(f))).alias(f) for f in rest), F.when(ok.isNull(), "text_adequate missing").alias("error"))


# ---- virtual raters ----

ANSWERS = "rater string, case_uid string, answer string, error string, at timestamp"


def _asked(raters: dict, text: str):
    import json

    from ..sources import services

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for name, case, packet in zip(pdf["rater"], pdf["case_uid"], pdf[text]):
                try:
                    rows.append((name, case, json.dumps(services.ask(raters[name], packet or "")), None))
                except Exception as e:  # a case that fails is a row, and is asked again when wanted
                    rows.append((name, case, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["rater", "case_uid", "answer", "error"])

    return run


def answers(spark, out: str) -> DataFrame:
    """The latest answer of every rater to every case in the log under ``out``."""
    from ..streaming.ingest import _exists

    log = spark.read.schema(ANSWERS).parquet(out) if _exists(spark, out) else spark.createDataFrame([], ANSWERS)
    return R.latest_per_key(log, ["rater", "case_uid"], ["at"])


def rate_cases(cases: DataFrame, raters: dict, out: str, text: str = "packet", parts: int = 16, retry_errors: bool = False) -> DataFrame:
    """The loop of virtual raters (RAT-05): ``raters`` (name: model with ``label(packet)``) fill in their sheets for ``cases`` (case_uid, packet).

    Answers go to an append log, a part of the questions at a time: what was asked before, in this run or an earlier one, is left out by its key, so a run
    that was killed is taken up where its last part ended. Failed cases stay failed unless ``retry_errors`` is set. Repeated cases are one.
    """
    spark = cases.sparkSession
    names = F.explode(F.array(*map(F.lit, sorted(raters)))).alias("rater") if raters else F.explode(F.array().cast("array<string>")).alias("rater")
    every = cases.where("case_uid IS NOT NULL").select(F.col("case_uid").cast("string").alias("case_uid"), text).groupBy("case_uid").agg(F.min(text).alias(text)).select("*", names)
    for part in range(parts):
        done = answers(spark, out).where(F.lit(not retry_errors) | F.col("error").isNull()).select("rater", "case_uid")
        mine = every.where(P.hash_shard(F.concat_ws(":", "rater", "case_uid"), parts) == part).join(done, ["rater", "case_uid"], "left_anti").select("rater", "case_uid", text)
        told = mine.mapInPandas(_asked(raters, text), "rater string, case_uid string, answer string, error string")
        told.withColumn("at", F.current_timestamp()).write.mode("append").parquet(out)
    return answers(spark, out)


def filled_sheet(found: DataFrame, rater: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """A rater's sheet from the log's answers: (case_uid, fields as 0, 1 or blank, error) (JSN-08)."""
    of = lambda f: F.get_json_object("answer", f"$.{f}").alias(f)
    got = coerce_rating(found.where((F.col("rater") == rater) & F.col("error").isNull()).select("case_uid", *map(of, fields)), fields)
    failed = found.where((F.col("rater") == rater) & F.col("error").isNotNull()).select("case_uid", "error")
    return got.unionByName(failed, allowMissingColumns=True)


# ---- citations ----


def cite_numbers(documents: DataFrame, doc: str, md: str) -> DataFrame:
    """Keys of a document numbered by first appearance (CIT-01, CIT-02)."""
    e = documents.select(doc, F.posexplode(S.cite_keys(F.col(md))).alias("p", "cite_key")).groupBy(doc, "cite_key").agg(F.min("p").alias("p"))
    return e.withColumn("number", F.row_number().over(W.partitionBy(doc).orderBy("p"))).drop("p")


def apply_citations(documents: DataFrame, doc: str, md: str, known: DataFrame | None = None) -> DataFrame:
    """Tags become ^N^; a key that ``known`` lacks fails the query (CIT-03, SET-04)."""
    numbers = cite_numbers(documents, doc, md)
    if known is not None:
        missing = numbers.join(known.select("cite_key"), "cite_key", "left_anti").limit(20).collect()
        if missing:
            raise KeyError(f"unknown citation keys: {sorted({r[0] for r in missing})}")
    maps = numbers.groupBy(doc).agg(F.collect_list(F.struct("cite_key", "number")).alias("m"))
    swap = F.aggregate(F.coalesce("m", F.array().cast("array<struct<cite_key:string,number:int>>")), F.col(md), lambda t, x: F.replace(t, F.concat(F.lit("{{cite:"), x["cite_key"], F.lit("}}")), F.concat(F.lit("^"), x["number"].cast("string"), F.lit("^"))))
    return documents.join(maps, doc, "left").withColumn(md, swap).drop("m")


def with_references(md: str, references: Sequence[str]) -> str:
    """Replaces or appends the References section (CIT-06)."""
    import re

    block = "## References\n\n" + "\n".join(f"{i}. {r}" for i, r in enumerate(references, 1)) + "\n"
    head = re.split(r"(?m)^##\s+References\s*$", md, maxsplit=1)[0].rstrip("\n")
    return f"{head}\n\n{block}"
