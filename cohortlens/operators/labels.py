"""Model labels: from JSON text to checked, complete, wide rows. Expressions only; bad rows are marked, not lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as X, text as S

TEXTS = ["label_schema_version", "pmcid", "case_id", "ftld_inclusion_tier", "non_ftld_primary_category", "non_ftld_specific_dx_free_text", "ftld_syndrome_reported", "ftld_syndrome_inferred", "imaging_laterality", "genetics_status", "neuropath_status", "misdiagnosed_prior_to_ftld", "initial_dx_category", "label_confidence", "notes"]
NUMBERS = ["symptom_duration_months", "age_at_onset_years", "age_at_presentation_years"]
LISTS = ["ftld_inclusion_basis", "imaging_modalities", "imaging_regions", "genes_reported", "pathology_types", "evidence_block_ids"]
_TAG = "struct<tag:string,status:string,evidence_block_ids:array<string>>"
SCHEMA = "struct<" + ",".join([*(f"{c}:string" for c in TEXTS), *(f"{c}:double" for c in NUMBERS), *(f"{c}:array<string>" for c in LISTS), "needs_fulltext_review:boolean", f"symptom_tags:array<{_TAG}>"]) + ">"
#: Allowed values; null is allowed too but for the first two.
ENUMS = {"ftld_inclusion_tier": X.INCLUSION_TIERS, "label_confidence": X.CONFIDENCES, "ftld_syndrome_reported": X.SYNDROMES, "ftld_syndrome_inferred": X.SYNDROMES, "imaging_laterality": X.IMAGING_LATERALITIES, "genetics_status": X.GENETICS_STATUSES, "neuropath_status": X.NEUROPATH_STATUSES, "misdiagnosed_prior_to_ftld": X.MISDIAGNOSES[:-1], "initial_dx_category": X.INITIAL_DIAGNOSES[:-1], "non_ftld_primary_category": X.NON_FTLD_CATEGORIES}


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds or replaces columns that are computed once a row: what reads their parts, a filter among them, isn't merged with what makes them."""
    row = F.struct(*(v.alias(k) for k, v in columns.items()))
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), F.inline(F.array(row)))


def parse(df: DataFrame, column: str) -> DataFrame:
    """Adds ``label`` from model text; null where there is no object in it (JSN-03, JSN-04)."""
    return _once(df, label=F.from_json(S.json_object(F.col(column)), SCHEMA))


def _words(c: Column, lower: bool = True) -> Column:
    t = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)) if lower else F.trim(x))
    return F.filter(t, lambda x: x.isNotNull() & (x != ""))


def sanitize(label: Column) -> Column:
    """Values that the schema accepts, conservatively (JSN-05)."""
    tier = F.trim(F.coalesce(label["ftld_inclusion_tier"], F.lit("")))
    region = lambda x: F.when(x.isin(*X.IMAGING_REGIONS), x).otherwise("other")
    kind = lambda x: F.when(S.pathology(x) != "other", S.pathology(x)).when(x.isin(*X.PATHOLOGY_TYPES), x).otherwise("other")
    basis = S.allowed_only(_words(label["ftld_inclusion_basis"], False), X.INCLUSION_BASES)
    first = F.trim(label["initial_dx_category"])
    moved = F.lit(None).cast("string")
    for old, new in X.DIAGNOSIS_MAPPING.items():
        moved = F.when(F.lower(first) == old, new).otherwise(moved)
    none = F.trim(F.coalesce(label["non_ftld_primary_category"], F.lit("")))
    empty = F.array().cast("array<string>")
    new = {
        "imaging_modalities": F.filter(_words(label["imaging_modalities"]), lambda x: x.isin(*X.IMAGING_MODALITIES)),
        "imaging_regions": F.array_distinct(F.transform(_words(label["imaging_regions"]), region)),
        "pathology_types": F.array_distinct(F.transform(_words(label["pathology_types"]), kind)),
        "genes_reported": F.coalesce(label["genes_reported"], empty),
        "ftld_inclusion_basis": F.when(tier == "exclude", empty).when((tier == "ftld_broad") & (F.size(basis) == 0), F.array(F.lit("unclear_basis"))).otherwise(basis),
        "initial_dx_category": F.when(first.isin(*X.INITIAL_DIAGNOSES[:-1]), first).otherwise(moved),
        "non_ftld_primary_category": F.when(tier == "exclude", F.when(none.isin(*X.NON_FTLD_CATEGORIES), none).otherwise("unclear")),
        "evidence_block_ids": F.coalesce(label["evidence_block_ids"], empty),
        "symptom_tags": F.transform(F.coalesce(label["symptom_tags"], F.array().cast(f"array<{_TAG}>")), lambda t: t.withField("evidence_block_ids", F.coalesce(t["evidence_block_ids"], F.array().cast("array<string>")))),
        "needs_fulltext_review": F.coalesce(label["needs_fulltext_review"], F.lit(False)),
    }
    out = label
    for k, v in new.items():
        out = out.withField(k, v)
    return out


def errors(label: Column) -> Column:
    """What keeps a label from being valid, as an array; empty for a valid one."""
    found = [F.when(label.isNull(), "not a JSON object")]
    for k, allowed in ENUMS.items():
        bad = ~label[k].isin(*allowed) if k not in ("ftld_inclusion_tier", "label_confidence") else ~F.coalesce(label[k].isin(*allowed), F.lit(False))
        found.append(F.when(label.isNotNull() & F.coalesce(bad, F.lit(False)), f"{k} is not allowed"))
    found += [F.when(label[k] < 0, f"{k} is negative") for k in NUMBERS]
    found += [F.when(label.isNotNull() & label[k].isNull(), f"{k} is missing") for k in ("pmcid", "case_id")]
    found.append(F.when(label.isNotNull() & (F.coalesce(F.size(label["evidence_block_ids"]), F.lit(0)) < 1), "evidence_block_ids is empty"))
    found.append(F.when(F.exists(F.coalesce(label["symptom_tags"], F.array().cast(f"array<{_TAG}>")), lambda t: ~F.coalesce(t["tag"].isin(*X.SYMPTOM_TAGS) & t["status"].isin(*X.TAG_STATUSES), F.lit(False))), "a symptom tag is not allowed"))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _named(name: str):
    return lambda tag: tag["tag"] == name


def flatten(df: DataFrame, keep: list[str]) -> DataFrame:
    """One wide row per label, two columns per tag, missing tags not_reported (JSN-06, JSN-07)."""
    label = F.col("label")
    cols = [label[c].alias(c) for c in (*TEXTS, *NUMBERS, "needs_fulltext_review")] + [F.to_json(F.coalesce(label[c], F.array().cast("array<string>"))).alias(f"{'case_' if c == 'evidence_block_ids' else ''}{c}_json") for c in LISTS]
    for t in X.SYMPTOM_TAGS:
        hit = F.try_element_at(F.filter(label["symptom_tags"], _named(t)), F.lit(-1))
        cols += [F.coalesce(hit["status"], F.lit("not_reported")).alias(f"tag__{t}__status"), F.to_json(F.coalesce(hit["evidence_block_ids"], F.array().cast("array<string>"))).alias(f"tag__{t}__evidence_block_ids_json")]
    return df.select(*keep, *cols)


def label_table(df: DataFrame, column: str, keep: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(valid wide rows, quarantined rows with their errors)."""
    clean = _once(parse(df, column), label=F.when(F.col("label").isNotNull(), sanitize(F.col("label"))))
    checked = _once(clean, errors=errors(F.col("label")))
    return flatten(checked.where(F.size("errors") == 0), list(keep)), checked.where(F.size("errors") > 0).select(*keep, F.col(column), "errors")
