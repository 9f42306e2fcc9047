"""Schemas of model answers, compiled to expressions over variant values that name the path of every error (JSN-04).

A field is boolean, integer, number, string, array or object. As in the workflow's own models, numbers may come as text and flags as 0, 1, yes or no;
text must be text. Extra fields are passed by. A field that isn't required may be absent; null is an error unless the field allows it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as X, text as S
from . import labels as L


@dataclass(frozen=True)
class Field:
    kind: str
    required: bool = False
    nullable: bool = False
    #: Least number, or least length of an array.
    least: float | None = None
    allowed: tuple[str, ...] = ()
    of: Field | None = None
    fields: dict[str, Field] = field(default_factory=dict)


_COUNT = Field("integer", nullable=True, least=1)
_NAMES = Field("array", of=Field("string"))
#: Which sections to read, of the first pass.
ROUTE = Field("object", fields={"is_case_like": Field("boolean", required=True), "n_cases_est": _COUNT, "selected_sec_paths": _NAMES, "case_markers_found": _NAMES})
#: Which blocks make up the segments of each case, of the second.
SEGMENT = Field("object", fields={"case_id": Field("string", required=True), "segment_type": Field("string", required=True, allowed=tuple(X.SEGMENT_TYPES)), "block_ids": Field("array", required=True, least=1, of=Field("string")), "include_for_embedding": Field("boolean", required=True)})
SEGMENTS = Field("object", fields={"n_cases_est": _COUNT, "segments": Field("array", of=SEGMENT)})
_TAG = Field("object", fields={"tag": Field("string", required=True, allowed=tuple(X.SYMPTOM_TAGS)), "status": Field("string", required=True, allowed=tuple(X.TAG_STATUSES)), "evidence_block_ids": _NAMES})
#: Labels of a case, as the model gives them.
LABEL = Field(
    "object",
    fields={k: Field("string", required=k in ("pmcid", "case_id", "ftld_inclusion_tier", "label_confidence"), nullable=k not in ("pmcid", "case_id", "ftld_inclusion_tier", "label_confidence"), allowed=tuple(L.ENUMS.get(k, ()))) for k in L.TEXTS}
    | {k: Field("number", nullable=True, least=0) for k in L.NUMBERS}
    | {k: _NAMES for k in L.LISTS}
    | {"evidence_block_ids": Field("array", required=True, least=1, of=Field("string")), "needs_fulltext_review": Field("boolean"), "symptom_tags": Field("array", of=_TAG)},
)
#: Text that stands for a flag.
FLAGS = ["true", "false", "yes", "no", "on", "off", "y", "n", "t", "f", "1", "0"]


def _errors(v: Column, f: Field, path: Column) -> Column:
    """Errors of a value that is there, as an array."""
    kind, none = F.schema_of_variant(v), F.array().cast("array<string>")
    say = lambda c, what: F.when(c, F.array(F.concat(path, F.lit(f": {what}")))).otherwise(none)
    text = F.try_variant_get(v, "$", "string")
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    if f.kind == "boolean":
        found = say(~((kind == "BOOLEAN") | F.coalesce(((kind == "STRING") | number) & F.lower(text).isin(*FLAGS), F.lit(False))), "not a flag")
    elif f.kind in ("integer", "number"):
        x = F.coalesce(F.try_variant_get(v, "$", "double"), text.try_cast("double"))
        fits = F.coalesce((number | kind.isin("STRING", "BOOLEAN")) & x.isNotNull() & ((x == F.floor(x)) if f.kind == "integer" else F.lit(True)), F.lit(False))
        found = say(~fits, f"not {'a whole number' if f.kind == 'integer' else 'a number'}")
        if f.least is not None:
            found = F.concat(found, say(fits & (x < f.least), f"less than {f.least:g}"))
    elif f.kind == "string":
        found = say(kind != "STRING", "not text")
        if f.allowed:
            found = F.concat(found, say((kind == "STRING") & ~text.isin(*f.allowed), "not allowed"))
    elif f.kind == "array":
        array = F.startswith(kind, F.lit("ARRAY"))
        items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
        found = say(~array, "not a list")
        if f.least is not None:
            found = F.concat(found, say(array & (F.size(items) < f.least), f"fewer than {f.least:g}"))
        each = F.transform(items, lambda x, i: _present(x, f.of, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        found = F.concat(found, F.when(array, F.flatten(each)).otherwise(none))
    else:
        is_object = F.startswith(kind, F.lit("OBJECT"))
        parts = []
        for name, g in f.fields.items():
            at, x = F.concat(path, F.lit(f".{name}")), F.try_variant_get(v, f"$.{name}", "variant")
            absent = F.when(x.isNull(), F.array(F.concat(at, F.lit(": missing"))) if g.required else none)
            parts.append(absent.otherwise(_present(x, g, at)))
        found = F.concat(say(~is_object, "not an object"), F.when(is_object, F.concat(*parts)).otherwise(none))
    return found


def _present(v: Column, f: Field, path: Column) -> Column:
    """Errors of a value that may be null."""
    null = F.coalesce(F.is_variant_null(v), F.lit(True))
    return F.when(null, F.array().cast("array<string>") if f.nullable else F.array(F.concat(path, F.lit(": null")))).otherwise(_errors(v, f, path))


def checked(df: DataFrame, column: str, schema: Field) -> DataFrame:
    """Adds ``answer`` (variant; null where the text holds no object) and ``errors`` (paths and what is wrong, in the schema's order)."""
    parsed = df.withColumn("answer", F.try_parse_json(S.json_object(F.col(column))))
    return parsed.withColumn("errors", F.when(F.col("answer").isNull(), F.array(F.lit("$: not a JSON object"))).otherwise(_present(F.col("answer"), schema, F.lit("$"))))


def quarantined(df: DataFrame, column: str, schema: Field) -> tuple[DataFrame, DataFrame]:
    """(rows with a valid answer, rows without one and their errors)."""
    c = checked(df, column, schema)
    return c.where(F.size("errors") == 0).drop("errors"), c.where(F.size("errors") > 0).drop("answer")
