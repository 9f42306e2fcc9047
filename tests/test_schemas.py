"""Schemas of model answers: every kind of error with its path, lenient numbers and flags, extra fields, nulls and empty tables."""

import json

from cohortlens.operators import schemas as Z

SEGMENT = {"case_id": "case_1", "segment_type": "other", "block_ids": ["b"], "include_for_embedding": True}
LABEL = {"label_schema_version": "1", "pmcid": "P", "case_id": "1", "ftld_inclusion_tier": "ftld_broad", "label_confidence": "low", "evidence_block_ids": ["b"]}


def errors(spark, schema, answers):
    rows = [(i, a if isinstance(a, str) or a is None else json.dumps(a)) for i, a in enumerate(answers)]
    df = spark.createDataFrame(rows, "i int, text string")
    return [r.errors for r in Z.checked(df, "text", schema).orderBy("i").collect()]


def test_route_answers(spark):
    good = [{"is_case_like": True}, {"is_case_like": "Yes", "n_cases_est": None}, {"is_case_like": 0, "n_cases_est": "3", "selected_sec_paths": [], "more": {"x": [1]}}, {"is_case_like": False, "n_cases_est": 2.0, "case_markers_found": ["a"]}]
    assert errors(spark, Z.ROUTE, good) == [[]] * len(good)
    bad = [{}, {"is_case_like": None}, {"is_case_like": 2}, {"is_case_like": [True]}, {"is_case_like": True, "n_cases_est": 0}, {"is_case_like": True, "n_cases_est": 1.5}, {"is_case_like": True, "n_cases_est": "x"}, {"is_case_like": True, "selected_sec_paths": "a"}, {"is_case_like": True, "selected_sec_paths": ["a", None, 3]}, {"is_case_like": True, "case_markers_found": None}, "none", None, "[1]"]
    assert errors(spark, Z.ROUTE, bad) == [
        ["$.is_case_like: missing"], ["$.is_case_like: null"], ["$.is_case_like: not a flag"], ["$.is_case_like: not a flag"], ["$.n_cases_est: less than 1"], ["$.n_cases_est: not a whole number"], ["$.n_cases_est: not a whole number"],
        ["$.selected_sec_paths: not a list"], ["$.selected_sec_paths[1]: null", "$.selected_sec_paths[2]: not text"], ["$.case_markers_found: null"], *[["$: not a JSON object"]] * 3,
    ]


def test_segment_answers(spark):
    assert errors(spark, Z.SEGMENTS, [{}, {"segments": []}, {"segments": [SEGMENT, SEGMENT]}]) == [[]] * 3
    bad = [{"segments": [SEGMENT, SEGMENT | {"segment_type": "odd", "block_ids": []}]}, {"segments": [7, {}]}, {"segments": {"a": 1}, "n_cases_est": -1}]
    assert errors(spark, Z.SEGMENTS, bad) == [
        ["$.segments[1].segment_type: not allowed", "$.segments[1].block_ids: fewer than 1"],
        ["$.segments[0]: not an object", "$.segments[1].case_id: missing", "$.segments[1].segment_type: missing", "$.segments[1].block_ids: missing", "$.segments[1].include_for_embedding: missing"],
        ["$.n_cases_est: less than 1", "$.segments: not a list"],
    ]


def test_labels_and_quarantine(spark):
    tag = {"tag": "agrammatism", "status": "present", "evidence_block_ids": []}
    rows = [(0, LABEL | {"symptom_tags": [tag], "age_at_onset_years": None}), (1, LABEL | {"evidence_block_ids": [], "age_at_onset_years": -1}), (2, LABEL | {"symptom_tags": [tag | {"status": "odd"}], "label_confidence": "sure", "pmcid": None})]
    df = spark.createDataFrame([(i, json.dumps(a), "kept") for i, a in rows], "i int, text string, other string")
    good, bad = Z.quarantined(df, "text", Z.LABEL)
    assert [r.i for r in good.collect()] == [0]
    assert {r.i: sorted(r.errors) for r in bad.collect()} == {
        1: ["$.age_at_onset_years: less than 0", "$.evidence_block_ids: fewer than 1"],
        2: ["$.label_confidence: not allowed", "$.pmcid: null", "$.symptom_tags[0].status: not allowed"],
    }
    assert Z.checked(df.where("false"), "text", Z.LABEL).collect() == []
