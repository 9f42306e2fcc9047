"""Labels are parsed, cleaned and checked once a row."""

import json

import pytest

from cohortlens.operators import labels as L
from cohortlens.plans import catalog, catalog_documents as Q  # noqa: F401


@pytest.mark.parametrize("part", [0, 1])
def test_a_label_is_parsed_once(spark, part):
    rows = [(i, json.dumps(a) if isinstance(a, dict) else a) for i, (a, _) in enumerate(Q.ANSWERS)] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id long, answer string")
    table = L.label_table(df, "answer", ["doc_id"])[part]
    assert str(table._jdf.queryExecution().optimizedPlan()).count("from_json(StructField(label_schema_version") == 1
    if part:
        assert {r.doc_id: ",".join(r.errors) for r in table.collect()} == {i: w for i, (_, w) in enumerate(Q.ANSWERS) if isinstance(w, str)} | {99: "not a JSON object"}
    else:
        assert {r.doc_id: tuple(r[c] for c in Q._KEPT) for r in table.collect()} == {i: w for i, (_, w) in enumerate(Q.ANSWERS) if isinstance(w, tuple)}


@pytest.mark.parametrize("query", [Q.label_rows, Q.label_quarantine])
def test_every_core_gets_answers(spark, tmp_path, query):
    spark.range(0, 2000).selectExpr("id AS doc_id", "1 AS toxic").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    ids = [[r.doc_id for r in part] for part in query(spark, str(tmp_path)).rdd.glom().collect()]
    n, total = 2 * spark.sparkContext.defaultParallelism, sum(map(len, ids))
    assert len(ids) == n and max(map(len, ids)) < 2 * total / n
    wanted = str if query is Q.label_quarantine else tuple
    assert sorted(i for part in ids for i in part) == [i for i in range(2000) if isinstance(Q.ANSWERS[i % len(Q.ANSWERS)][1], wanted)]
