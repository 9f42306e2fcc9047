"""The primary summary under ratings, by hand; files that must not be published."""

import pytest

from cohortlens.plans import raters as A
from cohortlens.sources import tables as T

CASES = "k long, split string, cluster int, is_ppa boolean"
RATINGS = "k long, text_adequate string, is_ppa string, is_ftld_spectrum string"


def cases_of(spark):
    rows, k = [], 0
    for split, cluster, yes, no in (("discovery", 0, 2, 8), ("discovery", 1, 6, 4), ("confirmation", 0, 1, 9), ("confirmation", 1, 7, 3)):
        for y in [True] * yes + [False] * no:
            rows.append((k, split, cluster, y))
            k += 1
    return rows, spark.createDataFrame(rows, CASES)


def test_summary_under_ratings(spark):
    rows, cases = cases_of(spark)
    # of cluster 0 in discovery all become positive; one inadequate, one contradictory, one empty rating, one unknown case, one outside
    ratings = [(k, "1", "1", None) for k in range(2, 10)] + [(10, "0", "0", None), (11, "1", "0", None), (11, "1", "1", None), (12, "1", None, None), (99, "1", "1", None), (20, "1", None, "0"), (None, "1", "1", "0")]
    got = A.relabel_study(cases, spark.createDataFrame(ratings, RATINGS), ["k"], "split", "cluster", "two raters", True, 200)
    assert tuple(got["counts"].first()) == (8, 1)
    out = {r.k: r for r in got["cases"].collect()}
    assert sorted(out) == [k for k in range(40) if k != 20]
    assert {k for k, r in out.items() if r.is_ppa_source == "two raters"} == set(range(2, 10))
    assert all(r.is_ppa_llm == rows[k][3] for k, r in out.items()) and all(out[k].is_ppa for k in range(10))
    s = got["summary"].first()
    assert (s.language_cluster, s.discovery_n, s.confirmation_n, s.discovery_share_cluster, s.confirmation_share_cluster) == (0, 20, 19, 1.0, 0.0)
    assert s.discovery_rr == pytest.approx((10.5 / 11) / (17 / 22)) and s.confirmation_odds_ratio == pytest.approx(0.5 * 3.5 / (9.5 * 7.5))
    assert 0 < s.discovery_p <= 0.3 and s.confirmation_p == 1.0


def test_no_ratings_keep_the_summary_and_an_empty_split_is_an_error(spark):
    _, cases = cases_of(spark)
    none = spark.createDataFrame([], RATINGS)
    s = A.relabel_study(cases, none, ["k"], "split", "cluster", draws=50)["summary"].first()
    assert (s.language_cluster, s.discovery_share_cluster, s.confirmation_share_cluster) == (1, 0.6, 0.7)
    with pytest.raises(ValueError):
        A.relabel_study(cases.where("split = 'discovery'"), none, ["k"], "split", "cluster", draws=50)
    missing = A.relabel_study(cases.where("NOT (split = 'confirmation' AND cluster = 1)"), none, ["k"], "split", "cluster", draws=50)["summary"].first()
    assert missing.confirmation_n == 10 and missing.confirmation_rr is None and missing.confirmation_p is None


def test_audit_of_paths(spark):
    want = {
        "manuscript/a.tex": "manuscript", "src/Model.PKL": "file type", "data/x.txt": "data or results", "results/deep/README.md": "data or results", "src/Segments.csv": "file of cases",
        "a/my-case-labels-1.csv": "segments or labels", "b/Kappa_report.csv": "ratings", "docs/FTD Ratings notes.md": "workbook",
        "data/README.md": None, "results/.gitkeep": None, "docs/ratings.md": None, "src/data/x.py": None, "data": None, ".git/data/x.pkl": None, ".csv": None, "notes/rater.txt": None,
    }
    df = spark.createDataFrame([(p,) for p in want] + [(None,)], "path string")
    assert {r.path: r.rule for r in T.disclosure_audit(df).collect()} == {p: r for p, r in want.items() if r}
    with pytest.raises(ValueError, match="8 files"):
        T.assert_disclosable(df)
    T.assert_disclosable(df.where("path LIKE '%.gitkeep'"))
