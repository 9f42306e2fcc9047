"""Selection, urn permutations, batched refits and matching against plain versions."""

import hashlib
import itertools
import math
import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import inference as I, refits as N, relational as R, sampling as P, selection as S, vectors as V
from cohortlens.plans import cohort as K


# ---- exact quantiles ----


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_are_exact_for_hot_groups_ties_and_nulls(spark, monkeypatch, accuracy):
    monkeypatch.setattr(S, "ACCURACY", accuracy)
    rng = random.Random(1)
    rows = [("hot", rng.gauss(0, 100)) for _ in range(3000)] + [("ties", float(rng.randint(0, 3))) for _ in range(700)] + [("one", 5.0), ("none", None), (None, 1.0), (None, 4.0), ("inf", float("inf")), ("inf", 1.0), ("inf", float("-inf"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {r.g: r.q for r in S.quantiles(df, ["g"], F.col("v"), shares).collect()}
    for g in {r[0] for r in rows}:
        x = [v for k, v in rows if k == g and v is not None]
        want = [None if not x else np.quantile(x, p) for p in shares] if g != "inf" else [float("-inf"), None, None, 1.0, None, None, float("inf")]
        assert all(w is None and g == "inf" or w is None and q is None or q == pytest.approx(w) for q, w in zip(got[g], want)), g
    assert S.quantiles(df.where("false"), ["g"], F.col("v"), shares).collect() == []
    n = {r.g: r for r in R.numeric_summary(df.where("g <> 'inf' OR g IS NULL"), ["g"], "v").collect()}
    assert n["none"].median is None and n["none"].n_cases == 1 and n[None].median == 2.5 and n["hot"].p75 == pytest.approx(np.quantile([v for k, v in rows if k == "hot"], 0.75))


def test_no_bracket_may_miss_silently(spark, monkeypatch):
    monkeypatch.setattr(S, "ACCURACY", 10)
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("double").alias("v"), F.lit(1).alias("g"))
    assert S.quantiles(df, ["g"], F.col("v"), [0.31]).first().q[0] == pytest.approx(0.31 * 4999)


def test_samples_are_the_first_in_hash_order(spark):
    rows = [(i, f"x{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "k long, row string").repartition(4)
    got = P.bootstrap(df, "k", 6, 0.37, 2, 9).collect()
    for b in range(6):
        order = sorted(range(500), key=lambda k: (hashlib.md5(f"9:{b}:{k}".encode()).hexdigest(), k))
        assert {r.k for r in got if r.replicate == b} == set(order[:185])
    small = P.bootstrap(df.where("k < 3"), "k", 2, 0.1, 5, 9).collect()
    assert Counter(r.replicate for r in small) == {0: 3, 1: 3}
    assert P.bootstrap(df.where("false"), "k", 2, 0.5).collect() == []


# ---- permutations ----


def hypergeometric(total, marked, drawn):
    return {k: math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn) for k in range(max(0, drawn - total + marked), min(drawn, marked) + 1)}


def test_urn_is_the_inverse_of_the_distribution():
    for total, marked, drawn in [(10, 4, 3), (60, 26, 20), (7, 7, 3), (7, 0, 3), (5, 2, 5), (1000, 3, 500), (600, 240, 180)]:
        p = hypergeometric(total, marked, drawn)
        upto, edge = 0.0, []
        for k, w in p.items():
            edge.append((upto, upto + w, k))
            upto += w
        for low, high, k in edge:
            if high - low > 1e-6:
                assert I._urn(total, marked, drawn, (low + high) / 2) == k
    assert I._urn(10**9, 4 * 10**8, 10**6, 0.5) == pytest.approx(400_000, abs=2)


def test_draws_follow_the_permutations(spark):
    """Joint counts over clusters against the enumeration of all permutations of a small table."""
    sizes, marked, draws = [3, 2, 4], 4, 6000
    rows = [(c, 0) for c, n in enumerate(sizes) for _ in range(n)]
    rows = [(c, i < marked) for i, (c, _) in enumerate(rows)]
    df = spark.createDataFrame([(i, c, y) for i, (c, y) in enumerate(rows)], "k int, c int, y boolean")
    null = I.permuted_shares(df, "k", "c", F.col("y"), draws).collect()
    by = {}
    for r in null:
        by.setdefault(r.draw, {})[r.cluster] = r.positives
    assert len(by) == draws and all(sum(v.values()) == marked for v in by.values())
    seen = Counter(tuple(v[c] for c in range(3)) for v in by.values())
    place = [c for c, n in enumerate(sizes) for _ in range(n)]
    every = Counter(tuple(Counter(place[i] for i in pick)[c] for c in range(3)) for pick in itertools.combinations(range(9), marked))
    total = sum(every.values())
    assert seen.keys() <= every.keys()
    assert sum((seen[k] - draws * n / total) ** 2 / (draws * n / total) for k, n in every.items()) < 2 * len(every) + 20
    test = I.max_share_test(df, "k", "c", F.col("y"), draws).first()
    best = max(sum(y for c2, y in rows if c2 == c) / n for c, n in enumerate(sizes))
    tail = sum(n for k, n in every.items() if max(k[c] / sizes[c] for c in range(3)) >= best - 1e-12) / total
    assert test.draws == draws and abs(test.p - tail) < 4 * math.sqrt(tail * (1 - tail) / draws) + 0.01
    mean = statistics.fmean(max(k[c] / sizes[c] for c in range(3)) for k in every.elements())
    assert test.null_mean == pytest.approx(mean, abs=0.02)


def test_draws_depend_on_counts_only(spark):
    """A hundred times the rows cost the same draws; groups draw side by side; null clusters are clusters; empty input is empty."""
    counts = spark.createDataFrame([("a", 0, 10**9, 10**8), ("a", 1, 10**9, 10**8), ("b", None, 3, 1), ("b", 2, 3, 3)], "g string, cluster int, n long, positives long")
    out = I.permuted_counts(counts, 300, 1, ["g"]).collect()
    assert len(out) == 1200
    a = [r.positives for r in out if r.g == "a" and r.cluster == 0]
    sd = math.sqrt(10**9 * 0.1 * 0.9 * 0.5)
    assert abs(statistics.fmean(a) - 10**8) < 5 * sd / math.sqrt(300) and statistics.stdev(a) == pytest.approx(sd, rel=0.2)
    assert {r.positives for r in out if r.g == "b" and r.cluster is None} <= {1, 2, 3}
    assert I.permuted_counts(counts.where("false"), 10, 1, ["g"]).collect() == []


# ---- refits ----


def plain_lloyd(x, c):
    for _ in range(N.ROUNDS):
        home = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[home == j].mean(0) if (home == j).any() else c[j] for j in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return c, ((x - c[home]) ** 2).sum()


def test_batched_refits_equal_plain_ones(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 1, (125, 6)) for m in (0, 3, 6, 9)])
    member = rng.random((500, 3)) < 0.7
    df = spark.createDataFrame([(i, v.tolist(), m.tolist()) for i, (v, m) in enumerate(zip(x, member))], "id long, vector array<double>, member array<boolean>").repartition(4)
    replicate = [0, 0, 1, 1, 2, 2]
    starts = np.stack([x[rng.choice(500, 4, replace=False)] for _ in replicate])
    starts[5, 3] = 1e6  # a cluster that stays empty
    for limit in (N.CENTRES, 8 * 24 * 4):  # all runs in one pass, and four at a time
        monkeypatch.setattr(N, "CENTRES", limit)
        centres, cost = N.batched_lloyd(df, starts, replicate)
        for r, b in enumerate(replicate):
            want, total = plain_lloyd(x[member[:, b]], starts[r])
            assert np.allclose(centres[r], want) and cost[r] == pytest.approx(total)


def test_seeding_finds_far_clusters(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.1, (n, 2)) for m, n in ((0, 900), (50, 40), (100, 40), (150, 20))])
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    starts = N.parallel_seeds(df, np.array([1000.0, 1000.0]), 4, [1, 2], 3)
    assert starts.shape == (6, 4, 2)
    assert all({round(float(c[0]) / 50) for c in s} == {0, 1, 2, 3} for s in starts)
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(20)], "id long, vector array<double>")
    assert (N.parallel_seeds(same, np.array([20.0]), 3, [1], 2) == 1).all()


def test_refits_of_repeated_null_and_empty_rows(spark):
    rows = [(i, [float(10 * (i % 3)), float(i % 2)], i % 3) for i in range(60)] + [(1, [10.0, 1.0], 1)] * 3 + [(90, None, 0), (91, [0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "k long, v array<double>, g int")
    a = K.resampled(df, "k", "v", "g", 4, 0.8, 3).collect()
    assert len(a) == 4 * 64 and all(r.cluster == r.baseline for r in a if r.baseline is not None) and {r.cluster for r in a if r.k == 91} == {0}
    assert K.resampled(df.where("false"), "k", "v", "g", 4, 0.8, 3).collect() == [] and K.reseeded(df.where("false"), "k", "v", "g", [1], 3).collect() == []
    again = K.resampled(df, "k", "v", "g", 4, 0.8, 3).collect()
    assert sorted(map(str, a)) == sorted(map(str, again))


# ---- matching ----


def test_matching_equals_brute_force_with_ties_and_sides():
    rng = random.Random(4)
    for t in range(200):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        sim = {(i, j): rng.choice([0, 0.5, 1, -1]) if t % 2 else rng.uniform(-1, 1) for i in range(n) for j in range(m)}
        if n <= m:
            every = [dict(enumerate(p)) for p in itertools.permutations(range(m), n)]
        else:
            every = [{r: c for c, r in enumerate(p)} for p in itertools.permutations(range(n), m)]
        want = min(every, key=lambda o: (round(-sum(sim[e] for e in o.items()), 9), tuple(o.get(i, m) for i in range(n))))
        assert V.best_matching(sim) == want
    assert V.best_matching({}) == {}


def test_matching_of_two_hundred():
    import time

    rng = random.Random(4)
    sim = {(i, j): rng.random() for i in range(200) for j in range(200)}
    began = time.process_time()
    assert len(set(V.best_matching(sim).values())) == 200
    assert time.process_time() - began < 2
