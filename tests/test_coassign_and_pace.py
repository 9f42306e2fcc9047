"""Co-assignment by profiles against all pairs; requests of all tasks held to one rate."""

import random
import time
from itertools import combinations

import pytest

from cohortlens.operators import coassign as G, vectors as V
from cohortlens.sources import services


def brute(rows, least):
    """Pairs of cases and their share of replicates, from the rows."""
    of, replicates = {}, sorted({r for _, r, _ in rows})
    for k, r, c in rows:
        of.setdefault(k, {})[r] = min(c, of.get(k, {}).get(r, c))
    out = {}
    for a, b in combinations(sorted(of), 2):
        n = sum(r in of[a] and of[a].get(r) == of[b].get(r) for r in replicates)
        if n and n / len(replicates) >= least:
            out[a, b] = n / len(replicates)
    return of, out


def draws(seed, cases=60, replicates=7, clusters=3):
    rng = random.Random(seed)
    home = [rng.randrange(clusters) for _ in range(cases)]
    rows = []
    for k in range(cases):
        for r in range(replicates):
            if rng.random() < 0.9:
                rows.append((k, r, f"c{home[k] if rng.random() < 0.8 else rng.randrange(clusters)}"))
    # one case twice in a replicate, and copies of one case
    rows.append((0, 0, "c9"))
    return rows + [(k, r, c) for k in range(cases, cases + 25) for (x, r, c) in rows if x == 1]


@pytest.mark.parametrize("least", [0.0, 0.5, 0.86, 1.0])
@pytest.mark.parametrize("block", [4, 1024])
def test_pairs_of_profiles_equal_all_pairs(spark, monkeypatch, least, block):
    monkeypatch.setattr(G, "BLOCK", block)
    rows = draws(3)
    cases = G.profiles(spark.createDataFrame(rows, "k long, r int, c string"), "k", "r", "c")
    profile = {x["k"]: x["profile"] for x in cases.collect()}
    of, want = brute(rows, least)
    assert all((profile[a] == profile[b]) == (of[a] == of[b]) for a, b in combinations(of, 2))
    found = [(x["i"], x["j"], x["coassignment"]) for x in G.coassigned(cases, least).collect()]
    assert len(found) == len({x[:2] for x in found})
    assert {(i, j): round(s, 9) for i, j, s in found} == {p: round(s, 9) for p, s in want.items() if p[0] != p[1] and profile[p[0]] == p[0] and profile[p[1]] == p[1]}


def test_all_cases_equal_all_pairs(spark):
    rows = draws(5, 30)
    df = spark.createDataFrame(rows, "k long, r int, c string")
    got = {(x["i"], x["j"]): round(x["coassignment"], 9) for x in V.coassignment(df, "k", "r", "c").collect()}
    assert got == {p: round(s, 9) for p, s in brute(rows, 0.0)[1].items()}


def test_pairs_of_one_large_profile_are_spread_over_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(V, "SPREAD", 20, raising=False)
    monkeypatch.setattr(V, "TASK_PAIRS", 5_000, raising=False)
    rows = [(k, r, "a") for k in range(300) for r in (0, 1)] + [(k, r, "b" if r else "a") for k in range(300, 310) for r in (0, 1)]
    got = V.coassignment(spark.createDataFrame(rows, "k long, r int, c string"), "k", "r", "c").withColumn("task", F.spark_partition_id()).collect()
    assert {(x["i"], x["j"]): x["coassignment"] for x in got} == brute(rows, 0.0)[1]
    n = [x["task"] for x in got]
    assert len(n) == 310 * 309 // 2 and max(map(n.count, set(n))) < len(n) / 5


def test_coassignment_of_nulls_and_nothing(spark):
    none = spark.createDataFrame([(None, 1, "a"), (1, None, "a"), (2, 1, None)], "k long, r int, c string")
    cases = G.profiles(none, "k", "r", "c")
    assert cases.count() == 0
    assert G.coassigned(cases, 0.5).count() == 0
    one = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, r int, c string")
    assert G.coassigned(G.profiles(one, "k", "r", "c"), 1.5).count() == 0


def recorder():
    """A service that answers with the time of the request; some keys ask for a pause first. Workers get it by value."""

    class Recorder:
        failed = set()

        def fetch(self, key):
            now = time.time()
            if key.endswith("7") and key not in self.failed:
                self.failed.add(key)
                raise services.RetryLater(0.05)
            return repr(now).encode()

    return Recorder()


def test_no_window_holds_more_than_the_rate(spark):
    pace = services.Pace(rate=40.0, lanes=4, batch=20, pause=0.3, jitter=0.1)
    keys = spark.createDataFrame([(f"PMC{i}",) for i in range(70)], "pmcid string")
    rows = services.fetch_all(keys, "pmcid", recorder(), pace=pace).collect()
    assert sorted(r["key"] for r in rows) == sorted(f"PMC{i}" for i in range(70))
    assert all(r["status"] == "ok" for r in rows)
    at = sorted(float(bytes(r["content"])) for r in rows)
    for window in (0.1, 0.25, 1.0):
        most = max(sum(a <= x < a + window for x in at) for a in at)
        assert most <= window * pace.rate + 2
    # every slot's batch stays before its break
    assert max(b - a for a, b in zip(at, at[1:])) >= 0.25


def test_slots_of_lanes_are_never_shared():
    pace = services.Pace(rate=10.0, lanes=3, batch=5, pause=2.0, jitter=1.0, start=1000.0)
    times = [pace.at(s) for s in range(200)]
    assert times == sorted(times)
    gaps = [b - a for a, b in zip(times, times[1:])]
    assert all(2.0 <= g - 0.1 <= 3.0 + 1e-9 for k, g in enumerate(gaps, 1) if k % 5 == 0)
    assert all(abs(g - 0.1) < 1e-9 for k, g in enumerate(gaps, 1) if k % 5)
    for lane in range(3):
        for now in (0.0, 1000.0, 1003.3, 1044.4):
            slot = pace.next_slot(lane, now)
            assert slot % 3 == lane and pace.at(slot) >= now
            assert not any(s % 3 == lane and pace.at(s) >= now for s in range(slot))
    with pytest.raises(ValueError):
        services.Pace(rate=0)


def test_late_slots_are_lost(monkeypatch):
    pace = services.Pace(rate=2.0, lanes=1, batch=100, pause=0.0, jitter=0.0, start=100.0)
    clock = [100.0]
    monkeypatch.setattr(services.time, "time", lambda: clock[0])
    late = iter([0.4, 0.0])
    monkeypatch.setattr(services.time, "sleep", lambda s: clock.__setitem__(0, clock[0] + s + next(late)))
    assert pace.wait(0, 101.2) == 102.0


def test_files_are_written_whole_and_paced(spark, tmp_path):
    (tmp_path / "PMC1.xml").write_bytes(b"old")
    keys = spark.createDataFrame([("PMC1",), ("PMC2",), ("PMC17",)], "pmcid string")
    pace = services.Pace(rate=50.0, lanes=2, batch=10, pause=0.0, jitter=0.0)
    for folder in (str(tmp_path), tmp_path.as_uri()):
        got = {r["key"]: r for r in services.fetch_files(keys, "pmcid", recorder(), folder, pace=pace).collect()}
        assert got["PMC1"]["status"] == "skipped" and got["PMC1"]["bytes"] == 3
        assert {got[k]["status"] for k in ("PMC2", "PMC17")} == ({"ok"} if folder == str(tmp_path) else {"skipped"})
    assert sorted(p.name for p in tmp_path.iterdir()) == ["PMC1.xml", "PMC17.xml", "PMC2.xml"]
