"""What a run of the extraction job makes for each document: no task of its own, and no reading of other batches."""

import os

from cohortlens.streaming import extraction as E

N = 50
PAPER = "<article><body><p>a</p><p>b %d</p></body></article>"


class Seen(E.Stop):
    def onQueryStarted(self, event):
        self.group = str(event.runId)
        super().onQueryStarted(event)


def put(folder, numbers):
    for i in numbers:
        os.makedirs(f"{folder}/pmcid=P{i}")
        with open(f"{folder}/pmcid=P{i}/part-0.txt", "w") as f:
            f.write(PAPER % i)


def run(spark, src, out, **more):
    seen, sc = Seen(), spark.sparkContext
    sc.setJobGroup(f"{out} {len(os.listdir(src))}", "")
    mine = sc.getLocalProperty("spark.jobGroup.id")
    E.extract_folder(spark, src, out, lambda b: b.where("block_index = 0").select("pmcid", "block_id"), stop=seen, resume=True, pattern="part-*", **more)
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for g in (mine, seen.group) for j in tracker.getJobIdsForGroup(g) for s in tracker.getJobInfo(j).stageIds]
    assert len(stages) > 4
    return max(s.numTasks for s in stages if s), seen.taken


def test_listings_make_no_task_for_each_document(spark, tmp_path):
    src, out, at = f"{tmp_path}/in", f"{tmp_path}/out", "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    was, most = spark.conf.get(at), 2 * spark.sparkContext.defaultParallelism
    put(src, range(N))
    tasks, taken = run(spark, src, out)
    assert tasks <= most < N and taken == N
    put(src, range(N, 2 * N))
    tasks, taken = run(spark, src, out)
    assert tasks <= most and taken == N
    assert spark.conf.get(at) == was
    rows = E.committed(spark, out, "blocks").select("pmcid", "block_index", "text").collect()
    assert sorted(map(tuple, rows)) == sorted(x for i in range(2 * N) for x in ((f"P{i}", 0, "a"), (f"P{i}", 1, f"b {i}")))
    log = E.committed(spark, out, "log").collect()
    assert {(r.pmcid, r.status, r.n_segments) for r in log} == {(f"P{i}", "ok", 1) for i in range(2 * N)} and len(log) == 2 * N


def test_batches_read_back_only_their_own(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(src, range(4))
    run(spark, src, out)
    # rows of another batch that can't be read: a later run doesn't look at them
    for table in ("blocks", "segments"):
        with open(f"{out}/{table}/part-0.parquet", "w") as f:
            f.write("no parquet")
    put(src, range(4, 8))
    assert run(spark, src, out, files_per_batch=3)[1] == 4
    assert {r.pmcid for r in E.committed(spark, out, "log").collect()} == {f"P{i}" for i in range(8)}
