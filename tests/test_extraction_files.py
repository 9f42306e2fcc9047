"""Files of documents: written by tasks under their names, one folder for all; a backlog is worked off in batches of BATCH files a core."""

import os

import pytest

from cohortlens.plans import catalog
from cohortlens.sources import tables as T
from cohortlens.streaming import extraction as E

PAPER = "<article><body><p>a</p><p>\u00e4\nb %s</p></body></article>"
first = lambda blocks: blocks.where("block_index = 0").select("pmcid", "block_id")


def put(folder, numbers):
    os.makedirs(folder, exist_ok=True)
    for i in numbers:
        with open(f"{folder}/P{i}.xml", "w") as f:
            f.write(PAPER % i)


def rows(spark, out):
    return sorted(map(tuple, E.committed(spark, out, "blocks").select("pmcid", "block_index", "text").collect()))


def expected(numbers):
    return sorted(x for i in numbers for x in ((f"P{i}", 0, "a"), (f"P{i}", 1, f"\u00e4 b {i}")))


def batches(spark, out):
    return E.committed(spark, out, "log").select("run", "batch").distinct().count()


def test_files_are_whole_and_named(spark, tmp_path):
    at = f"{tmp_path}/in"
    want = {"a.xml": b"one\n", "b.xml": "\u00e4".encode(), "c": b"", "none.xml": None}
    df = lambda d: spark.createDataFrame(list(d.items()), "name string, content binary")
    T.write_files(df(want), f"file://{at}")
    T.write_files(df({"a.xml": b"two", "d.xml": b"x"}), at)
    found = {n: open(f"{at}/{n}", "rb").read() for n in os.listdir(at)}
    assert found == {"a.xml": b"two", "b.xml": "\u00e4".encode(), "c": b"", "none.xml": b"", "d.xml": b"x"}
    for name in ("../out.xml", "_hidden.xml", ""):
        with pytest.raises(Exception, match="names no file"):
            T.write_files(df({name: b"x"}), at)
    T.write_files(df({"x": b""}).where("false"), f"{tmp_path}/empty")
    assert os.listdir(f"{tmp_path}/empty") == []


def test_other_file_systems_get_the_same_documents(spark, tmp_path):
    os.makedirs(tmp_path / "there")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.files.link./there", f"file://{tmp_path}/there")
    docs = spark.range(7).selectExpr("concat('P', id, '.xml') AS name", "encode(concat('<article><body><p>a</p><p>\u00e4\nb ', id, '</p></body></article>'), 'UTF-8') AS content")
    for at in (f"{tmp_path}/here", "viewfs://files/there"):
        T.write_files(docs, f"{at}/in")
        E.extract_folder(spark, f"{at}/in", f"{at}/out", first, pattern="*")
        assert rows(spark, f"{at}/out") == expected(range(7))


def test_a_backlog_takes_few_batches(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(src, range(1001))
    assert E.extract_folder(spark, src, out, first).taken == 1001
    assert batches(spark, out) == 1 and rows(spark, out) == expected(range(1001))


def test_watching_and_given_batches_stay_small(spark, tmp_path, monkeypatch):
    src = f"{tmp_path}/in"
    put(src, range(7))
    monkeypatch.setattr(E, "BATCH", 3)
    assert E.extract_folder(spark, src, f"{tmp_path}/a", first, watch=True, stop=E.Stop(most=7)).taken == 7
    assert E.extract_folder(spark, src, f"{tmp_path}/b", first, files_per_batch=2).taken == 7
    assert E.extract_folder(spark, src, f"{tmp_path}/c", first).taken == 7
    assert [batches(spark, f"{tmp_path}/{x}") for x in "abc"] == [3, 4, 1]
    assert rows(spark, f"{tmp_path}/a") == rows(spark, f"{tmp_path}/b") == rows(spark, f"{tmp_path}/c") == expected(range(7))


def test_files_that_share_a_hash_are_parsed_by_all_tasks(spark, tmp_path):
    src, out, parts = f"{tmp_path}/in", f"{tmp_path}/out", spark.sparkContext.defaultParallelism
    same = [r.id for r in spark.range(60 * parts).where(f"pmod(hash(concat('P', id)), {parts}) = 0").collect()]
    for numbers in (same[::2], same[1::2]):
        put(src, numbers)
        known = set(os.listdir(f"{out}/parsed")) if os.path.exists(out) else set()
        assert E.extract_folder(spark, src, out, first, resume=True).taken == len(numbers)
        new = [f"{out}/parsed/{d}/{n}" for d in os.listdir(f"{out}/parsed") if d not in known for n in os.listdir(f"{out}/parsed/{d}") if n.startswith("part-")]
        assert sum(spark.read.parquet(n).count() > 0 for n in new) == parts
    assert rows(spark, out) == expected(same)


@pytest.mark.parametrize("ids", [range(40, 60), range(50, 60)])
def test_query_makes_no_folder_for_each_paper(spark, tmp_path, monkeypatch, ids):
    at = f"{tmp_path}/scratch"
    monkeypatch.setattr(T, "scratch", lambda _: at)
    turns = [(i, t, role, f"t {i} {t} <&") for i in ids for t, role in enumerate(("system", "user", "assistant"))]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/d/conversations.parquet")
    got = catalog.queries()["extracted_folder"](spark, f"{tmp_path}/d").collect()
    assert {(r.pmcid, r.block_index, r.status, r.n_blocks_total) for r in got} == {(f"PMC{i}", t, "ok", 3) for i in ids for t in range(3)} and len(got) == 3 * len(ids)
    assert sorted(os.listdir(f"{at}/in")) == sorted(f"PMC{i}.xml" for i in ids)
