"""Event parsing against the whole tree, the table function, the watching job with its stops, and the write-once sink."""

import os
import random
import xml.etree.ElementTree as ET

import pytest

from cohortlens.plans import api
from cohortlens.sources import documents as D
from cohortlens.streaming import extraction as E, ingest as N


def tree_blocks(data):
    """(source, path, text) by walking the whole tree."""

    def walk(e, path):
        for x in e:
            tag = D._tag(x)
            if tag in D.SKIPPED:
                continue
            if tag == "sec":
                parts = [D._flat(c) for c in (D._child(x, "label"), D._child(x, "title")) if c is not None]
                name = " ".join(p for p in parts if p)
                yield from walk(x, [*path, name] if name else path)
            elif tag == "p":
                if D._flat(x):
                    yield path, D._flat(x)
            else:
                yield from walk(x, path)

    article = next(e for e in ET.fromstring(data).iter() if D._tag(e) == "article")
    for source in ("abstract", "body"):
        top = next((e for e in article.iter() if D._tag(e) == source), None)
        for path, text in walk(top, []) if top is not None else ():
            yield source, path, text


def grown(rng, depth=0):
    kinds = ["p", "p", "sec", "sec", "fig", "list", "ref-list", "p2"] if depth < 4 else ["p"]
    out = ""
    for _ in range(rng.randint(0, 4)):
        k = rng.choice(kinds)
        if k == "p":
            out += f"<p>t{rng.randint(0, 99)} <b>x<i>y</i></b> tail{'<fig><p>in</p></fig>' if rng.random() < 0.2 else ''}</p> loose "
        elif k == "p2":
            out += "<p> </p>"
        elif k == "sec":
            late = rng.random() < 0.2
            title = rng.choice(["", "<label>1</label><title>A <i>b</i></title>", "<title>C</title>", "<title/>", "<label>2</label>"])
            out += f"<m:sec>{'' if late else title}{grown(rng, depth + 1)}{title if late else ''}</m:sec>"
        else:
            out += f"<{k}>{grown(rng, depth + 1)}</{k}>"
    return out


def test_events_give_what_the_tree_gives():
    rng = random.Random(8)
    for t in range(300):
        front = f"<front><article-title>T{t} <i>x</i></article-title>{'<abstract>' + grown(rng) + '</abstract>' if t % 3 else ''}</front>"
        body = f"<body>{grown(rng)}</body>" if t % 5 else ""
        inner = front + body if t % 7 else body + front
        data = f'<w xmlns:m="urn:m"><article article-type="a">{inner}<back><p>no</p></back></article><article><body><p>second</p></body></article></w>'.encode()
        facts, blocks = D.parse_document(data, "P")
        assert [(b["source"], b["sec_path"], b["text"]) for b in blocks] == list(tree_blocks(data)), data
        assert facts == {"article_type": "a", "title": f"T{t} x", "has_body": bool(body)}


def test_memory_does_not_hold_the_tree():
    import tracemalloc

    data = b"<article><body>" + b"".join(b"<sec><title>S%d</title>%s</sec>" % (i, b"<p>some words of text in a row</p>" * 40) for i in range(1500)) + b"</body></article>"
    tracemalloc.start()
    n = sum(1 for _ in D.stream_document(data, "P"))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n == 60_000 and most < 2.5 * len(data)


def test_table_function_in_sql(spark, tmp_path):
    (tmp_path / "PMC1.xml").write_text("<article><body><p>x</p><p>y</p></body></article>")
    os.makedirs(tmp_path / "pmcid=PMC7")
    (tmp_path / "pmcid=PMC7" / "part-0.txt").write_text("<html/>")
    D.register(spark)
    spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).createOrReplaceTempView("files")
    got = spark.sql("SELECT b.* FROM files, LATERAL parse_blocks(path, content) b").collect()
    assert sorted((r.pmcid, r.status, r.text) for r in got) == sorted([("PMC1", "ok", "x"), ("PMC1", "ok", "y"), ("PMC7", "error", None)], key=str)
    none = spark.createDataFrame([("/a/P2.xml", None), ("/a/P3.xml", b"")], "path string, content binary")
    assert {(r.pmcid, r.status) for r in D.parse_contents(none).collect()} == {("P2", "error"), ("P3", "error")}
    assert D.parse_contents(none.where("false")).collect() == []


CASE = '<article article-type="case-report"><body><sec><title>Case Report</title><p>A 60-year-old man was well.</p><p>He presented with fever number %d.</p></sec></body></article>'


def extract(blocks):
    return api.extract_segments(blocks, ["well"])


def put(folder, names, text=CASE):
    os.makedirs(folder, exist_ok=True)
    for i, n in enumerate(names):
        with open(f"{folder}/{n}.xml", "w") as f:
            f.write(text % i if "%d" in text else text)


def test_job_runs_resumes_and_retries(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(src, ["PMC1", "PMC2"])
    put(src, ["PMC3"], "<broken")
    put(src, ["PMC4"], "<article><body><p>nothing here</p></body></article>")
    # a batch that dies before its log: nothing of it counts
    died = []

    def dies(blocks):
        if not died:
            died.append(1)
            raise RuntimeError("killed")
        return extract(blocks)

    with pytest.raises(Exception, match="killed"):
        E.extract_folder(spark, src, out, dies)
    assert E.committed(spark, out, "log").count() == 0 and E.committed(spark, out, "blocks").count() == 0
    assert E.extract_folder(spark, src, out, extract, resume=True).reason == "finished"
    status = lambda: {r.pmcid: r.status for r in E.committed(spark, out, "log").collect()}
    assert status() == {"PMC1": "ok", "PMC2": "ok", "PMC3": "error", "PMC4": "not_case_like"}
    assert E.committed(spark, out, "blocks").count() == 5
    one = {(r.pmcid, r.segment_uid) for r in E.committed(spark, out, "segments").collect()}
    assert E.committed(spark, out, "segments").count() == len(one) and {p for p, _ in one} == {"PMC1", "PMC2"}
    # again: nothing to do; failed documents only when asked for
    put(src, ["PMC3"])
    assert E.extract_folder(spark, src, out, extract, resume=True).taken == 0 and status()["PMC3"] == "error"
    assert E.extract_folder(spark, src, out, extract, resume=True, retry_errors=True).taken == 1 and status()["PMC3"] == "ok"
    assert E.committed(spark, out, "segments").count() == len(one) * 3 // 2
    with pytest.raises(ValueError):
        E.extract_folder(spark, src, out, extract)
    with pytest.raises(ValueError):
        E.extract_folder(spark, src, out, extract, resume=True, overwrite=True)
    assert E.extract_folder(spark, src, out, extract, overwrite=True).taken == 4


def test_job_stops_at_cap_targets_and_idle(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(src, [f"PMC{i}" for i in range(5)])
    cap = E.extract_folder(spark, src, out, extract, watch=True, stop=E.Stop(most=2))
    assert (cap.reason, cap.taken) == ("cap", 2)
    targets = E.extract_folder(spark, src, out, extract, watch=True, resume=True, stop=E.Stop(targets=["PMC0", "PMC4"]))
    assert targets.reason == "targets" and targets.taken == 3
    again = E.extract_folder(spark, src, out, extract, watch=True, resume=True, stop=E.Stop(targets=["PMC4"]))
    assert (again.reason, again.taken) == ("targets", 0)
    os.makedirs(f"{tmp_path}/none")
    idle = E.extract_folder(spark, f"{tmp_path}/none", f"{tmp_path}/out2", extract, watch=True, stop=E.Stop(idle_s=2))
    assert (idle.reason, idle.taken) == ("idle", 0)


def test_write_once_survives_restarts_and_lost_checkpoints(spark, tmp_path):
    src, out, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    os.makedirs(src)
    schema = "k string, v int"
    put_rows = lambda name, rows: (tmp_path / "in" / name).write_text("".join(f'{{"k": "{k}", "v": {v}}}\n' for k, v in rows))
    run = lambda at: N.write_once(N.watch(spark, src, schema), ["k"], out, at).awaitTermination()
    rows = lambda: sorted((r.k, r.v) for r in N.read_once(spark, out).collect())
    put_rows("a.json", [("x", 1), ("y", 1)])
    run(ck)
    put_rows("b.json", [("x", 2), ("z", 2), ("z", 2)])
    run(ck)
    assert rows() == [("x", 1), ("y", 1), ("z", 2)]
    # a batch that runs again replaces its own folder
    newest = max(int(d) for d in os.listdir(f"{tmp_path}/ck/commits") if d.isdigit())
    os.remove(f"{tmp_path}/ck/commits/{newest}")
    os.remove(f"{tmp_path}/ck/commits/.{newest}.crc")
    run(ck)
    assert rows() == [("x", 1), ("y", 1), ("z", 2)]
    # a lost checkpoint: everything comes again, nothing is written twice
    run(ck + "2")
    put_rows("c.json", [("w", 3), ("x", 3)])
    run(ck + "2")
    assert rows() == [("w", 3), ("x", 1), ("y", 1), ("z", 2)]
