"""Ranked search, personal data and fill-in-middle against plain versions, with edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("cohortlens.llm.queries")

DOCS = "doc_id long, text string"


def clash(df):
    """Extra columns with names that operators use inside."""
    from pyspark.sql import functions as F

    for c in ("row", "key", "n", "rank", "block", "kind", "email", "start", "hit", "_row", "question", "output", "form", "all"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# ---- 11 ----

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k=20):
    docs = [(i, Counter(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    least = {}
    for i, t in items:
        if t is not None:
            least[i] = min(least.get(i, t), t)
    out = []
    for i, text in least.items():
        found = []
        for d, c in docs:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(i, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def words(rng, n, most):
    return " ".join("w" + str(min(int(rng.expovariate(0.02)), most)) for _ in range(n))


@pytest.fixture(scope="module")
def searched():
    rng = random.Random(3)
    docs = [(i, words(rng, rng.randint(1, 120), 400)) for i in range(300)]
    docs += [(500 + i, "Café—été W1 w2\x00w3 Ünder") for i in range(30)]  # ties
    docs += [(600, None), (601, ""), (602, " .,;"), (None, "w1 w2 w3 w1"), (700, "w5 w6"), (700, "w5 w6"), (701, words(rng, 40_000, 400))]
    items = [(i, words(rng, 12, 500)) for i in range(12)] + [(50, "CAFÉ été café w1 w1"), (51, None), (52, "!"), (53, "nothing-here"), (54, "w5 w6 w7"), (54, "w6"), (None, "w2 w3")]
    return docs, items


def test_few_index_blocks_are_read_at_once(spark, monkeypatch, searched):
    """A block is tens of kilobytes: Spark's reader may not unpack its usual 4,096 rows of them."""
    from cohortlens.llm import ranked_search as R

    name, seen, real = "spark.sql.parquet.columnarReaderBatchSize", [], R._highest
    monkeypatch.setattr(R, "_highest", lambda q: seen.append(int(spark.conf.get(name))) or real(q))
    before = spark.conf.get(name)
    R.ranked_search(spark.createDataFrame(searched[0][:50], DOCS), spark.createDataFrame(searched[1][:3], "item_id long, text string"))
    assert seen and max(seen) <= 64
    assert spark.conf.get(name) == before


@pytest.mark.parametrize("block,questions", [(16, 2000), (3, 2)])
def test_search_equals_scoring_all(spark, monkeypatch, searched, block, questions):
    from cohortlens.llm import ranked_search as R

    monkeypatch.setattr(R, "BLOCK_DOCS", block)
    monkeypatch.setattr(R, "QUESTIONS", questions)
    monkeypatch.setattr(R, "HELD", 4)
    docs, items = searched
    got = R.ranked_search(clash(spark.createDataFrame(docs, DOCS).repartition(5)), clash(spark.createDataFrame(items, "item_id long, text string")))
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items)


def test_search_of_nothing(spark):
    from cohortlens.llm.ranked_search import ranked_search

    none, item = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search(none, item).collect() == []
    assert ranked_search(spark.createDataFrame([(1, "a")], DOCS), item.where("false")).collect() == []
    assert [tuple(r) for r in ranked_search(spark.createDataFrame([(1, "a")], DOCS), item).collect()] == ranked([(1, "a")], [(1, "a")])


def test_blocks_are_skipped_below_the_threshold(monkeypatch):
    """With one block of good documents, others are bounded but not opened."""
    import numpy as np

    from cohortlens.llm import common as C, ranked_search as R

    rng = random.Random(9)
    texts = [[words(rng, 30, 50).encode() for _ in range(40)] for _ in range(6)]
    texts[4] = [b"rare1 rare2 rare3 " + t for t in texts[4]]
    names = [x.split()[0] for x in R.INDEX.split(", ")]
    rows = []
    for b, some in enumerate(texts):
        h, n = C.word_hashes(some, R.APART)
        rows.append(dict(zip(names, R._pack(b, list(range(40 * b, 40 * b + 40)), h, n))))
    v, times = np.unique(C.word_hashes([b"rare1 rare2 rare3 w3"], R.APART)[0], return_counts=True)
    q = R.Questions([(1, v, times)])
    found = defaultdict(int)
    for r in rows:
        x = R.Block(r, q)
        for a, d in zip(x.has, np.frombuffer(r["df"], "<i4")[x.local]):
            found[int(a)] += int(d)
    q.weigh(found, 240, sum(r["terms_read"] for r in rows))
    blocks = [R.Block(r, q) for r in rows]
    best = [int(max(R.score([x], q, 0)[0])) for x in blocks]
    assert all(int(x.bounds(q)[0]) >= b for x, b in zip(blocks, best))
    blocks = [R.Block(r, q) for r in rows]
    q.floor[0] = sorted(R.score([R.Block(rows[4], q)], q, 0)[0])[-20]
    monkeypatch.setattr(R, "_rows", lambda batches, q: iter([blocks]))
    out = next(R._best(q, 20)([]))
    assert [x.block for x in blocks if hasattr(x, "first")] == [4] and out.num_rows == 20


# ---- 12 ----

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def luhn(d):
    return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m[0])]


def row_of(i, text):
    spans = base_spans(text)
    n = Counter(s.split(":")[0] for s in spans)
    return (i, *(n[k] for k in BASE), hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans), 0)


def test_base_spans_equal_the_expressions(spark):
    from cohortlens.llm.personal_data import personal_data

    rng = random.Random(11)
    parts = ["a", "Z9", "@", ".", "..", "-", "_", "%", " ", "\n", "é", "😀", "1", "25", "256", "255", "0", "+", "(", ")", "a@b.com", "x.y@c-d.e.f", "10.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-0199", "1.2.3.4.5.6.7.8", "0000255.1.1.1"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(400)]
    texts += [None, "", "a@b.com_x@c.de%y@z.z.z.", "a" * 50_000, "1 " * 20_000, "a@" + "b." * 30_000 + "c", "+1" + " (" * 20_000, "@" * 5_000, "9" * 30_000, "...@!!"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, "other a@b.co"), (None, "1.2.3.4"), (None, None)]
    got = personal_data(clash(spark.createDataFrame(rows, DOCS).repartition(4)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((row_of(*r) for r in rows), key=str)
    assert personal_data(spark.createDataFrame([], DOCS)).collect() == []


def plain_bootstrap(mentions):
    """{pattern: (kind, confidence)} in plain loops. mentions: (kind or None, hit, patterns)."""
    graph = defaultdict(dict)
    for kind, hit, patterns in mentions:
        for p in patterns:
            graph[p][hit.lower()] = max(filter(None, [graph[p].get(hit.lower()), kind]), default=None)
    known, before = {}, -1
    for _ in range(3):
        confident = {}
        for p, members in graph.items():
            n, ends = len(members), {}
            for k in BASE:
                share = sum(1.0 if s == k else known[h][1] if s is None and h in known and known[h][0] == k else 0.0 for h, s in members.items()) / n
                ends[k] = (share + 1.96**2 / (2 * n) - 1.96 * math.sqrt(share * (1 - share) / n + 1.96**2 / (4 * n * n))) / (1 + 1.96**2 / n)
            k = max(ends, key=ends.get)
            if ends[k] >= 0.8:
                confident[p] = k, ends[k]
        if len(confident) == before:
            break
        before, miss = len(confident), defaultdict(lambda: dict.fromkeys(BASE, 1.0))
        for p, (k, c) in confident.items():
            for h, s in graph[p].items():
                if s is None:
                    miss[h][k] *= 1 - c
        known = {h: (k := min(m, key=m.get), 1 - m[k]) for h, m in miss.items()}
    return confident


def test_patterns_find_what_no_expression_knows(spark):
    from pyspark.sql import functions as F

    from cohortlens.llm.personal_data import confident_patterns, personal_data

    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    around = lambda x: f"{word()} {word()} {x} {word()}"
    rows = [(i, around(f"please call +1 (555) 555-{1000 + i} today")) for i in range(60)]
    rows += [(100 + i, around(f"see order {rng.randint(10**6, 10**7)} of")) for i in range(60)]
    rows += [(300 + i, around(f"see order +1 (555) 556-{1000 + i} of")) for i in range(20)]  # a context that is not telling
    rows += [(i, t) for i in (200, 201) for t in [around("please call «555-01992». today")]] + [(202, around("555-01992")), (203, around("please call tomorrow")), (204, around("please call 12 today"))]
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t in rows:
        if i in (200, 201):
            at = t.index("555-01992")
            assert got[i].spans == f"phone:{at}:{at + 9}" and got[i].n_added == 1 and got[i].n_phone == 0
        else:
            assert got[i].n_added == 0 and got[i].spans == ",".join(base_spans(t))
    # the scores of every round, against plain loops
    names = [f"p{k}" for k in range(12)]
    seeds = [(rng.choice([*BASE, None, None]), f"I{k}") for k in range(150)]
    mentions = [(kind, hit, list({p for p in rng.choices(names[:4] if kind == "phone" else names, k=3)})) for kind, hit in seeds for _ in range(2)]
    mentions += [("email", f"E{k}", ["sure", f"tail{k % 2}"]) for k in range(80)] + [(None, f"C{k}", ["sure", "tail0", "next"]) for k in range(4)] + [(None, f"D{k}", ["next"]) for k in range(3)]
    flat = spark.createDataFrame(mentions, "kind string, hit string, patterns array<string>").select("kind", "hit", F.explode("patterns").alias("pattern"))
    found = {r.pattern: (r.kind, r.confidence) for r in confident_patterns(flat).collect()}
    want = plain_bootstrap(mentions)
    assert found.keys() == want.keys() and {"sure", "tail0", "tail1"} <= found.keys()
    assert all(found[p][0] == want[p][0] and abs(found[p][1] - want[p][1]) < 1e-9 for p in want)


def test_personal_data_runs_without_python(spark):
    """The operator is native: no Python node in the plan of its stages."""
    from cohortlens.llm.personal_data import personal_data

    plan = personal_data(spark.createDataFrame([(1, "a@b.co")], DOCS))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- 13 ----


def transformed(i, text):
    text = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(u)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:z]), "".join(u[z:])
    return n, *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def test_cuts_equal_plain_cuts_and_restore(spark):
    from cohortlens.llm.fill_middle import fill_in_middle, restore

    rng = random.Random(4)
    parts = ["a", "é", "漢", "😀", "\n", "\n\n", "<", "<P", "<S", "P>", "><", "<<M", "line of text", "\r\n", " ", "\x00", "�"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(1, 300)))) for i in range(300)]
    rows += [(i, "".join(rng.choices([*parts, "<P>", "<M>"], k=20))) for i in range(300, 340)]
    rows += [(400, None), (401, ""), (402, "\n"), (403, "no end"), (404, "x\n" * 400_000), (405, "é" * 500_000), (405, "a\nb"), (405, "a\nb"), (None, "a\nb\nc"), (None, None)]
    docs = clash(spark.createDataFrame(rows, DOCS).repartition(4))
    cut = fill_in_middle(docs, ["doc_id", "text", "row"])
    got = cut.select("row.doc_id", "row.text", "n", "form", "prefix_chars", "middle_chars", "output", restore(cut.output, cut.form).alias("back")).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(((i, t, *transformed(i, t)) for i, t in rows), key=str)
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.where("false")).collect() == []


def test_rates(spark):
    from cohortlens.llm.fill_middle import fill_in_middle

    docs = spark.createDataFrame([(i, "a\nb\nc") for i in range(400)], DOCS)
    forms = lambda **k: Counter(r.form for r in fill_in_middle(docs, **k).collect())
    assert forms(rate=0) == {"plain": 400}
    assert forms(spm=100) == {"spm": 400}
    assert 100 < forms(rate=50, spm=0)["psm"] < 300
