"""The ten operators and the pipeline against brute force, exact round trips and held-out accuracy, with edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("cohortlens.llm.queries")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
SYLLABLES = {"en": ["the", "ing", "tion", "ea", "th", "er"], "fr": ["eau", "eux", "lle", "oi", "qu", "é"], "de": ["sch", "ung", "ein", "tz", "ü", "keit"]}


def prose(lang, words, rng=RNG):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words))


def near(text, edits, rng=RNG):
    w = text.split()
    for i in rng.sample(range(len(w)), edits):
        w[i] = "x" + str(rng.randint(0, 10**6))
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(150):
        lang = rng.choice(list(SYLLABLES))
        out.append([i, prose(lang, rng.randint(60, 200), rng), lang, f"src{0 if rng.random() < 0.4 else rng.randint(1, 4)}", 0])
    base = prose("en", 150, rng)
    out += [[200 + i, near(base, rng.randint(0, 6), rng), "en", "src0", 0] for i in range(40)]
    out += [[300 + i, out[3][1], "en", "src1", 0] for i in range(20)]
    out += [[400, None, None, None, None], [401, "", "en", "src2", 0], [402, " \t\n ", None, "src2", 0], [403, "one two", "en", "src3", 0], [404, "One\tTwo", "en", "src3", 0], [405, "12 34 !!", "en", "src3", 0], [405, "12 34 !!", "en", "src3", 0], [None, "a b c d e f g h", "en", None, 0], [406, prose("fr", 30_000, rng), "fr", "src1", 0]]
    return [tuple(r) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clash(df):
    """Extra columns with names that operators use inside."""
    from pyspark.sql import functions as F

    for c in ("row", "key", "n", "rank", "block", "position", "cluster", "v", "id", "_h", "range"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# ---- 7 ----


def shingle_set(text):
    w = [x for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components_of(sets):
    """{row number: component} by comparing all pairs."""
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    up[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def all_pairs_joined(rows):
    """Counter of (doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingle_set(r[1]) for r in rows]
    group = components_of(sets)
    least = {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return Counter((r[0], len(s), r[0] if not s else least.get(g)) for r, s, g in zip(rows, sets, group))


@pytest.mark.parametrize("block", [1_500_000, 700])
def test_ngram_join_equals_all_pairs(spark, docs, rows, block):
    """A small block size cuts cells into many blocks and takes the path across blocks."""
    from cohortlens.llm.ngram_join import ngram_jaccard_join

    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(clash(docs), block=block).collect())
    assert got == all_pairs_joined(rows)


def test_ngram_join_with_frequent_shingles(spark):
    """Passages in most of the texts are dealt by class; texts that link by them, or by them and a few shingles more, still meet."""
    from cohortlens.llm import ngram_join as J

    rng = random.Random(11)
    passages = [prose("en", 60, rng) for _ in range(3)]
    rows = [(i, f"{passages[i % 3]} {prose('de', rng.choice([0, 3, 6, 10, 12, 15, 18, 40, 90]), rng)}", None, None, None) for i in range(400)]
    rows += [(1000 + i, f"{prose('fr', 12, rng)} {passages[0]} {passages[1]}", None, None, None) for i in range(80)]
    rows += [(2000 + i, rows[5][1], None, None, None) for i in range(100)]
    tokens, held = J._frequent(J.shingles([r[1].encode() for r in rows]))
    assert len(tokens) >= 150 and held.min() >= J.LEAST_HOT
    docs = spark.createDataFrame(rows, DOCS)
    for parts in (1, 3):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in J.ngram_jaccard_join(docs.coalesce(parts)).collect())
        assert got == all_pairs_joined(rows)


def test_ngram_join_of_nothing(empty):
    from cohortlens.llm.ngram_join import ngram_jaccard_join

    assert ngram_jaccard_join(empty).collect() == []


def test_word_hashes_follow_the_words():
    from cohortlens.llm.common import word_hashes

    texts = [b"", b"  A\x0bbb\tccc  ", "é ÉÉ longerthaneightbytes longerthaneightbytez".encode(), b"a", b"a\x00 a"]
    h, n = word_hashes(texts)
    words = [w for t in texts for w in t.lower().split(b" ") for w in w.split()]
    assert n.tolist() == [len(t.split()) for t in texts]
    seen = {}
    for w, x in zip([w for t in texts for w in t.lower().split()], h):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    from cohortlens.llm.common import components

    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7), (None, 3), (11, 10), (10, 12)] + [(100 + i, 100 + i + 1) for i in range(40)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {**{i: 1 for i in range(1, 6)}, 8: 8, 9: 8, **{i: 10 for i in (10, 11, 12)}, **{100 + i: 100 for i in range(41)}}


# ---- 2 ----


def test_token_counts_equal_the_library(spark, docs, rows, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    tokenizers = pytest.importorskip("public_tokenizers")
    from cohortlens.llm.token_count import Counter as Tokens, token_counts

    path = tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or ""))) for r in rows)
    got = token_counts(clash(docs), path).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and any(r.over_limit for r in got)
    assert token_counts(empty, path).collect() == []
    c, rng = Tokens(open(path, "rb").read()), random.Random(1)
    assert c.splits
    parts = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "▁", "é", "ß", "<s>", "</s>", "<unk>", "<0x0A>", "\u3000", "\xa0", "ing", "\0", "🙂", "Z", "123", "."]
    for _ in range(3000):
        s = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert c.count(s) == len(sp.encode(s)), s


# ---- 5 ----


def test_url_rules_and_list(spark):
    from cohortlens.llm.queries import RULES
    from cohortlens.llm.url_filter import canonical, filter_urls
    from pyspark.sql import functions as F

    urls = ["http://EXAMPLE.com/en/1", "https://a.example.com/en/7x?q", "https://example.net/de/8", "x://b.example.net/de/9#f", "http://foo.org/es/", "http://foo.org/es", None, "no scheme", "http://com/en/", "http://notcom/en/", "http://listed.xyz/a/", "http://www.listed.xyz:80/a#x", "http://listed.xyz/a?y=1", "://", "http://h?x/en/"]
    pages = clash(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).drop("host")
    listed = spark.createDataFrame([("http://listed.xyz/a",), (None,), ("http://listed.xyz/a",)], "url string").select(canonical(F.col("url")).alias("canonical"))
    many = RULES + [("block", f"rule{i}.test/") for i in range(300)]
    for rules in (RULES, many):
        got = {r.page_id: r for r in filter_urls(pages, listed, rules).collect()}
        assert [got[i].rule for i in range(15)] == ["com/en/", "example.com/en/7", "example.net/de/8", "net/de/", "org/es/", None, None, None, "com/en/", None, None, None, None, None, None]
        assert [got[i].verdict for i in range(15)] == ["block", "allow", "block", "allow", "block", "allow", "allow", "allow", "block", "allow", "block", "block", "allow", "allow", "allow"]
        assert (got[1].host, got[1].path) == ("a.example.com", "/en/7x") and (got[6].host, got[7].path) == ("", "") and got[14].path == ""
    assert filter_urls(pages.limit(0), listed, RULES).collect() == []


def test_many_rules_keep_null_ids_repeats_and_long_urls(spark):
    from cohortlens.llm.url_filter import filter_urls

    long = "http://rule7.test/" + "a/" * 100_000
    rows = [(None, "http://x.rule7.test/p"), (None, "http://x.rule7.test/p"), (3, long), (3, long), (4, "http://rule7.test/keep/me"), (5, None)]
    rules = [("block", f"rule{i}.test/") for i in range(300)] + [("allow", "rule7.test/keep/")]
    listed = spark.createDataFrame([], "canonical string")
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string"), listed, rules)
    assert got.columns == ["page_id", "host", "path", "rule", "listed", "verdict"]
    have = sorted(((r.page_id or -1, len(r.path), r.rule, r.verdict) for r in got.collect()), key=str)
    assert have == sorted([(-1, 2, "rule7.test/", "block")] * 2 + [(3, 200_001, "rule7.test/", "block")] * 2 + [(4, 8, "rule7.test/keep/", "allow"), (5, 0, None, "allow")], key=str)


# ---- 8 ----


def test_warc_round_trip(spark):
    import hashlib

    from cohortlens.llm.warc import archive_round_trip

    long = "<html>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n\r\n</html>"
    rows = [(5, "http://a/1", long), (3, "http://a/2", long), (9, None, long), (1, "http://a/3", "short"), (2, "http://b/\r\n4", "short"), (4, "", None), (6, "http://c", "é" * 100), (7, "http://c/x", "é" * 50), (8, "http://c/y", "é" * 50), (3, "http://a/2", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = archive_round_trip(clash(pages)).collect()
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = h in first and i > first[h]
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.digest_ok for r in got)
    assert archive_round_trip(pages.limit(0)).collect() == []


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch, broadcast):
    """Long captures get files of few records; revisits name the url and date of their response; an id in files of two kinds stays two captures; short payloads link with nothing in either join."""
    import gzip
    from pathlib import Path

    from cohortlens.llm import warc

    monkeypatch.setattr(warc, "SIZES", [(300, 30), (2_000, 6), (1 << 63, 3)])
    monkeypatch.setattr(warc, "MAX_BROADCAST", broadcast)
    rows = [(0, "http://a/x", "cd" * 900)] + [(i, f"http://a/{i}", "ab" * n) for i, n in enumerate([20] * 40 + [150] * 10 + [900] * 5 + [5_000] * 4)] + [(None, None, "ab" * 150), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.plan_revisits(pages), str(tmp_path / "w"))
    most = {}
    for f in Path(tmp_path / "w").rglob("*.gz"):
        records = list(warc.parse_archive(f.read_bytes()))
        most[f.parent.name] = max(most.get(f.parent.name, 0), len(records))
        for fields, block in records:
            if fields["warc-type"] == "revisit":
                assert fields["warc-refers-to-target-uri"] in ("http://a/40", "http://a/50", "http://a/55") and fields["warc-refers-to-date"] == fields["warc-date"]
            else:
                assert "warc-refers-to-target-uri" not in fields and "warc-refers-to-date" not in fields
    assert most == {"0": 30, "1": 6, "2": 3}
    got = Counter((r.page_id, r.payload_bytes, r.refers_to) for r in warc.archive_round_trip(pages).collect())
    first = {300: 40, 1_800: 50, 10_000: 55}
    want = Counter((i, n := len(h or ""), first[n] if n in first and i is not None and i > first[n] else None) for i, _, h in rows)
    assert got == want


def test_assembly_of_incomplete_captures(spark):
    from cohortlens.llm.warc import assemble

    r = spark.createDataFrame([("request", "q1", "c1"), ("response", "c1", None), ("metadata", "m2", "c2")], "record_type string, record_id string, concurrent_to string")
    got = {x.capture_id: x for x in assemble(r).collect()}
    assert got["c1"].request.record_id == "q1" and got["c1"].metadata is None and got["c2"].response is None


# ---- 1 ----


def test_mix_keeps_rows_and_shares(spark, docs, rows, empty):
    from cohortlens.llm.mixing import mix_sources

    got = mix_sources(clash(docs), block_rows=4).collect()
    assert Counter(r.row.doc_id for r in got) == Counter(r[0] for r in rows)
    assert len({r.position for r in got}) == len(got)
    plan = {r.mix_source: r for r in got}
    assert "" in plan  # null sources
    assert mix_sources(empty).collect() == []


#: (source, weight): large and small weights, equal ones, one unit and none.
WEIGHTS = [("a", 700), ("b", 200), ("c", 50), ("d", 33), ("e", 1), ("f", 0), ("g", 50), ("h", -3)]


def test_schedule_deviates_by_less_than_a_block(spark):
    """From the weights themselves, after every slot of three periods, every block within its release and deadline."""
    from cohortlens.llm.mixing import schedule

    rows = sorted(schedule(spark.createDataFrame(WEIGHTS, "source string, weight long")).collect(), key=lambda r: r.slot)
    weights = {s: w for s, w in WEIGHTS if w > 0}
    total = sum(weights.values())
    assert [r.slot for r in rows] == list(range(total)) and rows[0].d == total and {r.source for r in rows} == set(weights)
    got = Counter()
    for k in range(3):
        for r in rows:
            j, at = got[r.source] + 1, k * total + r.slot
            assert (j - 1) * total // weights[r.source] <= at < -(-j * total // weights[r.source]) and (k or r.turn == j - 1)
            got[r.source] = j
            assert all(abs(got[s] * total - w * (at + 1)) < total for s, w in weights.items())
    # a common factor shortens the period and changes nothing
    short = schedule(spark.createDataFrame([("x", 60), ("y", 30), ("z", 10)], "source string, weight long")).collect()
    assert Counter(r.source for r in short) == {"x": 6, "y": 3, "z": 1}


def test_schedule_is_earliest_deadline_first(spark):
    """Slot by slot against a plain simulation."""
    from cohortlens.llm.mixing import schedule

    rng = random.Random(8)
    weights = {f"s{i:03}": rng.choice([1, 2, 3, 7, 40, 100]) for i in range(60)}
    rows = sorted(schedule(spark.createDataFrame(list(weights.items()), "source string, weight long")).collect(), key=lambda r: r.slot)
    total, done = sum(weights.values()), Counter()
    for t in range(total):
        ready = [(-(-(done[s] + 1) * total // w), -w, s) for s, w in weights.items() if done[s] * total // w <= t]
        assert rows[t].source == min(ready)[2]
        done[min(ready)[2]] += 1


def test_mix_to_unequal_weights(spark):
    """A hot source, unequal weights, sources without rows or weight: shares hold at every prefix up to the first source that runs out."""
    from cohortlens.llm.mixing import mix_sources

    sizes = {"a": 2000, "b": 700, "c": 150, "d": 120, "e": 30, "f": 50, "no weight": 10}
    rows = [(i, "t", "en", s, 0) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [rows[0]] * 3
    got = sorted(mix_sources(spark.createDataFrame(rows, DOCS), spark.createDataFrame(WEIGHTS, "source string, weight long"), block_rows=2).collect(), key=lambda r: r.position)
    assert len(got) == len(rows) == len({r.position for r in got})
    weights = {s: w for s, w in WEIGHTS if w > 0 and s in sizes}
    seen, n = Counter(), 0
    for r in got:
        if r.on_target:
            assert r.position == n
            n += 1
            seen[r.mix_source] += 1
            # a block, and the part of the one that is begun
            assert all(abs(seen[s] - w * n / sum(weights.values())) < 4 for s, w in weights.items())
    assert n > 700 and [r.mix_source for r in got[-60:]] == ["f"] * 50 + ["no weight"] * 10 and not any(r.on_target for r in got[-60:])
    none = mix_sources(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "source string, weight long")).collect()
    assert len({r.position for r in none}) == len(rows) and not any(r.on_target for r in none)


def test_too_long_a_period_is_refused(spark):
    from cohortlens.llm.mixing import schedule

    with pytest.raises(Exception, match="period"):
        schedule(spark.createDataFrame([("a", 10**9), ("b", 1)], "source string, weight long")).collect()


# ---- 6 ----


def naive_best_fit(sizes, sources, clusters, capacity, quota):
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters):
        fits = [b for b in bins if b[0] >= n and b[1][s] < quota and not (c is not None and c in b[2])]
        if not fits:
            fits = [[capacity, Counter(), set(), len(bins)]]
            bins.append(fits[0])
        best = min(fits, key=lambda b: b[0])
        best[0] -= n
        best[1][s] += 1
        best[2].add(c)
        out.append((best[3], best[0]))
    return out


@pytest.mark.parametrize("sources,clusters", [(3, 5), (200, 300)])
def test_pack_is_best_fit(sources, clusters):
    from cohortlens.llm.packing import Bins, pack

    rng = random.Random(3)
    sizes = sorted((rng.randint(0, 100) for _ in range(600)), reverse=True)
    src = [0 if rng.random() < 0.4 else rng.randint(1, sources) for _ in sizes]
    clu = [rng.choice([None, rng.randint(1, clusters)]) for _ in sizes]
    got = pack(sizes, src, clu, 100, 2)
    left, seen, twice = Counter(), Counter(), set()
    for n, s, c, b in zip(sizes, src, clu, got):
        left[b] += n
        seen[b, s] += 1
        assert left[b] <= 100 and seen[b, s] <= 2 and (b, c) not in twice
        if c is not None:
            twice.add((b, c))
    # the residual left by every placement is the one that a search of all bins leaves
    want = naive_best_fit(sizes, src, clu, 100, 2)
    assert len(set(got)) <= len({b for b, _ in want}) * 1.02 + 1
    bins = Bins(100, 2, sources <= 64, False)
    for n, s in zip(sizes[:200], src):
        fits = [(bins.residual[k], k) for k in range(bins.n) if bins.residual[k] >= n and bins.count[int(bins.bin[k]), s] < 2]
        at = bins.find(n, s, -1)
        assert (at < 0 and not fits) or bins.residual[at] == min(fits)[0]
        bins.add(n, s, -1)
        assert (np.diff(bins.residual[: bins.n]) >= 0).all()


@pytest.mark.parametrize("sources,clusters,quota", [(3, 5, 2), (200, 300, 1), (90, 4, 3)])
def test_pack_places_like_a_search_of_all_bins(sources, clusters, quota):
    """Placement by placement: the tightest compatible bin, of equal ones the last touched."""
    from cohortlens.llm.packing import pack

    rng = random.Random(sources)
    sizes = sorted((rng.randint(0, 60) for _ in range(700)), reverse=True)
    src = [0 if rng.random() < 0.4 else rng.randint(1, sources) for _ in sizes]
    clu = [rng.choice([None, rng.randint(1, clusters)]) for _ in sizes]
    bins, want = [], []
    for at, (n, s, c) in enumerate(zip(sizes, src, clu)):
        fits = [b for b in bins if b["left"] >= n and b["of"][s] < quota and (c is None or c not in b["in"])]
        b = min(fits, key=lambda b: (b["left"], -b["at"]), default=None)
        if b is None:
            b = {"left": 100, "of": Counter(), "in": set(), "id": len(bins)}
            bins.append(b)
        b["left"] -= n
        b["at"] = at
        b["of"][s] += 1
        b["in"].add(c)
        want.append(b["id"])
    assert pack(sizes, src, clu, 100, quota) == want


def test_packing_keeps_every_character(docs, rows, empty):
    from cohortlens.llm.packing import pack_documents

    got = pack_documents(clash(docs), capacity=1000).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.piece, r.start, r.size))
    for r in rows:
        if [x[0] for x in rows].count(r[0]) == 1:
            pieces = sorted(by[r[0]])
            assert sum(p[2] for p in pieces) == len(r[1] or "") and [p[1] for p in pieces] == [1000 * k for k in range(len(pieces))]
    assert max(Counter(r.pack_id for r in got).values()) > 1
    load = Counter()
    for r in got:
        load[r.pack_id] += r.size
    assert max(load.values()) <= 1000
    assert pack_documents(empty).collect() == []


# ---- 9 ----


def test_language_held_out(docs, rows, empty):
    from cohortlens.llm.language_id import language_id

    got = language_id(clash(docs)).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 150}
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" for i in (400, 401, 402, 405)) and all(0 <= r.score <= 1 for r in got)
    assert by[7].held_out == (zlib.crc32(b"7") % 5 == 0)
    assert language_id(empty).collect() == []


def test_sample_takes_every_language_once(spark, monkeypatch):
    """Repeated rows count once, and a language is learned however many there are."""
    from cohortlens.llm import language_id as L

    rows = [(i, f"text {i} of l{i % 9}", f"l{i % 9}") for i in range(90)] + [(0, "text 0 of l0", "l0")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert Counter(lang for lang, _ in L.sample_for_fit(df)) == {f"l{k}": 10 for k in range(9)}
    monkeypatch.setattr(L, "SAMPLE", 5)
    assert Counter(lang for lang, _ in L.sample_for_fit(df)) == {f"l{k}": 1 for k in range(9)}


def test_a_language_of_one_often_repeated_id_is_learned(spark):
    from pyspark.sql import functions as F

    from cohortlens.llm import language_id as L

    common = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit("common").alias("text"), F.lit("aa").alias("lang"))
    many = spark.range(400_000).select((F.col("id") % 20 + 10_000).alias("doc_id"), F.concat(F.lit("rare "), (F.col("id") % 20).cast("string")).alias("text"), F.concat(F.lit("l"), (F.col("id") % 20).cast("string")).alias("lang"))
    no_id = spark.createDataFrame([(None, "none", "zz")] * 3, "doc_id long, text string, lang string")
    found = Counter(lang for lang, _ in L.sample_for_fit(common.unionByName(many).unionByName(no_id)))
    assert found == {"aa": L.PER_LANGUAGE, "zz": 1} | {f"l{k}": 1 for k in range(20)}


def test_nothing_to_learn_from(spark):
    from cohortlens.llm.language_id import language_id

    df = spark.createDataFrame([(1, "some text", None, "s", 1)], DOCS)
    assert language_id(df).collect()[0].lang_pred == "und"


def test_fast_convolution_is_the_networks(rows):
    from cohortlens.llm import language_id as L

    net = L.new_network(["a", "b"])
    text = rows[0][1].encode()
    x = np.zeros(L.SPAN * 2 + 8, np.uint8)
    c = L.CLASS_OF[np.frombuffer(text, np.uint8)][: L.SPAN * 2]
    x[: len(c)] = c
    z, _ = net._pooled(np.stack([x[: L.LENGTH], x[L.SPAN : L.SPAN + L.LENGTH]]).astype(np.int64))
    assert np.allclose(net.window_logits(x), np.maximum(z, 0) @ net.dense + net.out, atol=1e-3)


# ---- 10 ----


def test_base_scores_and_counts(docs, rows, empty):
    from cohortlens.llm.lm_scoring import score_texts

    got = score_texts(clash(docs)).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split()
    c, ends = Counter(), 0
    for r in rows:
        if not held(r[0]):
            c.update(words(r[1]))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    want = {(r[0], len(words(r[1])) + 1): (sum(c[w] > 0 for w in words(r[1])) + 1, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(r[1])) + math.log10((ends + 1) / (n + v + 1))) for r in rows}
    for r in got:
        known, base = want[r.doc_id, r.n_tokens]
        assert (r.n_known, r.train_tokens, r.held_out) == (known, n, held(r.doc_id)) and r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score <= 0 and (r.score == 0) == (r.bits_per_byte is None)
    out = [r for r in got if r.held_out and r.bits_per_byte and r.n_tokens > 50]
    assert out and np.mean([r.bits_per_byte for r in out]) < 4
    assert score_texts(empty).collect() == []


def counted_tables(texts, times=1):
    """(layout, zero and one counts) of texts by the operator's own pieces."""
    import pyarrow as pa
    from cohortlens.llm import lm_scoring as L

    bits, got = 4, []
    keys, n = L._count(L.strings(texts)[0])
    for o in L.ORDERS:
        k, m = L._count(L._within(keys, o), n)
        for r, at in L._ranges(L._context(k, o), bits):
            m_of = m[at].astype(np.int64) * times
            word = np.concatenate([np.repeat(k[at] << np.uint64(16), m_of // L._MOST) | np.uint64(L._MOST), (k[at] << np.uint64(16)) | (m_of % L._MOST).astype(np.uint64)])
            got += L._sum_strings(r, pa.table({"a": pa.array([word.tobytes()], pa.binary()), "place": [o]}), bits)
    low = {o: np.zeros(1 << bits, np.int64) for o in L.ORDERS}
    for _, part, o, zero, *_ in got:
        low[o][part] = (len(zero) // 4).bit_length() - 1
    layout = L.Layout(bits, low)
    tables = {o: (np.zeros(layout.size[o], np.float32), np.zeros(layout.size[o], np.float32)) for o in L.ORDERS}
    for _, part, o, zero, one, *_ in got:
        at = slice(layout.first[o][part], layout.first[o][part] + len(zero) // 4)
        tables[o][0][at], tables[o][1][at] = np.frombuffer(zero, np.float32), np.frombuffer(one, np.float32)
    return layout, tables


def test_string_probabilities_sum_to_one():
    from cohortlens.llm import lm_scoring as L

    texts = [b"the cat sat on the mat " * 20, b"a dog"]
    m = L.learn(*counted_tables(texts), texts)
    ctx = np.uint64(int.from_bytes(b"e mat", "little"))
    every = ctx | (np.arange(256, dtype=np.uint64) << np.uint64(8 * L._PAD))
    assert np.exp(m.log_p(every)).sum() == pytest.approx(1, abs=1e-6)
    assert np.allclose(m.lookup(every), m.log_p(every)) and np.allclose(m.lookup(every), m.log_p(every))


def test_counts_are_those_of_all_contexts():
    """Zero and one counts of every context and bit against a dictionary."""
    from cohortlens.llm import lm_scoring as L

    rng = random.Random(2)
    texts = [prose(lang, 200, rng).encode() for lang in SYLLABLES]
    layout, tables = counted_tables(texts)
    keys, _ = L.strings(texts)
    for o in (2, 4):
        want = Counter()
        for t in texts:
            padded = bytes(o) + t.lower()
            for i in range(len(t)):
                for b in range(8):
                    want[padded[i : i + o], b, padded[i + o] >> (8 - b), (padded[i + o] >> (7 - b)) & 1] += 1
        slot, bits = layout.slots(keys, o)
        assert tables[o][0].sum() + tables[o][1].sum() == 8 * len(keys)
        i, alone = 0, 0
        for t in texts:
            padded = bytes(o) + t.lower()
            for j in range(len(t)):
                for b in range(8):
                    have = tables[o][int(bits[i, b])][slot[i, b]]
                    known = want[padded[j : j + o], b, padded[j + o] >> (8 - b), int(bits[i, b])]
                    assert have >= known
                    alone += have == known
                i += 1
        # slots are shared by few
        assert alone > 0.7 * 8 * len(keys)


def test_tables_grow_with_the_strings():
    from cohortlens.llm import lm_scoring as L

    rng = random.Random(4)
    size = lambda n: counted_tables([bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz ", k=n))])[0].size[5]
    assert size(4000) > 2 * size(400) and L.low_bits(5, 10**9, 6) == L.MOST_BITS[5] - 6


@pytest.mark.parametrize("times", [100, 10_000])
def test_more_of_the_same_keeps_the_score(times):
    """All counts times 100 or 10,000: bits per byte of an unseen text stay within 0.02 of each other."""
    from cohortlens.llm import lm_scoring as L

    rng = random.Random(6)
    texts = [prose("en", 150, rng).encode() for _ in range(60)]
    unseen = prose("en", 400, rng).encode()
    keys, n = L._count(L.strings([unseen])[0])
    got = []
    for k in (100, 100 * times):
        m = L.learn(*counted_tables(texts, k), texts[:4])
        got.append(-(n * m.log_p(keys)).sum() / math.log(2) / len(unseen))
    # what is kept of a slot is its odds, so only bits never seen change
    assert got[1] == pytest.approx(got[0], abs=0.02)


def test_large_counts_keep_their_odds():
    """Counts of zero and one far beyond 65,504 in the same slot."""
    from cohortlens.llm import lm_scoring as L

    texts = [b"ea"] * 9 + [b"es"] * 27
    layout, tables = counted_tables(texts, 100_000)
    slot = layout.slots(L.strings([b"ea"])[0][1:], 1)[0][0]
    zero, one = tables[1]
    assert (zero[slot[0]], one[slot[0]]) == (3_600_000, 0)
    assert (zero[slot[3]], one[slot[3]]) == (900_000, 2_700_000)


def test_frequent_words_stand_where_they_are(spark, docs, monkeypatch):
    """Base scores are the same whether words are resolved in place or by range."""
    from cohortlens.llm import lm_scoring as L

    key = lambda: sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in L.score_texts(docs).collect())
    want = key()
    monkeypatch.setattr(L, "FREQUENT", 5)
    assert key() == want


def test_all_training_texts_reach_the_mixer(spark, monkeypatch):
    """Bytes met by the mixer are those of the training texts, whatever the stream of the start."""
    from cohortlens.llm import lm_scoring as L

    rng = random.Random(3)
    texts = [(i, prose("en", 80, rng)) for i in range(300)]
    train = [t for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    seen, real = [], L.averaged
    monkeypatch.setattr(L, "averaged", lambda start, passes: seen.append((start, list(passes))) or seen.append(real(start, seen[0][1])) or seen[1])
    monkeypatch.setattr(L, "LANES", 4)
    L.score_texts(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    (start, passes), model = seen
    assert sum(p[0] for p in passes) == sum(len(t.encode()) for t in train)
    assert sum(p[3].sum() for p in passes) == pytest.approx(8 * sum(len(t.encode()) for t in train))
    keys, n = L._count(L.strings([t.encode() for i, t in texts if zlib.crc32(str(i).encode()) % 7 == 2])[0])
    assert -(n * model.log_p(keys)).sum() < -(n * start.log_p(keys)).sum()


def test_sums_of_words_stay_with_the_words():
    """With the most ranges, what a batch's documents get back is no larger than the words they sent, and the sums are those of a dictionary."""
    import pyarrow as pa
    from cohortlens.llm import lm_scoring as L

    rng, bits, rows = np.random.default_rng(8), 12, []
    words, want = {}, {}
    for batch in range(2):
        h, at = rng.integers(0, 300, 4_000).astype(np.uint64), rng.integers(0, 5_000, 4_000)
        train = rng.random(5_000) < 0.8
        words[batch] = (L.C.mix(h), at, train)
    counts = Counter(int(w) for h, at, train in words.values() for w in h[train[at]])
    for batch, (h, at, train) in words.items():
        word = ((h << np.uint64(bits)) & ~np.uint64(0xFFFF)) | at.astype(np.uint64)
        rows += [(L._WORDS, k, batch, word[x].tobytes(), np.packbits(train[at[x]]).tobytes()) for k, x in L._ranges(h, bits)]
        for w, d in zip(h.tolist(), at.tolist()):
            logs, known = want.get((batch, d), (0.0, 0))
            want[batch, d] = logs + math.log10(counts[w] + 1), known + (counts[w] > 0)
    sums = []
    for k in {r[1] for r in rows}:
        t = pa.Table.from_batches([L._batch(L._SCORED, [r for r in rows if r[1] == k])])
        sums += L._sum_words((pa.scalar(L._WORDS), pa.scalar(k)), t).to_pylist()
    assert sum(len(r["a"]) for r in sums) <= L._SUM.itemsize * sum(len(h) for h, *_ in words.values())
    for batch in words:
        docs = np.zeros(5_000, L._DOC)
        docs["id"], docs["known_id"] = np.arange(5_000), True
        mine = [tuple(r.values()) for r in sums if r["batch"] == batch] + [(L._DOCS, 0, batch, docs.tobytes(), None)]
        got = L._by_document((pa.scalar(batch),), pa.Table.from_batches([L._batch(L._SCORED, mine)])).to_pylist()
        for r in got:
            logs, known = want.get((batch, r["doc_id"]), (0.0, 0))
            assert r["known"] == known and r["logs"] == pytest.approx(logs, abs=1e-9)


def test_means_of_many_tasks_equal_one_mean(spark, monkeypatch):
    from cohortlens.llm import lm_scoring as L

    rng, width = np.random.default_rng(1), len(L.ORDERS) + 1
    passes = [(int(rng.integers(1, 90)), rng.normal(size=(L.GATES, width)), rng.random((256, L.STEPS)), rng.integers(0, 3, (256, L.STEPS)).astype(float)) for _ in range(30)]
    df = spark.createDataFrame([(i, n, *(bytearray(a.tobytes()) for a in arrays)) for i, (n, *arrays) in enumerate(passes)], L._LEARNED)
    want = L._mean(passes)
    monkeypatch.setattr(L, "FAN", 3)
    few = L._few_passes(df)
    assert len(few) <= 3
    for a, b in zip(L._mean(few), want):
        assert np.allclose(a, b)
    assert L._few_passes(df.limit(0)) == []


def test_score_equals_a_plain_scorer_bit_by_bit():
    """Whole texts, one bit after another with Python's numbers; of the model's code only the place of a slot is used."""
    from cohortlens.llm import lm_scoring as L

    rng = random.Random(12)
    m = L.learn(*counted_tables([prose("en", 150, rng).encode() for _ in range(20)]), [prose("en", 150, rng).encode()])

    def plain(text):
        total, padded = 0.0, bytes(L._PAD) + text.lower()
        for i in range(len(text)):
            string = np.array([int.from_bytes(padded[i : i + L._PAD + 1], "little")], np.uint64)
            slots, node = {o: m.layout.slots(string, o)[0][0] for o in L.ORDERS}, 1
            for b in range(8):
                bit = padded[i + L._PAD] >> (7 - b) & 1
                gate = 16 * b + 4 * int(m.seen[L.GATED[0]][slots[L.GATED[0]][b]]) + int(m.seen[L.GATED[1]][slots[L.GATED[1]][b]])
                inputs = [int(m.odds[o][slots[o][b]]) / 16 for o in L.ORDERS] + [0.3]
                mix = max(-L.CLIP, min(L.CLIP, sum(x * float(w) for x, w in zip(inputs, m.weights[gate]))))
                place = (mix + L.CLIP) * (L.STEPS - 1) / (2 * L.CLIP)
                low = min(int(place), L.STEPS - 2)
                q = m.refine[node][low] * (low + 1 - place) + m.refine[node][low + 1] * (place - low)
                p = max(1e-6, min(1 - 1e-6, (1 / (1 + math.exp(-mix)) + q) / 2))
                total += math.log(p if bit else 1 - p)
                node = 2 * node + bit
        return total

    for text in (b"", b"a", "Été, THE cat".encode(), prose("en", 60, rng).encode(), b"\x00\x00 zz \n"):
        keys, _ = L.strings([text])
        assert m.log_p(keys).sum() == pytest.approx(plain(text), rel=1e-9, abs=1e-12)


# ---- 3 and 4 ----


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    x[100:160] = x[0] + 0.12 * rng.normal(size=(60, 16))
    x[160:180] = x[1]
    x[200:230] = x[2] + 0.28 * rng.normal(size=(30, 16))
    rows = [(i, [float(np.float32(v)) for v in r], 0) for i, r in enumerate(x)]
    rows += [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] + [1.0] * 15, 0), (503, [None] + [1.0] * 15, 0), (504, [], 0), (505, [float("inf")] + [1.0] * 15, 0), (None, rows[5][1], 0), (506, [1.0, 2.0], 0), (507, [1.0, 2.0], 0)]
    return rows, clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).drop("id")


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_embedding_groups(spark, vectors):
    from cohortlens.llm.embedding_dedup import near_duplicate_vectors

    rows, df = vectors
    ok = [i for i, r in enumerate(rows) if good(r[1])]
    link = defaultdict(set)
    for i in ok:
        for j in ok:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                    link[i].add(j)
                    link[j].add(i)
    comp = {}
    for i in range(len(rows)):
        seen, stack = {i}, [i]
        while stack:
            for j in link[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        comp[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    want = Counter((r[0], len(link[i]), comp[i]) for i, r in enumerate(rows))
    got = near_duplicate_vectors(df).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert near_duplicate_vectors(df.limit(0)).collect() == []


def brute_links(rows):
    """{row number: (links, component)} of unit-free vectors of any lengths."""
    by = defaultdict(list)
    for i, r in enumerate(rows):
        by[len(r[1])].append(i)
    up, links = list(range(len(rows))), Counter()

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for group in by.values():
        x = np.array([rows[i][1] for i in group], float)
        u = x / np.sqrt((x * x).sum(1, keepdims=True))
        for i, j in np.argwhere(np.triu(u @ u.T >= 0.9, 1)):
            a, b = group[i], group[j]
            links[a] += 1
            links[b] += 1
            up[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], links[i], least[find(i)]) for i, r in enumerate(rows))


def test_many_cells_guests_and_blocks(spark, monkeypatch):
    """More than ten cells, small blocks of homes and guests, groups across boundaries and repeated rows, against all pairs."""
    from cohortlens.llm import embedding_dedup as E

    rng = np.random.default_rng(9)
    x = [rng.normal(size=24) for _ in range(40)]
    x = [c + s * rng.normal(size=24) for c in x for s in (0.0, 0.1, 0.2, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 3
    monkeypatch.setattr(E, "PER_CELL", 25)
    monkeypatch.setattr(E, "BLOCK", 9)
    monkeypatch.setattr(E, "GUESTS", 20)
    seen, real = [], E.spherical_kmeans
    monkeypatch.setattr(E, "spherical_kmeans", lambda x, k: seen.append(k) or real(x, k))
    got = E.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert seen[0] >= 10
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == brute_links(rows)


def test_more_vector_lengths_than_have_cells(spark):
    from cohortlens.llm import embedding_dedup as E

    rng = np.random.default_rng(3)
    rows = []
    for d in range(2, 22):
        v = rng.normal(size=d)
        rows += [(100 * d + k, (v + 0.02 * k * rng.normal(size=d)).tolist()) for k in range(4)]
    assert len({len(r[1]) for r in rows}) > E.LENGTHS
    got = E.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == brute_links(rows)


def test_blocks_of_a_cell_agree(spark, vectors, monkeypatch):
    from cohortlens.llm import embedding_dedup as E

    key = lambda d: Counter((r.vec_id, r.n_links, r.component_id) for r in d.collect())
    whole = key(E.near_duplicate_vectors(vectors[1]))
    monkeypatch.setattr(E, "BLOCK", 50)
    assert key(E.near_duplicate_vectors(vectors[1])) == whole


def test_groups_on_either_side_of_a_boundary(spark, monkeypatch):
    """Two dense groups with a cell each: the links between them lie along the boundary's normal."""
    from cohortlens.llm import embedding_dedup as E

    rng = np.random.default_rng(4)
    u, v = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    other = 0.92 * u + (1 - 0.92**2) ** 0.5 * v
    x = np.concatenate([u + 0.01 * rng.normal(size=(150, 64)), other + 0.01 * rng.normal(size=(150, 64))])
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    assert want.min() > 150
    monkeypatch.setattr(E, "PER_CELL", 150)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in E.near_duplicate_vectors(df).collect()}
    assert [got[i].n_links for i in range(300)] == want.tolist()
    assert [i for i in got if got[i].kept] == [0]


def test_what_travels_follows_the_vectors_not_the_cells(spark, monkeypatch):
    """Vectors without structure are guests of most cells; cells of a hundredth of the rows may not multiply what is shuffled."""
    from cohortlens.llm import embedding_dedup as E

    rng = np.random.default_rng(8)
    x = rng.normal(size=(3_000, 32)).astype(np.float32)
    x[2_900:] = x[:100] + 0.1 * x[100:200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")

    def shuffled():
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    monkeypatch.setattr(E, "PER_CELL", 30)
    before = shuffled()
    got = E.near_duplicate_vectors(df).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == brute_links(rows)
    assert shuffled() - before < 6 * x.nbytes


def test_nearest_recall(spark, vectors, monkeypatch):
    from cohortlens.llm import nearest as N
    from pyspark.sql import functions as F

    rows, df = vectors
    monkeypatch.setattr(N, "ROWS", 150)
    got = defaultdict(list)
    for r in N.nearest_neighbours(df, df.where(F.col("vec_id") % 20 == 0)).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    use = [(r[0], np.array(r[1])) for r in rows if r[0] is not None and good(r[1]) and len(r[1]) == 16]
    hit = n = 0
    for q, v in use:
        if q % 20 == 0:
            want = sorted(((-float((v * x).sum()), i) for i, x in use if i != q))[:20]
            found = sorted(got[q])
            assert [f[0] for f in found] == list(range(1, 21)) and [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
            hit += len({i for _, i in want} & {f[1] for f in found})
            n += 20
    assert n and hit / n >= 0.9
    assert N.nearest_neighbours(df.limit(0), df.limit(0)).collect() == []
    few = df.where("vec_id < 3")
    assert len(N.nearest_neighbours(few, few).collect()) == 6


def test_nearest_repeats_ties_and_recall(spark, monkeypatch):
    """64 dimensions, several blocks of rows and queries: repeated query rows, equal candidates, null ids."""
    from cohortlens.llm import nearest as N
    from pyspark.sql import functions as F

    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 64))
    x[40:70] = x[3]
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[20].tolist())] * 2 + [(None, x[5].tolist())]
    monkeypatch.setattr(N, "ROWS", 400)
    monkeypatch.setattr(N, "QUERIES", 30)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in N.nearest_neighbours(df, df.where(F.col("vec_id") % 20 == 0)).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(1500), -np.round(s, 12))) if i != q][:20]
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 21)) and len({f[1] for f in found}) >= 18
        assert all(f[2] == pytest.approx(s[f[1]], abs=1e-12) for f in found) and found == sorted(found, key=lambda f: (-f[2], f[1]))
        hit += len(set(want) & {f[1] for f in found})
    assert len(got) == 75 and hit / (75 * 20) >= 0.9
    # of equal vectors those with the smallest ids
    assert [f[1] for f in sorted(got[40])] == [3, *range(41, 60)]


def test_chi_square_quantile():
    from cohortlens.llm.nearest import chi_square_quantile

    assert chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


# ---- pipeline ----


def test_pipeline(spark, docs, rows, empty, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(pipeline.STAGES)
    one = stage["language_id"](spark, docs, str(tmp_path))
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    assert not kept & {400, 401, 402, 405} and kept >= set(range(150))
    two = stage["ngram_jaccard_join"](spark, docs, str(tmp_path))
    ids = Counter(r.doc_id for r in two.collect())
    assert two.columns == docs.columns and max(ids.values()) == 1
    group = components_of([shingle_set(r[1]) for r in rows])
    least = {}
    for r, g in zip(rows, group):
        least[g] = min(least.get(g, r[0]), r[0]) if r[0] is not None and g in least else (r[0] if r[0] is not None else least.get(g))
    assert {i for i in ids if i is not None} == {v for v in least.values() if v is not None}
    three = stage["mix_sources"](spark, docs, str(tmp_path))
    assert three.columns == docs.columns and Counter(r.doc_id for r in three.collect()) == Counter(r[0] for r in rows)
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= kept
    for _, f in pipeline.STAGES:
        assert f(spark, empty, str(tmp_path)).collect() == []


def test_bins_follow_the_mix(spark, tmp_path, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    from cohortlens.llm import packing

    monkeypatch.setattr(packing, "SHARD", 60)
    sizes = {"a": 600, "b": 200, "c": 100}
    rows = [(i, f"text {i}", "en", s, 0) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    stage = dict(pipeline.STAGES)
    stage["mix_sources"](spark, spark.createDataFrame(rows, DOCS), "").write.parquet(f"{tmp_path}/mixed")
    out = stage["pack"](spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()
    assert sorted(r.doc_id for r in out) == list(range(900))
    total, seen, n = sum(v**0.5 for v in sizes.values()), Counter(), 0
    for shard in sorted({r.pack_id >> 32 for r in out}):
        part = [r.source for r in out if r.pack_id >> 32 == shard]
        seen.update(part)
        n += len(part)
        if n <= 450:  # all sources last
            # a block, and the part of the one that is begun
            assert all(abs(seen[s] - n * v**0.5 / total) < 32 for s, v in sizes.items())
    assert n == 900


def test_default_weights_of_very_many_sources_keep_the_period_short(spark):
    from pyspark.sql import functions as F

    from cohortlens.llm import mixing as M

    # the n-th source has some 1 to 40 documents
    docs = spark.range(20_000).select(F.concat(F.lit("s"), "id").alias("source"), F.explode(F.sequence(F.lit(1), F.lit(1) + F.col("id") % 40)).alias("k")).select("source", F.concat("source", F.lit("-"), "k").alias("doc_id"))
    w = M.temperature_weights(docs)
    total, n, kinds = w.agg(F.sum("weight"), F.count("*"), F.count_distinct("weight")).first()
    assert n == 20_000 and total <= M.DEFAULT_PERIOD and kinds > 3
    mixed = M.mix_sources(docs, keep=["doc_id"])
    assert mixed.count() == docs.count() == mixed.select("position").distinct().count()
