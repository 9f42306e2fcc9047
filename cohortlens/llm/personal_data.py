"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

**Base.** Four expressions find emails, addresses, cards and telephone numbers; those that pass their check are spans and, as instances
of their kind, the seeds. Texts are read once: each expression gives its matches and the gaps between them, so places are
running sums of lengths, taken over rows of matches and not over texts.

**Bootstrapping.** Words that look like identifiers (an @ or four digits) and overlap no base span are candidates.
Around every seed and candidate stand lexical patterns: two words before, one before and one after, one before, two after. The
graph of patterns and distinct instances is scored in rounds: a pattern's confidence for a kind is the lower end of Wilson's
interval of the share of its instances that belong to the kind; a candidate's score is the probability that not
all of its confident patterns err, and counts as that much of an instance in the next round. Rounds end when no pattern
joins the confident ones, or after ``ROUNDS``. A candidate becomes a span where its own context holds a confident pattern
and its shape is possible for the kind; the same word elsewhere doesn't. Copies of a document add nothing to a confidence, since an instance counts once with a pattern.

Null and empty texts have no span. Rows are judged one by one, so rows that repeat an id, equal or not, and null ids each have a row of their own. Ties between kinds go
to the one listed first. Texts of any length are read whole, in time linear in their length. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import common as C

#: The kinds and their expressions, fixed by the contract. Written without backtracking: a match starts at the first character of
#: its run, or where the match before ended, since a later start in a run fails as the first does.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without one of these have no match.
NEEDS = {"email": "@", "phone": "+"}
#: Identifier-like words: an @ or four digits.
WORD = r"(?<!\S)(?:[^\s@0-9]*+[0-9]){0,3}+[^\s@0-9]*+[@0-9]\S*+"
#: What a candidate must hold to be of a kind.
SHAPES = {"email": "@.*[A-Za-z]|[A-Za-z].*@", "ip": r"[0-9]+[.:]+[0-9a-fA-F]", "card": "(?:[0-9][^0-9]*){8}", "phone": "(?:[0-9][^0-9]*){5}"}
#: Characters of context on each side, least confidence, normal quantile of the interval, most rounds.
CONTEXT, CONFIDENT, Z, ROUNDS = 48, 0.8, 1.96, 3


def _found(text: Column, pattern: str, needs: str | None) -> Column:
    """Matches of a text with the gap before each (its length, start and end); last the gap after all, without a match. Null where there is none."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).cast("long").alias("size"), F.left(g, F.lit(CONTEXT)).alias("head"), F.right(g, F.lit(CONTEXT)).alias("tail")))
    pairs = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    there = text.rlike(pattern) if needs is None else text.contains(needs)
    return F.when(there, pairs)


def _luhn(digits: Column) -> Column:
    """Luhn's check; from the right, every second digit doubled, digits of products summed."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]+", "")
    n = F.length(digits)
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(kind == "ip", hit.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def _mentions(found: DataFrame) -> DataFrame:
    """A row for each match: _row, kind (``word`` for words), start, end, hit, context before and after."""
    one = lambda k: found.where(F.col(k).isNotNull()).select("_row", F.lit(k).alias("kind"), F.posexplode(k).alias("i", "x"))
    rows = reduce(DataFrame.unionByName, [one(k) for k in (*KINDS, "word")]).select("_row", "kind", "i", "x.hit", "x.gap.*")
    order = W.partitionBy("_row", "kind").orderBy("i")
    size = F.coalesce(F.length("hit").cast("long"), F.lit(0))
    end = F.sum(F.col("size") + size).over(order.rowsBetween(W.unboundedPreceding, 0))
    placed = rows.repartition("_row").select("*", end.alias("end"), F.lead("head").over(order).alias("after")).where("hit IS NOT NULL")
    return placed.select("_row", "kind", (F.col("end") - size).alias("start"), "end", "hit", F.col("tail").alias("before"), "after")


def _trimmed(m: DataFrame) -> DataFrame:
    """Words without the marks around them."""
    word, marks = F.col("kind") == "word", r"^[^\p{L}\p{N}+@]*+"
    lead = F.when(word, F.length(F.regexp_extract("hit", marks, 0))).otherwise(0)
    trail = F.when(word, F.length(F.regexp_extract(F.reverse("hit"), marks, 0))).otherwise(0)
    cut = m.select("*", lead.alias("lead"), trail.alias("trail"))
    hit = F.expr("CASE WHEN kind = 'word' THEN substring(hit, lead + 1, length(hit) - lead - trail) ELSE hit END")
    return cut.select("_row", "kind", (F.col("start") + F.col("lead")).alias("start"), (F.col("end") - F.col("trail")).alias("end"), hit.alias("hit"), "before", "after").where("start < end")


def _split(mentions: DataFrame) -> DataFrame:
    """Base spans that pass their check, and words that overlap none of them."""
    base = (F.col("kind") != "word") & _valid(F.col("kind"), F.col("hit"))
    m = _trimmed(mentions.where((F.col("kind") == "word") | base))
    order = W.partitionBy("_row").orderBy("start", "end")
    past, next_ = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    base = F.col("kind") != "word"
    covered = (F.coalesce(F.max(F.when(base, F.col("end"))).over(past), F.lit(0)) > F.col("start")) | (F.coalesce(F.min(F.when(base, F.col("start"))).over(next_), F.col("end")) < F.col("end"))
    return m.select("*", covered.alias("covered")).where((F.col("kind") != "word") | ~F.col("covered")).drop("covered")


def _patterns() -> Column:
    """The lexical patterns of a mention: words lower-cased, the edge of a text as an empty word."""
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    b, a = words(F.col("before")), words(F.col("after"))
    left = lambda k: F.coalesce(F.try_element_at(b, F.lit(-k)), F.lit(""))
    right = lambda k: F.coalesce(F.try_element_at(a, F.lit(k)), F.lit(""))
    return F.array(F.concat_ws(" ", left(2), left(1), F.lit("_")), F.concat_ws(" ", left(1), F.lit("_"), right(1)), F.concat_ws(" ", left(1), F.lit("_")), F.concat_ws(" ", F.lit("_"), right(1), right(2)))


def _lower_end(p: Column, n: Column) -> Column:
    """Lower end of Wilson's interval of a share ``p`` of ``n``."""
    z = Z * Z
    return (p + z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)


def _best(scores: dict[str, Column], name: str) -> list[Column]:
    top = F.greatest(*scores.values())
    return [top.alias(name), F.coalesce(*(F.when(s == top, F.lit(k)) for k, s in scores.items())).alias("kind")]


def confident_patterns(mentions: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) after bootstrapping over the graph of ``mentions`` (kind, hit, pattern); null kind: a candidate."""
    graph = C.cut(mentions.groupBy("pattern", F.xxhash64(F.lower("hit")).alias("instance")).agg(F.max("kind").alias("seed")))
    known, before = None, -1
    for _ in range(ROUNDS):
        # every instance of a pattern counts in full, and for a kind as far as it is known to belong to it
        edges = graph if known is None else graph.join(known, "instance", "left")
        belongs = lambda k: F.when(F.col("seed") == k, 1.0).when(F.col("seed").isNotNull() | F.lit(known is None), 0.0)
        part = lambda k: F.sum(belongs(k) if known is None else belongs(k).when(F.col("kind") == k, F.col("score")).otherwise(0.0)) / F.count("*")
        scored = edges.groupBy("pattern").agg(F.count("*").alias("n"), *(part(k).alias(k) for k in KINDS))
        confident = scored.select("pattern", *_best({k: _lower_end(F.col(k), F.col("n")) for k in KINDS}, "confidence")).where(F.col("confidence") >= CONFIDENT)
        confident = C.cut(confident.select("pattern", "kind", "confidence"))
        size = confident.count()
        if size == before:
            break
        before = size
        # the probability that not all confident patterns of an instance err
        reached = graph.where("seed IS NULL").join(confident, "pattern").groupBy("instance").agg(*((1 - F.exp(F.sum(F.when(F.col("kind") == k, F.log1p(-F.col("confidence"))).otherwise(0.0)))).alias(k) for k in KINDS))
        known = C.cut(reached.select("instance", *_best({k: F.col(k) for k in KINDS}, "score")))
    return confident


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (_row, id_col) numbers the rows of ``docs``; spans has _row, kind, start, end, base.

    Both are written to the shared folder, so numbers are the same whoever reads them.
    """
    text = docs[text_col].cast("string")
    numbered = docs.select(docs[id_col], F.monotonically_increasing_id().alias("_row"), *(_found(text, p, NEEDS.get(k)).alias(k) for k, p in {**KINDS, "word": WORD}.items()))
    found = C.cut(numbered)
    mentions = C.cut(_split(_mentions(found)).select("*", _patterns().alias("patterns")))
    seen = mentions.select(F.when(F.col("kind") != "word", F.col("kind")).alias("kind"), "hit", F.explode("patterns").alias("pattern"))
    confident = confident_patterns(seen)
    candidates = mentions.where("kind = 'word'").select("_row", "start", "end", "hit", F.explode("patterns").alias("pattern"))
    fits = F.coalesce(*(F.when(F.col("kind") == k, F.col("hit").rlike(s)) for k, s in SHAPES.items()))
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, -i)))[F.col("kind")]
    judged = candidates.join(confident, "pattern").where(fits).groupBy("_row", "start", "end").agg(F.max_by("kind", F.struct("confidence", rank)).alias("kind"))
    spans = mentions.where("kind <> 'word'").select("_row", "kind", "start", "end", F.lit(True).alias("base")).unionByName(judged.withColumn("base", F.lit(False)))
    return found.select("_row", id_col), spans


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): base matches by kind, the hash of their places, and all places."""
    rows, spans = find_personal_data(docs, id_col, text_col)
    order = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))[F.col("kind")]
    by_row = spans.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), "start", "end", "kind", "base"))).alias("all"))
    joined = lambda xs: F.concat_ws(",", F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    full = rows.join(by_row, "_row", "left").select(id_col, F.coalesce("all", F.expr("array()").cast("array<struct<k:int,start:bigint,end:bigint,kind:string,base:boolean>>")).alias("all"))
    base = F.filter("all", lambda x: x["base"])
    count = lambda k: F.size(F.filter("all", lambda x: x["base"] & (x["kind"] == k))).cast("long")
    return full.select(id_col, *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), F.size(F.filter("all", lambda x: ~x["base"])).cast("long").alias("n_added"))
