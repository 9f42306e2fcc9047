"""Mixing sources to target weights by Pfair scheduling. Native throughout.

Sources are dealt in blocks of ``block_rows`` documents. Target weights w are whole numbers; W is their total. Block j (from
1) of a source is released at slot floor((j - 1) W / w) and due by ceil(j W / w), with no rounding of the weights; in every slot
the released block with the earliest deadline is taken (ties to the larger weight, then to the source that sorts first). That meets every deadline, so
after any number of slots each source has had its weight's share to within less than one block. The schedule repeats after W slots (over the weights'
greatest common divisor), so one period of it is all there is to simulate, and every document's position follows from its rank in its source.

Sources of the same weight have the same windows and take turns, so the simulation runs over the distinct weights, in one
expression; it holds one number per weight and the period's picks. A period of more than ``MOST_PERIOD`` slots is refused with an error: give such weights in coarser units. The default weights do that by themselves, so only more than ``MOST_PERIOD`` sources are refused.

Ranks need no single task for a hot source: documents are ordered by the MD5 of their id, ``4096`` ranges of it
are counted, and ranks are the range's offset plus the row number within it.

All rows are kept. When a source runs out, the others go on in their order; ``on_target`` is true up to there. A source of
weight 0 or less, or without a weight, is never scheduled: its rows follow after all others, source by source. A null
source counts as the source ''; weights of equal names are added. Null ids and repeated rows are ranked like others, ties by the whole row. Where
no row has a scheduled source, no row is on target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from . import common as C

BLOCK_ROWS = 16
#: Slots of a period; one long integer each travels with the plan.
MOST_PERIOD = 1 << 20
#: Slots of a period with the default weights, as long as there are fewer sources than that.
DEFAULT_PERIOD = 1 << 17
#: Hex digits of the hash ranges within which rows are numbered.
DIGITS = 3
#: Picks that are gathered before they are put away, so that no long array is copied at every slot.
_CHUNK = 256


def _name(c):
    return F.coalesce(c.cast("string"), F.lit(""))


def temperature_weights(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """(source, weight): the square root of a source's documents in hundredths of the largest one's, 1 at least: large sources are held down, small ones lifted. Where these come to more than ``DEFAULT_PERIOD``, in
    units so coarse that they don't; up to ``MOST_PERIOD`` sources then have a schedule."""
    return _tempered(docs.groupBy(_name(F.col(source_col)).alias("source")).agg(F.count("*").alias("n")))


def _tempered(n: DataFrame) -> DataFrame:
    share = n.select("source", F.sqrt(F.col("n") / n.agg(F.max("n")).scalar()).alias("x"))
    fine = F.greatest(F.lit(1.0), F.round(F.col("x") * 100))
    # with very many sources the units get coarser, so that the period keeps its bound
    all_ = share.agg(F.struct(F.sum(fine).alias("fine"), F.sum("x").alias("x"), F.count("*").alias("n")).alias("a")).scalar()
    coarse = F.greatest(F.lit(1.0), F.floor(F.col("x") * (F.greatest(F.lit(0), F.lit(DEFAULT_PERIOD) - F.col("_a.n")) / F.col("_a.x"))))
    return share.withColumn("_a", all_).select("source", F.when(F.col("_a.fine") <= DEFAULT_PERIOD, fine).otherwise(coarse).cast("long").alias("weight"))


def _computed(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, worked out once per row: a generator keeps the optimiser from copying their expressions into what follows."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def ranked_weights(weights: DataFrame) -> DataFrame:
    """(source, weight, class, member, members): scheduled sources by distinct weight, the largest first, and their turn within it."""
    w = weights.groupBy(_name(F.col("source")).alias("source")).agg(F.sum(F.greatest(F.col("weight").cast("long"), F.lit(0).cast("long"))).alias("weight")).where("weight > 0")
    classes = w.groupBy("weight").agg(F.count("*").alias("members"))
    # as many rows as there are distinct weights
    classes = classes.withColumn("class", (F.row_number().over(W.orderBy(F.desc("weight"))) - 1).cast("int"))
    return w.withColumn("member", F.row_number().over(W.partitionBy("weight").orderBy("source")) - 1).join(classes, "weight").select("source", "weight", "class", "member", "members")


def period(ranked: DataFrame) -> DataFrame:
    """One row (d, unit, slots): slots of a period, the weights' greatest common divisor, and of every class the slots of its picks in order.

    Pick q of a class is block q div members + 1 of its member q mod members.
    """
    per = ranked.groupBy("class").agg(F.first("weight").alias("w"), F.first("members").alias("m"))
    one = per.agg(F.array_sort(F.collect_list(F.struct("class", "w", "m"))).alias("s")).where("size(s) > 0")
    # Euclid's steps: never more than 92 for 64-bit integers
    one = one.withColumn("unit", F.expr("aggregate(s, 0L, (g, x) -> aggregate(sequence(1, 92), named_struct('a', g, 'b', x.w), (p, k) -> if(p.b = 0, p, named_struct('a', p.b, 'b', p.a % p.b)), p -> p.a))"))
    one = _computed(one, "s", "unit")
    one = one.withColumn("s", F.expr("transform(s, x -> named_struct('w', x.w div unit, 'm', x.m))")).withColumn("d", F.expr("aggregate(s, 0L, (a, x) -> a + x.w * x.m)"))
    one = one.withColumn("d", F.when(F.col("d") <= MOST_PERIOD, F.col("d")).otherwise(F.raise_error(F.lit(f"weights make a period of more than {MOST_PERIOD} slots")).cast("long")))
    one = _computed(one, "s", "unit", "d")
    pick = """
      array_min(transform(s, (x, i) -> if((a.done[i] div x.m) * d div x.w <= t AND a.done[i] < x.w * x.m,
        (((a.done[i] div x.m + 1) * d + x.w - 1) div x.w) * size(s) + i, NULL))) % size(s)"""
    step = f"""transform(array({pick}), p -> named_struct('done', transform(a.done, (v, i) -> if(i = p, v + 1, v)), 'out', concat(a.out, array(p))))[0]"""
    picked = one.withColumn(
        "picks",
        F.expr(
            f"""
            aggregate(sequence(0L, d - 1, {_CHUNK}L), named_struct('done', transform(s, x -> 0L), 'out', cast(array() AS array<array<bigint>>)),
              (b, u) -> transform(array(aggregate(sequence(u, least(u + {_CHUNK - 1}, d - 1)), named_struct('done', b.done, 'out', cast(array() AS array<bigint>)), (a, t) -> {step})),
                c -> named_struct('done', c.done, 'out', concat(b.out, array(c.out))))[0],
              b -> flatten(b.out))
            """
        ),
    )
    rows = picked.select("d", "unit", F.posexplode("picks").alias("slot", "class"))
    # as many rows as a period has slots
    per = rows.groupBy("d", "unit", "class").agg(F.array_sort(F.collect_list(F.col("slot").cast("long"))).alias("slots"))
    return per.groupBy("d", "unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "slots"))), lambda x: x["slots"]).alias("slots"))


def schedule(weights: DataFrame) -> DataFrame:
    """(slot, source, weight, turn, d) of one period; turns count a source's blocks from 0."""
    ranked = ranked_weights(weights)
    rows = period(ranked).select("d", F.posexplode("slots").alias("class", "slots")).select("d", "class", F.posexplode("slots").alias("q", "slot"))
    return rows.join(ranked, "class").where(F.expr("q % members = member")).select("slot", "source", "weight", F.expr("q div members").alias("turn"), "d")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, all by default) as ``row``, with mix_source, block, slot, position and on_target.

    ``weights`` has (source, weight), whole numbers; by default those of ``temperature_weights``.
    """
    kept = F.struct(*(docs[c] for c in (keep or docs.columns))).alias("row")
    source, h = _name(docs[source_col]), F.md5(_name(docs[id_col]))
    rows = docs.select(kept, docs[id_col].alias("_id"), source.alias("mix_source"), h.alias("_h")).withColumn("_range", F.substring("_h", 1, DIGITS))
    # written once: at most 4096 rows of a source
    counts = C.cut(docs.select(source.alias("mix_source"), F.substring(h, 1, DIGITS).alias("_range")).groupBy("mix_source", "_range").agg(F.count("*").alias("n")))
    before = W.partitionBy("mix_source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("mix_source", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))

    have = counts.groupBy("mix_source").agg(F.sum("n").alias("n"))
    ranked = ranked_weights(_tempered(have.select(F.col("mix_source").alias("source"), "n")) if weights is None else weights.select(_name(F.col("source")).alias("source"), "weight").join(have.select(F.col("mix_source").alias("source")), "source", "left_semi"))
    ranked = C.cut(ranked)
    plan = C.cut(period(ranked).select(F.struct("d", "unit", "slots").alias("p"))).scalar()

    def slot_of(block: str):
        """Of a scheduled source's block."""
        c = "(weight div _p.unit)"
        return F.expr(f"({block} div {c}) * _p.d + _p.slots[class][({block} % {c}) * members + member]")

    sources = have.join(ranked, have.mix_source == ranked.source, "left").drop("source").withColumn("_p", plan)
    sources = sources.withColumn("_last", slot_of(f"((n - 1) div {block_rows})")).withColumn("_end", slot_of(f"(n div {block_rows})") * block_rows + F.expr(f"n % {block_rows}")).drop("_p")
    sources = C.cut(sources)
    # slots after the schedule's last, and where the first missing document would stand
    ends = sources.agg(F.struct((F.coalesce(F.max("_last"), F.lit(-1)) + 1).alias("slots"), F.min("_end").alias("first")).alias("e")).scalar()
    late = sources.where("weight IS NULL").select("mix_source", F.coalesce(F.sum(F.expr(f"(n + {block_rows - 1}) div {block_rows}")).over(W.orderBy("mix_source").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_late"))
    known = sources.select("mix_source", "weight", "class", "member", "members").join(late, "mix_source", "left")

    rank = F.row_number().over(W.partitionBy("mix_source", "_range").orderBy("_h", "_id", F.xxhash64("row"))) - 1
    placed = rows.join(offsets.join(known, "mix_source"), ["mix_source", "_range"]).withColumn("rank", F.col("_offset") + rank)
    placed = placed.withColumn("_p", plan).withColumn("_e", ends).withColumn("block", F.expr(f"rank div {block_rows}"))
    placed = placed.withColumn("slot", F.when(F.col("weight").isNull(), F.expr("_e.slots + _late + block")).otherwise(slot_of("block"))).withColumn("position", F.expr(f"slot * {block_rows} + rank % {block_rows}"))
    return placed.select("row", "mix_source", "block", "slot", "position", F.expr("weight IS NOT NULL AND position < _e.first").alias("on_target"))
