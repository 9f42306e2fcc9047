"""Exact order statistics of groups of any size, without holding a group's rows in one place.

A sketch brackets each wanted place; one aggregate then counts what lies between brackets and, value by value, what lies inside
them. Running counts over these few cells give the exact value at every wanted place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Ranks that the sketch may miss, as a share of the group: its memory grows with the inverse, the rows inside brackets with the share.
ACCURACY = 10_000


def _same(a: DataFrame, b: DataFrame, group: Sequence[str]) -> Column:
    out = F.lit(True)
    for g in group:
        out = out & a[g].eqNullSafe(b[f"_{g}"])
    return out


def values_at(df: DataFrame, group: Sequence[str], value: Column, shares: Sequence[float] = (), ranks: Column | None = None) -> DataFrame:
    """(group, n, cells): cells holds, for every wanted place, (rank from 0, the value there, rows below the value).

    Places are shares of the number of non-null values less one, both whole neighbours of each, or ``ranks``, an array of whole
    places as a column of the group and of ``_n``, its number. Groups without a value have null cells. Nulls in a group's key are keys.
    """
    x = value.cast("double")
    rows = df.select(*group, x.alias("_x"))
    n = rows.groupBy(*group).agg(F.count("_x").alias("_n"))
    place = lambda p: (F.lit(float(p)) * (F.col("_n") - 1))
    wanted = ranks if ranks is not None else F.array(*(f(place(p)).cast("long") for p in shares for f in (F.floor, F.ceil)))
    n = n.select(*(F.col(g).alias(f"_{g}") for g in group), "_n", F.when(F.col("_n") > 0, F.array_distinct(wanted)).alias("_ranks"))
    if ranks is None:
        about = [min(1.0, max(0.0, p + s * 4 / ACCURACY)) for p in shares for s in (-1, 1)]
        sketch = rows.groupBy(*group).agg(F.percentile_approx("_x", F.array(*map(F.lit, about)), F.lit(ACCURACY)).alias("_q")).select(*(F.col(g).alias(f"__{g}") for g in group), "_q")
        join = F.lit(True)
        for g in group:
            join = join & F.col(f"_{g}").eqNullSafe(F.col(f"__{g}"))
        pairs = F.array(*(F.struct(F.col("_q")[2 * i].alias("lo"), F.col("_q")[2 * i + 1].alias("hi")) for i in range(len(shares))))
        # small groups are counted value by value
        every = F.array(F.struct(F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")))
        n = n.join(sketch, join).select(*(f"_{g}" for g in group), "_n", "_ranks", F.when(F.col("_n") <= 2 * ACCURACY, every).otherwise(pairs).alias("_b"))
    else:
        # values are uniform on 0 to 1: a place lies within eight standard deviations of its share
        at = lambda r: (r + 0.5) / F.col("_n")
        wide = lambda r: 8 * F.sqrt(at(r) * F.greatest(1 - at(r), F.lit(0.0)) / F.col("_n")) + 40 / F.col("_n")
        n = n.withColumn("_b", F.transform("_ranks", lambda r: F.struct((at(r) - wide(r)).alias("lo"), (at(r) + wide(r)).alias("hi"))))
    near = rows.where("_x IS NOT NULL").join(n, _same(rows, n, group))
    # not a number sorts after all numbers, and is a value
    inside = F.exists("_b", lambda b: (F.col("_x") >= b["lo"]) & ((F.col("_x") <= b["hi"]) | (b["hi"] == float("inf"))))
    # what is outside falls between the same brackets, above as many of them
    gap = F.size(F.filter("_b", lambda b: F.col("_x") > b["hi"]))
    cells = near.select(*group, "_ranks", "_x", inside.alias("_in"), F.when(~inside, gap).alias("_gap"), F.when(inside, F.col("_x")).alias("_at"))
    cells = cells.groupBy(*group, "_in", "_gap", "_at").agg(F.count("*").alias("_c"), F.min("_x").alias("_m"), F.first("_ranks").alias("_ranks"))
    order = W.partitionBy(*(group or [F.lit(1)])).orderBy("_m")
    below = F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")
    hit = F.filter("_ranks", lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_c")))
    found = cells.withColumn("_below", below).select(*group, "_in", "_m", "_below", F.explode(hit).alias("_r"))
    found = found.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col("_r").alias("rank"), F.col("_m").alias("value"), F.col("_below").alias("below"), "_in"))).alias("cells"))
    named = n.select(*(f"_{g}" for g in group), "_n")
    out = named.join(found, _same(found, named, group), "left").select(*(F.col(f"_{g}").alias(g) for g in group), F.col("_n").alias("n"), "cells")
    # a bracket that misses its place would be the sketch's error, not a result
    sound = F.forall("cells", lambda c: c["_in"])
    return out.withColumn("cells", F.when(F.col("cells").isNull() | sound, F.col("cells")).otherwise(F.raise_error(F.lit("a bracket misses its place"))))


def quantiles(df: DataFrame, group: Sequence[str], value: Column, shares: Sequence[float]) -> DataFrame:
    """(group, q): exact quantiles, interpolated between neighbours; null elements for groups without a value."""
    found = values_at(df, group, value, shares)

    def one(p: float) -> Column:
        at = F.lit(float(p)) * (F.col("n") - 1)
        pick = lambda r: F.filter("cells", lambda c: c["rank"] == r.cast("long"))[0]["value"]
        low, high = pick(F.floor(at)), pick(F.ceil(at))
        return F.when(F.col("n") > 0, F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at))))

    return found.select(*group, F.array(*(one(p) for p in shares)).alias("q"))
