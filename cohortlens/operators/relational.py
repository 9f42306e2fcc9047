"""Relational operators of the cohort engine: keys, windows, joins, cohort tables.

Every ordering ends in a unique key, so that results don't depend on partitioning. Windows are partitioned by a key
of bounded groups; whole-table orderings are used on small summary tables only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .selection import quantiles
from ..functions import stats


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every key by ``order`` (AGG-11): a partial aggregate, so a hot key is combined before the shuffle."""
    return _edge_per_key(df, key, order, F.max_by)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _edge_per_key(df, key, order, F.min_by)


def _edge_per_key(df, key, order, pick):
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    best = df.groupBy(*key).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*key, "_r.*").select(*df.columns)


def first_non_null(df: DataFrame, key: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """First non-null value of each column by ``order`` (AGG-13)."""
    return df.groupBy(*key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def ordered_text(df: DataFrame, key: Sequence[str], order: str, text: str, sep: str = "\n") -> DataFrame:
    """Texts of a key joined in order (AGG-14)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*key).agg(F.array_join(F.transform(rows, lambda r: r["t"]), sep).alias(text))


def ordered_distinct(df: DataFrame, key: Sequence[str], order: str, value: str) -> DataFrame:
    """Distinct values of a key in order of first occurrence (AGG-15)."""
    first = df.groupBy(*key, value).agg(F.min(order).alias("_o"))
    rows = F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("v"))))
    return first.groupBy(*key).agg(F.transform(rows, lambda r: r["v"]).alias(value))


def prefix_cap(df: DataFrame, key: Sequence[str], order: Sequence[str], size: str, most_rows: int, most_size: int) -> DataFrame:
    """Rows in order while number and running size stay within the caps; the first row always stays (WIN-02)."""
    w = W.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("_n", F.row_number().over(w)).withColumn("_sum", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.where((F.col("_n") == 1) | ((F.col("_n") <= most_rows) & (F.col("_sum") <= most_size))).drop("_n", "_sum")


def first_rows(df: DataFrame, key: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """First n rows of every key (WIN-05); the group limit runs before the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def duplicate_suffix(df: DataFrame, name: str, order: Sequence[str], out: str = "unique_name") -> DataFrame:
    """name, name__dup1, name__dup2 ... in order (WIN-04)."""
    k = F.row_number().over(W.partitionBy(name).orderBy(*order)) - 1
    return df.withColumn("_k", k).withColumn(out, F.when(F.col("_k") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("__dup"), F.col("_k").cast("string")))).drop("_k")


def running_total(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Running total over a small ordered table (WIN-01)."""
    return df.withColumn(out, F.sum(value).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)))


def bh_fdr(df: DataFrame, p: str, tie: str, group: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg: q and reject within each group (WIN-07, STT-07). Fails where a p is null, not a number or outside [0, 1]."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    sound = F.when(F.col(p).cast("double").between(0.0, 1.0), F.col(p)).otherwise(F.raise_error(F.lit(f"{p} must be a number in [0, 1]")).cast(dict(df.dtypes)[p]))
    df = df.withColumn(p, sound)
    m = F.count(F.lit(1)).over(W.partitionBy(*group))
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(p, tie))).withColumn("_q", F.col(p) * m / F.col("_r"))
    down = W.partitionBy(*group).orderBy("_r").rowsBetween(W.currentRow, W.unboundedFollowing)
    q = F.least(F.lit(1.0), F.min("_q").over(down))
    return ranked.withColumn("q", q).withColumn("reject", F.col("q") <= alpha).drop("_r", "_q")


def share_of_parent(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Counts by group and value (nulls kept) with their share of the group (AGG-07)."""
    n = df.groupBy(*group, value).agg(F.count("*").alias("n_cases"))
    total = F.sum("n_cases").over(W.partitionBy(*group))
    return n.withColumn("cluster_n", total).withColumn("prop_within_cluster", F.col("n_cases") / total)


def _with_quantiles(summary: DataFrame, df: DataFrame, group: Sequence[str], x: Column, shares: dict[str, float]) -> DataFrame:
    q = quantiles(df, group, x, list(shares.values())).select(*(F.col(g).alias(f"_{g}") for g in group), "q")
    same = F.lit(True)
    for g in group:
        same = same & summary[g].eqNullSafe(q[f"_{g}"])
    return summary.join(q, same).select(*summary.columns, *(F.col("q")[i].alias(name) for i, name in enumerate(shares)))


def numeric_summary(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """n, non-null, mean, sample sd and exact quartiles (AGG-09). No group is held in one place, however large."""
    x = F.col(value).cast("double")
    base = df.groupBy(*group).agg(F.count("*").alias("n_cases"), F.count(x).alias("n_nonmissing"), F.avg(x).alias("mean"), F.when(F.count(x) > 1, F.stddev_samp(x)).alias("sd"))
    return _with_quantiles(base, df, group, x, {"median": 0.5, "p25": 0.25, "p75": 0.75})


def quantile_summary(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Median, tenth and ninetieth percentile, extremes (AGG-10), exact for groups of any size."""
    x = F.col(value).cast("double")
    base = df.groupBy(*group).agg(F.min(x).alias("min"), F.max(x).alias("max"))
    return _with_quantiles(base, df, group, x, {"median": 0.5, "p10": 0.1, "p90": 0.9}).select(*group, "median", "p10", "p90", "min", "max")


def two_by_two(df: DataFrame, group: Sequence[str], cluster: str, positive: Column) -> DataFrame:
    """Cells a, b (cluster), c, d (rest of the group) for every cluster (AGG-21): one aggregate, then a window over its few rows."""
    yes = positive.cast("long")
    per = df.groupBy(*group, cluster).agg(F.coalesce(F.sum(yes), F.lit(0)).alias("a"), F.count(yes).alias("_n"))
    w = W.partitionBy(*group)
    per = per.withColumn("b", F.col("_n") - F.col("a"))
    return per.withColumn("c", F.sum("a").over(w) - F.col("a")).withColumn("d", F.sum("b").over(w) - F.col("b")).drop("_n")


def enrichment(df: DataFrame, group: Sequence[str], cluster: str, positive: Column) -> DataFrame:
    """two_by_two with shares, ratios and intervals."""
    t = two_by_two(df, group, cluster, positive)
    e = stats.effect_sizes(*(F.col(k) for k in "abcd"))
    return t.select(*t.columns, *(v.alias(k) for k, v in e.items()))


def top_cluster(df: DataFrame, group: Sequence[str], cluster: str, positive: Column, tolerance: tuple[float, float] | None = None) -> DataFrame:
    """The cluster with the largest positive share, ties (exact, or within tolerance) to the smallest cluster (AGG-19, AGG-20)."""
    per = df.groupBy(*group, cluster).agg(F.avg(positive.cast("double")).alias("share"), F.count("*").alias("n_cases"))
    best = F.max("share").over(W.partitionBy(*group))
    near = F.col("share") >= best - (tolerance[0] + tolerance[1] * F.abs(best)) if tolerance else F.col("share") == best
    return first_rows(per.withColumn("_near", near).where("_near").drop("_near"), group, [cluster], 1)


def split_and_pooled(df: DataFrame, split: str, cluster: str, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates by split and cluster, and pooled over splits as 'pooled' (AGG-22)."""
    g = df.groupingSets([[split, cluster], [cluster]], split, cluster).agg(F.grouping(split).alias("_g"), *aggregates)
    return g.withColumn(split, F.when(F.col("_g") == 1, "pooled").otherwise(F.col(split))).drop("_g")


def skeleton_counts(df: DataFrame, group: Sequence[str], value: str, values: Sequence[str]) -> DataFrame:
    """Counts for every listed value of every group, zeros included (JN-13, AGG-23, AGG-29)."""
    n = df.groupBy(*group).agg(F.count("*").alias("n_cases"), *(F.count_if(F.col(value) == v).alias(f"_{i}") for i, v in enumerate(values)))
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(f"_{i}").alias("value_n")) for i, v in enumerate(values))))
    return n.select(*group, "n_cases", rows.alias("x")).select(*group, "n_cases", "x.value", "x.value_n").withColumn("value_prop", F.col("value_n") / F.col("n_cases"))


def array_skeleton_counts(df: DataFrame, group: Sequence[str], value: str, values: Sequence[str]) -> DataFrame:
    """As skeleton_counts, for a column of arrays."""
    n = df.groupBy(*group).agg(F.count("*").alias("n_cases"), *(F.count_if(F.coalesce(F.array_contains(value, v), F.lit(False))).alias(f"_{i}") for i, v in enumerate(values)))
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(f"_{i}").alias("value_n")) for i, v in enumerate(values))))
    return n.select(*group, "n_cases", rows.alias("x")).select(*group, "n_cases", "x.value", "x.value_n").withColumn("value_prop", F.col("value_n") / F.col("n_cases"))


def tag_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("tag__") and c.endswith("__status")]


def tag_summary(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Status counts of every tag column by group (AGG-06, SET-06)."""
    tags = tag_columns(df)
    long = df.select(*group, *tags).unpivot(list(group), tags, "column", "status").withColumn("tag", F.split_part("column", F.lit("__"), F.lit(2)))
    count = lambda s: F.count_if(F.col("status") == s)
    return long.groupBy(*group, "tag").agg(F.count("*").alias("n_cases"), count("present").alias("present_n"), F.avg((F.coalesce("status", F.lit("")) == "present").cast("double")).alias("present_prop"), count("explicitly_absent").alias("explicitly_absent_n"), count("uncertain").alias("uncertain_n"), count("not_reported").alias("not_reported_n"))


def characterization(df: DataFrame, split: str, cluster: str, families: dict[str, Sequence[str]]) -> DataFrame:
    """Every family's values by split and cluster: counts, shares, share of the split, ratio and odds ratio (scalar or array columns)."""
    kinds, out = dict(df.dtypes), None
    for family, values in families.items():
        count = array_skeleton_counts if kinds[family].startswith("array") else skeleton_counts
        rows = count(df, [split, cluster], family, values).withColumn("family", F.lit(family))
        out = rows if out is None else out.unionByName(rows)
    w = W.partitionBy(split, "family", "value")
    a, n = F.col("value_n"), F.col("n_cases")
    out = out.withColumn("_c", F.sum("value_n").over(w) - a).withColumn("_d", F.sum(n - a).over(w) - (n - a))
    e = stats.effect_sizes(a, n - a, F.col("_c"), F.col("_d"))
    return out.select(split, cluster, "family", "value", "n_cases", "value_n", "value_prop", e["share_split"].alias("value_prop_split"), e["rr"].alias("rr_vs_split"), e["odds_ratio"].alias("or_vs_rest"))


def flow_table(steps: Sequence[tuple[str, DataFrame]], key: Sequence[str], split: str) -> DataFrame:
    """Distinct keys in total and by split after every step (AGG-04, AGG-05)."""
    k = F.struct(*key)
    rows = [df.agg(F.count_distinct(k).alias("n_total"), F.count_distinct(F.when(F.col(split) == "discovery", k)).alias("n_discovery"), F.count_distinct(F.when(F.col(split) == "confirmation", k)).alias("n_confirmation")).select(F.lit(i).alias("step_no"), F.lit(name).alias("step"), "n_total", "n_discovery", "n_confirmation") for i, (name, df) in enumerate(steps)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def pending(keys: DataFrame, log: DataFrame, key: Sequence[str], order: Sequence[str], status: str, terminal: Sequence[str], retry_errors: bool = True) -> DataFrame:
    """Keys whose latest status is not terminal (JN-09, STM-03); without ``retry_errors``, keys with any status are done."""
    latest = latest_per_key(log, key, order)
    done = (latest.where(F.col(status).isin(*terminal)) if retry_errors else latest).select(*key)
    return keys.join(done, list(key), "left_anti")


def apply_overrides(base: DataFrame, overrides: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sparse overrides onto base columns, with their source (JN-03)."""
    o = overrides.select(*key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_hit"))
    j = base.join(o, list(key), "left")
    return j.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns), F.when(F.col("_hit"), "override").otherwise("base").alias("label_source"))


def lookup_rows(lists: DataFrame, key: Sequence[str], ids: str, rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """Texts of listed ids in list order (JN-08)."""
    e = lists.select(*key, F.posexplode(ids).alias("_p", id_col))
    return ordered_text(e.join(rows.select(id_col, text), id_col), key, "_p", text)


def first_use_wins(segments: DataFrame, scope: str, blocks: str, priority: Sequence) -> DataFrame:
    """A block stays with the first segment of its scope by priority; segments left empty go (WIN-09)."""
    rest = [c for c in segments.columns if c != blocks]
    e = segments.withColumn("_s", F.struct(*rest)).select("_s", *rest, F.posexplode(blocks).alias("_p", "_b"))
    kept = first_rows(e, [scope, "_b"], [*priority, "_p"], 1)
    rows = F.array_sort(F.collect_list(F.struct("_p", "_b")))
    return kept.groupBy("_s").agg(F.transform(rows, lambda r: r["_b"]).alias(blocks)).select("_s.*", blocks)


def reorder_by(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Sorted by an explicit order, unknown values last (TOP-05)."""
    place = F.nullif(F.array_position(F.lit(list(order)), F.col(column)), F.lit(0))
    return df.orderBy(place.asc_nulls_last(), column)


def restrict_to(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Only the listed values, in their order, where the table holds all of them; else the table as it is (TOP-07)."""
    found = df.agg(F.count_distinct(F.when(F.col(column).isin(*order), F.col(column))).alias("n")).scalar()
    place = F.nullif(F.array_position(F.lit(list(order)), F.col(column)), F.lit(0))
    return df.where(place.isNotNull() | (found < len(set(order)))).orderBy(place.asc_nulls_last(), column)


def direction_summary(results: DataFrame, run: str, rr: str, q: str) -> DataFrame:
    """Of every run, the number of ratios above one and the smallest q (AGG-25)."""
    return results.groupBy(run).agg(F.count_if(F.col(rr) > 1).alias("n_rr_above_1"), F.count(rr).alias("n_rr"), F.min(q).alias("min_q"))


def rates(df: DataFrame, group: Sequence[str], flag: Column, name: str = "rate") -> DataFrame:
    """Share of true among non-null flags by group, 0 where there is none (AGG-28)."""
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.coalesce(F.avg(flag.cast("double")), F.lit(0.0)).alias(name))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of every combination, nulls kept (AGG-01, AGG-08)."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def error_counts(log: DataFrame, error: str, type_of) -> DataFrame:
    """Errors by type, the most frequent first (AGG-27)."""
    return log.where(F.col(error).isNotNull()).groupBy(type_of(F.col(error)).alias("error_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type")


def left_counts(keys: DataFrame, rows: DataFrame, key: Sequence[str], out: str = "n") -> DataFrame:
    """Every key with the number of its rows, zeros included (JN-02)."""
    n = rows.groupBy(*key).agg(F.count("*").alias(out))
    return keys.join(n, list(key), "left").withColumn(out, F.coalesce(out, F.lit(0)))


def map_values(df: DataFrame, column: str, known: DataFrame, key: str, value: str, out: str, default: str | None = None) -> DataFrame:
    """A column looked up in a table by key (JN-06); repeated keys count once, the smallest value wins, and unknown ones get the default."""
    k = known.groupBy(F.col(key).alias("_k")).agg(F.min(value).alias(out))
    j = df.join(k, df[column] == F.col("_k"), "left").drop("_k")
    return j.withColumn(out, F.coalesce(out, F.lit(default))) if default is not None else j


def pivot_counts(df: DataFrame, rows: Sequence[str], column: str, values: Sequence) -> DataFrame:
    """Counts with one column per listed value, zeros included (AGG-24)."""
    return df.groupBy(*rows).agg(*(F.count_if(F.col(column).eqNullSafe(F.lit(v))).alias(str(v)) for v in values))


def union_tagged(parts: dict[str, DataFrame], out: str = "origin") -> DataFrame:
    """Rows of all parts under their names; columns that a part lacks are null (SET-01, SET-02)."""
    got = None
    for name, df in parts.items():
        one = df.withColumn(out, F.lit(name))
        got = one if got is None else got.unionByName(one, allowMissingColumns=True)
    return got


def case_number(c: Column, unknown: int = 10_000) -> Column:
    """Number at the end of a case id, unknown last (TOP-06)."""
    return F.coalesce(F.regexp_extract(c, r"(\d+)$", 1).try_cast("int"), F.lit(unknown))
