"""Statistics as Column expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The 97.5 % point of the normal distribution.
Z95 = 1.959963984540054


def effect_sizes(a: Column, b: Column, c: Column, d: Column, z: float = Z95) -> dict[str, Column]:
    """Of a 2x2 table (cluster yes, cluster no, rest yes, rest no): shares, ratio to the whole split, odds ratio, intervals.

    One half is added to every cell. The ratio is that of the cluster to the whole split. An empty cluster or split gives nulls (STT-01).
    """
    ok = (a + b > 0) & (a + b + c + d > 0)
    x, y, u, v = (k + 0.5 for k in (a, b, c, d))
    n = x + y + u + v
    rr, odds = (x / (x + y)) / ((x + u) / n), (x * v) / (y * u)
    se_rr = F.sqrt(1 / x - 1 / (x + y) + 1 / (x + u) - 1 / n)
    se_or = F.sqrt(1 / x + 1 / y + 1 / u + 1 / v)
    # the denominators are kept from zero where the row has no result anyway
    safe = lambda t: F.when(t > 0, t)
    out = {
        "share_cluster": a / safe(a + b),
        "share_split": (a + c) / safe(a + b + c + d),
        "rr": rr,
        "rr_low": F.exp(F.log(rr) - z * se_rr),
        "rr_high": F.exp(F.log(rr) + z * se_rr),
        "odds_ratio": odds,
        "or_low": F.exp(F.log(odds) - z * se_or),
        "or_high": F.exp(F.log(odds) + z * se_or),
    }
    return {k: F.when(ok, e) for k, e in out.items()}


def odds_ratio_on_zero(a: Column, b: Column, c: Column, d: Column, z: float = 1.96) -> dict[str, Column]:
    """Odds ratio with one half added only where a cell is zero (STT-02)."""
    zero = (a == 0) | (b == 0) | (c == 0) | (d == 0)
    x, y, u, v = (F.when(zero, k + 0.5).otherwise(k * 1.0) for k in (a, b, c, d))
    odds = (x * v) / (y * u)
    se = F.sqrt(1 / x + 1 / y + 1 / u + 1 / v)
    return {"odds_ratio": odds, "or_low": F.exp(F.log(odds) - z * se), "or_high": F.exp(F.log(odds) + z * se)}


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval within [0, 1]; null for n <= 0 (STT-03)."""
    m = F.when(n > 0, n * 1.0)
    p = k / m
    mid = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z / (1 + z * z / m) * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def permutation_p(at_least: Column, draws: Column) -> Column:
    return (1 + at_least) / (1 + draws)


def cohen_kappa(n11: Column, n10: Column, n01: Column, n00: Column) -> dict[str, Column]:
    """n, kappa, agreement and positive rates; nulls where nothing is rated, kappa null at pe = 1 (STT-12)."""
    n = n11 + n10 + n01 + n00
    m = F.when(n > 0, n * 1.0)
    po, r1, r2 = (n11 + n00) / m, (n11 + n10) / m, (n11 + n01) / m
    pe = r1 * r2 + (1 - r1) * (1 - r2)
    return {"n_pairs": n, "kappa": F.when(pe < 1, (po - pe) / F.when(pe < 1, 1 - pe)), "agreement": po, "r1_positive_rate": r1, "r2_positive_rate": r2}


def jaccard(both: Column, either: Column, empty: float = 1.0) -> Column:
    return F.when(either > 0, both / F.when(either > 0, either)).otherwise(F.lit(empty))


def pairs(n: Column) -> Column:
    return n * (n - 1) / 2
