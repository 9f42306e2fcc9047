"""What the vector operators share: valid vectors, packing into Arrow, groups of equal vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows whose vector is not null, not empty, not zero and has finite components only."""
    v = F.col(vector_col).cast("array<double>")
    big = F.lit(float("inf"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (x < big) & (x > -big), F.lit(False)))
    some = F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & finite & some)


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal length as a matrix of doubles."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that large components don't overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
