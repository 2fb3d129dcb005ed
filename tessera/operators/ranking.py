"""The one place where scores are rounded and ties broken."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Sums of doubles differ in their last bits with the order of rows; equal scores must tie.
DIGITS = 9


def top_k(df: DataFrame, by: Sequence[str], k: int | None, score: str = "score", ids: Sequence[str] = ("doc_id",), tie: Column | None = None) -> DataFrame:
    """df with rank (from 1) by falling rounded score, then tie, then ids; the first k of each group (None: all; k <= 0: none)."""
    order = [F.desc(score), *([tie] if tie is not None else []), *ids]
    out = df.withColumn(score, F.round(score, DIGITS)).withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= max(k, 0))


def best_columns(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest finite values of each row, largest first, ties to the smaller column; for use inside of workers."""
    rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if k > 0 and s.shape[1]:
        least = np.partition(s, -k, axis=1)[:, -k] if k < s.shape[1] else np.full(len(s), -np.inf)
        for i, x in enumerate(s):
            at = np.flatnonzero((x >= least[i]) & np.isfinite(x))
            cols.append(at[np.argsort(-x[at], kind="stable")][:k])
            rows.append(np.full(len(cols[-1]), i))
    return np.concatenate(rows), np.concatenate(cols)
