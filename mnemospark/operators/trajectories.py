"""Similarity of trajectories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic time warping distance of two rows of numbers."""
    cost = np.abs(a[:, None] - b[None, :])
    total = np.full((len(a) + 1, len(b) + 1), np.inf)
    total[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            total[i + 1, j + 1] = cost[i, j] + min(total[i, j], total[i, j + 1], total[i + 1, j])
    return float(total[-1, -1])


def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    rows = zip(a, b, strict=True)
    return pd.Series([1 / (1 + dtw(np.asarray(x, float), np.asarray(y, float)) / max(len(x), len(y))) if x is not None and y is not None and len(x) and len(y) else None for x, y in rows], dtype="float64")


def dtw_similarity():
    """A function of two array columns: 1 / (1 + distance per step); null if either is empty."""
    return F.pandas_udf(similarity, DoubleType())
