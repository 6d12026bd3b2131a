"""Fu's F_S from the Ewens sampling formula."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def fs_of(n: int, k: int, theta: float) -> float:
    """ln(S / (1 - S)), S the chance of at least ``k`` haplotypes among ``n`` sequences.

    A sequence after i others brings a new haplotype with the chance theta / (theta + i),
    whatever came before; only the chances of fewer than k haplotypes are kept, in k numbers.
    """
    few, tail = np.zeros(k), 0.0
    few[0] = 1.0
    for i in range(n):
        new = theta / (theta + i)
        tail += new * few[-1]
        few[1:] = few[1:] * (1 - new) + few[:-1] * new
        few[0] *= 1 - new
    s = min(1 - 1e-12, max(1e-12, tail))
    return math.log(s / (1 - s))


@F.pandas_udf(DoubleType())
def fs(n: pd.Series, k: pd.Series, theta: pd.Series) -> pd.Series:
    return pd.Series([fs_of(*row) for row in zip(n, k, theta)], dtype=float)


def fu_fs(parts: DataFrame) -> DataFrame:
    """pop, n, n_haplotypes, fs of populations with differences; their number of steps is n, each over n_haplotypes numbers."""
    return parts.select("pop", "n", "n_haplotypes", (F.round(fs("n", "n_haplotypes", "theta"), 6) + 0.0).alias("fs"))
