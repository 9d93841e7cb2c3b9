"""Tail probabilities for one-row results. They run on aggregates, never on data rows."""
from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    fraction = d
    for m in range(1, 10_000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            fraction *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * fraction


def t_two_sided(t: float, degrees: float) -> float:
    return incomplete_beta(degrees / 2, 0.5, degrees / (degrees + t * t)) if degrees > 0 else math.nan


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, degrees: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(x) or n <= 0 else 0.0 if math.isinf(x) else t_two_sided(x, n) for x, n in zip(t, degrees)],
        dtype="float64",
    )


@F.pandas_udf(T.DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2))).astype("float64")


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    inverse = NormalDist().inv_cdf
    return p.map(lambda v: None if pd.isna(v) or not 0 < v < 1 else inverse(v)).astype("float64")
