"""t and binomial tails for the few aggregated rows. Vector functions on numpy, applied by pandas UDFs."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 100000):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_cdf(t: float, df: float) -> float:
    tail = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    """Newton from the normal quantile, kept inside a bracket."""
    if not df > 0 or math.isnan(p):
        return math.nan
    low, high = -1.0, 1.0
    while t_cdf(low, df) > p:
        low *= 2
    while t_cdf(high, df) < p:
        high *= 2
    t = min(max(NormalDist().inv_cdf(p), low), high)
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    for _ in range(200):
        gap = t_cdf(t, df) - p
        low, high = (low, t) if gap > 0 else (t, high)
        step = t - gap / (scale * (1 + t * t / df) ** (-(df + 1) / 2))
        step = step if low < step < high else (low + high) / 2
        if abs(step - t) <= 1e-14 * max(1.0, abs(t)):
            return step
        t = step
    return t


def binomial_cdf(k: float, n: float, p: float = 0.5) -> float:
    """P(X <= k); zero for negative k, as for a sign test with more ties than wins."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    return incomplete_beta(n - k, k + 1, 1 - p)


def t_quantile_col(p: float, df: Column) -> Column:
    @F.pandas_udf("double")
    def udf(values: pd.Series) -> pd.Series:
        return values.map(lambda v: t_quantile(p, v) if v and v > 0 else np.nan).astype(float)

    return F.nullif(udf(df.cast("double")), F.lit(float("nan")))


def binomial_cdf_col(k: Column, n: Column) -> Column:
    @F.pandas_udf("double")
    def udf(ks: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([binomial_cdf(a, b) for a, b in zip(ks, ns)], dtype=float)

    return udf(k.cast("double"), n.cast("double"))
