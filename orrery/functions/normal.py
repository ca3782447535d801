"""Normal distribution as column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# W. J. Cody's rational approximations of the error function (1969).
ERF_SMALL_P = [3.16112374387056560, 113.864154151050156, 377.485237685302021, 3209.37758913846947, 0.185777706184603153]
ERF_SMALL_Q = [23.6012909523441209, 244.024637934444173, 1282.61652607737228, 2844.23683343917062]
ERFC_MID_P = [
    0.564188496988670089, 8.88314979438837594, 66.1191906371416295, 298.635138197400131, 881.952221241769090,
    1712.04761263407058, 2051.07837782607147, 1230.33935479799725, 2.15311535474403846e-8,
]
ERFC_MID_Q = [
    15.7449261107098347, 117.693950891312499, 537.181101862009858, 1621.38957456669019, 3290.79923573345963,
    4362.61909014324716, 3439.36767414372164, 1230.33935480374942,
]
ERFC_TAIL_P = [
    0.305326634961232344, 0.360344899949804439, 0.125781726111229246, 0.0160837851487422766, 6.58749161529837803e-4,
    0.0163153871373020978,
]
ERFC_TAIL_Q = [2.56852019228982242, 1.87295284992346047, 0.527905102951428412, 0.0605183413124413191, 0.00233520497626869185]


def _ratio(x: Column, p: list[float], q: list[float]) -> Column:
    """(p[-1] x^n + p[0] x^(n-1) + ...) / (x^n + q[0] x^(n-1) + ...)"""
    top, bottom = x * p[-1], x
    for a, b in zip(p[:-2], q[:-1]):
        top, bottom = (top + a) * x, (bottom + b) * x
    return (top + p[-2]) / (bottom + q[-1])


def erfc(x: Column) -> Column:
    y = F.abs(x)
    square = y * y
    small = 1 - y * _ratio(square, ERF_SMALL_P, ERF_SMALL_Q)
    middle = F.exp(-square) * _ratio(y, ERFC_MID_P, ERFC_MID_Q)
    inverse = 1 / F.greatest(square, F.lit(1.0))
    tail = F.exp(-square) / F.greatest(y, F.lit(1.0)) * (1 / math.sqrt(math.pi) - inverse * _ratio(inverse, ERFC_TAIL_P, ERFC_TAIL_Q))
    upper = F.when(y <= 0.46875, small).when(y <= 4.0, middle).otherwise(tail)
    return F.when(x < 0, 2 - upper).otherwise(upper)


def cdf(x: Column) -> Column:
    return erfc(-x / math.sqrt(2)) / 2


def quantile(p: float) -> float:
    """Quantile of a fixed probability; parameters are plain numbers."""
    return NormalDist().inv_cdf(p)
