"""Standard normal density and distribution as native columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of West's (2005) double-precision cumulative normal.
NUM = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
DEN = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def npdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _poly(coeffs: list[float], x: Column) -> Column:
    out = F.lit(coeffs[0])
    for c in coeffs[1:]:
        out = out * x + c
    return out


def ncdf(x: Column) -> Column:
    """Cumulative normal, absolute error below 1e-15.

    The tail stands in it once, flipped by exact factors: written in both branches, the generated method of a priced
    book is larger than the JVM compiles (8,000 bytes) and runs interpreted.
    """
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    near = e * _poly(NUM, a) / _poly(DEN, a)
    cf = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(e / cf / 2.506628274631)
    return F.when(x > 0, 1.0).otherwise(0.0) + F.when(x > 0, -1.0).otherwise(1.0) * tail
