"""Standard normal density and distribution function.

Spark SQL has no error function, so the distribution function is written with
Hart's double-precision rational approximation (J. F. Hart et al., Computer
Approximations, 1968, no. 5666; also West, 2005), absolute error near 1e-15.
The same formula exists as a Column expression and as a numpy function.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

INV_SQRT_2PI = 0.3989422804014327
SQRT_2PI = 2.506628274631

# Published coefficients, highest power first (fixed values).
NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
SPLIT = 7.07106781186547
FAR = 37.0


def _horner(x, coefficients):
    acc = x * coefficients[0] + coefficients[1]
    for c in coefficients[2:]:
        acc = acc * x + c
    return acc


def pdf(x: Column) -> Column:
    return F.lit(INV_SQRT_2PI) * F.exp(x * x * -0.5)


def upper_tail(z: Column) -> Column:
    """Probability above z, for z >= 0. Give it a plain column: z occurs many times."""
    e = F.exp(z * z * -0.5)
    near = e * _horner(z, NUMERATOR) / _horner(z, DENOMINATOR)
    tail = z + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = z + F.lit(k) / tail
    far = e / tail / SQRT_2PI
    return F.when(z > FAR, F.lit(0.0)).when(z < SPLIT, near).otherwise(far)


def cdf(x: Column) -> Column:
    upper = upper_tail(F.abs(x))
    return F.when(x > 0, 1.0 - upper).otherwise(upper)


def cdf_np(x: np.ndarray) -> np.ndarray:
    z = np.minimum(np.abs(x), FAR + 1.0)
    e = np.exp(-0.5 * z * z)
    near = e * _horner(z, NUMERATOR) / _horner(z, DENOMINATOR)
    tail = z + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = z + k / tail
    upper = np.where(z > FAR, 0.0, np.where(z < SPLIT, near, e / tail / SQRT_2PI))
    return np.where(x > 0, 1.0 - upper, upper)


def pdf_np(x: np.ndarray) -> np.ndarray:
    return INV_SQRT_2PI * np.exp(-0.5 * x * x)
