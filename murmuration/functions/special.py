"""Logarithms of the gamma function and of densities, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos approximation of the gamma function with g = 7 and nine terms.
LANCZOS_G = 7.0
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for positive ``x``, with a relative error of about 1e-14; null for
    null. It is taken at ``x + 1``, where the series holds for all positive x, and brought back by ``log x``."""
    x = x.cast("double")
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (x + F.lit(float(i)))
    t = x + F.lit(LANCZOS_G + 0.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (x + F.lit(0.5)) * F.log(t) - t + F.log(series) - F.log(x)


def log_normal(x: Column, mean: Column, var: Column) -> Column:
    """Log density of a normal distribution."""
    return F.lit(-0.5 * math.log(2 * math.pi)) - F.log(var) / 2 - (x - mean) * (x - mean) / (var * 2)


def log_student_t(x: Column, mean: Column, var: Column, v: Column) -> Column:
    """Log density of a Student t distribution with ``v`` degrees of freedom and squared scale ``var``."""
    c = lgamma((v + 1) / 2) - lgamma(v / 2) - (F.log(v) + F.lit(math.log(math.pi)) + F.log(var)) / 2
    return c - (v + 1) / 2 * F.log1p((x - mean) * (x - mean) / (var * v))
