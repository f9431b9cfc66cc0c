"""Statistics as columns: aggregates, window expressions and a few scalars for the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

D2 = 1.128  # expected range of two normal values, in sigmas


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def sample_std(x: Column) -> Column:
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def pearson(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; null without variance."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def two_proportion_z(a: Column, n_a: Column, b: Column, n_b: Column) -> Column:
    p = (a + b) / (n_a + n_b)
    se = F.sqrt(p * (1 - p) * (1 / n_a + 1 / n_b))
    return F.when((n_a == 0) | (n_b == 0), 0.0).otherwise(F.coalesce(F.try_divide(a / n_a - b / n_b, se), F.lit(0.0)))


def skewness(m2: Column, m3: Column, n: Column) -> Column:
    """Sample-adjusted skewness from sums of squared and cubed deviations."""
    return F.when((n < 3) | (m2 <= 0), 0.0).otherwise(n * m3 / ((n - 1) * (n - 2)) / F.pow(m2 / (n - 1), F.lit(1.5)))


def normal_quantile(p: float) -> float:
    return -math.inf if p <= 0 else math.inf if p >= 1 else NormalDist().inv_cdf(p)


def chi2_quantile(df: float, p: float) -> float:
    """Wilson and Hilferty's approximation."""
    z = normal_quantile(p)
    return df * (1 - 2 / (9 * df) + z * math.sqrt(2 / (9 * df))) ** 3


def f_quantile(df1: float, df2: float, upper: float) -> float:
    """The ratio of two upper chi-square quantiles per degree of freedom: crude for few degrees, kept for equal limits."""
    c1, c2 = chi2_quantile(df1, 1 - upper) / df1, chi2_quantile(df2, 1 - upper) / df2
    return c1 if c2 == 0 else c1 / c2
