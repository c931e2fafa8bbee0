"""Statistics as column expressions. Empty input gives NaN where the definition says so, never NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")

# Coefficients of the approximation of the normal distribution. The exponent is -x^2/2 with x itself
# in t, so values differ from the exact distribution by up to 0.04; results are defined by this form.
A1 = 0.254829592
A2 = -0.284496736
A3 = 1.421413741
A4 = -1.453152027
A5 = 1.061405429
P = 0.3275911


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    """x within [low, high]; NaN stays NaN."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.least(x, high), low))


def normal_cdf(x: Column) -> Column:
    t = 1 / (1 + P * F.abs(x))
    series = t * (A1 + t * (A2 + t * (A3 + t * (A4 + t * A5))))
    tail = series * F.exp(-x * x / 2) / 2
    return F.when(x < -8, 0.0).when(x > 8, 1.0).when(x < 0, tail).otherwise(1 - tail)


def t_p_value(t: Column, df: Column) -> Column:
    """Upper tail, with the small-sample shift of t."""
    return 1 - normal_cdf(t * (1 - 1 / (4 * df)))


def t_test(n: Column, mean: Column, sd: Column, mu: float = 0.0) -> tuple[Column, Column]:
    """t and p of a one-sample, one-tailed test from count, mean and sample deviation."""
    se = sd / F.sqrt(n)
    flat_t = F.when(mean == mu, 0.0).when(mean > mu, float("inf")).otherwise(float("-inf"))
    t = F.when(n < 2, NAN).when(sd == 0, flat_t).otherwise((mean - mu) / se)
    p = F.when(n < 2, NAN).when(sd == 0, F.when(mean > mu, 0.0).otherwise(1.0)).otherwise(t_p_value((mean - mu) / se, n - 1))
    return t, p


def cohens_d(mean: Column, sd: Column, mu: float = 0.0) -> Column:
    return F.when(sd == 0, 0.0).otherwise((mean - mu) / sd)


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd == 0, 0.0).otherwise((x - mean) / sd)


def sharpe(mean: Column, sd: Column, scale: float = 1.0) -> Column:
    """mean / sd; a flat series has 0, or infinity with the mean's sign."""
    flat = F.when(mean == 0, 0.0).when(mean > 0, float("inf")).otherwise(float("-inf"))
    return F.when(sd == 0, flat).otherwise(mean / sd * scale)


def upper_quantile(values: Column, q: float) -> Column:
    """The element at floor(n * q) of the sorted array, counted from 0; NULL if there is none."""
    return F.get(F.array_sort(values), F.floor(F.size(values) * q).cast("int"))


def or_nan(x: Column) -> Column:
    return F.coalesce(x, F.lit(NAN))
