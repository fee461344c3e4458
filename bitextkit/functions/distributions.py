"""Tail probabilities of the F and t distributions as column expressions.

Both are values of the regularised incomplete beta function I_x(a, b), here a
continued fraction evaluated by an ``aggregate`` over a bounded number of steps
(some sqrt(max(a, b)) are needed) and Lanczos' series for the gamma function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos' coefficients for g = 7.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
TINY = 1e-300
MAX_STEPS = 20_000


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0 (x below 1 by one step of the recurrence)."""
    y = x                                         # gamma(x) = gamma(x + 1) / x
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(c) / (y + F.lit(float(i)))
    t = y + F.lit(7.5)
    return F.lit(0.9189385332046727) + (y + 0.5) * F.log(t) - t + F.log(series) - F.log(x)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of I_x(a, b) by Lentz' method."""
    def safe(v):
        return F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    steps = F.least(F.lit(MAX_STEPS), (F.lit(200) + 6 * F.sqrt(F.greatest(a, b))).cast("int"))
    d0 = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def step(acc, i):
        m = i.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1 = 1.0 / safe(1.0 + even * acc["d"])
        c1 = safe(1.0 + even / acc["c"])
        h1 = acc["h"] * d1 * c1
        d2 = 1.0 / safe(1.0 + odd * d1)
        c2 = safe(1.0 + odd / c1)
        return F.struct(c2.alias("c"), d2.alias("d"), (h1 * d2 * c2).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda acc: acc["h"])


def incomplete_beta(x: Column, y: Column, a: Column, b: Column) -> Column:
    """I_x(a, b) for a, b > 0 and x + y = 1 (both given, so that neither loses
    digits); NULL where an argument is."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(y))
    inner = F.when(x < (a + 1.0) / (a + b + 2.0), front * _fraction(x, a, b) / a).otherwise(
        1.0 - front * _fraction(y, b, a) / b)
    return F.when(x.isNull() | y.isNull() | a.isNull() | b.isNull(), F.lit(None).cast("double")).when(
        x <= 0, F.lit(0.0)).when(y <= 0, F.lit(1.0)).otherwise(inner)


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(F >= f) with df1 and df2 degrees of freedom."""
    df1, df2 = df1.cast("double"), df2.cast("double")
    whole = df2 + df1 * f
    return F.when(f == float("inf"), F.lit(0.0)).otherwise(
        incomplete_beta(df2 / whole, df1 * f / whole, df2 / 2, df1 / 2))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) with df degrees of freedom."""
    return f_tail(t * t, F.lit(1.0), df)
