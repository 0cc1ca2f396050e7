"""Statistical expressions: bias-corrected moments and chi-square survival."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def corrected_skew(x) -> Column:
    """Aggregate: G1 = sqrt(n(n-1))/(n-2) * g1 (pandas ``skew``); null for
    n < 3, 0 for a constant column."""
    v = _c(x)
    n = F.count(v).cast("double")
    g1 = F.skewness(v)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(F.stddev_pop(v) == 0, F.lit(0.0))
            .otherwise(F.sqrt(n * (n - 1)) / (n - 2) * g1))


def corrected_kurtosis(x) -> Column:
    """Aggregate: G2 = (n-1)/((n-2)(n-3)) * ((n+1) g2 + 6) (pandas ``kurt``);
    null for n < 4, 0 for a constant column."""
    v = _c(x)
    n = F.count(v).cast("double")
    g2 = F.kurtosis(v)
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(F.stddev_pop(v) == 0, F.lit(0.0))
            .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))


def chi2_sf_even(stat, dof) -> Column:
    """Survival of chi-square with even dof as a closed-form finite sum:
    exp(-x/2) * sum_{i<dof/2} (x/2)^i / i!.  Built from the term recurrence
    t_i = t_{i-1} * h / i so no factorial overflows."""
    h = _c(stat) / 2.0
    k = (_c(dof) / 2).cast("int")
    acc0 = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))), acc0,
        lambda acc, i: F.when(
            i <= k - 1,
            F.struct((acc["t"] * h / i).alias("t"), (acc["s"] + acc["t"] * h / i).alias("s")))
        .otherwise(acc),
        lambda acc: acc["s"])
    return F.exp(-h) * series


def _chi2_sf_scalar(x: float, dof: int) -> float:
    """Chi-square survival of one number, by other formulas (finite sums and erfc):
    what the tests hold the column expressions against."""
    if x is None or dof is None or math.isnan(x) or dof <= 0:
        return float("nan")
    if x <= 0:
        return 1.0
    if dof % 2 == 0:
        h = x / 2.0
        t = s = 1.0
        for i in range(1, dof // 2):
            t *= h / i
            s += t
        return math.exp(-h) * s
    r = math.sqrt(x)
    p = math.erfc(r / math.sqrt(2.0))
    term = math.sqrt(2.0 / math.pi) * math.exp(-x / 2.0) * r
    acc = 0.0
    for j in range(1, (dof - 1) // 2 + 1):
        acc += term
        term *= x / (2 * j + 1)
    return p + acc


def _ln_gamma(a: Column) -> Column:
    """ln Γ(a) for a > 0: Stirling's series at a + 15, and the recurrence down."""
    z = a + 15.0
    down = F.lit(0.0)
    for i in range(15):
        down = down + F.log(a + float(i))
    z3 = z * z * z
    return ((z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1.0 / (12.0 * z)
            - 1.0 / (360.0 * z3) + 1.0 / (1260.0 * z3 * z * z) - 1.0 / (1680.0 * z3 * z3 * z) - down)


def gamma_q(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function for a > 0, x > 0: one minus the
    power series below a + 1, the continued fraction (Lentz's steps) above."""
    front = F.exp(a * F.log(x) - x - _ln_gamma(a))
    # both need a multiple of sqrt(a) steps where x is near a, few elsewhere
    steps = F.sequence(F.lit(1), (F.lit(100.0) + 12.0 * F.sqrt(a)).cast("int"))
    series = F.aggregate(
        steps, F.struct((1.0 / a).alias("t"), (1.0 / a).alias("s")),
        lambda acc, n: F.struct((acc["t"] * x / (a + n)).alias("t"),
                                (acc["s"] + acc["t"] * x / (a + n)).alias("s")),
        lambda acc: acc["s"])

    def step(acc, n):
        b = acc["b"] + 2.0
        an = n * (a - n)
        c, d = b + an / acc["c"], 1.0 / (an * acc["d"] + b)
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    b0 = x + 1.0 - a
    fraction = F.aggregate(steps, F.struct(b0.alias("b"), F.lit(1e300).alias("c"),
                                           (1.0 / b0).alias("d"), (1.0 / b0).alias("h")),
                           step, lambda acc: acc["h"])
    return F.when(x < a + 1.0, 1.0 - front * series).otherwise(front * fraction)


def chi2_sf(stat, dof) -> Column:
    """Chi-square survival for any dof, on the JVM: the closed form for even dof,
    the incomplete gamma function for odd; 1 for a statistic of 0, null without a
    degree of freedom."""
    x, k = _c(stat).cast("double"), _c(dof).cast("double")
    odd = F.when(k <= 0, F.lit(None).cast("double")).when(x <= 0, F.lit(1.0)).otherwise(
        gamma_q(k / 2.0, x / 2.0))
    p = F.when(_c(dof) % 2 == 0, chi2_sf_even(stat, dof)).otherwise(odd)
    return F.when(p.isNotNull(), F.least(p, F.lit(1.0)))  # rounding
