"""Two-sided Student t probability as a column expression.

p = I_x(df/2, 1/2) with x = df / (df + t^2), by the continued fraction of the
regularised incomplete beta function.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published Lanczos coefficients for g = 7.
LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)
LANCZOS_G = 7.0
#: terms of the continued fraction; it settles within about sqrt(df) of them
TERMS = 600


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z of at least 1/2."""
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        series = series + F.lit(c) / (z + F.lit(float(i)))
    shifted = z + F.lit(LANCZOS_G - 0.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (z - 0.5) * F.log(shifted) - shifted + F.log(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction, evaluated forwards term by term."""

    def coefficient(k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(k % 2 == 0, even).otherwise(odd)

    def step(state: Column, k: Column) -> Column:
        term = coefficient(k)
        numerator = F.lit(1.0) + term / state["c"]
        denominator = F.lit(1.0) / (F.lit(1.0) + term * state["d"])
        return F.struct(
            numerator.alias("c"),
            denominator.alias("d"),
            (state["h"] * numerator * denominator).alias("h"),
        )

    one = F.lit(1.0)
    start_d = one / (one - (a + b) * x / (a + 1))
    start = F.struct(one.alias("c"), start_d.alias("d"), start_d.alias("h"))
    terms = F.sequence(F.lit(2), F.lit(TERMS))
    return F.aggregate(terms, start, step)["h"]


def two_sided_p(t: Column, df: Column) -> Column:
    """Probability of a t at least this far from 0; NaN for an unknown t."""
    t2 = t * t
    a, b, half = df / 2, F.lit(0.5), F.lit(0.5)
    x, rest = df / (df + t2), t2 / (df + t2)
    front = F.exp(
        log_gamma(a + half) - log_gamma(a) - F.lit(0.5 * math.log(math.pi)) + a * F.log(x) + half * F.log(rest)
    )
    lower = front * _fraction(a, b, x) / a
    upper = F.lit(1.0) - front * _fraction(b, a, rest) / b
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return (
        F.when(t.isNull() | F.isnan(t), nan)
        .when(F.abs(t) == inf, F.lit(0.0))
        .when(t == 0, F.lit(1.0))
        .when(x < (a + 1) / (a + b + 2), lower)
        .otherwise(upper)
    )
