"""Student-t tail and quantile for integer degrees of freedom as column expressions.

With theta = atan(|t|/sqrt(df)) the central probability is a finite trigonometric sum (Abramowitz and
Stegun 26.7.3, 26.7.4). It loses relative accuracy in the tail, so for t^2 >= df, and wherever the sum
leaves less than a millionth, the two-sided p is the power series of the incomplete beta function in
x = df/(df + t^2), whose terms are all positive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import ColumnLike, col, f64

BISECTIONS = 60


def _central(theta: Column, df: Column) -> Column:
    """P(|T| <= t) from the finite sum; theta in [0, pi/2)."""
    sin, cos = F.sin(theta), F.cos(theta)
    even = (df % 2) == 0
    terms = F.when(even, (df / 2).cast("int") - 1).otherwise(((df - 3) / 2).cast("int"))
    first = F.when(even, F.lit(1.0)).otherwise(cos)

    def step(acc: Column, k: Column) -> Column:
        kd = k.cast("double")
        ratio = F.when(even, (2 * kd - 1) / (2 * kd)).otherwise(2 * kd / (2 * kd + 1))
        nxt = acc["term"] * cos * cos * ratio
        return F.struct(nxt.alias("term"), (acc["sum"] + nxt).alias("sum"))

    summed = F.aggregate(
        F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")),
        F.struct(first.alias("term"), first.alias("sum")),
        step,
        lambda acc: acc["sum"],
    )
    odd_value = F.when(df == 1, theta).otherwise(theta + sin * summed) * F.lit(2.0 / math.pi)
    return F.when(even, sin * summed).otherwise(odd_value)


def _tail_series(x: Column, df: Column) -> Column:
    """Regularised incomplete beta I_x(df/2, 1/2); about 40/ln(1/x) terms reach double precision."""
    a = f64(df) / 2
    even = (df % 2) == 0
    steps = F.when(even, (df / 2).cast("int") - 1).otherwise(((df - 1) / 2).cast("int"))
    base_a = F.when(even, F.lit(1.0)).otherwise(F.lit(0.5))
    beta = F.aggregate(
        F.when(steps >= 1, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")),
        F.when(even, F.lit(2.0)).otherwise(F.lit(math.pi)),
        lambda acc, i: acc * (base_a + i) / (base_a + i + F.lit(0.5)),
    )

    def step(acc: Column, n: Column) -> Column:
        coeff = acc["coeff"] * (n.cast("double") - F.lit(0.5)) / n.cast("double") * x
        return F.struct(coeff.alias("coeff"), (acc["sum"] + coeff / (a + n)).alias("sum"))

    series = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(8), F.ceil(F.lit(40.0) / -F.log(x)).cast("int"))),
        F.struct(F.lit(1.0).alias("coeff"), (F.lit(1.0) / a).alias("sum")),
        step,
        lambda acc: acc["sum"],
    )
    return F.pow(x, a) / beta * series


def two_sided_p(t: ColumnLike, df: ColumnLike) -> Column:
    """Two-sided p-value of a t statistic with integer df >= 1."""
    stat, d = F.abs(f64(t)), col(df).cast("int")
    x = f64(d) / (f64(d) + stat * stat)
    rest = F.lit(1.0) - _central(F.atan(stat / F.sqrt(f64(d))), d)
    return F.when((stat * stat >= f64(d)) | (rest < 1e-6), _tail_series(x, d)).otherwise(rest)


def critical_value(confidence: float, df: ColumnLike) -> Column:
    """Two-sided critical value: bisection on theta = atan(t/sqrt(df))."""
    d = col(df).cast("int")

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        below = _central(mid, d) < F.lit(float(confidence))
        return F.struct(
            F.when(below, mid).otherwise(acc["lo"]).alias("lo"),
            F.when(below, acc["hi"]).otherwise(mid).alias("hi"),
        )

    theta = F.aggregate(
        F.sequence(F.lit(1), F.lit(BISECTIONS)),
        F.struct(F.lit(0.0).alias("lo"), F.lit(math.pi / 2).alias("hi")),
        halve,
        lambda acc: (acc["lo"] + acc["hi"]) / 2,
    )
    return F.sqrt(f64(d)) * F.tan(theta)
