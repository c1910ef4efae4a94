"""Column expressions shared by the operators. Everything here stays inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def f64(c: ColumnLike) -> Column:
    return col(c).cast("double")


def total(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def safe_div(num: ColumnLike, den: ColumnLike) -> Column:
    """num/den in double, 0 where the denominator is 0."""
    return F.when(f64(den) == 0, F.lit(0.0)).otherwise(f64(num) / f64(den))


def is_finite(c: ColumnLike) -> Column:
    """Neither null, NaN nor infinite."""
    value = f64(c)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(math.inf))


def is_integral(c: ColumnLike) -> Column:
    return is_finite(c) & (f64(c) == F.floor(f64(c)))


def argmax(probs: Sequence[ColumnLike]) -> Column:
    """Index of the largest value; an exact tie goes to the lowest index."""
    values = [col(p) for p in probs]
    best = F.greatest(*values)
    out = F.lit(len(values) - 1)
    for index in range(len(values) - 2, -1, -1):
        out = F.when(values[index] == best, F.lit(index)).otherwise(out)
    return out


def pick(index: ColumnLike, values: Sequence[ColumnLike]) -> Column:
    """values[index] as a branch expression, null outside the range."""
    out = F.lit(None).cast("double")
    for i, value in enumerate(values):
        out = F.when(col(index) == i, col(value)).otherwise(out)
    return out


def entropy(probs: Sequence[ColumnLike], guard: str = "skip") -> Column:
    """Shannon entropy in nats.

    skip    zero terms contribute nothing
    clip    values are clipped to [1e-12, 1] first
    offset  log(p + 1e-5), the smoothing used for sample weighting
    """
    terms = []
    for p in (f64(p) for p in probs):
        if guard == "skip":
            terms.append(F.when(p > 0, -p * F.log(p)).otherwise(F.lit(0.0)))
        elif guard == "clip":
            clipped = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0))
            terms.append(-clipped * F.log(clipped))
        elif guard == "offset":
            terms.append(-p * F.log(p + F.lit(1e-5)))
        else:
            raise ValueError(f"unknown entropy guard {guard!r}")
    return total(terms)


def softmax(logits: Sequence[ColumnLike], temperature: float = 1.0) -> list[Column]:
    """Max-shifted softmax over per-class logit columns."""
    values = [f64(z) / F.lit(float(temperature)) for z in logits]
    top = F.greatest(*values) if len(values) > 1 else values[0]
    exps = [F.exp(v - top) for v in values]
    norm = total(exps)
    return [e / norm for e in exps]


def equal_width_bin(score: ColumnLike, bins: int) -> Column:
    """Bin of a score in [0, 1]; an inner edge i/bins belongs to the upper bin, 1.0 to the last.

    The floor guess is corrected against the double edges i*(1/bins), so the result equals a
    search over those edges at constant cost.
    """
    x, step = f64(score), F.lit(1.0 / bins)
    guess = F.floor(x * F.lit(float(bins))).cast("int")
    fixed = (
        F.when(x >= (guess + 1) * step, guess + 1)
        .when(x < guess * step, guess - 1)
        .otherwise(guess)
    )
    return F.greatest(F.lit(0), F.least(fixed, F.lit(bins - 1)))


def hash_text(seed: int, *ids: ColumnLike) -> Column:
    """Hex digest of `seed|id|...`: the only source of randomness, stable under retries."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(i).cast("string") for i in ids]))


def hash_uniform(seed: int, *ids: ColumnLike) -> Column:
    """Uniform number in [0, 1) from the first 52 bits of the digest."""
    head = F.conv(F.substring(hash_text(seed, *ids), 1, 13), 16, 10)
    return head.cast("bigint").cast("double") / F.lit(float(2**52))


def hash_index(n: ColumnLike, seed: int, *ids: ColumnLike) -> Column:
    """Uniform index in [0, n)."""
    size = col(n) if isinstance(n, (Column, str)) else F.lit(n)
    return F.least(F.floor(hash_uniform(seed, *ids) * size), size - 1).cast("bigint")


def soft_floor(x: ColumnLike, knee: float) -> Column:
    """Identity above the knee, exponential approach to 0 below it; slope is continuous."""
    v = f64(x)
    return F.when(v >= knee, v).otherwise(F.lit(knee) * F.exp((v - knee) / F.lit(knee)))


def soft_ceil(x: ColumnLike, knee: float, hi: float = 255.0) -> Column:
    """Mirror image of soft_floor below the upper bound."""
    v, edge = f64(x), hi - knee
    return F.when(v <= edge, v).otherwise(F.lit(hi) - F.lit(knee) * F.exp((F.lit(edge) - v) / F.lit(knee)))


def conditional_features(probs: Sequence[ColumnLike], features: ColumnLike) -> Column:
    """Flattened outer product of class probabilities and a feature array, class-major."""

    def block(p: Column) -> Column:
        return F.transform(col(features), lambda f: p * f.cast("double"))

    return F.flatten(F.array(*[block(f64(p)) for p in probs]))


def class_index(label: ColumnLike, classes: Sequence[str]) -> Column:
    """Position of a class name in the fixed order, null when unknown."""
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), col(label))
    return F.when(position > 0, (position - 1).cast("int"))


def inverse_decay(base: ColumnLike, progress: ColumnLike, alpha: float = 10.0, beta: float = 0.75) -> Column:
    """Learning rate base*(1 + alpha*p)^(-beta)."""
    return f64(base) * F.pow(F.lit(1.0) + F.lit(alpha) * f64(progress), F.lit(-beta))


def ramp(progress: ColumnLike, alpha: float = 10.0) -> Column:
    """Coefficient 2/(1 + e^(-alpha*p)) - 1."""
    return F.lit(2.0) / (F.lit(1.0) + F.exp(F.lit(-alpha) * f64(progress))) - F.lit(1.0)
