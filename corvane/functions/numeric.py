"""Fail-closed coercions and closed forms over columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_double(c: Column, default: float | None = None) -> Column:
    """``c`` as a finite double; malformed, infinite, NaN, null and booleans give ``default``."""
    x = c.cast("string").try_cast("double")
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(good, x).otherwise(F.lit(default).cast("double"))


def finite_long(c: Column, default: int | None = None) -> Column:
    """``c`` as an integer; values with a fraction, out of range or malformed give ``default``."""
    x = finite_double(c)
    return F.when((x == F.floor(x)) & (F.abs(x) < 9e18), x.try_cast("long")).otherwise(F.lit(default).cast("long"))


def truthy(c: Column, *, correct: bool = False) -> Column:
    """Serialised booleans: 1, true and yes, and with ``correct`` also the word itself; all else is false."""
    names = ["1", "1.0", "true", "yes", *(["correct"] if correct else [])]
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(names), F.lit(False))


def strict_boolean(c: Column) -> Column:
    """A boolean or its 0/1/true/false spelling; anything else raises when evaluated."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def close(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-6) -> Column:
    """Equal within the larger of a relative and an absolute tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-clamp(c, -30.0, 30.0)))


def history_weight(cycle: Column, current: Column, policy: str = "cumulative", decay: float = 0.5) -> Column:
    """Weight of an observation by its age in cycles; an unknown cycle is the current one."""
    age = F.greatest(F.lit(0), current - F.coalesce(cycle, current))
    if policy == "cumulative":
        return F.lit(1.0)
    if policy == "cycle_reset":
        return F.when(age == 0, 1.0).otherwise(0.0)
    if policy == "time_decay":
        return F.exp(-F.lit(float(decay)) * age)
    raise ValueError(policy)


Z_95 = 1.959963984540054


def wilson(successes: Column, n: Column, z: float = Z_95) -> Column:
    """struct<low, high> of the Wilson score interval; null without observations."""
    p = successes / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), middle - half).alias("low"), F.least(F.lit(1.0), middle + half).alias("high")))


# The 97.5 % quantiles of Student's t for 1 to 30 degrees of freedom.
T_975 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)


def t_critical(df: Column) -> Column:
    """Two-sided 95 % critical value: the table to 30 degrees of freedom, an expansion in 1 / df beyond; null below 1."""
    z = Z_95
    a, b, c = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    wide = F.lit(z) + a / df + b / (df * df) + c / (df * df * df)
    table = F.array(*[F.lit(x) for x in T_975])
    return F.when(df < 1, F.lit(None).cast("double")).when(df <= 30, F.get(table, df.cast("int") - 1)).otherwise(wide)


def beta_mean_variance(alpha: Column, beta: Column) -> tuple[Column, Column]:
    total = alpha + beta
    return alpha / total, alpha * beta / (total * total * (total + 1))


def log_binomial_tail(n: int, k: int) -> float:
    """log of the sum of C(n, i) / 2^n for i from 0 to k, without overflow."""
    if k < 0:
        return -math.inf
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))
