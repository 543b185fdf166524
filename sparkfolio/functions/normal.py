"""The normal distribution by built-in functions, with the same forms in SQL."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS, FAR = 160, 5.9
EULER = 0.5772156649015329


def erf(x: Column) -> Column:
    """Error function by its series of positive terms: each is the last one times 2x²/(2n+1); beyond ``FAR`` it is one."""
    a = F.abs(x)
    zero = F.struct(a.alias("term"), a.alias("total"))
    step = lambda acc, n: F.struct((acc["term"] * 2 * a * a / (2 * n + 1)).alias("term"), (acc["total"] + acc["term"] * 2 * a * a / (2 * n + 1)).alias("total"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), zero, step, lambda acc: acc["total"])
    return F.signum(x) * F.when(a > FAR, 1.0).otherwise(2 / math.sqrt(math.pi) * F.exp(-a * a) * series)


def erfc(x: Column) -> Column:
    return 1 - erf(x)


def two_sided(t: Column) -> Column:
    """Two-sided p value of a t value, by the normal distribution."""
    return erfc(F.abs(t) / math.sqrt(2))


def cdf(z: Column) -> Column:
    return (1 + erf(z / math.sqrt(2))) / 2


def sql_erf(x: str) -> str:
    """The same series: its n-th term is x^(2n+1) 2^n / (1·3·…·(2n+1))."""
    a = f"greatest(abs({x}), 1e-150)"
    term = f"exp((2 * n + 1) * ln({a}) + 2 * n * ln(2.0) - lgamma(2 * n + 2.0) + lgamma(n + 1.0))"
    return f"(sign({x}) * CASE WHEN abs({x}) > {FAR} THEN 1.0 ELSE 2 / sqrt(pi()) * exp(-{a} * {a}) * list_sum(list_transform(range({TERMS + 1}), lambda n: {term})) END)"


def sql_two_sided(t: str) -> str:
    return f"(1 - {sql_erf(f'(abs({t}) / sqrt(2.0))')})"


def sql_cdf(z: str) -> str:
    return f"((1 + {sql_erf(f'(({z}) / sqrt(2.0))')}) / 2)"


def luckiest(trials: int) -> float:
    """Expected largest of ``trials`` standard normal draws; none for one trial."""
    if trials <= 1:
        return 0.0
    quantile = NormalDist().inv_cdf
    return (1 - EULER) * quantile(1 - 1 / trials) + EULER * quantile(1 - 1 / (trials * math.e))
