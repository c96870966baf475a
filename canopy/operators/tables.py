"""Tables of experiments: grids of settings, results by method, and paired comparisons."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, **choices: tuple[str, list]) -> DataFrame:
    """A row for every combination of the choices, each a SQL type and a list of values."""
    out = spark.range(1)
    for name, (kind, values) in choices.items():
        out = out.withColumn(name, F.explode(F.array(*(F.lit(v).cast(kind) for v in values))))
    return out.drop("id")


def grids(*some: DataFrame) -> DataFrame:
    """All rows of several grids; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), some)


def without(settings: DataFrame, *conditions: Column) -> DataFrame:
    """The settings that meet none of the conditions; a condition that is null is not met."""
    for c in conditions:
        settings = settings.where(~F.coalesce(c, F.lit(False)))
    return settings


def by_method(results: DataFrame, row: str, method: str, methods: list[str], value: str) -> DataFrame:
    """One row per replicate and one column per method."""
    return results.groupBy(row).pivot(method, methods).agg(F.first(value, ignorenulls=True))


def paired(results: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, n, wins, t): over rows with both values how often a is smaller, and the paired t statistic."""
    d = F.col(a) - F.col(b)
    both = results.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(a) < F.col(b)).alias("wins"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count("*")))).alias("t"))


def p_less(t: float, n: int) -> float:
    """The probability of a paired t statistic of n pairs at or below t, for the alternative that a is smaller."""
    v = n - 1
    x = v / (v + t * t)
    tail = 0.5 * _beta_share(v / 2, 0.5, x)
    return tail if t < 0 else 1 - tail


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    down = 1 / (1 - (a + b) * x / (a + 1))
    up, out = 1.0, down
    for m in range(1, 300):
        for top in (m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))):
            down, up = 1 / (1 + top * x * down), 1 + top * x / up
            out *= down * up
        if abs(down * up - 1) < 1e-15:
            break
    return front * out
