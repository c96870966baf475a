"""Posterior summaries of long frames of draws (row_id, draw, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.operators.lineage import durable

MOST_ROWS = 1_000_000  #: of a key that is sorted in one task
RANGES = 200  #: of the values of a larger key


def normal_cdf(x: Column) -> Column:
    """The normal distribution function in built-in functions, by the rational approximation of erfc (error under 2e-7)."""
    z = F.abs(x) / F.lit(2**0.5)
    t = 1 / (1 + 0.5 * z)
    #: Published coefficients of the approximation.
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = poly * t + k
    tail = t * F.exp(-z * z + poly) / 2
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def _points(ranked: DataFrame, key: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """Quantiles from rows whose values stand at the ranks _from to _to of _n."""
    out = []
    for i, p in enumerate(shares):
        h = F.least(F.greatest(F.col("_n") * p + 0.5, F.lit(1.0)), F.col("_n").cast("double"))
        low, part = F.floor(h), h - F.floor(h)
        a = F.max(F.when((F.col("_from") <= low) & (low <= F.col("_to")), F.col(value)))
        high = F.least(low + 1, F.col("_n"))
        b = F.max(F.when((F.col("_from") <= high) & (high <= F.col("_to")), F.col(value)))
        out.append((a + F.max(part) * (b - a)).alias(f"q{i}"))
    return ranked.groupBy(key).agg(*out)


def quantile_hf5(draws: DataFrame, key: str, value: str, *shares: float, most: int = MOST_ROWS) -> DataFrame:
    """Quantiles by the definition with sample points at (k - 1/2) / n; columns q0, q1, ... A key of more than
    ``most`` rows is not sorted in one task: its values are counted, cut into ranges by approximate quantiles, and
    only the ranges that hold the ranks asked for are ordered. The result is exact either way. Null values count."""
    sizes = durable(draws.groupBy(key).agg(F.count("*").alias("_n")))
    large = sizes.where(F.col("_n") > most)
    narrow = draws.select(key, value)
    if large.isEmpty():
        ranked = narrow.withColumn("_from", F.row_number().over(Window.partitionBy(key).orderBy(value))).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
        return _points(ranked.withColumn("_to", F.col("_from")), key, value, shares)
    few = narrow.join(large, key, "left_anti")
    counted = narrow.join(F.broadcast(large), key).groupBy(key, value, "_n").agg(F.count("*").alias("_c"))
    cuts = counted.groupBy(key).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("_cuts"))  # a row per large key
    placed = counted.join(F.broadcast(cuts), key).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = placed.groupBy(key, "_range").agg(F.sum("_c").alias("_sum"))
    totals = totals.withColumn("_before", F.sum("_sum").over(Window.partitionBy(key).orderBy("_range")) - F.col("_sum"))
    asked = F.lit(False)
    for p in shares:
        h = F.floor(F.least(F.greatest(F.col("_n") * p + 0.5, F.lit(1.0)), F.col("_n").cast("double")))
        asked = asked | (h + 1 > F.col("_before")) & (h <= F.col("_before") + F.col("_sum"))
    near = placed.join(totals, [key, "_range"]).where(asked)
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(key, "_range").orderBy(value))
    ranked = near.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c") + 1)
    return quantile_hf5(few, key, value, *shares, most=most).unionByName(_points(ranked, key, value, shares))


def summarize(draws: DataFrame, key: str = "row_id", value: str = "value", sigma: DataFrame | None = None, seed: int = 1, method: str = "hf5") -> DataFrame:
    """(key, mean, lower, upper): mean of the draws and 2.5 and 97.5 % points of the draws with noise of ``sigma``
    (draw, sigma); the noise is a hash of seed, row and draw, so it does not depend on partitions."""
    noisy = draws
    if sigma is not None:
        u = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), F.col(key), F.col("draw")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        z = F.sqrt(-2 * F.log(u(0))) * F.cos(2 * F.pi() * u(1))
        noisy = draws.join(sigma.select("draw", "sigma"), "draw").withColumn("_noisy", F.col(value) + F.col("sigma") * z)
    else:
        noisy = draws.withColumn("_noisy", F.col(value))
    mean = draws.groupBy(key).agg(F.avg(value).alias("mean"))
    if method == "hf7":
        ends = noisy.groupBy(key).agg(F.percentile("_noisy", F.lit(0.025)).alias("lower"), F.percentile("_noisy", F.lit(0.975)).alias("upper"))
    else:
        ends = quantile_hf5(noisy, key, "_noisy", 0.025, 0.975).withColumnsRenamed({"q0": "lower", "q1": "upper"})
    return mean.join(ends, key)


def kept_draws(trace: DataFrame, burn: int, thin: int = 1, sweep: str = "sweep") -> DataFrame:
    """The sweeps after warm-up that thinning keeps, with the number of their draw."""
    kept = trace.where((F.col(sweep) >= burn) & (F.pmod(F.col(sweep) - burn, F.lit(thin)) == 0))
    return kept.withColumn("draw", ((F.col(sweep) - burn) / thin).cast("int"))


def posterior_mean(draws: DataFrame, *key: str, value: str = "value") -> DataFrame:
    """(key, mean) over draws; of probabilities it is the mean of the distribution function, not that of the mean.
    A draw without a value, where a tree could not place the row, leaves none."""
    return draws.groupBy(*key).agg(F.when(F.count(value) == F.count("*"), F.avg(value)).alias("mean"))
