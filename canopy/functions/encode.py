"""Preparation of model frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stats(df: DataFrame, *columns: str) -> dict[str, dict[str, float]]:
    """Mean, sample sd, smallest and largest value of columns, in one aggregate of one row."""
    kinds = {"mean": F.avg, "sd": F.stddev_samp, "low": F.min, "high": F.max}
    r = df.agg(*(f(c).alias(f"{k}_{c}") for c in columns for k, f in kinds.items())).first()
    return {c: {k: r[f"{k}_{c}"] for k in kinds} for c in columns}


def _one(df: DataFrame, **aggregates: Column) -> DataFrame:
    return F.broadcast(df.agg(*(v.alias(k) for k, v in aggregates.items())))


def standardise(df: DataFrame, y: str, out: str = "y_std") -> DataFrame:
    joined = df.join(_one(df, _m=F.avg(y), _s=F.stddev_samp(y)))
    return joined.withColumn(out, (F.col(y) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def rescale(df: DataFrame, *columns: str) -> DataFrame:
    """Each column to [-1, 1]; a constant column becomes null."""
    lows = {f"_l{i}": F.min(c) for i, c in enumerate(columns)} | {f"_h{i}": F.max(c) for i, c in enumerate(columns)}
    joined = df.join(_one(df, **lows))
    for i, c in enumerate(columns):
        joined = joined.withColumn(c, -1 + 2 * (F.col(c) - F.col(f"_l{i}")) / F.nullif(F.col(f"_h{i}") - F.col(f"_l{i}"), F.lit(0.0)))
    return joined.drop(*lows)


def log_response(df: DataFrame, y: str, out: str = "y_log") -> DataFrame:
    """ln(y), or ln(1 + y) where the smallest value is 0."""
    joined = df.join(_one(df, _l=F.min(y)))
    return joined.withColumn(out, F.when(F.col("_l") == 0, F.log1p(y)).otherwise(F.log(y))).drop("_l")


def level_codes(df: DataFrame, column: str) -> DataFrame:
    """(label, code): ranks of the distinct labels from 0. One row per level."""
    labels = df.where(F.col(column).isNotNull()).select(F.col(column).alias("label")).distinct()
    return labels.withColumn("code", F.dense_rank().over(Window.orderBy("label")) - 1)


def encode(df: DataFrame, column: str, codes: DataFrame, out: str) -> DataFrame:
    """Left join with a dictionary; unseen labels get null."""
    named = codes.select(F.col("label").alias("_label"), F.col("code").alias(out))
    return df.join(named, F.col(column) == F.col("_label"), "left").drop("_label")


def one_hot(code: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == code).cast("int"))


def cutpoints(df: DataFrame, column: str) -> DataFrame:
    """(cut): the distinct values of a column, ascending, one row each."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).alias("cut")).distinct().orderBy("cut")


def integer_cutpoints(spark: SparkSession, low: int, high: int) -> DataFrame:
    """(cut): every whole number from ``low`` to ``high``."""
    return spark.range(low, high + 1).select(F.col("id").cast("double").alias("cut"))


def collapse(column: Column, merged: dict[str, str]) -> Column:
    """Labels with some merged into others; the rest stay."""
    out = column
    for old, new in merged.items():
        out = F.when(column == old, F.lit(new)).otherwise(out)
    return out


def dummies_to_label(labels: dict[str, str], base: str) -> Column:
    """The label whose indicator column is 1, in the order given, or ``base`` where none is."""
    out = F.lit(base)
    for column, label in reversed(labels.items()):
        out = F.when(F.col(column) == 1, F.lit(label)).otherwise(out)
    return out


def prefixed(column: Column, prefix: str) -> Column:
    """Ids as text, told from those of other kinds by a prefix."""
    return F.concat(F.lit(prefix), column.cast("string"))


def is_text(column: Column, value: str) -> Column:
    """1 if a text equals ``value``, 0 if not, null if it is null."""
    return (column == value).cast("int")


def between(near: Column, far: Column, scale: float = 5.0) -> Column:
    """From scale at distance 0 of the first set to -scale at distance 0 of the second, by the ratio of distances."""
    total = F.nullif(near + far, F.lit(0))
    return scale * far / total - scale * near / total


def complete_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a null or NaN in any of the columns, response included, so that both stay aligned."""
    kinds = dict(df.dtypes)
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNotNull())
    return df


def exactly_one(*conditions: Column) -> Column:
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions), F.lit(0)) == 1


def leaf_prior(df: DataFrame, y: str, trees: int) -> DataFrame:
    """(y_mean, y_sd, tau): the scale of a response and the prior sd of its leaves."""
    spread = (F.max(y) - F.min(y)) / F.stddev_samp(y)
    return df.agg(F.avg(y).alias("y_mean"), F.stddev_samp(y).alias("y_sd"), (spread / (4 * trees**0.5)).alias("tau"))


def _ticket(seed: int, *key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))


def lowest(df: DataFrame, n: int, seed: int, *key: str, out: str = "chosen") -> DataFrame:
    """Adds whether a row is among the ``n`` of the smallest md5 of seed and key, which is unique. Rows are counted
    by the first digits of that hash; only those of the one group at the border are put in order."""
    held = df.withColumn("_t", _ticket(seed, *key)).withColumn("_g", F.substring("_t", 1, 4))
    groups = held.groupBy("_g").agg(F.count("*").alias("_c"))  # at most 65536 rows
    groups = groups.withColumn("_upto", F.sum("_c").over(Window.orderBy("_g"))).withColumn("_before", F.col("_upto") - F.col("_c"))
    edge = groups.where((F.col("_before") < n) & (F.col("_upto") > n)).select("_g", "_before")
    border = held.join(F.broadcast(edge), "_g").withColumn("_k", F.col("_before") + F.row_number().over(Window.partitionBy("_g").orderBy("_t")))
    last = border.where(F.col("_k") <= n).agg(F.max("_t").alias("_last"))
    whole = groups.where(F.col("_upto") <= n).agg(F.max("_g").alias("_whole"))
    flagged = held.join(F.broadcast(last)).join(F.broadcast(whole))
    chosen = F.coalesce(F.col("_g") <= F.col("_whole"), F.lit(False)) | F.coalesce(F.col("_t") <= F.col("_last"), F.lit(False))
    return flagged.withColumn(out, chosen).drop("_t", "_g", "_last", "_whole")


def sample_share(df: DataFrame, share: float, seed: int, *key: str, out: str = "chosen") -> DataFrame:
    """Adds a flag that is true for exactly floor(share * rows) rows."""
    return lowest(df, int(share * df.count()), seed, *key, out=out)


def sample_groups(df: DataFrame, share: float, seed: int, group: str, out: str = "chosen") -> DataFrame:
    """Adds a flag that is true for all rows of floor(share * groups) groups."""
    some = sample_share(df.select(group).distinct(), share, seed, group, out=out)
    return df.join(some, group)


def sample_rows(df: DataFrame, n: int, n_train: int, seed: int, *key: str) -> DataFrame:
    """``n`` rows, ``n_train`` of them with is_train."""
    return lowest(lowest(df, n, seed, *key).where("chosen").drop("chosen"), n_train, seed + 1, *key, out="is_train")


def target_encode(train: DataFrame, rows: DataFrame, level: str, y: str, out: str) -> DataFrame:
    """Mean training response of a row's level; the overall mean for a level not seen."""
    means = train.groupBy(F.col(level).alias("_level")).agg(F.avg(y).alias("_mean"))
    return rows.join(means, F.col(level).eqNullSafe(F.col("_level")), "left").join(_one(train, _all=F.avg(y))).withColumn(out, F.coalesce("_mean", "_all")).drop("_level", "_mean", "_all")


def split(df: DataFrame, key: str, share: float, seed: int = 1) -> DataFrame:
    """Adds is_train by a seeded hash of the key, so that no row's side depends on partitions or on other rows."""
    return df.withColumn("is_train", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20)))


def cells(df: DataFrame, y: str, *columns: str) -> DataFrame:
    """Sufficient statistics of equal covariate cells, with the ends of y: all a Gaussian fit on discrete cutpoints needs."""
    return df.groupBy(*columns).agg(F.count(y).alias("n"), F.sum(y).alias("sum_y"), F.sum(F.col(y) * F.col(y)).alias("sum_yy"), F.min(y).alias("low"), F.max(y).alias("high"))
