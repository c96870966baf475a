"""Evaluation metrics as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def standardised_mse(y: Column, p: Column, train_mean: Column) -> Column:
    return mse(y, p) / mse(y, train_mean)


def coverage(y: Column, low: Column, high: Column) -> Column:
    return F.avg(((y >= low) & (y <= high)).cast("int"))


def interval_score(y: Column, low: Column, high: Column, alpha: float = 0.05) -> Column:
    return F.avg(high - low + 2 / alpha * (F.greatest(low - y, F.lit(0.0)) + F.greatest(y - high, F.lit(0.0))))


def misclassification(y: Column, p: Column) -> Column:
    return F.avg((y != (p >= 0.5).cast("int")).cast("int"))


def brier(y: Column, p: Column) -> Column:
    return mse(y, p)


def log_loss(y: Column, p: Column, clip: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return -F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))
