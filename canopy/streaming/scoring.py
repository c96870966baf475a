"""Streaming scoring of a frozen forest, and streaming cell statistics for refits. Extensions: the model family has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators.forest import Tree, score


def score_stream(stream: DataFrame, forest: list[Tree], cont: list[str], cat: list[str]) -> DataFrame:
    return score(stream, forest, cont, cat)


def cell_stream(stream: DataFrame, time: str, late: str, window: str, y: str, *cell: str) -> DataFrame:
    """Counts, sums and squares of y per window and cell; rows later than ``late`` are left out by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *cell).agg(F.count(y).alias("n"), F.sum(y).alias("sum_y"), F.sum(F.col(y) * F.col(y)).alias("sum_yy"))
