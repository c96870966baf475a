"""Durable cuts of lineage, and row numbers without a task that sees all rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir or setCheckpointDir; a session of one machine without either gets a
    temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*)?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="canopy-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, *order: str, out: str = "n") -> DataFrame:
    """Adds row numbers from 0 in the order of columns; rows that tie in all of them stand in any order. Ranges are
    sorted side by side and shifted by the counts of those before them."""
    place = F.monotonically_increasing_id()
    sorted_ = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.shiftright(place, 33)).withColumn("_place", place.bitwiseAND((1 << 33) - 1)))
    counts = sorted_.groupBy("_part").agg(F.count("*").alias("_count"))
    before = counts.select("_part", (F.sum("_count").over(Window.orderBy("_part")) - F.col("_count")).alias("_before"))  # a row per partition
    return sorted_.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")
