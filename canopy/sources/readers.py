"""Readers of delimited, white-space-delimited and several-lines-per-record files, and edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.operators.lineage import numbered


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = False) -> DataFrame:
    """Columns by a schema or, without one, by inference."""
    return spark.read.csv(path, schema=schema, header=header, inferSchema=schema is None, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(f.split()) for f in schema.split(",")]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, value): the lines of every file, numbered from 0 within it. Large files are read in blocks, whose
    lines follow those of the blocks before."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = spark.read.text(path).select("value", at.alias("at"), F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("at").agg(F.min("id").alias("first"), F.count("*").alias("lines"))
    upto = F.sum("lines").over(Window.partitionBy("at.file").orderBy("at.block"))
    blocks = blocks.select("at", "first", (upto - F.col("lines")).alias("before"))  # a row per block
    return lines.join(blocks, "at").select("at.file", (F.col("before") + F.col("id") - F.col("first")).alias("n"), "value")


def read_whitespace(spark: SparkSession, path: str, schema: str, null: str = "?", skip: int = 0) -> DataFrame:
    """Fields parted by white space; a quoted last field keeps its spaces. The first ``skip`` lines of every file
    are left out."""
    lines = numbered_lines(spark, path).where(F.col("n") >= skip) if skip else spark.read.text(path)
    fields = _fields(schema)
    parts = F.split(F.trim("value"), r"\s+", len(fields))
    clean = lambda i: F.nullif(F.regexp_replace(F.get(parts, F.lit(i)), '^"|"$', ""), F.lit(null))
    return lines.where(F.trim("value") != "").select(*(clean(i).cast(kind).alias(name) for i, (name, kind) in enumerate(fields)))


def read_records(spark: SparkSession, path: str, lines_per_record: int) -> DataFrame:
    """(file, record, fields): every ``lines_per_record`` lines of a file are one record; a shorter rest is one too."""
    lines = numbered_lines(spark, path).withColumn("record", F.floor(F.col("n") / lines_per_record))
    whole = lines.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("l"))
    return whole.select("file", "record", F.split(F.trim(F.array_join(F.transform("l", lambda x: F.trim(x["value"])), " ")), r"\s+").alias("fields"))


def bind_columns(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Joins two frames by their row number in the order of a column that both have."""
    return numbered(left, order, out="_n").join(numbered(right, order, out="_n").drop(order), "_n").drop("_n")


def edges_from_matrix(adjacency: DataFrame, vertex: str = "vertex") -> DataFrame:
    """(src, dst, weight) of the upper triangle of a wide matrix whose columns are named by vertex."""
    names = [c for c in adjacency.columns if c != vertex]
    cells = F.explode(F.array(*(F.struct(F.lit(int(c)).alias("dst"), F.col(c).cast("double").alias("w")) for c in names)))
    return adjacency.select(F.col(vertex).cast("int").alias("src"), cells.alias("e")).where("src < e.dst AND e.w <> 0").select("src", "e.dst", F.lit(1.0).alias("weight"))


def edges_from_rows(rows: DataFrame) -> DataFrame:
    """(src, dst, weight) of two columns, whose edges weigh 1, or three."""
    if len(rows.columns) not in (2, 3):
        raise ValueError("an edge list has two columns, or three with weights")
    named = rows.toDF(*["src", "dst", "weight"][: len(rows.columns)])
    weight = F.col("weight").cast("double") if len(rows.columns) == 3 else F.lit(1.0)
    return named.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), weight.alias("weight"))
