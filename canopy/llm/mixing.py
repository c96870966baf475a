"""Mixing sources to target weights, in DataFrame functions alone.

Every row gets a hash-random key. Rows are dealt into key ranges within their source; the ranges' sums,
accumulated per source, and a running sum inside each range give every row's exact place among its
source's words. A source's target is taken as whole epochs and one part epoch, cut at the exact budget:
the row at the cut is taken in part. No task holds more than one range of one source.

Targets share SHARE of all words by weight; a target above CAP times its source's words stops there and
the excess is reshared by weight, found in closed form from the sources in order of cap over weight.

Defined results: null texts have size 0 and are taken 0 times; a null source is a source of its own,
last; repeated rows are numbered, count each and get keys of their own, so that neither they nor rows of a null
doc_id meet in one range; ties in keys are broken by the key columns; very long texts are counted whole; further
columns pass, whatever their names, but for the three that are added; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.llm.shared import durable, quoted, table

WEIGHTS = (3.0, 1.0, 2.0)  #: of the sources in order of code points, repeating
SHARE, CAP = 1.5, 2.0
ROWS_PER_RANGE = 2000  #: mean rows of a key range
BROADCAST_SOURCES = 10_000  #: a table of more sources than this is joined by shuffle
AT_ONCE = 100_000  #: repeated rows that are numbered in one piece
RESULTS = ["source_size", "target", "taken"]


def size_of(text: str = "text") -> Column:
    """Words of a text: runs without ASCII white space."""
    blank = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(blank, " "), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """For each row (source, source_size, n_rows) its target. One row per source, so its windows are small."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weighed = sizes.withColumn("_place", place).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("_place", F.lit(len(weights))) + 1).cast("int")))
    capped = weighed.withColumn("_cap", cap * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = share * F.sum("source_size").over(every)
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = capped.withColumn("_level", (full - before) / left)
    # The first source whose cap is not reached sets the level of all sources after it.
    chosen = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(every)["_level"]
    return level.withColumn("_final", chosen).select("source", "_place", "source_size", "n_rows", F.least("_cap", F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap"))).alias("target"))


def numbered(counted: DataFrame, count: str, out: str) -> DataFrame:
    """Every row as often as its column ``count`` says, with a number from 1. Pieces of AT_ONCE are dealt out first,
    so that no task writes all of a row that is very common."""
    piece, first = F.floor((F.col(count) - 1) / AT_ONCE), F.col("piece") * AT_ONCE
    pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0), piece.cast("long"))))
    pieces = pieces.repartition(*(F.col(quoted(c)) for c in pieces.columns))
    return pieces.withColumn(out, F.explode(F.sequence(first + 1, F.least(first + AT_ONCE, F.col(count))))).drop("piece", count)


def mix_sources(docs: DataFrame, source: str = "source", size: str = "size", key: tuple[str, ...] = ("doc_id",), weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds source_size, target and taken to ``docs``, which has the column ``size`` and is told apart by ``key``."""
    keep = [c for c in docs.columns if c.lower() not in RESULTS]
    # 60 bits of an md5, which SQL has as well; the rest of it breaks ties.
    ticket = F.md5(F.concat_ws(":", *(F.coalesce(F.col(quoted(k)).cast("string"), F.lit("")) for k in key)))
    rows = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep))).alias("row"), F.col(quoted(source)).alias("source"), F.col(quoted(size)).cast("long").alias("size"), ticket.alias("ticket"), F.struct(*(F.col(quoted(k)) for k in key)).alias("key"))
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    goal = targets(stats, weights, share, cap).select(F.col("source").alias("named"), "_place", "source_size", "target", F.ceil(F.col("n_rows") / ROWS_PER_RANGE).alias("ranges"))
    if stats.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        goal = F.broadcast(goal)
    placed = rows.join(goal, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    share_of = F.conv(F.substring("ticket", 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    placed = placed.withColumn("range", F.floor(share_of * F.col("ranges")).cast("long"))
    sums = placed.groupBy("_place", "range").agg(F.sum("size").alias("sum"))
    start = sums.withColumn("start", F.sum("sum").over(Window.partitionBy("_place").orderBy("range")) - F.col("sum")).drop("sum")
    inside = Window.partitionBy("_place", "range").orderBy("ticket", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("run", F.sum("size").over(inside) - F.col("size")).join(start, ["_place", "range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    part = F.least(F.greatest(F.floor(rest) - F.col("start") - F.col("run"), F.lit(0)), F.col("size"))
    return placed.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)), "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").select("doc_id", "source", size_of().alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    docs = numbered(durable(counted), "n", "copy")
    return mix_sources(docs, key=("doc_id", "size", "copy")).drop("source", "copy")


def sql() -> str:
    """One running sum over each whole source in the order of the keys."""
    weights = ", ".join(map(str, WEIGHTS))
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS copy FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [{weights}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, {CAP}::DOUBLE * source_size AS cap, ({CAP}::DOUBLE * source_size) / w AS ratio, {SHARE}::DOUBLE * sum(source_size) OVER () AS full_size FROM s),
l AS (SELECT a.source, any_value(a.source_size) AS source_size, any_value(a.w) AS w, any_value(a.cap) AS cap, any_value(a.ratio) AS ratio,
  (any_value(a.full_size) - coalesce(sum(b.cap) FILTER (WHERE b.ratio < a.ratio), 0)) / sum(b.w) FILTER (WHERE b.ratio >= a.ratio) AS level
  FROM c a CROSS JOIN c b GROUP BY a.source),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT min(level) FROM l WHERE level <= ratio AND ratio = (SELECT min(ratio) FROM l WHERE level <= ratio)) * w, cap)) AS target FROM l),
r AS (SELECT n.*, t.source_size, t.target, sum(size) OVER (PARTITION BY n.source ORDER BY md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), size, copy)), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before,
  CASE WHEN t.source_size > 0 THEN floor(target / t.source_size) ELSE 0 END AS epochs FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(floor(target - epochs * source_size) - before, 0), size))::BIGINT AS taken FROM r"""


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row stands once per whole repeat taken; one at a source's cut stands whole if at least half is taken. Rows
    without words go; no rows give no rows; columns of any name pass. Every row is a unit of its own, whatever its
    doc_id; rows equal in all columns are told apart by number and stand for each other. Texts move once, to meet
    their number of repeats."""
    flags = [F.col(quoted(c)) for c in docs.columns]
    flags += [c.isNull() for c in flags]
    rows = docs.select(F.xxhash64(*flags).alias("a"), F.hash(*flags).alias("b"), F.col("source"), F.col("text"), F.struct(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row"))
    groups = durable(rows.select("a", "b", "source", size_of().alias("size")).groupBy("a", "b", "source", "size").agg(F.count("*").alias("n")))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    mixed = mix_sources(numbered(groups, "n", "unit"), key=("a", "b", "unit")).groupBy("a", "b").agg(F.sum(copies).cast("int").alias("copies")).where("copies > 0")
    # One of equal rows meets the repeats of all.
    one = F.row_number().over(Window.partitionBy("a", "b").orderBy("a"))
    kept = rows.drop("source", "text").join(mixed, ["a", "b"]).withColumn("k", one).where("k = 1")
    kept = kept.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return kept.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
