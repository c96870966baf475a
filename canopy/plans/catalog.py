"""Named queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import encode, metrics
from canopy.operators import forest, graph, sampler, summary
from canopy.plans import more
from canopy.sources import forest_text

#: A small stored forest on price frames: continuous discount, tax; categorical return flag code.
TEXTS = ["1 r 0 0.05 0\n2 m -1.0\n3 r 1 0 3 8 6\n6 m 2.0\n7 m 0.5", "1 r 1 0 3 4 a\n2 m 0.25\n3 r 0 0.03 1\n6 m -0.5\n7 m 1.5", "1 m 0.125"]
FLAGS = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _frame(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_discount", "l_tax", f"{FLAGS} AS flag", "l_extendedprice")


def _forest() -> list[forest.Tree]:
    return [forest_text.read_tree(t) for t in TEXTS]


ARGS = (["l_discount", "l_tax"], ["flag"])


def score_forest(spark, sf):
    return forest.score(_frame(spark, sf), _forest(), *ARGS).select("l_orderkey", "l_linenumber", "score")


def score_forest_arrow(spark, sf):
    return forest.score(_frame(spark, sf), _forest(), *ARGS, strategy="arrow").select("l_orderkey", "l_linenumber", "score")


def _routed(spark, sf):
    return forest.leaves_of(_frame(spark, sf).withColumn("r", F.round("l_discount", 2)), _forest(), *ARGS, "r")


def leaf_statistics(spark, sf):
    return forest.sufficient(_routed(spark, sf), "r", 0.5, 1.0).select("tree", "nid", "n", F.round("sum_r", 4).alias("sum_r"), F.round("lil", 4).alias("lil"))


def leaf_sizes(spark, sf):
    return forest.leaf_sizes(forest.with_empty_leaves(forest.sufficient(_routed(spark, sf), "r", 0.5, 1.0), _forest()))


def parse_forest(spark, sf):
    return more.listed(forest_text.parse_forest(spark.createDataFrame(list(enumerate(TEXTS)), "tree int, text string")))


def variable_counts(spark, sf):
    return forest.variable_counts(forest_text.parse_forest(spark.createDataFrame(list(enumerate(TEXTS)), "tree int, text string")))


def standardise(spark, sf):
    return encode.standardise(_t(spark, sf, "customer"), "c_acctbal").select("c_custkey", F.round("y_std", 6).alias("y_std"))


def rescale(spark, sf):
    return encode.rescale(_t(spark, sf, "customer"), "c_acctbal").select("c_custkey", F.round("c_acctbal", 6).alias("x"))


def level_codes(spark, sf):
    return encode.level_codes(_t(spark, sf, "orders"), "o_orderpriority").select("label", F.col("code").cast("int").alias("code"))


def target_encode(spark, sf):
    """Every customer by the mean of the customers of its nation that stand in a training share of three quarters."""
    c = encode.sample_share(_t(spark, sf, "customer"), 0.75, 7, "c_custkey", out="is_train")
    return encode.target_encode(c.where("is_train"), c, "c_nationkey", "c_acctbal", "enc").select("c_custkey", F.round("enc", 6).alias("enc"))


def target_encode_all(spark, sf):
    """Every customer by the mean of all customers of its nation."""
    c = _t(spark, sf, "customer")
    return encode.target_encode(c, c, "c_nationkey", "c_acctbal", "enc").select("c_custkey", F.round("enc", 4).alias("enc"))


def cells(spark, sf):
    f = encode.cells(_t(spark, sf, "lineitem").withColumn("q", F.col("l_quantity")), "q", "l_returnflag", "l_linestatus", "l_linenumber")
    return f.select("l_returnflag", "l_linestatus", "l_linenumber", "n", "sum_y", "sum_yy")


def model_metrics(spark, sf):
    f, y, p = _t(spark, sf, "lineitem"), F.col("l_discount"), F.col("l_tax")
    return f.groupBy("l_returnflag").agg(
        F.round(metrics.rmse(y, p), 8).alias("rmse"), F.round(metrics.coverage(y, p - 0.03, p + 0.03), 8).alias("coverage"), F.round(metrics.interval_score(y, p - 0.02, p + 0.02), 8).alias("interval_score")
    )


def summarize_hf5(spark, sf):
    f = _t(spark, sf, "events").where("value IS NOT NULL")
    return summary.quantile_hf5(f, "event_type", "value", 0.025, 0.975).select("event_type", F.round("q0", 6).alias("lower"), F.round("q1", 6).alias("upper"))


def _edges(spark, sf):
    n = _t(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("src"), "n_regionkey"), n.select(F.col("n_nationkey").alias("dst"), "n_regionkey")
    return a.join(b, "n_regionkey").where("src < dst").select("src", "dst")


def nation_components(spark, sf):
    return graph.connected_components(_t(spark, sf, "nation").select(F.col("n_nationkey").alias("v")), _edges(spark, sf))


def nation_distances(spark, sf):
    chain = _t(spark, sf, "nation").where("n_nationkey > 0").select((F.col("n_nationkey") - 1).alias("src"), F.col("n_nationkey").alias("dst"))
    return graph.distances(chain, _t(spark, sf, "nation").where("n_nationkey IN (3, 20)").select(F.col("n_nationkey").alias("v")))


def induced_edges(spark, sf):
    """The edges between nations whose customers' mean balance is above that of all customers."""
    c = _t(spark, sf, "customer")
    rich = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m")).join(c.agg(F.avg("c_acctbal").alias("a"))).where("m > a")
    return graph.induced(_edges(spark, sf), rich.select(F.col("c_nationkey").alias("v")))


def fit_balance(spark, sf):
    """Two chains of a regression of all customers' balances on nations, with the network of regions."""
    n = spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey").collect()  # a fixed table of 25 rows
    edges = [(a["n_nationkey"], b["n_nationkey"]) for a in n for b in n if a["n_nationkey"] < b["n_nationkey"] and a["n_regionkey"] == b["n_regionkey"]]
    c = encode.cells(_t(spark, sf, "customer"), "c_acctbal", "c_nationkey").withColumn("chain", F.explode(F.array(F.lit(0), F.lit(1))))
    fits = sampler.fit_chains(c, "c_acctbal", [], ["c_nationkey"], sampler.Design([], [len(n)], {0: edges}), trees=20, draws=10, burn=20, cells=True)
    return fits.groupBy("chain").agg(F.countDistinct("draw").alias("draws"), F.count("*").alias("trees"), F.avg("sigma").alias("sigma"))


def prior_trees(spark, sf):
    return sampler.sample_prior(spark, sampler.Design([None, None], [5]), 100)


NAMES = [score_forest, score_forest_arrow, leaf_statistics, leaf_sizes, parse_forest, variable_counts, standardise, rescale, level_codes, target_encode, target_encode_all, cells, model_metrics, summarize_hf5, nation_components, nation_distances, induced_edges, fit_balance, prior_trees]
QUERIES = {f.__name__: f for f in NAMES}

_L0 = f"CASE WHEN l_discount < 0.05 THEN 2 WHEN l_discount >= 0.05 THEN CASE WHEN ({FLAGS}) = 0 THEN 6 WHEN ({FLAGS}) IN (1, 2) THEN 7 END END"
_L1 = f"CASE WHEN ({FLAGS}) = 1 THEN 2 WHEN ({FLAGS}) IN (0, 2) THEN CASE WHEN l_tax < 0.03 THEN 6 WHEN l_tax >= 0.03 THEN 7 END END"
_SCORE = f"""SELECT l_orderkey, l_linenumber, CASE l0 WHEN 2 THEN -1.0 WHEN 6 THEN 2.0 WHEN 7 THEN 0.5 END::DOUBLE
  + CASE l1 WHEN 2 THEN 0.25 WHEN 6 THEN -0.5 WHEN 7 THEN 1.5 END::DOUBLE + 0.125 AS score FROM (SELECT *, {_L0} AS l0, {_L1} AS l1 FROM lineitem)"""
_ROUTED = f"SELECT 0 AS tree, {_L0} AS nid, round(l_discount, 2) AS r FROM lineitem UNION ALL SELECT 1, {_L1}, round(l_discount, 2) FROM lineitem UNION ALL SELECT 2, 1, round(l_discount, 2) FROM lineitem"
_SAME = "SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey < b.n_nationkey"
SQL = {
    "score_forest": _SCORE,
    "score_forest_arrow": _SCORE,
    "leaf_statistics": f"""SELECT tree::INT AS tree, nid::BIGINT AS nid, count(*) AS n, round(sum(r), 4) AS sum_r,
  round(-0.5 * ln(4 + count(*)) + 0.5 * sum(r) * sum(r) / (4 + count(*)), 4) AS lil FROM ({_ROUTED}) GROUP BY tree, nid""",
    "leaf_sizes": f"""WITH e(tree, nid) AS (VALUES (0, 2), (0, 6), (0, 7), (1, 2), (1, 6), (1, 7), (2, 1)),
s AS (SELECT e.tree, e.nid, count(r) AS n FROM e LEFT JOIN ({_ROUTED}) x ON e.tree = x.tree AND e.nid = x.nid GROUP BY ALL)
SELECT tree::INT AS tree, count(*) AS num_leafs, count(*) FILTER (WHERE n = 1) AS num_singletons, count(*) FILTER (WHERE n = 0) AS num_empty, max(n) AS max_leaf_size, min(n) AS min_leaf_size FROM s GROUP BY tree""",
    "standardise": "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS y_std FROM customer",
    "rescale": "SELECT c_custkey, round(-1 + 2 * (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS x FROM customer",
    "level_codes": "SELECT DISTINCT o_orderpriority AS label, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS code FROM orders WHERE o_orderpriority IS NOT NULL",
    "target_encode": """WITH s AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || c_custkey)) <= floor(0.75 * count(*) OVER ()) AS is_train FROM customer),
t AS (SELECT * FROM s WHERE is_train), m AS (SELECT c_nationkey, avg(c_acctbal) AS m FROM t GROUP BY 1)
SELECT c_custkey, round(coalesce(m, (SELECT avg(c_acctbal) FROM t)), 6) AS enc FROM customer LEFT JOIN m USING (c_nationkey)""",
    "target_encode_all": "SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS enc FROM customer",
    "cells": "SELECT l_returnflag, l_linestatus, l_linenumber, count(l_quantity) AS n, sum(l_quantity) AS sum_y, sum(l_quantity * l_quantity) AS sum_yy FROM lineitem GROUP BY 1, 2, 3",
    "model_metrics": """SELECT l_returnflag, round(sqrt(avg((l_discount - l_tax) * (l_discount - l_tax))), 8) AS rmse,
  round(avg((l_discount >= l_tax - 0.03 AND l_discount <= l_tax + 0.03)::INT), 8) AS coverage,
  round(avg(l_tax + 0.02 - (l_tax - 0.02) + 40 * (greatest(l_tax - 0.02 - l_discount, 0) + greatest(l_discount - (l_tax + 0.02), 0))), 8) AS interval_score FROM lineitem GROUP BY 1""",
    "summarize_hf5": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
h AS (SELECT *, least(greatest(n * 0.025 + 0.5, 1.0), n)::DOUBLE AS a, least(greatest(n * 0.975 + 0.5, 1.0), n)::DOUBLE AS b FROM r)
SELECT event_type, round(max(value) FILTER (WHERE k = floor(a)) + max(a - floor(a)) * (max(value) FILTER (WHERE k = least(floor(a) + 1, n)) - max(value) FILTER (WHERE k = floor(a))), 6) AS lower,
  round(max(value) FILTER (WHERE k = floor(b)) + max(b - floor(b)) * (max(value) FILTER (WHERE k = least(floor(b) + 1, n)) - max(value) FILTER (WHERE k = floor(b))), 6) AS upper FROM h GROUP BY event_type""",
    "nation_components": "SELECT n_nationkey AS v, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS component FROM nation",
    "nation_distances": "SELECT n_nationkey AS v, least(abs(n_nationkey - 3), abs(n_nationkey - 20))::INT AS distance FROM nation",
    "induced_edges": f"WITH r AS (SELECT c_nationkey FROM customer GROUP BY 1 HAVING avg(c_acctbal) > (SELECT avg(c_acctbal) FROM customer)) SELECT * FROM ({_SAME}) WHERE src IN (FROM r) AND dst IN (FROM r)",
}

QUERIES |= more.QUERIES
SQL |= more.SQL
