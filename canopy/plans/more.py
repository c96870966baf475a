"""Further queries over the driver's tables, one for each operator that a query can check, and their SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import encode, metrics, synthetic
from canopy.operators import forest, graph, sampler, summary, tables
from canopy.operators.lineage import numbered, shared_folder
from canopy.sources import forest_text, readers
from canopy.streaming import scoring

TEXTS = ["1 r 0 0.05 0\n2 m -1.0\n3 r 1 0 3 8 6\n6 m 2.0\n7 m 0.5", "1 r 1 0 3 4 a\n2 m 0.25\n3 r 0 0.03 1\n6 m -0.5\n7 m 1.5", "1 m 0.125"]
#: Two stored draws of a fit of two trees each, with the scale of its response.
DRAWS = [(0, 0, TEXTS[0]), (0, 1, TEXTS[1]), (1, 0, TEXTS[1]), (1, 1, TEXTS[2])]
MEAN, SD = 0.5, 2.0
FLAGS = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END"
ARGS = (["l_discount", "l_tax"], ["flag"])
KEY = ("l_orderkey", "l_linenumber")
N_TABLE = 25  #: nations
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _frame(spark, sf) -> DataFrame:
    return _t(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_discount", "l_tax", f"{FLAGS} AS flag", "l_extendedprice", "concat_ws('-', l_orderkey, l_linenumber) AS id")


def _forest() -> list[forest.Tree]:
    return [forest_text.read_tree(t) for t in TEXTS]


def _nodes(spark) -> DataFrame:
    return forest_text.parse_forest(spark.createDataFrame(list(enumerate(TEXTS)), "tree int, text string"))


def _fits(spark) -> DataFrame:
    return spark.createDataFrame([(0, d, t, x, MEAN, SD) for d, t, x in DRAWS], "chain int, draw int, tree int, text string, y_mean double, y_sd double")


_L0 = f"CASE WHEN l_discount < 0.05 THEN 2 WHEN l_discount >= 0.05 THEN CASE WHEN ({FLAGS}) = 0 THEN 6 WHEN ({FLAGS}) IN (1, 2) THEN 7 END END"
_L1 = f"CASE WHEN ({FLAGS}) = 1 THEN 2 WHEN ({FLAGS}) IN (0, 2) THEN CASE WHEN l_tax < 0.03 THEN 6 WHEN l_tax >= 0.03 THEN 7 END END"
_V0, _V1 = "CASE l0 WHEN 2 THEN -1.0 WHEN 6 THEN 2.0 WHEN 7 THEN 0.5 END::DOUBLE", "CASE l1 WHEN 2 THEN 0.25 WHEN 6 THEN -0.5 WHEN 7 THEN 1.5 END::DOUBLE"
_VALUES = f"SELECT *, {_V0} AS v0, {_V1} AS v1, l_orderkey::VARCHAR || '-' || l_linenumber AS id FROM (SELECT *, {_L0} AS l0, {_L1} AS l1 FROM lineitem)"
_D0, _D1 = f"{MEAN} + {SD} * (v0 + v1)", f"{MEAN} + {SD} * (v1 + 0.125)"
_DRAWS = f"SELECT id, 0 AS draw, {_D0} AS value FROM ({_VALUES}) UNION ALL SELECT id, 1, {_D1} FROM ({_VALUES})"


def _cdf(x: str) -> str:
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    t, poly = f"(1 / (1 + 0.5 * abs({x}) / sqrt(2.0::DOUBLE)))", str(c[-1])
    for k in reversed(c[:-1]):
        poly = f"({poly} * {t} + ({k}))"
    tail = f"({t} * exp(-({x}) * ({x}) / 2 + {poly}) / 2)"
    return f"CASE WHEN ({x}) >= 0 THEN 1 - {tail} ELSE {tail} END"


# Preparation


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN min(l_discount) OVER () = 0 THEN ln(1 + l_discount) ELSE ln(l_discount) END, 8) AS y_log FROM lineitem")
def log_transform(spark, sf):
    return encode.log_response(_t(spark, sf, "lineitem"), "l_discount").select(*KEY, F.round("y_log", 8).alias("y_log"))


@query("SELECT p_partkey, round(ln(p_size), 8) AS y_log FROM part")
def log_transform_positive(spark, sf):
    return encode.log_response(_t(spark, sf, "part"), "p_size").select("p_partkey", F.round("y_log", 8).alias("y_log"))


@query("SELECT c_custkey, round(m + s * z, 4) AS back FROM (SELECT c_custkey, avg(c_acctbal) OVER () AS m, stddev_samp(c_acctbal) OVER () AS s, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS z FROM customer)")
def unstandardise(spark, sf):
    c = encode.standardise(_t(spark, sf, "customer"), "c_acctbal", "z")
    scale = encode.leaf_prior(_t(spark, sf, "customer"), "c_acctbal", 200)
    return c.join(F.broadcast(scale)).select("c_custkey", F.round(F.col("y_mean") + F.col("y_sd") * F.col("z"), 4).alias("back"))


@query("SELECT round(avg(o_totalprice), 4) AS y_mean, round(stddev_samp(o_totalprice), 4) AS y_sd, round((max(o_totalprice) - min(o_totalprice)) / stddev_samp(o_totalprice) / (4 * sqrt(200)), 10) AS tau FROM orders")
def leaf_prior_scale(spark, sf):
    return encode.leaf_prior(_t(spark, sf, "orders"), "o_totalprice", 200).select(F.round("y_mean", 4).alias("y_mean"), F.round("y_sd", 4).alias("y_sd"), F.round("tau", 10).alias("tau"))


def _coded(spark, sf) -> DataFrame:
    o = _t(spark, sf, "orders")
    return encode.encode(o, "o_orderpriority", encode.level_codes(o, "o_orderpriority"), "code").withColumn("code", F.col("code").cast("int"))


_CODED = "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority IS NOT NULL THEN (dense_rank() OVER (PARTITION BY o_orderpriority IS NULL ORDER BY o_orderpriority) - 1)::INT END AS code FROM orders"


@query(f"SELECT o_orderkey, code FROM ({_CODED})")
def encode_levels(spark, sf):
    return _coded(spark, sf).select("o_orderkey", "code")


@query(f"SELECT o_orderkey, {', '.join(f'(code = {i})::INT AS is_{i}' for i in range(5))} FROM ({_CODED})")
def one_hot(spark, sf):
    hot = _coded(spark, sf).withColumn("h", encode.one_hot(F.col("code"), 5))
    return hot.select("o_orderkey", *(F.get("h", F.lit(i)).alias(f"is_{i}") for i in range(5)))


@query("SELECT l_discount AS cut, row_number() OVER (ORDER BY l_discount) - 1 AS n FROM (SELECT DISTINCT l_discount FROM lineitem WHERE l_discount IS NOT NULL)")
def distinct_cutpoints(spark, sf):
    return numbered(encode.cutpoints(_t(spark, sf, "lineitem"), "l_discount"), "cut")


@query("SELECT range::DOUBLE AS cut FROM range(1969, 2001)")
def integer_cutpoints(spark, sf):
    return encode.integer_cutpoints(spark, 1969, 2000)


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'OTHER' ELSE o_orderpriority END AS label FROM orders")
def collapse_levels(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", encode.collapse(F.col("o_orderpriority"), {"4-NOT SPECIFIED": "OTHER", "5-LOW": "OTHER"}).alias("label"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'back' WHEN l_returnflag = 'R' THEN 'refused' ELSE 'kept' END AS label FROM lineitem")
def dummies_to_label(spark, sf):
    d = _t(spark, sf, "lineitem").select(*KEY, encode.is_text(F.col("l_returnflag"), "A").alias("a"), encode.is_text(F.col("l_returnflag"), "R").alias("r"))
    return d.select(*KEY, encode.dummies_to_label({"a": "back", "r": "refused"}, "kept").alias("label"))


@query("SELECT c_custkey, 'c.' || c_custkey AS id FROM customer")
def prefix_ids(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", encode.prefixed(F.col("c_custkey"), "c.").alias("id"))


@query("SELECT event_id, (event_type = 'error')::INT AS y FROM events")
def text_flag(spark, sf):
    return _t(spark, sf, "events").select("event_id", encode.is_text(F.col("event_type"), "error").alias("y"))


_NEAR, _FAR = "abs(n_nationkey - 3)", "abs(n_nationkey - 20)"


@query(f"SELECT n_nationkey AS v, round(5.0::DOUBLE * {_FAR} / ({_NEAR} + {_FAR}) - 5.0::DOUBLE * {_NEAR} / ({_NEAR} + {_FAR}), 8) AS mu FROM nation")
def distance_ratio(spark, sf):
    hops = lambda v, out: graph.distances(_chain(spark, sf), spark.createDataFrame([(v,)], "v int")).withColumnRenamed("distance", out)
    return hops(3, "a").join(hops(20, "b"), "v").select("v", F.round(encode.between(F.col("a"), F.col("b")), 8).alias("mu"))


_X = ["l_discount * 20 - 1", "l_tax * 25 - 1", "l_quantity / 25 - 1", "(l_linenumber - 4) / 3.0", "l_discount * l_tax * 250 - 1"]
_Z = [f"(({x}) + 1) / 2" for x in _X]
_P1, _P2 = f"10 * sin(pi() * {_Z[0]} * {_Z[1]})", f"10 * ({_Z[2]} - 0.5) * ({_Z[2]} - 0.5)"
_P3 = f"{_P2} + 10 * {_Z[3]} + 5 * {_Z[4]}"
_FR, _HIGH = f"({_P1} + {_P2} + {_P3})", f"({_Z[1]} > 0.5)::INT"
_TWO = f"(3 * {_Z[0]} + (2 - 5 * {_HIGH}) * sin(pi() * {_Z[0]}) - 2 * {_HIGH})"
_LV = "(l_orderkey % 10)::INT"


@query(f"""SELECT l_orderkey, l_linenumber, round({_FR}, 6) AS friedman, round({_TWO}, 6) AS two_regime,
  round(CASE WHEN {_LV} IN (0, 2, 4, 8) THEN {_FR} ELSE {_TWO} END, 6) AS mixture_1, round(CASE WHEN {_LV} = 0 THEN {_TWO} ELSE {_FR} END, 6) AS mixture_2,
  round(CASE {_LV} WHEN 0 THEN {_P1} WHEN 1 THEN {_P2} WHEN 2 THEN {_P3} WHEN 3 THEN {_P1} + {_P2} WHEN 4 THEN {_P1} + {_P3} WHEN 5 THEN {_P2} + {_P3} WHEN 6 THEN {_FR} ELSE {_TWO} END, 6) AS mixture_3,
  round(({_LV} + 1) / 10.0::DOUBLE * {_FR} + (9 - {_LV}) / 10.0::DOUBLE * {_TWO}, 6) AS mixture_4 FROM lineitem""")
def response_functions(spark, sf):
    x = [F.expr(e.replace("3.0", "3.0D")) for e in _X]
    level = F.expr("CAST(l_orderkey % 10 AS INT)")
    each = {"friedman": synthetic.friedman(x), "two_regime": synthetic.two_regime(x)} | {f"mixture_{k}": synthetic.mixture(k, x, level) for k in (1, 2, 3, 4)}
    return _t(spark, sf, "lineitem").select(*KEY, *(F.round(c, 6).alias(k) for k, c in each.items()))


@query("SELECT event_id, value, event_type FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND event_type IS NOT NULL")
def drop_missing(spark, sf):
    return encode.complete_rows(_t(spark, sf, "events").select("event_id", "value", "event_type"), "value", "event_type")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_discount > 0.05)::INT + (l_tax > 0.04)::INT + (l_quantity > 25)::INT = 1")
def exactly_one(spark, sf):
    return _t(spark, sf, "lineitem").where(encode.exactly_one(F.col("l_discount") > 0.05, F.col("l_tax") > 0.04, F.col("l_quantity") > 25)).select(*KEY)


@query("SELECT c_custkey, row_number() OVER (ORDER BY md5('7:' || c_custkey)) <= floor(0.75 * count(*) OVER ()) AS is_train FROM customer")
def share_split(spark, sf):
    return encode.sample_share(_t(spark, sf, "customer"), 0.75, 7, "c_custkey", out="is_train").select("c_custkey", "is_train")


@query("WITH s AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('7:' || c_custkey)) <= floor(0.75 * count(*) OVER ()) AS t FROM customer) SELECT c.c_custkey FROM customer c WHERE c.c_custkey NOT IN (SELECT c_custkey FROM s WHERE t)")
def split_complement(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey")
    train = encode.sample_share(c, 0.75, 7, "c_custkey", out="is_train").where("is_train")
    return c.join(train, "c_custkey", "left_anti")


@query("WITH g AS (SELECT c_nationkey, row_number() OVER (ORDER BY md5('3:' || c_nationkey)) <= floor(0.9 * count(*) OVER ()) AS seen FROM (SELECT DISTINCT c_nationkey FROM customer)) SELECT c_custkey, seen FROM customer JOIN g USING (c_nationkey)")
def group_split(spark, sf):
    return encode.sample_groups(_t(spark, sf, "customer"), 0.9, 3, "c_nationkey", out="seen").select("c_custkey", "seen")


@query("WITH a AS (SELECT o_orderkey FROM orders ORDER BY md5('5:' || o_orderkey) LIMIT 110) SELECT o_orderkey, row_number() OVER (ORDER BY md5('6:' || o_orderkey)) <= 100 AS is_train FROM a")
def sampled_rows(spark, sf):
    return encode.sample_rows(_t(spark, sf, "orders").select("o_orderkey"), 110, 100, 5, "o_orderkey")


# Settings, results and metrics

_GRID = """WITH n AS (SELECT 'network' AS alg, t AS cut_type, NULL::VARCHAR AS embed, NULL::INT AS dim, s AS sim FROM range(1, 8) a(t), range(1, 51) b(s)),
f AS (SELECT 'levels' AS alg, NULL AS cut_type, e AS embed, d AS dim, s AS sim FROM (VALUES (NULL), ('ase')) a(e), (VALUES (1), (3), (5)) b(d), range(1, 51) c(s)
  WHERE NOT coalesce(e IS NULL AND d IN (3, 5), false) AND NOT coalesce(e IS NOT NULL AND d = 1, false))
SELECT alg, coalesce(cut_type, -1)::INT AS cut_type, embed, coalesce(dim, -1)::INT AS dim, sim::INT AS sim FROM n
UNION ALL SELECT alg, coalesce(cut_type, -1)::INT, embed, coalesce(dim, -1)::INT, sim::INT FROM f"""


@query(_GRID)
def settings_grid(spark, sf):
    sims = ("int", list(range(1, 51)))
    network = tables.grid(spark, alg=("string", ["network"]), cut_type=("int", list(range(1, 8))), sim=sims)
    plain = tables.grid(spark, alg=("string", ["levels"]), embed=("string", [None, "ase"]), dim=("int", [1, 3, 5]), sim=sims)
    plain = tables.without(plain, F.col("embed").isNull() & F.col("dim").isin(3, 5), F.col("embed").isNotNull() & (F.col("dim") == 1))
    return tables.grids(network, plain).select("alg", "cut_type", "embed", "dim", "sim").na.fill(-1, ["cut_type", "dim"])


@query("SELECT l_linenumber, round(avg(l_discount) FILTER (WHERE l_returnflag = 'A'), 8) AS a, round(avg(l_discount) FILTER (WHERE l_returnflag = 'N'), 8) AS n, round(avg(l_discount) FILTER (WHERE l_returnflag = 'R'), 8) AS r FROM lineitem GROUP BY 1")
def result_pivot(spark, sf):
    each = _t(spark, sf, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.round(F.avg("l_discount"), 8).alias("v"))
    return tables.by_method(each, "l_linenumber", "l_returnflag", ["A", "N", "R"], "v").toDF("l_linenumber", "a", "n", "r")


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount < l_tax) AS wins, round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 6) AS t FROM lineitem GROUP BY 1")
def paired_t(spark, sf):
    return tables.paired(_t(spark, sf, "lineitem"), "l_returnflag", "l_discount", "l_tax").withColumn("t", F.round("t", 6))


_YP = f"SELECT l_linenumber, (l_returnflag = 'R')::INT AS y, l_discount * 8 + 0.1 AS p, avg((l_returnflag = 'R')::INT) OVER () AS m FROM lineitem"


@query(f"""SELECT l_linenumber, round(avg((y - p) * (y - p)), 8) AS mse, round(avg((y - p) * (y - p)) / avg((y - m) * (y - m)), 8) AS smse, round(avg((y <> (p >= 0.5)::INT)::INT), 8) AS wrong,
  round(avg((y - p) * (y - p)), 8) AS brier, round(-avg(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15))), 6) AS log_loss FROM ({_YP}) GROUP BY 1""")
def metrics_by_group(spark, sf):
    f = _t(spark, sf, "lineitem").select("l_linenumber", encode.is_text(F.col("l_returnflag"), "R").alias("y"), (F.col("l_discount") * 8 + 0.1).alias("p"))
    f = f.join(F.broadcast(f.agg(F.avg("y").alias("m"))))
    y, p = F.col("y"), F.col("p")
    each = {"mse": (metrics.mse(y, p), 8), "smse": (metrics.standardised_mse(y, p, F.col("m")), 8), "wrong": (metrics.misclassification(y, p), 8), "brier": (metrics.brier(y, p), 8), "log_loss": (metrics.log_loss(y, p), 6)}
    return f.groupBy("l_linenumber").agg(*(F.round(c, d).alias(k) for k, (c, d) in each.items()))


# Stored forests


def listed(nodes: DataFrame) -> DataFrame:
    """Node rows with level sets as text and no nulls but in what a kind of node lacks."""
    sets = (F.array_join(c, ",").alias(c) for c in ("lvals", "rvals"))
    return nodes.select("tree", "nid", "is_leaf", "mu", F.coalesce("is_cat", F.lit(False)).alias("is_cat"), F.coalesce("var", F.lit(-1)).alias("var"), "cut", *sets)


@query("""SELECT tree, nid::BIGINT AS nid, is_leaf, mu::DOUBLE AS mu, is_cat, var, cut::DOUBLE AS cut, lvals, rvals FROM (VALUES (0, 1, false, NULL, false, 0, 0.05, NULL, NULL), (0, 2, true, -1.0, false, -1, NULL, NULL, NULL), (0, 3, false, NULL, true, 0, NULL, '0', '1,2'),
(0, 6, true, 2.0, false, -1, NULL, NULL, NULL), (0, 7, true, 0.5, false, -1, NULL, NULL, NULL), (1, 1, false, NULL, true, 0, NULL, '1', '0,2'), (1, 2, true, 0.25, false, -1, NULL, NULL, NULL),
(1, 3, false, NULL, false, 1, 0.03, NULL, NULL), (1, 6, true, -0.5, false, -1, NULL, NULL, NULL), (1, 7, true, 1.5, false, -1, NULL, NULL, NULL), (2, 1, true, 0.125, false, -1, NULL, NULL, NULL))
AS n(tree, nid, is_leaf, mu, is_cat, var, cut, lvals, rvals)""")
def forest_table_function(spark, sf):
    forest_text.register(spark)
    spark.createDataFrame(list(enumerate(TEXTS)), "tree int, text string").createOrReplaceTempView("forest_texts")
    return listed(spark.sql("SELECT tree, n.* FROM forest_texts, LATERAL forest_nodes(text) AS n"))


SQL["parse_forest"] = SQL["forest_table_function"]
SQL["variable_counts"] = "SELECT * FROM (VALUES (true, 0, 2::BIGINT), (false, 0, 1), (false, 1, 1)) AS v(is_cat, var, n_rules)"


@query(f"SELECT * FROM (VALUES {', '.join('(%d, %r)' % (i, t) for i, t in enumerate(TEXTS))}) AS t(tree, raw)".replace("'1 ", "E'1 ").replace("AS t(tree, raw)", "AS t(tree, text)"))
def write_forest(spark, sf):
    return forest_text.forest_text(forest_text.node_lines(_nodes(spark)), "tree")


@query("SELECT * FROM (VALUES ('b50', 8, '0,2,3,5,7', 'b50'), ('4a0', 8, '1,4,6', '4a0'), ('8', 3, '0', '8'), ('6', 3, '1,2', '6'), ('81c', 9, '0,7,8,9', '81c'), ('000', 8, '', '000')) AS h(hex, k, levels, back)")
def level_bitmaps(spark, sf):
    h = spark.createDataFrame([("b50", 8), ("4a0", 8), ("8", 3), ("6", 3), ("81c", 9), ("000", 8)], "hex string, k int").withColumn("l", forest_text.hex_levels(F.col("hex")))
    return h.select("hex", "k", F.array_join("l", ",").alias("levels"), forest_text.levels_hex(F.col("l"), F.col("k")).alias("back"))


@query("""SELECT * FROM (VALUES (0, 1::BIGINT, 'root'), (0, 2, 'leaf'), (0, 3, 'prunable'), (0, 6, 'leaf'), (0, 7, 'leaf'), (1, 1, 'root'), (1, 2, 'leaf'), (1, 3, 'prunable'), (1, 6, 'leaf'), (1, 7, 'leaf'), (2, 1, 'stump')) AS n(tree, nid, kind)""")
def node_kinds(spark, sf):
    return forest.node_types(_nodes(spark), "tree").select("tree", "nid", "kind")


@query("SELECT * FROM (VALUES (0, 5::BIGINT, 3::BIGINT, 2), (1, 5, 3, 2), (2, 1, 1, 0)) AS s(tree, n_nodes, n_leaves, depth)")
def tree_shapes(spark, sf):
    return forest.tree_shapes(_nodes(spark), "tree")


@query("SELECT * FROM (VALUES (0, 2::BIGINT, 0, -1.0::DOUBLE, 0.05::DOUBLE), (0, 3, 0, 0.05, 1.0), (0, 6, 0, 0.05, 1.0), (0, 7, 0, 0.05, 1.0), (1, 6, 1, -1.0, 0.03), (1, 7, 1, 0.03, 1.0)) AS i(tree, nid, var, low, high)")
def available_intervals(spark, sf):
    return forest.available_intervals(_nodes(spark), "tree")


@query("SELECT * FROM (VALUES (0, 6::BIGINT, 0, '0'), (0, 7, 0, '1,2'), (1, 2, 0, '1'), (1, 3, 0, '0,2'), (1, 6, 0, '0,2'), (1, 7, 0, '0,2')) AS i(tree, nid, var, levels)")
def available_levels(spark, sf):
    return forest.available_levels(_nodes(spark), "tree").withColumn("levels", F.array_join("levels", ","))


@query(f"SELECT DISTINCT l_orderkey, l_linenumber, l_discount, l_tax, coalesce({FLAGS}, -1) AS flag, v0 + v1 + 0.125 AS score FROM ({_VALUES})")
def score_by_joins(spark, sf):
    key = (*KEY, "l_discount", "l_tax", "flag")
    return forest.score_by_joins(_frame(spark, sf).select(*key).distinct(), _nodes(spark), *ARGS, *key).na.fill(-1, ["flag"])


@query(f"SELECT l_orderkey, l_linenumber, 0 AS tree, l0::BIGINT AS nid, v0 AS mu FROM ({_VALUES}) WHERE l0 IS NOT NULL UNION ALL SELECT l_orderkey, l_linenumber, 1, l1, v1 FROM ({_VALUES}) WHERE l1 IS NOT NULL UNION ALL SELECT l_orderkey, l_linenumber, 2, 1, 0.125 FROM lineitem")
def rows_in_boxes(spark, sf):
    return forest.rows_in_boxes(_frame(spark, sf), forest.leaf_boxes(_nodes(spark), "tree"), *ARGS).select(*KEY, "tree", "nid", "mu")


@query(f"SELECT l_orderkey, l_linenumber, 0 AS tree, l0::BIGINT AS nid, v0 AS mu FROM ({_VALUES}) UNION ALL SELECT l_orderkey, l_linenumber, 1, l1, v1 FROM ({_VALUES}) UNION ALL SELECT l_orderkey, l_linenumber, 2, 1, 0.125 FROM lineitem")
def tree_fits(spark, sf):
    return forest.tree_fits(_frame(spark, sf), _forest(), *ARGS, *KEY)


@query(f"SELECT id, 0 AS chain, draw, round(value, 8) AS value FROM ({_DRAWS})")
def predict_draws(spark, sf):
    return sampler.predict_draws(_fits(spark), _frame(spark, sf), "id", *ARGS).withColumn("value", F.round("value", 8))


@query(f"SELECT id, round(avg(value), 8) AS mean FROM ({_DRAWS}) GROUP BY id")
def posterior_mean(spark, sf):
    return summary.posterior_mean(sampler.predict_draws(_fits(spark), _frame(spark, sf), "id", *ARGS), "id").withColumn("mean", F.round("mean", 8))


@query(f"SELECT id, 0 AS chain, round(({_D0} + {_D1}) / 2, 8) AS value FROM ({_VALUES})")
def predict_mean(spark, sf):
    return sampler.predict_draws(_fits(spark), _frame(spark, sf), "id", *ARGS, mean_only=True).withColumn("value", F.round("value", 8))


@query(f"SELECT id, round(({_D0} + {_D1}) / 2, 8) AS mean FROM ({_VALUES})")
def predict_column(spark, sf):
    column = sampler.predict_column(_fits(spark), (0,), *ARGS)
    return _frame(spark, sf).select("id", F.round(column("l_discount", "l_tax", "flag"), 8).alias("mean"))


@query(f"SELECT id, 0 AS chain, draw, round({_cdf('value')}, 6) AS value FROM ({_DRAWS})")
def predict_probit(spark, sf):
    return sampler.predict_probit(_fits(spark), _frame(spark, sf), "id", *ARGS).withColumn("value", F.round("value", 6))


@query(f"SELECT id, round(avg({_cdf('value')}), 6) AS mean FROM ({_DRAWS}) GROUP BY id")
def posterior_probability(spark, sf):
    return summary.posterior_mean(sampler.predict_probit(_fits(spark), _frame(spark, sf), "id", *ARGS), "id").withColumn("mean", F.round("mean", 6))


@query("SELECT l_linenumber, round(avg(l_discount), 8) AS mean, round(quantile_cont(l_discount, 0.025), 8) AS lower, round(quantile_cont(l_discount, 0.975), 8) AS upper FROM lineitem GROUP BY 1")
def posterior_summary_hf7(spark, sf):
    got = summary.summarize(_t(spark, sf, "lineitem"), "l_linenumber", "l_discount", method="hf7")
    return got.select("l_linenumber", *(F.round(c, 8).alias(c) for c in ("mean", "lower", "upper")))


_HF5 = """WITH r AS (SELECT l_linenumber, l_extendedprice AS x, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_linenumber) AS n FROM lineitem),
h AS (SELECT *, least(greatest(n * 0.025 + 0.5, 1.0), n)::DOUBLE AS a, least(greatest(n * 0.975 + 0.5, 1.0), n)::DOUBLE AS b FROM r)
SELECT l_linenumber, round(avg(x), 4) AS mean, round(max(x) FILTER (WHERE k = floor(a)) + max(a - floor(a)) * (max(x) FILTER (WHERE k = least(floor(a) + 1, n)) - max(x) FILTER (WHERE k = floor(a))), 4) AS lower,
  round(max(x) FILTER (WHERE k = floor(b)) + max(b - floor(b)) * (max(x) FILTER (WHERE k = least(floor(b) + 1, n)) - max(x) FILTER (WHERE k = floor(b))), 4) AS upper FROM h GROUP BY 1"""


@query(_HF5)
def posterior_summary_hf5(spark, sf):
    got = summary.summarize(_t(spark, sf, "lineitem"), "l_linenumber", "l_extendedprice")
    return got.select("l_linenumber", *(F.round(c, 4).alias(c) for c in ("mean", "lower", "upper")))


@query("SELECT range::INT AS sweep, ((range - 20) // 7)::INT AS draw FROM range(100) WHERE range >= 20 AND (range - 20) % 7 = 0")
def kept_draws(spark, sf):
    return summary.kept_draws(spark.range(100).select(F.col("id").cast("int").alias("sweep")), 20, 7)


@query("SELECT i, j, round(count(*) / 2, 8) AS share FROM (SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey // 2 = b.n_regionkey // 2 UNION ALL SELECT a.n_nationkey, b.n_nationkey FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND (a.n_nationkey < 1) = (b.n_nationkey < 1)) GROUP BY 1, 2")
def coclustering(spark, sf):
    return forest.cocluster(_nation_leaves(spark, sf), "n_nationkey", 2).withColumn("share", F.round("share", 8))


def _nation_leaves(spark, sf) -> DataFrame:
    n = _t(spark, sf, "nation")
    pair = n.select(F.lit(0).alias("tree"), F.expr("CAST(n_regionkey DIV 2 + 1 AS BIGINT)").alias("nid"), "n_nationkey")
    return pair.union(n.select(F.lit(1), F.expr("CAST(IF(n_nationkey < 1, 2, 3) AS BIGINT)"), "n_nationkey"))


@query("SELECT n_nationkey AS i, (1 + (n_nationkey >= 1)::INT) / 2.0::DOUBLE AS share FROM nation")
def kernel_diagonal_compat(spark, sf):
    return forest.kernel_diagonal(_nation_leaves(spark, sf), "n_nationkey", 2, compat=True)


@query("SELECT n_nationkey AS i, 1.0::DOUBLE AS share FROM nation")
def kernel_diagonal(spark, sf):
    return forest.kernel_diagonal(_nation_leaves(spark, sf), "n_nationkey", 2)


_G = "count(*) FILTER (WHERE l_discount < 0.05) AS nl, count(*) FILTER (WHERE l_discount >= 0.05) AS nr, sum(round(l_tax, 2)) FILTER (WHERE l_discount < 0.05) AS sl, sum(round(l_tax, 2)) FILTER (WHERE l_discount >= 0.05) AS sr"
_LIL = lambda n, s: f"(-0.5 * ln(4 + ({n}) / 4.0::DOUBLE) + 0.5 * (({s}) / 4) * (({s}) / 4) / (4 + ({n}) / 4.0::DOUBLE))"
_LOG = "(ln(0.95::DOUBLE) + 2 * ln(1 - 0.95 / 4.0::DOUBLE) - ln(1 - 0.95::DOUBLE) + ln(0.5::DOUBLE) - ln(0.5::DOUBLE))"


@query(f"SELECT l_returnflag, round({_LIL('nl', 'sl')} + {_LIL('nr', 'sr')} - {_LIL('nl + nr', 'sl + sr')} + ln(0.95::DOUBLE) + 2 * ln(1 - 0.95::DOUBLE / 4) - ln(1 - 0.95::DOUBLE) + ln(0.5::DOUBLE) - ln(0.5::DOUBLE), 4) AS log_ratio FROM (SELECT l_returnflag, {_G} FROM lineitem GROUP BY 1)")
def grow_ratio(spark, sf):
    low, tax = F.col("l_discount") < 0.05, F.round("l_tax", 2)
    sums = _t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_if(low).alias("nl"), F.count_if(~low).alias("nr"), F.sum(F.when(low, tax)).alias("sl"), F.sum(F.when(~low, tax)).alias("sr"))
    return forest.grow_log_ratio(sums, 0.5, 2.0, 0, 1, 1).select("l_returnflag", F.round("log_ratio", 4).alias("log_ratio"))


# Graphs


def _chain(spark, sf) -> DataFrame:
    return _t(spark, sf, "nation").where("n_nationkey > 0").select((F.col("n_nationkey") - 1).alias("src"), F.col("n_nationkey").alias("dst"))


def _pairs() -> list[tuple[int, int]]:
    return [(i, i + 1) for i in range(N_TABLE - 1)]


@query("SELECT n_nationkey - 1 AS src, n_nationkey AS dst FROM nation WHERE n_nationkey > 0 UNION ALL SELECT n_nationkey, n_nationkey - 1 FROM nation WHERE n_nationkey > 0")
def symmetric_edges(spark, sf):
    return graph.symmetric(_chain(spark, sf))


@query("SELECT n_nationkey - 1 AS src, n_nationkey AS dst FROM nation WHERE n_nationkey > 0")
def unique_edges(spark, sf):
    return graph.undirected(graph.symmetric(_chain(spark, sf)))


@query("SELECT n_nationkey - 1 AS src, n_nationkey AS dst, 1.0::DOUBLE AS weight FROM nation WHERE n_nationkey > 0")
def edge_list(spark, sf):
    return readers.edges_from_rows(_chain(spark, sf))


@query("SELECT n_nationkey - 1 AS src, n_nationkey AS dst, n_regionkey + 0.5::DOUBLE AS weight FROM nation WHERE n_nationkey > 0")
def weighted_edge_list(spark, sf):
    n = _t(spark, sf, "nation").where("n_nationkey > 0")
    return readers.edges_from_rows(n.selectExpr("n_nationkey - 1 AS a", "n_nationkey AS b", "n_regionkey + 0.5D AS w"))


@query("SELECT n_nationkey AS vertex, " + ", ".join(f"(abs(n_nationkey - {j}) = 1)::INT::DOUBLE AS v{j}" for j in range(N_TABLE)) + " FROM nation")
def adjacency_matrix(spark, sf):
    return graph.adjacency(readers.edges_from_rows(_chain(spark, sf)), list(range(N_TABLE))).toDF("vertex", *(f"v{j}" for j in range(N_TABLE)))


@query("SELECT n_nationkey - 1 AS src, n_nationkey AS dst, 1.0::DOUBLE AS weight FROM nation WHERE n_nationkey > 0")
def edges_of_matrix(spark, sf):
    return readers.edges_from_matrix(graph.adjacency(readers.edges_from_rows(_chain(spark, sf)), list(range(N_TABLE))))


@query("SELECT a.n_nationkey AS src, b.n_nationkey AS dst, abs(a.n_nationkey - b.n_nationkey)::DOUBLE AS distance FROM nation a, nation b")
def all_distances(spark, sf):
    return graph.all_distances(_t(spark, sf, "nation").select(F.col("n_nationkey").alias("v")), readers.edges_from_rows(_chain(spark, sf)))


@query("SELECT a.n_nationkey AS src, b.n_nationkey AS dst, CASE WHEN a.n_nationkey = b.n_nationkey THEN 0.0 WHEN a.n_regionkey = b.n_regionkey THEN 1.0 ELSE 625.0 END::DOUBLE AS distance FROM nation a, nation b")
def all_distances_apart(spark, sf):
    n = _t(spark, sf, "nation")
    same = n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).selectExpr("a.n_nationkey AS a", "b.n_nationkey AS b")
    return graph.all_distances(n.select(F.col("n_nationkey").alias("v")), readers.edges_from_rows(same))


def _sides(spark, sides) -> DataFrame:
    return spark.createDataFrame([(v, k == 0) for k, side in enumerate(sides) for v in side], "v int, is_left boolean")


@query("SELECT n_nationkey AS v, n_nationkey <= 9 AS is_left FROM nation")
def cut_tree_edge(spark, sf):
    return _sides(spark, graph.without_edge(range(N_TABLE), _pairs(), 9))


@query("SELECT n_nationkey - 1 AS src, least(n_nationkey, 25 - n_nationkey)::DOUBLE AS smaller FROM nation WHERE n_nationkey > 0")
def smaller_sides(spark, sf):
    return spark.createDataFrame([(a, float(s)) for (a, _), s in zip(_pairs(), graph.smaller_sides(range(N_TABLE), _pairs()), strict=True)], "src int, smaller double")


@query("SELECT n_nationkey AS v, n_nationkey < 12 AS is_left FROM nation")
def fiedler_split(spark, sf):
    return _sides(spark, graph.fiedler(range(N_TABLE), _pairs()))


@query("SELECT n_nationkey AS v, n_nationkey <= 11 AS is_left FROM nation")
def most_even_cut(spark, sf):
    """The chain of nations with the last one moved to the middle, so that one cut is the most even."""
    return _sides(spark, graph.graph_split(range(N_TABLE), [*_pairs()[:-1], (12, N_TABLE - 1)], 4, np.random.default_rng(1)))


@query("SELECT n_nationkey AS v, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS component FROM nation")
def local_components(spark, sf):
    n = _t(spark, sf, "nation").collect()  # a fixed table of 25 rows
    edges = [(a["n_nationkey"], b["n_nationkey"]) for a in n for b in n if a["n_nationkey"] < b["n_nationkey"] and a["n_regionkey"] == b["n_regionkey"]]
    return spark.createDataFrame([(v, g[0]) for g in graph.components_of([r["n_nationkey"] for r in n], edges) for v in g], "v int, component int")


# Fits, by what they recover


@query("SELECT * FROM (VALUES (0, true), (1, true), (2, true)) AS d(depth, close)")
def prior_depths(spark, sf):
    """Of 4000 trees from the prior, is the share of nodes that split at a depth near its probability?"""
    texts = sampler.sample_prior(spark, sampler.Design([None, None], [5]), 4000)
    nodes = forest_text.parse_forest(texts).withColumn("depth", (F.length(F.bin("nid")) - 1).cast("int"))
    split = nodes.where("depth < 3").groupBy("depth").agg(F.avg((~F.col("is_leaf")).cast("int")).alias("share"))
    return split.select("depth", (F.abs(F.col("share") - 0.95 * F.pow(1 + F.col("depth"), F.lit(-2.0))) < 0.03).alias("close"))


@query("SELECT l_linenumber, true AS close FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def fit_recovers_means(spark, sf):
    """Does a fit on the cells of all line items come within a tenth of a standard deviation of each cell's mean?"""
    f = _t(spark, sf, "lineitem").selectExpr("CAST(l_linenumber - 1 AS INT) AS line", "l_linenumber * 1000 + l_extendedprice / 1000 AS y", "0 AS chain")
    fits = sampler.fit_chains(encode.cells(f, "y", "chain", "line"), "y", [], ["line"], sampler.Design([], [7]), trees=20, draws=30, burn=60, cells=True)
    truth = f.groupBy("line").agg(F.avg("y").alias("mean"))
    got = sampler.predict_draws(fits, truth, "line", [], ["line"], mean_only=True).select("line", "value")
    return got.join(truth, "line").select((F.col("line") + 1).cast("int").alias("l_linenumber"), (F.abs(F.col("value") - F.col("mean")) < 200).alias("close"))


@query("SELECT DISTINCT l_linenumber, true AS close FROM lineitem")
def probit_recovers_shares(spark, sf):
    """Does a binary fit of a label that follows the line number give its share?"""
    f = _t(spark, sf, "lineitem").selectExpr("CAST(l_linenumber - 1 AS INT) AS line", "CAST(l_linenumber > 4 AS INT) AS y", "0 AS chain")
    fits = sampler.fit_chains(encode.cells(f, "y", "chain", "line"), "y", [], ["line"], sampler.Design([], [7]), probit=True, trees=20, draws=30, burn=60, cells=True)
    got = sampler.predict_draws(fits, f.select("line").distinct(), "line", [], ["line"], mean_only=True, probit=True)
    return got.select((F.col("line") + 1).cast("int").alias("l_linenumber"), ((F.col("value") > 0.5) == (F.col("line") > 3)).alias("close"))


def _network(spark, sf, probit: bool) -> DataFrame:
    """A response of two halves of the chain of nations, fitted without nation 12: does every nation two steps or
    more from the border, that one included, come out on its side?"""
    design = sampler.Design([], [N_TABLE], {0: _pairs()}, 1)
    f = _t(spark, sf, "customer").selectExpr("c_nationkey", "0 AS chain", "CAST(c_nationkey >= 10 AS INT) AS one", "IF(c_nationkey >= 10, 5.0D, -5.0D) + c_acctbal / 10000 AS y").where("c_nationkey <> 12")
    every = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    fits = sampler.fit_chains(f if probit else encode.cells(f, "y", "chain", "c_nationkey"), "one" if probit else "y", [], ["c_nationkey"], design, probit=probit, trees=20, draws=30, burn=60, cells=not probit)
    got = sampler.predict_draws(fits, every, "c_nationkey", [], ["c_nationkey"], mean_only=True, probit=probit)
    border = F.abs(F.col("c_nationkey") - 9.5) < 2
    return got.select(F.col("c_nationkey").alias("n_nationkey"), (border | ((F.col("value") > (0.5 if probit else 0.0)) == (F.col("c_nationkey") >= 10))).alias("close"))


@query("SELECT n_nationkey, true AS close FROM nation")
def network_fit(spark, sf):
    return _network(spark, sf, False)


@query("SELECT n_nationkey, true AS close FROM nation")
def network_probit_fit(spark, sf):
    return _network(spark, sf, True)


@query("SELECT 'sparse' AS fit, true AS close")
def sparse_fit(spark, sf):
    """With the sparse prior, does the one predictor that matters of five get most of the weight?"""
    f = _t(spark, sf, "lineitem").selectExpr("l_discount * 20 - 1 AS a", "l_tax * 25 - 1 AS b", "l_quantity / 25 - 1 AS c", "l_extendedprice / 200000 AS d", "(l_linenumber - 4) / 3 AS e", "l_quantity / 25 AS y", "0 AS chain")
    trace = sampler.fit_passes(f, "y", list("abcde"), [], sampler.Design([None] * 5), sparse=True, trees=10, draws=40, burn=80, trace=True)
    return summary.kept_draws(trace.drop("draw"), 80).agg((F.avg(F.get("theta", F.lit(2))) > 0.6).alias("close")).select(F.lit("sparse").alias("fit"), "close")


@query("SELECT 'trace' AS fit, 50::BIGINT AS sweeps, true AS close")
def fit_trace(spark, sf):
    """The trace of a fit: a row per sweep, and no more refusals than proposals."""
    f = encode.cells(_t(spark, sf, "customer").withColumn("chain", F.lit(0)), "c_acctbal", "chain", "c_nationkey")
    t = sampler.fit_chains(f, "c_acctbal", [], ["c_nationkey"], sampler.Design([], [N_TABLE]), trees=10, draws=20, burn=30, cells=True, trace=True)
    good = (F.col("level_refused") <= F.col("level_tried")) & (F.col("accepted") <= 10) & (F.col("sigma") > 0) & (F.col("axis_tried") == 0)
    return t.agg(F.count("*").alias("sweeps"), F.bool_and(good).alias("close")).select(F.lit("trace").alias("fit"), "sweeps", "close")


@query("SELECT DISTINCT l_returnflag, true AS close FROM lineitem")
def fit_by_group(spark, sf):
    """A fit of its own for every return flag, and its predictions brought back to the rows of that flag."""
    f = _t(spark, sf, "lineitem").selectExpr("l_returnflag", "CAST(l_linenumber - 1 AS INT) AS line", f"l_linenumber * (({FLAGS}) + 1) + l_discount AS y")
    fits = sampler.fit_chains(encode.cells(f, "y", "l_returnflag", "line"), "y", [], ["line"], sampler.Design([], [7]), keys=("l_returnflag",), trees=20, draws=30, burn=60, cells=True)
    truth = f.groupBy("l_returnflag", "line").agg(F.avg("y").alias("mean"))
    got = sampler.predict_draws(fits, truth, "line", [], ["line"], keys=("l_returnflag",), mean_only=True, own=True)
    return got.join(truth, ["l_returnflag", "line"]).groupBy("l_returnflag").agg((F.max(F.abs(F.col("value") - F.col("mean"))) < 1.0).alias("close"))


@query("SELECT * FROM (VALUES ('cut', true), ('cut_off_ends', true), ('predictor', true), ('sides', true)) AS c(rule, close)")
def prior_rules(spark, sf):
    """Are root rules of the prior spread evenly over the predictors, uniform cuts around 0, listed cuts never at
    the ends of their list, and level sets never empty?"""
    design = sampler.Design([None, np.array([-0.9, -0.3, 0.3, 0.9])], [5])
    roots = forest_text.parse_forest(sampler.sample_prior(spark, design, 4000)).where("nid = 1 AND NOT is_leaf")
    share = lambda c: F.avg(c.cast("int"))
    a, b, c = ~F.col("is_cat") & (F.col("var") == 0), ~F.col("is_cat") & (F.col("var") == 1), F.col("is_cat")
    checks = {
        "predictor": (F.abs(share(a) - 1 / 3) < 0.03) & (F.abs(share(b) - 1 / 3) < 0.03),
        "cut": (F.abs(F.avg(F.when(a, F.col("cut")))) < 0.05) & (F.abs(F.stddev_samp(F.when(a, F.col("cut"))) - 3**-0.5) < 0.03),
        "cut_off_ends": F.bool_and(~b | (F.abs("cut") < 0.5)),
        "sides": F.bool_and(~c | (F.size("lvals") > 0) & (F.size("rvals") > 0) & (F.size("lvals") + F.size("rvals") == 5)),
    }
    one = roots.agg(*(v.alias(k) for k, v in checks.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("close")) for k in sorted(checks)))).alias("r")).select("r.*")


@query("SELECT range::INT AS cut_type, true AS close FROM range(8)")
def network_prior(spark, sf):
    """On a chain of levels, is a side of every root rule of each cut type one stretch of the chain?"""
    out = None
    for kind in range(8):
        design = sampler.Design([], [12], {0: [(i, i + 1) for i in range(11)]}, kind)
        roots = forest_text.parse_forest(sampler.sample_prior(spark, design, 60)).where("nid = 1 AND NOT is_leaf")
        stretch = lambda c: F.array_max(c) - F.array_min(c) + 1 == F.size(c)
        # Random weights may cut a chain in more than two places by the signs of their vector, but rarely.
        one = roots.agg((F.avg((stretch("lvals") & stretch("rvals")).cast("int")) >= (0.9 if kind in (0, 2, 7) else 1.0)).alias("close")).select(F.lit(kind).alias("cut_type"), "close")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'sigma' AS fit, true AS close")
def noise_draws(spark, sf):
    """Balances follow nothing: is the noise of their fit near their standard deviation?"""
    f = encode.cells(_t(spark, sf, "customer").withColumn("chain", F.lit(0)), "c_acctbal", "chain", "c_nationkey")
    fits = sampler.fit_chains(f, "c_acctbal", [], ["c_nationkey"], sampler.Design([], [N_TABLE]), trees=20, draws=40, burn=40, cells=True)
    sd = _t(spark, sf, "customer").agg(F.stddev_samp("c_acctbal").alias("sd"))
    return fits.where("tree = 0").agg(F.avg("sigma").alias("sigma")).crossJoin(sd).select(F.lit("sigma").alias("fit"), (F.abs(F.col("sigma") / F.col("sd") - 1) < 0.15).alias("close"))


@query("SELECT DISTINCT l_linenumber, true AS close FROM lineitem")
def summary_with_noise(spark, sf):
    """With noise of 2, do 95 % intervals of draws that hardly vary have a width of about 4 times 1.96?"""
    draws = _t(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.avg("l_discount").alias("value")).join(spark.range(4000).withColumnRenamed("id", "draw"))
    got = summary.summarize(draws, "l_linenumber", sigma=spark.range(4000).select(F.col("id").alias("draw"), F.lit(2.0).alias("sigma")))
    return got.select("l_linenumber", (F.abs((F.col("upper") - F.col("lower")) / (4 * 1.96) - 1) < 0.08).alias("close"))


@query("SELECT tree, nid::BIGINT AS nid, rvals, complement FROM (VALUES (0, 3, '1,2', '1,2'), (1, 1, '0,2', '0,2')) AS c(tree, nid, rvals, complement)")
def level_complement(spark, sf):
    """The right side of a rule on levels: those available that the left side lacks."""
    rules = _nodes(spark).where("is_cat")
    rest = F.array_except(F.sequence(F.lit(0), F.col("k") - 1), "lvals")
    return rules.select("tree", "nid", F.array_join("rvals", ",").alias("rvals"), F.array_join(rest, ",").alias("complement"))


# Files, written to the shared folder first


def _written(spark, df: DataFrame, kind: str, **options) -> str:
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    df.coalesce(1).write.options(**options).format(kind).save(path)
    return path


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def read_csv(spark, sf):
    n = _t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return readers.read_csv(spark, _written(spark, n, "csv"), "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def read_csv_inferred(spark, sf):
    n = _t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return readers.read_csv(spark, _written(spark, n, "csv", header=True), header=True)


@query("SELECT n_nationkey, CASE WHEN n_regionkey > 0 THEN n_regionkey::DOUBLE END AS x, n_name || ' of ' || n_regionkey AS n_name FROM nation")
def read_whitespace(spark, sf):
    lines = _t(spark, sf, "nation").selectExpr("concat(n_nationkey, '   ', if(n_regionkey > 0, CAST(n_regionkey AS STRING), '?'), '  \"', n_name, ' of ', n_regionkey, '\"') AS value")
    return readers.read_whitespace(spark, _written(spark, lines, "text"), "n_nationkey int, x double, n_name string")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey > 2")
def read_after_preamble(spark, sf):
    lines = _t(spark, sf, "nation").orderBy("n_nationkey").selectExpr("CAST(n_nationkey AS STRING) AS value")
    return readers.read_whitespace(spark, _written(spark, lines, "text"), "n_nationkey int", skip=3)


@query("SELECT (n_nationkey // 4)::BIGINT AS record, string_agg(n_nationkey || ' ' || n_regionkey, ' ' ORDER BY n_nationkey) AS fields FROM nation GROUP BY 1")
def read_records(spark, sf):
    lines = _t(spark, sf, "nation").orderBy("n_nationkey").selectExpr("concat(n_nationkey, ' ', n_regionkey) AS value")
    return readers.read_records(spark, _written(spark, lines, "text"), 4).select("record", F.array_join("fields", " ").alias("fields"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def bind_columns(spark, sf):
    n = _t(spark, sf, "nation")
    return readers.bind_columns(n.select("n_nationkey", "n_name").repartition(3), n.select("n_nationkey", "n_regionkey").repartition(5), "n_nationkey")


# Streams


def _stream(spark, sf, table: str) -> DataFrame:
    return spark.readStream.schema(_t(spark, sf, table).schema).parquet(f"{sf}/{table}*.parquet")


def _drained(spark, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives on what is there now, through a table in the shared folder."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    write = lambda batch, k: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query(f"SELECT l_orderkey, l_linenumber, v0 + v1 + 0.125 AS score FROM ({_VALUES})")
def stream_score(spark, sf):
    rows = _stream(spark, sf, "lineitem").selectExpr(*KEY, "l_discount", "l_tax", f"{FLAGS} AS flag")
    return _drained(spark, scoring.score_stream(rows, _forest(), *ARGS).select(*KEY, "score"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(value) AS n, round(sum(value), 4) AS sum_y, round(sum(value * value), 4) AS sum_yy FROM events GROUP BY 1, 2")
def stream_cells(spark, sf):
    cells = scoring.cell_stream(_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "365 days", "1 day", "value", "event_type")
    flat = cells.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("sum_y", 4).alias("sum_y"), F.round("sum_yy", 4).alias("sum_yy"))
    return _drained(spark, flat, "complete")
