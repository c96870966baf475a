import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.functions import encode
from canopy.operators import forest, graph, lineage, sampler, summary, tables
from canopy.sources import forest_text, readers

TEXTS = ["1 r 0 0.05 0\n2 m -1.0\n3 r 1 0 3 8 6\n6 m 2.0\n7 m 0.5", "1 r 1 0 3 4 a\n2 m 0.25\n3 r 0 0.03 1\n6 m -0.5\n7 m 1.5", "1 m 0.125"]


def random_forest(rng, n):
    design = sampler.Design([None, np.array([-0.5, 0.0, 0.5])], [5, 3])
    return [sampler.draw_tree(design, sampler.Prior(n, alpha=0.99, beta=0.5 if k == 0 else 2.0) if k else sampler.Prior(n), rng) for k in range(n)]


def test_flat_forest_equals_single_trees():
    rng = np.random.default_rng(4)
    trees = random_forest(rng, 30)
    x, z = rng.uniform(-1, 1, (500, 2)), np.stack((rng.integers(-1, 6, 500), rng.integers(0, 4, 500)), 1)
    x[:20, 0] = np.nan
    want = sum(t.evaluate(x, z, 500) for t in trees)
    assert np.allclose(forest.FlatForest(trees).total(x, z, 500), want, equal_nan=True) and np.isnan(want).any() and not np.isnan(want).all()


def test_tree_copy_reset_and_text():
    t = forest_text.read_tree(TEXTS[0])
    other = t.copy()
    other.reset()
    assert t.rules and not other.rules and other.leaves == {1: 0.0}
    assert str(t).split("\n") == ["1: x_cont[0] < 0.05", "  2: -1", "  3: x_cat[0] in [0] or [1, 2]", "    6: 2", "    7: 0.5"]


def test_normals_above_a_bound():
    rng = np.random.default_rng(0)
    for low in (-3.0, 0.0, 0.4, 2.0, 9.0, 30.0):
        z = sampler.normal_above(np.full(4000, low), rng)
        assert (z > low).all()
        tail = 0.5 * math.erfc(low / 2**0.5)
        mean = math.exp(-low * low / 2) / (2 * math.pi) ** 0.5 / tail
        assert abs(z.mean() - mean) < 0.06


def test_latent_responses_keep_their_side():
    y = np.array([1, 0] * 50)
    c = sampler.Chain(None, np.zeros((100, 1), int), y, sampler.Design([], [2]), sampler.Prior(5), True, 1)
    c.fit = np.where(np.arange(100) < 50, -9.0, 9.0)
    c.latent()
    assert ((c.target > 0) == (y > 0)).all()


def test_state_of_a_chain_stays_consistent():
    rng = np.random.default_rng(2)
    x, z = rng.uniform(-1, 1, (300, 2)), rng.integers(0, 6, (300, 1))
    y = x[:, 0] + (z[:, 0] > 2) + 0.1 * rng.normal(size=300)
    c = sampler.Chain(x, z, y, sampler.Design([None, None], [6], {0: [(i, i + 1) for i in range(5)]}, 0), sampler.Prior(12, tau=0.3), False, 5)
    for _ in range(60):
        c.step()
        trees = c.trees
        assert np.allclose(sum(t.evaluate(x, z, 300) for t in trees), c.fit)
        for m, t in enumerate(trees):
            assert (np.array(c.nids[m])[c.at[m]] == t.route(x, z, 300)).all()
            assert (np.bincount(c.at[m], minlength=len(c.nids[m])) == c.size[m]).all()
    used = Counter(r.var + 2 * r.is_cat for t in c.trees for r in t.rules.values())
    assert [used[v] for v in range(3)] == c.counts.tolist()


def test_stump_leaf_draws_follow_their_posterior():
    y = np.array([0.5, 1.5, 1.0, 2.0])
    c = sampler.Chain(None, np.zeros((4, 1), int), y, sampler.Design([], [1]), sampler.Prior(1, tau=0.7), False, 3)
    got = []
    for _ in range(6000):
        c.sigma = 1.0
        c.step()
        got.append(c.fit[0])
    precision = 1 / 0.7**2 + 4
    assert abs(np.mean(got) - y.sum() / precision) < 0.03 and abs(np.std(got) - precision**-0.5) < 0.03


def test_chain_without_information_gives_the_prior():
    """With no rows the chain samples trees from the prior."""
    c = sampler.Chain(np.zeros((0, 1)), None, np.zeros(0), sampler.Design([None]), sampler.Prior(40), False, 8)
    roots, n = 0, 0
    for k in range(1500):
        c.step()
        if k > 100:
            roots += sum(bool(t.rules) for t in c.rules)
            n += len(c.rules)
    assert abs(roots / n - 0.95) < 0.02


def test_a_seed_fixes_the_fit_whatever_the_order_of_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(0, int(i % 5), float(i % 5 + rng.normal())) for i in range(80)]
    fit = lambda r: sorted(map(tuple, sampler.fit_chains(spark.createDataFrame(r, "chain int, level int, y double"), "y", [], ["level"], sampler.Design([], [5]), trees=5, draws=4, burn=6).select("draw", "tree", "text").collect()))
    assert fit(rows) == fit(rows[::-1])


def test_predictions_in_several_passes(spark, monkeypatch):
    fits = spark.createDataFrame([(0, d, t, x, 0.5, 2.0) for d in range(4) for t, x in enumerate(TEXTS)], "chain int, draw int, tree int, text string, y_mean double, y_sd double")
    rows = spark.createDataFrame([(i, 0.01 * i, 0.02, i % 3) for i in range(12)], "id int, a double, b double, flag int")
    f = lambda **k: sorted(map(tuple, sampler.predict_draws(fits, rows, "id", ["a", "b"], ["flag"], **k).collect()))
    one, mean = f(), f(mean_only=True)
    monkeypatch.setattr(sampler, "FOREST_BYTES", 150)
    assert f() == one and np.allclose(f(mean_only=True), mean)


def test_spanning_trees():
    rng = np.random.default_rng(0)
    square = [(0, 1), (1, 2), (2, 3), (0, 3)]
    left_out = Counter(next(e for e in square if e not in t and e[::-1] not in t) for t in (graph.spanning_tree(range(4), square, rng) for _ in range(2000)))
    assert all(abs(n / 2000 - 0.25) < 0.05 for n in left_out.values()) and len(left_out) == 4
    # A tree's probability goes with the product of its weights: an edge of weight 3 is left out a third as often.
    left_out = Counter(next(e for e in square if e not in t and e[::-1] not in t) for t in (graph.spanning_tree(range(4), square, rng, np.array([3.0, 1, 1, 1])) for _ in range(3000)))
    assert abs(left_out[0, 1] / 3000 - 1 / 10) < 0.03
    assert graph.minimum_tree(range(4), square, [4, 1, 2, 3]) == [(1, 2), (2, 3), (0, 3)]


def test_fiedler_split_is_canonical_and_kept():
    ring = [(i, (i + 1) % 8) for i in range(8)]
    chain = ring[:-1]
    left, right = graph.fiedler(range(8), chain)
    assert (left, right) == ([0, 1, 2, 3], [4, 5, 6, 7])
    memo = {}
    a = graph.graph_split(range(8), chain, 1, np.random.default_rng(0), memo)
    assert graph.graph_split(range(8), chain, 1, np.random.default_rng(1), memo) is a and len(memo) == 1
    heavy = [(a, b, 100.0 if (a, b) != (1, 2) else 0.01) for a, b in chain]
    assert graph.graph_split(range(8), heavy, 1, np.random.default_rng(0))[0] == [0, 1]


def test_records_of_several_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2\n3 4\n5 6\n7 8\n")
    (tmp_path / "b.txt").write_text("9 10\n 11 12\n13 14\n")
    got = {(r["file"][-5:], r["record"]): r["fields"] for r in readers.read_records(spark, str(tmp_path), 2).collect()}
    assert got == {("a.txt", 0): list("1234"), ("a.txt", 1): list("5678"), ("b.txt", 0): ["9", "10", "11", "12"], ("b.txt", 1): ["13", "14"]}


def test_preamble_of_every_file_and_nulls(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text(f"about {name}\n---\n1.5  ? \"x y\"\n\n 2 3 z\n")
    got = readers.read_whitespace(spark, str(tmp_path), "a double, b int, c string", skip=2).collect()
    assert Counter(map(tuple, got)) == {(1.5, None, "x y"): 2, (2.0, 3, "z"): 2}


def test_lines_of_a_file_read_in_blocks(spark, tmp_path):
    (tmp_path / "a").write_text("".join(f"{i} {'x' * (i % 50)}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = readers.numbered_lines(spark, str(tmp_path)).collect()
        assert len(got) == 3000 and all(r["n"] == int(r["value"].split()[0]) for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_with_a_schema_and_by_inference(spark, tmp_path):
    (tmp_path / "a.csv").write_text("state1,state2\nAL, FL\nAL,GA\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path), header=True).collect()] == [("AL", "FL"), ("AL", "GA")]
    assert readers.read_csv(spark, str(tmp_path), "a string, b string", header=True).columns == ["a", "b"]


def test_columns_are_bound_by_position(spark):
    left, right = spark.createDataFrame([(i * 2, f"l{i}") for i in range(50)], "k int, a string"), spark.createDataFrame([(i * 3, f"r{i}") for i in range(50)], "k int, b string")
    got = readers.bind_columns(left.repartition(7), right.repartition(3), "k").collect()
    assert len(got) == 50 and all(r["a"][1:] == r["b"][1:] for r in got)


def test_edge_lists(spark):
    with pytest.raises(ValueError):
        readers.edges_from_rows(spark.createDataFrame([(1,)], "a int"))
    assert readers.edges_from_rows(spark.createDataFrame([(1, 2, 0.5)], "x int, y int, z double")).first()["weight"] == 0.5


def test_row_numbers(spark):
    got = lineage.numbered(spark.range(1000).repartition(9), "id").collect()
    assert all(r["id"] == r["n"] for r in got) and len(got) == 1000


def test_quantiles_of_large_keys(spark):
    rng = np.random.default_rng(6)
    rows = [("ties", float(v)) for v in rng.integers(0, 4, 700)] + [("far", float(v)) for v in rng.normal(size=900)] + [("few", 1.0), ("few", 4.0)] + [("far", None)] * 3
    df = spark.createDataFrame(rows, "k string, v double")
    f = lambda most: {r["k"]: tuple(r)[1:] for r in summary.quantile_hf5(df, "k", "v", 0.025, 0.5, 0.975, most=most).collect()}
    assert f(50) == f(10**6) and len(f(50)) == 3


def test_exact_samples(spark):
    df = spark.range(997)
    for n in (0, 1, 500, 996, 997):
        assert encode.lowest(df, n, 3, "id").where("chosen").count() == n
    assert encode.sample_share(df, 0.3, 3, "id").where("chosen").count() == 299
    assert encode.lowest(df.limit(0), 5, 3, "id").count() == 0
    both = encode.sample_rows(df, 110, 100, 5, "id")
    assert both.count() == 110 and both.where("is_train").count() == 100


def test_p_values_of_paired_t():
    # Two-sided 5 % points of the t distribution with 9, 1 and 49 degrees of freedom.
    for t, n in ((2.262157, 10), (12.7062, 2), (2.009575, 50)):
        assert abs(tables.p_less(-t, n) - 0.025) < 1e-5 and abs(tables.p_less(t, n) - 0.975) < 1e-5
    assert abs(tables.p_less(0.0, 8) - 0.5) < 1e-12


def test_scoring_ways_agree(spark):
    rng = np.random.default_rng(9)
    trees = random_forest(rng, 6)
    rows = spark.createDataFrame([(i, *map(float, rng.uniform(-1, 1, 2)), *map(int, (rng.integers(0, 5), rng.integers(0, 3)))) for i in range(200)], "id int, a double, b double, c int, d int")
    args = (["a", "b"], ["c", "d"])
    nodes = forest_text.parse_forest(spark.createDataFrame([(i, forest_text.write_tree(t)) for i, t in enumerate(trees)], "tree int, text string"))
    case = {r["id"]: r["score"] for r in forest.score(rows, trees, *args, strategy="case").collect()}
    arrow = {r["id"]: r["score"] for r in forest.score(rows, trees, *args, strategy="arrow").collect()}
    joins = {r["id"]: r["score"] for r in forest.score_by_joins(rows, nodes, *args, "id").collect()}
    boxes = {r["id"]: r["s"] for r in forest.rows_in_boxes(rows, forest.leaf_boxes(nodes, "tree"), *args).groupBy("id").agg(F.sum("mu").alias("s")).collect()}
    for other in (arrow, joins, boxes):
        assert other.keys() == case.keys() and all(abs(other[k] - case[k]) < 1e-9 for k in case)


def test_large_forests_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(forest, "BROADCAST_NODES", 3)
    with pytest.raises(ValueError):
        forest.score(spark.range(1).selectExpr("0.1D AS a", "0 AS b"), [forest_text.read_tree(TEXTS[0])], ["a"], ["b"], strategy="arrow")


def test_missing_values_are_not_placed_by_joins(spark):
    nodes = forest_text.parse_forest(spark.createDataFrame([(0, TEXTS[0])], "tree int, text string"))
    rows = spark.createDataFrame([(1, float("nan"), 0), (2, 0.9, 7), (3, None, 0), (4, 0.9, 0)], "id int, a double, c int")
    assert {r["id"]: r["score"] for r in forest.score_by_joins(rows, nodes, ["a"], ["c"], "id").collect()} == {1: None, 2: None, 3: None, 4: 2.0}
