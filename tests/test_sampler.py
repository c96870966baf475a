import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.functions import encode
from canopy.operators import sampler, summary
from canopy.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    level = rng.integers(0, 6, 200) ** 2 // 5
    return spark.createDataFrame([(0, int(v), float(v + rng.normal())) for v in level], "chain int, level int, y double")


def test_cells_fit_as_their_rows(rows):
    design, keep = sampler.Design([], [6]), ["draw", "tree"]
    f = lambda df, **k: sampler.fit_chains(df, "y", [], ["level"], design, trees=5, draws=8, burn=8, **k).toPandas().sort_values(keep)
    whole, cells = f(rows), f(encode.cells(rows, "y", "chain", "level"), cells=True)
    assert [[x.split()[:2] for x in t.split("\n")] for t in whole["text"]] == [[x.split()[:2] for x in t.split("\n")] for t in cells["text"]]
    for c in ("sigma", "y_mean", "y_sd"):
        assert np.allclose(whole[c], cells[c], rtol=1e-6)


def test_registered_fit_has_the_noise_of_balances(spark):
    sd = spark.read.parquet(f"{SF}/customer.parquet").selectExpr("stddev_samp(c_acctbal)").first()[0]
    assert all(0.7 * sd < r["sigma"] < 1.3 * sd for r in catalog.QUERIES["fit_balance"](spark, SF).collect())


def test_predictions_from_stored_draws(spark):
    rng = np.random.default_rng(5)
    data = [(i, 0, i % 4, float(3 * (i % 4) + 0.1 * rng.normal()), int(i % 4 > 1)) for i in range(120)]
    df = spark.createDataFrame(data, "id long, chain int, level int, y double, one int")
    design = sampler.Design([], [4])
    fits = sampler.fit_chains(df, "y", [], ["level"], design, trees=10, draws=10, burn=40)
    draws = sampler.predict_draws(fits, df, "id", [], ["level"])
    assert draws.count() == 120 * 10
    mean = {r["row_id"]: r["mean"] for r in summary.summarize(draws.withColumnRenamed("id", "row_id")).collect()}
    assert all(abs(mean[i] - 3 * (i % 4)) < 0.5 for i in mean) and len(mean) == 120
    probit = sampler.fit_chains(df, "one", [], ["level"], design, probit=True, trees=10, draws=10, burn=40)
    chance = sampler.predict_probit(probit, df, "id", [], ["level"]).toPandas().groupby("id")["value"].mean()
    assert chance[[0, 1]].max() < 0.3 and chance[[2, 3]].min() > 0.7
    trace = sampler.fit_chains(df, "y", [], ["level"], design, trees=10, draws=10, burn=40, trace=True).toPandas()
    assert len(trace) == 50 and trace["draw"].notna().sum() == 10 and all(abs(sum(t) - 1) < 1e-9 for t in trace["theta"])
    kept = fits.toPandas().groupby("draw")["sigma"].first()
    assert np.allclose(trace.dropna(subset="draw").set_index("draw")["sigma"].to_numpy(float), kept)


@pytest.mark.parametrize("low", [-3.0, -0.2, 0.7, 4.0])
def test_sums_of_many_truncated_normals(low):
    rng, n, times = np.random.default_rng(9), 20_000, 300
    got = np.array([sampler.normal_sum(low, n, rng) for _ in range(times)])
    one = sampler.normal_above(np.full(1_000_000, low), rng)
    z = (got - n * one.mean()) / (one.std() * n**0.5)  # the mean of a million is off by 0.14 of these at most, nearly surely 0.42
    assert abs(z.mean()) < 0.6 and 0.85 < z.std() < 1.15
    assert sampler.normal_sum(low, 0, rng) == 0


def test_binary_fit_of_cells(spark):
    """Cells of a number of rows that no task could hold: probabilities are near the shares, so near a half too."""
    n, shares = 40_000_000, [0.02, 0.5, 0.501, 0.9]
    cells = spark.createDataFrame([(0, v, n, round(n * s), round(n * s), 0, 1) for v, s in enumerate(shares)], "chain int, level int, n long, sum_y long, sum_yy long, low int, high int")
    fits = sampler.fit_chains(cells, "y", [], ["level"], sampler.Design([], [4]), probit=True, trees=10, draws=10, burn=40, cells=True)
    got = sampler.predict_draws(fits, cells, "level", [], ["level"], mean_only=True, probit=True).toPandas().set_index("level")["value"]
    assert np.allclose(got.sort_index(), shares, atol=0.02)
    with pytest.raises(Exception, match="0 and 1 alone"):
        sampler.fit_chains(cells.selectExpr("* EXCEPT (sum_yy)", "sum_y + 1 AS sum_yy"), "y", [], ["level"], sampler.Design([], [4]), probit=True, trees=5, draws=2, burn=2, cells=True).count()


def test_binary_cells_fit_as_their_rows(spark):
    rows = spark.createDataFrame([(0, i % 4, int(i % 7 < 2 * (i % 4))) for i in range(2000)], "chain int, level int, one int")
    fit = lambda df, **k: sampler.predict_draws(sampler.fit_chains(df, "one", [], ["level"], sampler.Design([], [4]), probit=True, trees=10, draws=100, burn=50, **k), rows.select("level").distinct(), "level", [], ["level"], mean_only=True, probit=True).toPandas().set_index("level")["value"].sort_index()
    assert np.allclose(fit(rows), fit(encode.cells(rows, "one", "chain", "level"), cells=True), atol=0.02)


@pytest.mark.parametrize("probit", [False, True])
def test_passes_fit_as_single_rows(spark, monkeypatch, probit):
    """Boxes of rows, summed for each sweep, give the chain that single rows give for the same random numbers."""
    rng = np.random.default_rng(4)
    data = [(0, float(round(a, 1)), float(b), int(v), float(a > 0.2) if probit else float(a + v + 0.1 * e)) for a, b, v, e in zip(rng.uniform(-1, 1, 300), rng.uniform(-1, 1, 300), rng.integers(0, 3, 300), rng.normal(size=300), strict=True)]
    df = spark.createDataFrame(data, "chain int, a double, b double, level int, y double").repartition(3)
    design, settings = sampler.Design([None, np.array([-0.5, 0.0, 0.5])], [3]), {"probit": probit, "trees": 4, "draws": 6, "burn": 20, "sparse": True}
    keep = lambda f: f.toPandas().sort_values(["draw", "tree"], ignore_index=True)
    rules = lambda f: [[x.split() for x in t.split("\n") if x.split()[1] == "r"] for t in f["text"]]
    passes = keep(sampler.fit_passes(df, "y", ["a", "b"], ["level"], design, **settings))
    if probit:
        got = sampler.predict_draws(spark.createDataFrame(passes), df.withColumn("id", F.monotonically_increasing_id()), "id", ["a", "b"], ["level"], mean_only=True, probit=True)
        assert got.count() == 300 and 0.2 < got.agg(F.avg("value")).first()[0] < 0.6
        return
    chain, step = sampler.Chain, sampler.Chain.step

    class Ahead(chain):
        def step(self):
            step(self, [self.propose(m) for m in range(4)])

    sorted_ = df.toPandas().sort_values(["a", "b", "level", "y"], ignore_index=True)
    monkeypatch.setattr(sampler, "Chain", Ahead)
    v = sorted_["y"].to_numpy()
    std = (v - v.mean()) / v.std(ddof=1)
    prior = sampler.Prior(trees=4, sparse=True, tau=float(std.max() - std.min()) / 8)
    kept = [[sampler.write_tree(t) for t in c.trees] for d, c in sampler.run_chain(sorted_.assign(y=std), "y", ["a", "b"], ["level"], design, prior, False, 6, 20, 1, sampler._seed(1, (0,))) if d is not None]
    assert rules(passes) == rules({"text": [t for draw in kept for t in draw]}) and sum(map(len, rules(passes))) > 20


def test_passes_over_repeated_rows(spark, monkeypatch):
    """Rows of equal predictors, summed once before the passes, give the chain that all rows give."""
    df = spark.range(600).selectExpr("0 AS chain", "sin(id % 60) AS a", "CAST(id % 3 AS INT) AS level", "id % 3 + sin(id % 60) + cos(id) / 9 AS y")
    fit = lambda: [[x.split()[:5] for x in r["text"].split("\n") if " r " in x] for r in sampler.fit_passes(df, "y", ["a"], ["level"], sampler.Design([None], [3]), trees=3, draws=3, burn=12).orderBy("draw", "tree").collect()]
    cells = fit()
    monkeypatch.setattr(sampler, "REPEATED", 1e9)
    assert cells == fit() and sum(map(len, cells)) > 5


def test_sparse_fit_keeps_rows_out_of_a_task(spark, monkeypatch):
    """The query's rows are summed where they are; none goes to a task of one chain."""
    monkeypatch.setattr(sampler, "run_chain", lambda *a, **k: pytest.fail("rows of a chain in one task"))
    monkeypatch.setattr(sampler, "fit_chains", lambda *a, **k: pytest.fail("rows of a chain in one task"))
    assert [r["close"] for r in catalog.QUERIES["sparse_fit"](spark, SF).collect()] == [True]


def test_too_many_boxes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(sampler, "BOXES", 40)
    df = spark.range(500).selectExpr("0 AS chain", "sin(id) AS a", "cos(id * 3) AS b", "sin(id) * cos(id * 3) AS y")
    with pytest.raises(ValueError, match="boxes"):
        sampler.fit_passes(df, "y", ["a", "b"], [], sampler.Design([None, None]), trees=10, draws=2, burn=5)
    with pytest.raises(ValueError, match="missing"):
        sampler.fit_passes(df.withColumn("b", F.expr("if(b > 0.9, null, b)")), "y", ["a", "b"], [], sampler.Design([None, None]), trees=2, draws=2, burn=2)
