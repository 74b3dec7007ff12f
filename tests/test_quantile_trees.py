"""Boosted quantile trees: loss, coverage, and trees that do not depend on how rows are dealt."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import intervals
from tidewell.operators.quantile_trees import QuantileTrees, _best_splits, fit_quantile_trees, pinball

TAUS = {"lo": 0.05, "hi": 0.95}


@pytest.fixture(scope="module")
def bent(spark):
    rng = np.random.default_rng(6)
    x, z = rng.uniform(-2, 2, 3000), rng.normal(size=3000)
    y = np.abs(x) * 3 + (0.3 + (x > 0)) * rng.normal(size=3000)
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y))] + [(9000, None, 0.0, 1.0), (9001, 0.0, 0.0, None)]
    return spark.createDataFrame(rows, "i long, x double, z double, y double").repartition(4).cache()


@pytest.fixture(scope="module")
def trees(bent):
    return fit_quantile_trees(bent.where("i < 2000"), ["x", "z"], TAUS, rounds=25, step=0.2)


def test_loss_and_coverage(bent, trees):
    test = trees.predict(bent.where("i >= 2000 AND i < 9000"))
    beta = intervals.quantile_regression(bent.where("i < 2000"), ["x", "z"], TAUS, tol=1e-2)
    lines = test.withColumns({f"line_{t}": intervals.linear_prediction(b, ["x", "z"]) for t, b in beta.items()})
    loss = lines.agg(*[F.avg(pinball(F.col("y"), F.col(c), TAUS[t])).alias(c) for t in TAUS for c in (t, f"line_{t}")]).first()
    assert all(loss[t] < 0.75 * loss[f"line_{t}"] for t in TAUS)
    inside = test.agg(F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("double"))).first()[0]
    assert 0.86 <= inside <= 0.94


def test_missing_features_have_no_prediction(bent, trees):
    got = {r["i"]: r["lo"] for r in trees.predict(bent.where("i >= 9000")).collect()}
    assert got[9000] is None and got[9001] is not None


def test_trees_do_not_depend_on_partitions(bent, trees):
    again = fit_quantile_trees(bent.where("i < 2000").repartition(9, "z"), ["x", "z"], TAUS, rounds=3, step=0.2)
    assert again.edges == trees.edges and all(again.trees[t] == trees.trees[t][:3] for t in TAUS)


def test_saved_as_text(bent, trees):
    back = QuantileTrees.from_json(trees.to_json())
    sums = [m.predict(bent).agg(F.sum("lo"), F.sum("hi")).first() for m in (trees, back)]
    assert sums[0] == sums[1]


def test_rounds_group_no_rows(bent, monkeypatch):
    frame, calls = type(bent), []
    group = frame.groupBy
    monkeypatch.setattr(frame, "groupBy", lambda self, *a: (calls.append(a), group(self, *a))[1])
    number = []
    for rounds in (1, 3):
        fit_quantile_trees(bent.where("i < 2000"), ["x", "z"], TAUS, rounds=rounds)
        number.append(len(calls))
    # those of the first fit, twice: more rounds add no shuffle
    assert number[1] == 2 * number[0]


def test_best_split_is_the_brute_force_one():
    rng = np.random.default_rng(1)
    x, low = rng.integers(0, 6, (400, 2)), rng.random(400)
    low = low < np.where(x[:, 1] > 2, 0.8, 0.1)
    n, below = (np.array([[np.bincount(x[m, f], minlength=6) for f in range(2)]]) for m in (np.ones(400, bool), low))
    f, b = _best_splits(below, n, 0.3, 5)[0]

    def gain(f, b):
        g = 0.3 - low
        left = x[:, f] <= b
        return g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum()

    assert (f, b) == max(((f, b) for f in range(2) for b in range(5)), key=lambda s: gain(*s)) == (1, 2)


def test_tables_of_cells_give_the_trees_of_rows(bent, monkeypatch):
    from tidewell.operators import quantile_trees as qtr

    seen = {}
    for cells in (0, qtr.CELLS):
        monkeypatch.setattr(qtr, "CELLS", cells)
        monkeypatch.setattr(qtr, "KEEP", 2)
        seen[cells] = fit_quantile_trees(bent.where("i < 2000"), ["x", "z"], TAUS, rounds=5, step=0.2).to_json()
    assert len(set(seen.values())) == 1
