"""Tree contributions: exactness against brute-force Shapley values, closure, scoring parity."""

import itertools
import math

import numpy as np
import pytest

from riskloom import config as C
from riskloom.operators.forest import TreeEnsemble
from riskloom.plans.workbench import fixed_forest


def _expectation(tree, node, x, S):
    if tree.feature[node] < 0:
        return tree.value[node]
    f = tree.feature[node]
    l, r = tree.left[node], tree.right[node]
    if f in S:
        return _expectation(tree, l if x[f] <= tree.threshold[node] else r, x, S)
    return (tree.cover[l] * _expectation(tree, l, x, S) + tree.cover[r] * _expectation(tree, r, x, S)) / tree.cover[node]


def brute_force(ens, x):
    used = sorted({int(f) for t in ens.trees for f in t.feature if f >= 0})
    v = lambda S: np.mean([_expectation(t, 0, x, S) for t in ens.trees])
    phi = np.zeros(len(ens.features))
    for i in used:
        others = [j for j in used if j != i]
        for k in range(len(others) + 1):
            for S in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(len(used) - k - 1) / math.factorial(len(used))
                phi[i] += w * (v(set(S) | {i}) - v(set(S)))
    return phi


def random_tree_rows(rng, n_features, depth, tree_id):
    rows, counter = [], [0]

    def grow(node, d, cover):
        if d == depth or rng.random() < 0.2:
            rows.append((tree_id, node, None, None, None, None, cover, float(rng.random())))
            return
        left, right = counter[0] + 1, counter[0] + 2
        counter[0] += 2
        share = rng.uniform(0.1, 0.9)
        rows.append((tree_id, node, f"f{rng.integers(n_features)}", float(rng.integers(0, 10)), left, right, cover, None))
        grow(left, d + 1, cover * share)
        grow(right, d + 1, cover * (1 - share))

    grow(0, 0, 100.0)
    return rows


def test_fixed_forest_base_value():
    assert fixed_forest().base_value() == pytest.approx(0.2527166667, abs=1e-9)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_contributions_equal_brute_force_shapley(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(3):
        rows += random_tree_rows(rng, 5, 4, t)
    ens = TreeEnsemble.from_node_rows(rows, [f"f{i}" for i in range(5)])
    X = rng.integers(0, 10, size=(25, 5)).astype(float)
    phi = ens.contributions_numpy(X)
    for r in range(len(X)):
        np.testing.assert_allclose(phi[r], brute_force(ens, X[r]), atol=1e-12)
    np.testing.assert_allclose(ens.base_value() + phi.sum(1), ens.predict_numpy(X), atol=1e-12)


def test_fixed_forest_closure_and_score_expression(spark):
    ens = fixed_forest()
    rng = np.random.default_rng(3)
    X = np.zeros((200, len(C.STANDARD_FEATURES)))
    idx = {f: i for i, f in enumerate(C.STANDARD_FEATURES)}
    X[:, idx["OverTime"]] = rng.integers(0, 2, 200)
    X[:, idx["MonthlyIncome"]] = rng.uniform(-1000, 9000, 200)
    X[:, idx["JobSatisfaction"]] = rng.integers(1, 5, 200)
    X[:, idx["StockOptionLevel"]] = rng.integers(0, 4, 200)
    phi = ens.contributions_numpy(X)
    np.testing.assert_allclose(ens.base_value() + phi.sum(1), ens.predict_numpy(X), atol=1e-15)
    df = spark.createDataFrame([tuple(map(float, r)) for r in X], ", ".join(f"{f} double" for f in C.STANDARD_FEATURES))
    got = [r[0] for r in df.select(ens.score_expr()).collect()]
    np.testing.assert_allclose(got, ens.predict_numpy(X), atol=0)


def test_explain_in_spark_matches_numpy(spark):
    ens = fixed_forest()
    rows = [(i, float(i % 2), float(500 * i - 1000), float(1 + i % 4), float(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, OverTime double, MonthlyIncome double, JobSatisfaction double, StockOptionLevel double")
    for f in C.STANDARD_FEATURES:
        if f not in df.columns:
            df = df.withColumn(f, __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0.0))
    out = ens.explain(df, "id").orderBy("id").collect()
    X = np.array([[r[f] for f in C.STANDARD_FEATURES] for r in df.orderBy("id").collect()])
    np.testing.assert_allclose(np.array([o["phi"] for o in out]), ens.contributions_numpy(X), atol=0)


def test_deep_trees_close():
    rng = np.random.default_rng(11)
    rows = []
    for t in range(3):
        rows += random_tree_rows(rng, 14, 13, t)
    ens = TreeEnsemble.from_node_rows(rows, [f"f{i}" for i in range(14)])
    X = rng.integers(0, 10, size=(60, 14)).astype(float)
    phi = ens.contributions_numpy(X)
    np.testing.assert_allclose(ens.base_value() + phi.sum(1), ens.predict_numpy(X), atol=1e-12)
    np.testing.assert_allclose(ens.contributions_numpy(X, max_cells=500), phi, atol=1e-14)


def test_contributions_of_missing_values_close():
    """NaN goes right, in scores and in contributions."""
    rng = np.random.default_rng(5)
    rows = [r for t in range(4) for r in random_tree_rows(rng, 4, 6, t)]
    ens = TreeEnsemble.from_node_rows(rows, [f"f{i}" for i in range(4)])
    X = rng.integers(0, 10, size=(50, 4)).astype(float)
    X[rng.random(X.shape) < 0.3] = np.nan
    np.testing.assert_allclose(ens.base_value() + ens.contributions_numpy(X).sum(1), ens.predict_numpy(X), atol=1e-12)


def test_a_tree_of_one_leaf_and_deep_chains():
    """No edges at all, and 60 splits of two features in a row."""
    single = TreeEnsemble.from_node_rows([(0, 0, None, None, None, None, 10.0, 0.3)], ["a", "b"])
    X = np.array([[1.0, 2.0], [3.0, 4.0]])
    np.testing.assert_allclose(single.contributions_numpy(X), 0)
    rows = []
    for d in range(60):
        rows += [(0, 2 * d, "ab"[d % 2], float(60 - d), 2 * d + 2, 2 * d + 1, 100.0 - d, None), (0, 2 * d + 1, None, None, None, None, 1.0, d / 60)]
    rows.append((0, 120, None, None, None, None, 40.0, 0.9))
    chain = TreeEnsemble.from_node_rows(rows, ["a", "b"])
    X = np.random.default_rng(1).uniform(0, 70, size=(40, 2))
    phi = chain.contributions_numpy(X)
    np.testing.assert_allclose(chain.base_value() + phi.sum(1), chain.predict_numpy(X), atol=1e-12)
    for r in range(len(X)):
        np.testing.assert_allclose(phi[r], brute_force(chain, X[r]), atol=1e-12)


def test_features_without_a_split_are_not_shuffled(spark):
    """They contribute 0 and take their place by name among the others that do."""
    ens = TreeEnsemble.from_node_rows(
        [(0, 0, "m", 1.0, 1, 2, 4.0, None), (0, 1, "z", 1.0, 3, 4, 2.0, None), (0, 2, None, None, None, None, 2.0, 0.5), (0, 3, None, None, None, None, 1.0, 0.5), (0, 4, None, None, None, None, 1.0, 0.1)],
        ["z", "idle_b", "m", "a_idle"],
    )
    X = np.array([[0.0, 9.0, 0.0, 9.0], [2.0, 9.0, 0.0, 9.0], [0.0, 9.0, 5.0, 9.0], [np.nan, 9.0, np.nan, 9.0]])
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "id long, z double, idle_b double, m double, a_idle double")
    out = ens.explain(df, "id")
    sent = next(line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "MapInPandas" in line)
    assert "__x0" in sent and "__x2" in sent and "__x1" not in sent and "__x3" not in sent
    phi = ens.contributions_numpy(X)
    names = np.argsort(np.argsort(np.array(ens.features, dtype=object)))
    order = np.lexsort((np.broadcast_to(names, phi.shape), -np.abs(np.round(phi, 12))), axis=-1) + 1
    for r in out.collect():
        np.testing.assert_allclose(r.phi, phi[r.id], atol=1e-15)
        assert r.order == order[r.id].tolist()
    leaf = TreeEnsemble.from_node_rows([(0, 0, None, None, None, None, 10.0, 0.3)], ["z", "m"])
    assert [(r.score, r.phi, r.order) for r in leaf.explain(df.limit(1), "id").collect()] == [(0.3, [0.0, 0.0], [2, 1])]


def test_looked_up_contributions_equal_the_walk_and_brute_force(monkeypatch):
    """Trees with and without tables, features split on again, rows with NaN, nodes without cover."""
    from riskloom.operators import forest as FO

    rng = np.random.default_rng(11)
    rows = [r for t in range(6) for r in random_tree_rows(rng, 6, 7, t)]
    rows += [(6, 0, "f1", 3.0, 1, 2, 10.0, None), (6, 1, None, None, None, None, 0.0, 0.9), (6, 2, None, None, None, None, 10.0, 0.2), (7, 0, None, None, None, None, 5.0, 0.4)]
    names = [f"f{i}" for i in range(6)]
    X = rng.integers(0, 10, size=(3000, 6)).astype(float)
    X[::7, 2] = np.nan
    looked_up, walked = (TreeEnsemble.from_node_rows(rows, names) for _ in range(2))
    phi = looked_up.contributions_numpy(X)
    made = [i for i, size in enumerate(looked_up.table_sizes()) if size]
    assert sorted(looked_up._lookups) == made and len(made) > 4 and 6 in made and 7 not in made
    assert all(sum(t.size for s in looked_up._lookups[i] for _, t in s.reads) == looked_up.table_sizes()[i] for i in looked_up._lookups)
    monkeypatch.setattr(FO, "TREE_TABLES", 0)
    np.testing.assert_allclose(phi, walked.contributions_numpy(X), atol=1e-12)
    assert not walked._lookups
    for r in range(0, 40):
        np.testing.assert_allclose(phi[r], brute_force(looked_up, X[r]), atol=1e-12)
    monkeypatch.setattr(FO, "TREE_TABLES", 1 << 18)
    monkeypatch.setattr(FO, "FOREST_TABLES", looked_up.table_sizes()[made[0]])
    partly = TreeEnsemble.from_node_rows(rows, names)
    np.testing.assert_allclose(phi, partly.contributions_numpy(X), atol=1e-12)
    assert list(partly._lookups)[0] == made[0] and len(partly._lookups) < len(made)
