"""Recall of the graphs against all inner products, and the contract's cases."""

import random

import numpy as np
import pytest

from riskloom.llm.ann import Graph, nearest
from tests.conftest import SF_ORACLE


def brute(rows, every, k):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = set()
    for i, v in ok:
        if i % every == 0:
            found = sorted((-float((np.array(v, float) * np.array(w, float)).sum()), j) for j, w in ok if j != i and len(w) == len(v))[:k]
            out |= {(i, n + 1, j, round(-s, 6)) for n, (s, j) in enumerate(found)}
    return out


def result(frame, **settings):
    return {(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in nearest(frame, **settings).collect()}


def test_hard_rows(spark):
    r = random.Random(1)
    rows = [(i, [float(np.float32(r.gauss(0, 1) * (1 + i % 3))) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, [1.0] * 8) for i in range(60)] + [(None, [1.0] * 8), (2000, None), (2001, []), (2020, [0.0] * 8), (2040, [1.0, None] + [0.0] * 6)]
    rows += [(2060, [float("nan")] * 8), (2080, [1.0, 2.0]), (2081, [2.0, 2.0]), (2100, [float("inf")] * 8), rows[20]]
    frame = spark.createDataFrame([(*x, 1, "v") for x in rows], "vec_id long, embedding array<float>, rank int, vector string")
    got, expected = result(frame, shard_rows=100), brute(rows, 20, 20)
    assert len(got) == len(expected)
    assert len(got & expected) >= 0.98 * len(expected)
    assert nearest(frame.limit(0)).count() == 0
    assert nearest(frame.limit(1)).count() == 0


def test_recall_on_the_table(spark):
    frame = spark.read.parquet(f"{SF_ORACLE}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    got, expected = result(frame, shard_rows=200), brute(rows, 20, 20)
    assert len({g[::2] for g in got} & {e[::2] for e in expected}) >= 0.9 * len(expected)


def test_clustered_vectors_are_reached():
    g = np.random.default_rng(2)
    centres = g.normal(size=(40, 16)) * 5
    x = (centres[:, None, :] + 0.05 * g.normal(size=(40, 50, 16))).reshape(-1, 16)
    x = x[g.permutation(len(x))]
    graph = Graph.build(x, np.floor(-np.log(g.random(len(x))) / np.log(16)).astype(int))
    best, _ = graph.search(x[:300])
    exact = np.argsort(-(x[:300] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b[:32])) / 20 for a, b in zip(exact, best, strict=True)]) > 0.95


@pytest.mark.parametrize("n", [2_000, 20_000])
def test_recall_of_graphs_of_any_size(n):
    g = np.random.default_rng(n)
    x = g.normal(size=(n, 32)) @ g.normal(size=(32, 32)) * g.uniform(0.5, 2, size=(n, 1))
    graph = Graph.build(x, np.floor(-np.log(g.random(n)) / np.log(16)).astype(int))
    best, _ = graph.search(x[:200])
    exact = np.argsort(-(x[:200] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b[:32])) / 20 for a, b in zip(exact, best, strict=True)]) > 0.95
