"""Tree ensembles: node tables, scoring expressions and exact additive contributions.

A forest is held as small per-tree node arrays (size bounded by the model, not
the data). Scoring compiles each tree into a nested ``CASE`` expression so it runs
inside whole-stage codegen; trained Spark ML forests can instead be scored with
their own ``transform``. Contributions (path-dependent tree Shapley values) run
as one vectorised NumPy pass per Arrow batch in ``mapInPandas``.

For one leaf with value ``c`` and, per distinct feature j on its path, the merged
interval (lo_j, hi_j] and cover share z_j (product of child/parent cover ratios of
j's splits), the leaf adds to feature i::

    c * (o_i - z_i) * Integral_0^1 prod_{j != i} f_j(t) dt,
    f_j(t) = o_j t + z_j (1 - t),   o_j = 1[lo_j < x_j <= hi_j]

The integrand is a polynomial of degree n-1, so Gauss-Legendre with ceil(n/2) points is
exact. Leaves share what their paths share: one walk down carries the product G of the
factors at the points (a split on a feature that the path has already replaces its factor),
one walk up sums c * G over the leaves below each edge, and an edge's feature gets::

    (o - z) * sum_t w(t) * (sum over leaves whose last split on it is this edge) / f(t)

So the work is edges x points for a row, not leaves x path x points.

The same integral depends on a row only through the conditions o that it meets on a leaf's path.
For trees whose paths have few features, and rows enough to pay for it, it is worked out once for
each leaf and each set of conditions; a row then carries its conditions down as bits and looks up
the contributions of the leaves below each last split (``_lookup_of``).

Contributions are averaged over trees; base value = mean over trees of the cover-weighted leaf values; base +
sum(phi) = score for every row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.expressions import round_double
from riskloom.session import spread

# Numbers that the lookup tables of one tree, and those of a forest, hold at most.
TREE_TABLES, FOREST_TABLES = 1 << 18, 1 << 24
# Contributions are rounded to this many decimals before ranking (ties stay ties).
RANK_DECIMALS = 12


@dataclass
class Tree:
    feature: np.ndarray  # int index into features, -1 for leaves
    threshold: np.ndarray  # go left when x <= threshold
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray  # probability of class 1 at leaves


@dataclass
class Walk:
    """The edges of a tree, level by level: the children of a level's inner nodes, left and
    right in turn, make up the next level."""

    levels: list[tuple[int, int]]  # first edge and the one after the last
    feature: np.ndarray  # (E,)
    lo: np.ndarray
    hi: np.ndarray
    z: np.ndarray  # merged cover share of the feature on the path down to here
    before: np.ndarray  # edge of the same feature above, or -1
    value: np.ndarray  # value of the leaf that the edge leads to, NaN for inner nodes
    ratio: np.ndarray  # (3 E, m) new / old factor: feature's conditions fail here, hold, failed above
    gain: np.ndarray  # (2 E, m) weight * (o - z) / factor for o = 0, 1
    by_feature: np.ndarray  # edges ordered by feature
    starts: np.ndarray  # where the next feature starts in that order
    repeated: np.ndarray  # edges with an edge of their feature above, ordered by that
    repeat_starts: np.ndarray


@dataclass
class Step:
    """An inner node of a tree, parents first. A row's pattern holds a bit for each feature split on
    above the node: whether the row meets all conditions of the path on it."""

    feature: int
    threshold: float
    went_left: int  # bit that the row's own side adds to the pattern where contributions are read
    reads: list[tuple[int, np.ndarray]]  # feature and its contributions from the leaves just below, by pattern
    inner: list[tuple[int, bool, int, bool]]  # step below, whether to the left, bit of the feature, first split on it


class TreeEnsemble:
    def __init__(self, features: Sequence[str], trees: list[Tree]):
        self.features = list(features)
        self.trees = trees
        self._walks: list[Walk] | None = None
        self._lookups: dict[int, list[Step]] = {}
        self._sizes: list[int] | None = None

    # -- construction ---------------------------------------------------------

    @classmethod
    def from_node_rows(cls, rows: Sequence[tuple], features: Sequence[str] | None = None) -> "TreeEnsemble":
        """Rows (tree, node, feature, threshold, left, right, cover, value)."""
        used = [r[2] for r in rows if r[2] is not None]
        features = list(features) if features is not None else sorted(set(used))
        index = {f: i for i, f in enumerate(features)}
        trees = []
        for t in sorted({r[0] for r in rows}):
            nodes = sorted((r for r in rows if r[0] == t), key=lambda r: r[1])
            n = max(r[1] for r in nodes) + 1
            arr = {k: np.full(n, np.nan) for k in ("threshold", "cover", "value")}
            feat = np.full(n, -1, dtype=np.int64)
            left = np.full(n, -1, dtype=np.int64)
            right = np.full(n, -1, dtype=np.int64)
            for _, node, f, thr, lft, rgt, cover, value in nodes:
                arr["cover"][node] = cover
                if f is None:
                    arr["value"][node] = value
                else:
                    feat[node], arr["threshold"][node], left[node], right[node] = index[f], thr, lft, rgt
            trees.append(Tree(feat, arr["threshold"], left, right, arr["cover"], arr["value"]))
        return cls(features, trees)

    @classmethod
    def from_spark_model(cls, spark: SparkSession, model, features: Sequence[str], path: str) -> "TreeEnsemble":
        """Read a fitted ``RandomForestClassificationModel`` from its node data, saved to ``path``."""
        model.write().overwrite().save(path)
        return cls.from_saved_model(spark, features, path)

    @classmethod
    def from_saved_model(cls, spark: SparkSession, features: Sequence[str], path: str) -> "TreeEnsemble":
        """Read a saved ``RandomForestClassificationModel``: one array a column and tree.

        Leaf value = impurityStats[1] / sum(impurityStats)."""
        nodes = saved_nodes(spark, path).toArrow()  # model-sized (trees x nodes), not data-sized
        col = {c: nodes.column(c).to_numpy() for c in nodes.column_names}
        inner, weight = col["left"] >= 0, col["weight"]
        share = np.divide(col["positives"], weight, out=np.zeros(len(weight)), where=weight > 0)
        by_tree = np.argsort(col["tree"], kind="stable")
        trees = []
        for rows in np.split(by_tree, np.flatnonzero(np.diff(col["tree"][by_tree])) + 1) if len(by_tree) else []:
            at, here = col["node"][rows], inner[rows]
            n = int(at.max()) + 1

            def placed(values, empty, dtype):
                out = np.full(n, empty, dtype=dtype)
                out[at] = np.where(here if values is not share else ~here, values[rows], empty)
                return out

            cover = np.zeros(n)
            cover[at] = weight[rows]
            trees.append(
                Tree(
                    placed(col["feature_index"], -1, np.int64), placed(col["threshold"], np.nan, float), placed(col["left"], -1, np.int64),
                    placed(col["right"], -1, np.int64), cover, placed(share, np.nan, float),
                )
            )
        return cls(features, trees)

    def depth(self) -> int:
        """Splits on the longest path of any tree."""
        deepest = 0
        for tree in self.trees:
            level, frontier = 0, np.array([0])
            while len(frontier := frontier[tree.feature[frontier] >= 0]):
                level, frontier = level + 1, np.concatenate([tree.left[frontier], tree.right[frontier]])
            deepest = max(deepest, level)
        return deepest

    # -- scoring --------------------------------------------------------------

    def _tree_expr(self, tree: Tree, node: int, cols: Sequence[Column]) -> Column:
        if tree.feature[node] < 0:
            return F.lit(float(tree.value[node]))
        x = cols[tree.feature[node]]
        return F.when(
            x <= F.lit(float(tree.threshold[node])), self._tree_expr(tree, int(tree.left[node]), cols)
        ).otherwise(self._tree_expr(tree, int(tree.right[node]), cols))

    def _visited_expr(self, tree: Tree, node: int, cols: Sequence[Column]) -> Column:
        own = F.array(F.lit(int(node)))
        if tree.feature[node] < 0:
            return own
        left, right = (self._visited_expr(tree, int(k), cols) for k in (tree.left[node], tree.right[node]))
        return F.concat(own, F.when(cols[tree.feature[node]] <= F.lit(float(tree.threshold[node])), left).otherwise(right))

    def node_table(self, spark: SparkSession) -> DataFrame:
        """(tree, node, feature, left, right): the splits, as many rows as the model has nodes."""
        rows = [
            (t, n, self.features[tree.feature[n]] if tree.feature[n] >= 0 else None, int(tree.left[n]), int(tree.right[n]))
            for t, tree in enumerate(self.trees) for n in range(len(tree.feature))
        ]
        return spark.createDataFrame(rows, "tree int, node int, feature string, left int, right int")

    def node_statistics(self, df: DataFrame, label: Column, cols: Sequence[Column] | None = None) -> DataFrame:
        """(tree, node, weight, positives): rows of ``df`` with a label that come through each node,
        and those with label 1. Each row lists the nodes it visits; counts are partial before the
        shuffle, so it carries one row a node from each partition."""
        cols = cols or [F.col(f) for f in self.features]
        visits = F.array(*[F.struct(F.lit(t).alias("tree"), self._visited_expr(tree, 0, cols).alias("nodes")) for t, tree in enumerate(self.trees)])
        long = df.select(label.cast("double").alias("_y"), F.explode(visits).alias("v")).where("_y IS NOT NULL").select("_y", "v.tree", F.explode("v.nodes").alias("node"))
        return long.groupBy("tree", "node").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.sum("_y").alias("positives"))

    def score_expr(self, cols: Sequence[Column] | None = None) -> Column:
        """Mean of the trees' leaf values as one Column expression (sum left to right, / trees)."""
        cols = cols or [F.col(f) for f in self.features]
        total = None
        for tree in self.trees:
            e = self._tree_expr(tree, 0, cols)
            total = e if total is None else total + e
        return total / F.lit(float(len(self.trees)))

    def predict_numpy(self, X: np.ndarray) -> np.ndarray:
        out = np.zeros(len(X))
        for tree in self.trees:
            node = np.zeros(len(X), dtype=np.int64)
            while True:
                f = tree.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                xi = X[np.arange(len(X)), np.where(inner, f, 0)]
                go_left = xi <= tree.threshold[node]
                nxt = np.where(go_left, tree.left[node], tree.right[node])
                node = np.where(inner, nxt, node)
            out += tree.value[node]
        return out / len(self.trees)

    # -- contributions --------------------------------------------------------

    def walks(self) -> list[Walk]:
        if self._walks is None:
            self._walks = [_walk_of(tree) for tree in self.trees]
        return self._walks

    def leaf_conditions(self) -> list[tuple]:
        """(tree, leaf, feature, lo, hi, z, value) rows, unbounded ends as None."""
        rows = []
        for t, tree in enumerate(self.trees):
            leaves = []  # (value, {feature: (lo, hi, z)}), left before right

            def down(node: int, conds: dict) -> None:
                f = int(tree.feature[node])
                if f < 0:
                    leaves.append((tree.value[node], conds))
                    return
                lo, hi, z = conds.get(f, (-np.inf, np.inf, 1.0))
                thr = float(tree.threshold[node])
                for child, bounds in ((int(tree.left[node]), (lo, min(hi, thr))), (int(tree.right[node]), (max(lo, thr), hi))):
                    down(child, {**conds, f: (*bounds, z * tree.cover[child] / tree.cover[node])})

            down(0, {})
            for leaf, (value, conds) in enumerate(leaves):
                for f, (lo, hi, z) in sorted(conds.items()):
                    ends = [None if np.isinf(x) else float(x) for x in (lo, hi)]
                    rows.append((t, leaf, self.features[f], *ends, float(z), float(value)))
        return rows

    def base_value(self) -> float:
        total = 0.0
        for tree in self.trees:
            leaves = tree.feature < 0
            total += float(np.nansum(tree.value[leaves] * tree.cover[leaves]) / tree.cover[0])
        return total / len(self.trees)

    def table_sizes(self) -> list[int]:
        """Numbers in the lookup tables of each tree; 0 where a tree is to have none."""
        if self._sizes is None:
            self._sizes, total = [], 0
            for tree in self.trees:
                size = _lookup_size(tree, TREE_TABLES)
                size = size if total + size <= FOREST_TABLES else 0
                self._sizes.append(size)
                total += size
        return self._sizes

    def contributions_numpy(self, X: np.ndarray, max_cells: int = 60_000) -> np.ndarray:
        """phi (rows x features) for the rows of X (columns in ``self.features`` order). A tree
        takes as many rows at a time as keep its edges x points x rows within ``max_cells``; with
        tables, ``max_cells / 12`` rows."""
        phi = np.zeros((X.shape[1], len(X)))
        columns = np.ascontiguousarray(X.T)
        for i, (walk, size) in enumerate(zip(self.walks(), self.table_sizes())):
            if not len(walk.feature):
                continue
            if i not in self._lookups and 0 < size <= len(X) * walk.ratio.size // 3:
                self._lookups[i] = _lookup_of(self.trees[i])
            lookup = self._lookups.get(i)
            step = max(1, max_cells // 12 if lookup else 3 * max_cells // walk.ratio.size)
            for s in range(0, len(X), step):
                if lookup:
                    _look_up_contributions(lookup, columns[:, s : s + step], phi[:, s : s + step])
                else:
                    _add_contributions(walk, columns[:, s : s + step], phi[:, s : s + step])
        return phi.T / len(self.trees)

    def predict_column(self, cols: Sequence[Column]) -> Column:
        """Score by walking the node arrays, one Arrow batch at a time: for trees of any depth,
        which a nested ``CASE`` cannot hold."""
        ensemble = TreeEnsemble(self.features, self.trees)

        @F.pandas_udf("double")
        def predict(*xs: pd.Series) -> pd.Series:
            return pd.Series(ensemble.predict_numpy(np.column_stack([x.to_numpy(dtype=float) for x in xs])))

        return predict(*[c.cast("double") for c in cols])

    def used_features(self) -> list[str]:
        """Features that some tree splits on, in feature order."""
        used = {int(f) for t in self.trees for f in t.feature if f >= 0}
        return [f for i, f in enumerate(self.features) if i in used]

    def narrowed(self) -> "TreeEnsemble":
        """The same trees over the features they split on and no others."""
        used = self.used_features()
        place = np.array([used.index(f) if f in used else -1 for f in self.features] + [-1])  # -1, a leaf, stays
        trees = [Tree(place[t.feature], t.threshold, t.left, t.right, t.cover, t.value) for t in self.trees]
        return TreeEnsemble(used, trees)

    def explain(
        self,
        df: DataFrame,
        id_col: str = "id",
        features: Sequence[str] | None = None,
        carry: Sequence[str] = (),
        decimals: int = RANK_DECIMALS,
    ) -> DataFrame:
        """(id, *carry, score, base, phi array<double>, order array<int>) for every row.

        ``phi`` holds the contributions in ``self.features`` order; ``order`` lists the 1-based
        feature positions by |phi| (rounded to ``decimals``, so float noise cannot reorder
        ties) descending, then feature name. One Arrow batch at a time inside the executors;
        the forest travels with the task closure (model-sized). ``carry`` columns pass
        through, so per-row outputs (top-k, raw values, reports) need no join back. Features
        that no tree splits on contribute 0: their values are neither shuffled nor sent."""
        features = list(features or self.features)
        ensemble = self.narrowed()
        ensemble.walks()  # computed once on the driver, shipped with the closure; tables are made in the tasks
        ensemble.table_sizes()
        base = self.base_value()
        keep = [id_col, *carry]
        fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        n = len(self.features)
        used = [self.features.index(f) for f in ensemble.features]
        phi_cols = [f"__phi{i}" for i in used]
        ord_cols = [f"__ord{i}" for i in range(n)]
        schema = ", ".join(
            [f"`{c}` {fields[c]}" for c in keep] + ["score double"] + [f"{c} double" for c in phi_cols] + [f"{c} int" for c in ord_cols]
        )
        feat_cols = [f"__x{i}" for i in used]
        by_name = np.argsort(np.array(self.features, dtype=object))

        def run(batches):
            for pdf in batches:
                X = pdf[feat_cols].to_numpy(dtype=float)
                phi = ensemble.contributions_numpy(X)
                key = np.zeros((len(X), n))
                key[:, used] = -np.abs(np.round(phi, decimals))  # ranking only; outputs are rounded by Spark
                order = by_name[np.argsort(key[:, by_name], axis=-1, kind="stable")] + 1
                out = pd.concat(
                    [
                        pd.DataFrame(phi, columns=phi_cols, index=pdf.index),
                        pd.DataFrame(order.astype(np.int32), columns=ord_cols, index=pdf.index),
                    ],
                    axis=1,
                )
                out.insert(0, "score", ensemble.predict_numpy(X))
                for c in reversed(keep):
                    out.insert(0, c, pdf[c])
                yield out

        inputs = df.select(*keep, *[F.col(features[i]).cast("double").alias(x) for i, x in zip(used, feat_cols)])
        res = spread(inputs, id_col).mapInPandas(run, schema)
        phi = [F.col(f"__phi{i}") if i in used else F.lit(0.0) for i in range(n)]
        return res.select(*keep, "score", F.lit(base).alias("base"), F.array(*phi).alias("phi"), F.array(*ord_cols).alias("order"))


def _walk_of(tree: Tree) -> Walk:
    levels, rows, frontier = [], [], [(0, {})]  # frontier: node, {feature: (lo, hi, z, edge)}
    deepest = 0
    while True:
        first, following = len(rows), []
        for node, conds in frontier:
            f = int(tree.feature[node])
            if f < 0:
                continue
            lo, hi, z, before = conds.get(f, (-np.inf, np.inf, 1.0, -1))
            thr = float(tree.threshold[node])
            for child, bounds in ((int(tree.left[node]), (lo, min(hi, thr))), (int(tree.right[node]), (max(lo, thr), hi))):
                share = z * (tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.0)
                value = tree.value[child] if tree.feature[child] < 0 else np.nan
                following.append((child, {**conds, f: (*bounds, share, len(rows))}))
                rows.append((f, *bounds, share, before, value))
        if not following:
            break
        deepest = max(deepest, max(len(c) for _, c in following))
        levels.append((first, len(rows)))
        frontier = following
    m = max(1, math.ceil(deepest / 2))
    nodes, weights = np.polynomial.legendre.leggauss(m)
    t, w = (nodes + 1.0) / 2.0, weights / 2.0
    feature, lo, hi, z, before, value = (np.array(x, dtype=k) for x, k in zip(zip(*rows) if rows else [()] * 6, (np.int64, float, float, float, np.int64, float)))
    holds, fails = t + z[:, None] * (1 - t), z[:, None] * (1 - t)
    old = np.where(before[:, None] >= 0, holds[before] if len(rows) else holds, 1.0)
    z_old = np.where(before >= 0, z[before] if len(rows) else z, 1.0)
    both_fail = np.broadcast_to(np.divide(z, z_old, out=np.zeros_like(z), where=z_old > 0)[:, None], holds.shape)
    ratio = np.stack([fails / old, holds / old, both_fail], axis=1).reshape(-1, m)
    gain = np.stack([np.broadcast_to(-w / (1 - t), holds.shape), (1 - z[:, None]) * w / holds], axis=1).reshape(-1, m)
    by_feature = np.argsort(feature, kind="stable")
    repeated = np.flatnonzero(before >= 0)
    repeated = repeated[np.argsort(before[repeated], kind="stable")]
    edges_of = [np.flatnonzero(np.diff(x, prepend=-2)) for x in (feature[by_feature], before[repeated])]
    return Walk(levels, feature, lo, hi, z, before, value, ratio, gain, by_feature, edges_of[0], repeated, edges_of[1])


def _add_contributions(walk: Walk, columns: np.ndarray, phi: np.ndarray) -> None:
    """Adds one tree's contributions for the rows in ``columns`` (features, rows) to ``phi``."""
    n_edges, m, rows = len(walk.feature), walk.ratio.shape[1], columns.shape[1]
    x = columns[walk.feature]
    # what is not <= a threshold goes right, so does NaN, as in scoring
    on = ~(x <= walk.lo[:, None]) & ((x <= walk.hi[:, None]) | np.isinf(walk.hi)[:, None])
    state = on.astype(np.int64)
    if len(walk.repeated):
        own = walk.repeated
        state[own] += 2 * (~on[own] & ~on[walk.before[own]])
    at = np.arange(n_edges)[:, None]
    products = np.take(walk.ratio, 3 * at + state, axis=0, mode="clip")  # (E, rows, m)
    above = None
    for first, last in walk.levels:
        if above is not None:
            products[first:last] *= np.repeat(above, 2, axis=0)
        above = products[first:last][np.isnan(walk.value[first:last])]
    below = products  # from here on sums of leaf values x products below each edge
    deeper = None
    for first, last in reversed(walk.levels):
        leaf = ~np.isnan(walk.value[first:last])
        part = below[first:last]
        part[leaf] *= walk.value[first:last][leaf][:, None, None]
        if deeper is not None:
            part[~leaf] = deeper[0::2] + deeper[1::2]
        deeper = part
    if len(walk.repeated):
        # edges of one feature on a path: each keeps the leaves whose last such edge it is
        later = np.add.reduceat(below[walk.repeated], walk.repeat_starts, axis=0)
        below[walk.before[walk.repeated[walk.repeat_starts]]] -= later
    of_edge = np.einsum("ebm,ebm->eb", below, np.take(walk.gain, 2 * at + on, axis=0, mode="clip"))
    phi[walk.feature[walk.by_feature[walk.starts]]] += np.add.reduceat(of_edge[walk.by_feature], walk.starts, axis=0)


def _lookup_size(tree: Tree, limit: int) -> int:
    """Numbers in the tree's lookup tables, 0 if there are none or more than ``limit``."""
    total, frontier = 0, [(0, frozenset())] if tree.feature[0] >= 0 else []
    while frontier:
        node, above = frontier.pop()
        here = above | {int(tree.feature[node])}
        below = [(int(c), here) for c in (tree.left[node], tree.right[node]) if tree.feature[c] >= 0]
        if len(below) < 2:
            total += len(here) << (len(above) + 1)
        if total > limit:
            return 0
        frontier += below
    return total


def _lookup_of(tree: Tree) -> list[Step]:
    """The inner nodes with the contributions of the leaves below them. A table has an entry for
    each pattern of the node and, as its highest bit, whether the row goes left there."""
    steps, leaves = [], []  # leaves: step, value, z of each feature, place of each entry in the leaf's own table
    frontier = [(0, {})]  # node, {feature: z} in the order of their bits
    for at, (node, above) in enumerate(frontier):
        f, k = int(tree.feature[node]), len(above)
        first = f not in above
        bit = 1 << (k if first else list(above).index(f))
        pattern = np.arange(1 << k)
        met, missed = pattern | bit if first else pattern, pattern & ~bit
        step = Step(f, float(tree.threshold[node]), 1 << k, [], [])
        for child, to_left in ((int(tree.left[node]), True), (int(tree.right[node]), False)):
            z = above.get(f, 1.0) * (tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.0)
            below = {**above, f: z}
            if tree.feature[child] >= 0:
                step.inner.append((len(frontier), to_left, bit, first))
                frontier.append((child, below))
            else:
                leaves.append((at, tree.value[child], below, np.concatenate([missed, met] if to_left else [met, missed])))
        steps.append(step)
    for k in sorted({len(leaf[2]) for leaf in leaves}):
        own = [leaf for leaf in leaves if len(leaf[2]) == k]
        tables = _leaf_tables(np.array([leaf[1] for leaf in own]), np.array([list(leaf[2].values()) for leaf in own]))
        for (at, _, below, entries), table in zip(own, tables):
            had, got = steps[at].reads, table[:, entries]
            steps[at].reads = [(f, x + had[i][1] if had else x) for i, (f, x) in enumerate(zip(below, got))]
    return steps


def _leaf_tables(values: np.ndarray, z: np.ndarray) -> np.ndarray:
    """(leaves, k features, 2^k): contributions of leaves with k features on their paths, for every
    pattern of conditions met; z is (leaves, k)."""
    n, k = z.shape
    m = max(1, math.ceil(k / 2))
    nodes, weights = np.polynomial.legendre.leggauss(m)
    t, w = (nodes + 1.0) / 2.0, weights / 2.0
    fails = z[:, :, None] * (1 - t)  # (n, k, m)
    holds = t + fails
    products = np.ones((n, 1, m))
    for j in range(k):
        products = np.concatenate([products * fails[:, None, j], products * holds[:, None, j]], axis=1)
    gain = np.stack([np.broadcast_to(-w / (1 - t), holds.shape), (1 - z[:, :, None]) * w / holds], axis=2)
    out = np.empty((n, k, 1 << k))
    for i in range(k):
        parts = products.reshape(n, 1 << (k - 1 - i), 2, 1 << i, m)
        out[:, i] = np.einsum("nabcm,nbm->nabc", parts, gain[:, i]).reshape(n, -1)
    return values[:, None, None] * out


def _look_up_contributions(steps: list[Step], columns: np.ndarray, phi: np.ndarray) -> None:
    """Adds one tree's contributions for the rows in ``columns`` (features, rows) to ``phi``."""
    patterns = [np.zeros(columns.shape[1], dtype=np.int64)] + [None] * (len(steps) - 1)
    found = np.empty(columns.shape[1])
    for i, step in enumerate(steps):
        pattern, patterns[i] = patterns[i], None
        left = columns[step.feature] <= step.threshold  # NaN goes right, as in scoring
        if step.reads:
            place = pattern + left * step.went_left
            for f, table in step.reads:
                phi[f] += np.take(table, place, out=found, mode="clip")
        for below, to_left, bit, first in step.inner:
            meets = left if to_left else ~left
            patterns[below] = pattern | meets * bit if first else pattern & (meets * bit | ~bit)


def saved_nodes(spark: SparkSession, path: str, features: Sequence[str] | None = None) -> DataFrame:
    """(tree, node, feature_index, threshold, left, right, weight, positives[, feature]) of a saved
    Spark forest, left and right -1 at leaves. Layout (Spark 4.x): ``treeID, nodeData{id,
    impurityStats, leftChild, rightChild, split{featureIndex, leftCategoriesOrThreshold}}``;
    continuous splits go left when x <= threshold."""
    data, stats = F.col("nodeData"), F.col("nodeData.impurityStats")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        data["id"].alias("node"),
        data["split"]["featureIndex"].alias("feature_index"),
        F.try_element_at(data["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"),
        data["leftChild"].alias("left"),
        data["rightChild"].alias("right"),
        F.aggregate(stats, F.lit(0.0), lambda acc, x: acc + x).alias("weight"),
        F.coalesce(F.try_element_at(stats, F.lit(2)), F.lit(0.0)).alias("positives"),
    )
    if features is None:
        return nodes
    names = F.array(*[F.lit(f) for f in features])
    return nodes.withColumn("feature", F.when(F.col("left") >= 0, F.element_at(names, F.col("feature_index") + 1)))


def impurity_importance(nodes: DataFrame) -> DataFrame:
    """(feature, importance): the impurity that a feature's splits take away, weighted by the rows
    that come through them, as a share of the tree's; averaged over the trees whose splits take
    away any, as a share of the whole. ``nodes`` has tree, node, feature, left, right, weight and
    positives (two classes, Gini)."""
    p = F.col("positives") / F.col("weight")
    impure = F.when(F.col("weight") > 0, F.col("weight") * 2 * p * (1 - p)).otherwise(F.lit(0.0))
    each = nodes.select("tree", "node", "feature", "left", "right", impure.alias("impure"))
    sides = [each.select("tree", F.col("node").alias(side), F.col("impure").alias(f"impure_{side}")) for side in ("left", "right")]
    split = each.where(F.col("feature").isNotNull())
    for side, child in zip(("left", "right"), sides):
        split = split.join(child, ["tree", side], "left")
    gone = F.col("impure") - F.coalesce("impure_left", F.lit(0.0)) - F.coalesce("impure_right", F.lit(0.0))
    by_tree = split.groupBy("tree", "feature").agg(F.sum(gone).alias("gain"))
    totals = by_tree.groupBy("tree").agg(F.sum("gain").alias("total")).where("total > 0")
    shares = by_tree.join(totals, "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("total")).alias("share"))
    whole = shares.agg(F.sum("share").alias("whole")).scalar()
    return shares.select("feature", (F.col("share") / whole).alias("importance"))


def ranked_contributions(features: Sequence[str], k: int | None = None) -> Column:
    """array<struct<feature, phi, idx>> of the first ``k`` (default all) contributions of one
    row in rank order — plain element lookups through the row's ``order`` array; phi is
    rounded to ``RANK_DECIMALS`` like the ranking key."""
    names = F.array(*[F.lit(f) for f in features])
    k = len(features) if k is None else min(k, len(features))
    entries = []
    for j in range(k):
        i = F.col("order")[j]
        entries.append(
            F.struct(
                F.element_at(names, i).alias("feature"),
                round_double(F.element_at(F.col("phi"), i), RANK_DECIMALS).alias("phi"),
                i.alias("idx"),
            )
        )
    return F.array(*entries)


def explanations_long(
    explained: DataFrame,
    features: Sequence[str],
    id_col: str = "id",
    k: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(id, *carry, feature, phi, rank, idx): rank 1 = largest |phi|. No shuffle — each row's
    ``order`` array (sliced to the top ``k``) is exploded first and the feature name and phi
    are looked up per output row (cheaper than exploding an array of structs)."""
    names = F.array(*[F.lit(f) for f in features])
    order = F.col("order") if k is None else F.slice("order", 1, k)
    exploded = explained.select(id_col, *carry, "phi", F.posexplode_outer(order).alias("pos", "idx"))
    return exploded.select(
        id_col,
        *carry,
        F.element_at(names, F.col("idx")).alias("feature"),
        round_double(F.element_at(F.col("phi"), F.col("idx")), RANK_DECIMALS).alias("phi"),
        (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("idx"),
    )


FOREST_NODE_SCHEMA = T.StructType(
    [
        T.StructField("tree", T.IntegerType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("feature", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("right", T.IntegerType()),
        T.StructField("cover", T.DoubleType()),
        T.StructField("value", T.DoubleType()),
    ]
)
