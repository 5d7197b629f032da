"""Nearest neighbours by inner product: a hierarchical small-world graph for each shard.

Equal vectors are indexed once, with their smallest ids: of the copies of one vector only
that many can be in a result. Vectors are dealt to shards by hash, SHARD_ROWS to a shard or
as many as SHARD_BYTES hold, whatever the size of the table. In a shard, nodes are inserted
block by block in an order fixed by hash: a block searches down the layers among the nodes
before it; each of its nodes links to diverse near ones of those found and of its block, and
these link back, keeping diverse ones where they run out of room, on every layer that the
node reaches. So the work of a shard grows little faster than its rows. A layer is kept as a
flat array of neighbours. Queries go in blocks down the layers, all of a block in step, each with a beam
of its own; what the shards find is scored in double precision and merged for each query.

For inner products of vectors of different lengths the graph is built after adding one
component that makes all lengths of a shard equal, which keeps their order for any query.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without an id, take no part; vectors are compared with those of as
many components only; repeated rows count once; ties go to the smaller id; a query finds
fewer neighbours if there are no more candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import checkpoint

NEIGHBOURS = 20
#: Expected vectors of a shard and bytes of them at most, queries of a block, nodes inserted together.
SHARD_ROWS, SHARD_BYTES, BLOCK_ROWS, INSERTED = 32_768, 1 << 26, 1024, 512
#: Links of a node to earlier nodes, and with links back; candidates looked at; beams.
LINKS, LINKS_BACK, CANDIDATES, BEAM, UPPER_BEAM = 16, 32, 48, 96, 24


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def diverse(points: np.ndarray, near: np.ndarray, dist: np.ndarray, links: int) -> np.ndarray:
    """Of each row's candidates, nearest first, those nearer to the row's node than to any
    already taken; free places go to the nearest of the others. -1 where there is none."""
    rows, width = near.shape
    taken = np.full((rows, links), -1, dtype=np.int32)
    count = np.zeros(rows, dtype=np.int64)
    chosen = np.zeros((rows, width), dtype=bool)
    for j in range(width):
        live = np.flatnonzero((near[:, j] >= 0) & (count < links))
        if not len(live):
            continue
        c = points[near[live, j]]
        k = taken[live]
        gap = ((points[k] - c[:, None, :]) ** 2).sum(axis=2)
        gap[k < 0] = np.inf
        good = live[gap.min(axis=1) > dist[live, j]]
        taken[good, count[good]] = near[good, j]
        count[good] += 1
        chosen[good, j] = True
    order = np.argsort(chosen | (near < 0), axis=1, kind="stable")
    for j in range(width):
        live = np.flatnonzero(count < links)
        at = order[live, j]
        free = ~chosen[live, at] & (near[live, at] >= 0)
        live, at = live[free], at[free]
        if not len(live):
            break
        taken[live, count[live]] = near[live, at]
        count[live] += 1
    return taken


class Layer:
    """Nodes of one layer in the order of insertion, and their neighbours: links to earlier
    nodes, then links back from later ones. Both are places in the layer."""

    def __init__(self, nodes: np.ndarray, points: np.ndarray, back: int) -> None:
        self.nodes, self.points, self.rough, self.back = nodes, points, points.astype(np.float32), back
        self.links = np.full((len(nodes), LINKS + back), -1, dtype=np.int32)
        self.room = np.full(len(nodes), back)

    def insert(self, lo: int, hi: int, found: np.ndarray) -> None:
        """Links the nodes lo to hi; `found` has places of near nodes below lo, or -1."""
        points, own = self.points, np.arange(lo, hi, dtype=np.int32)
        earlier = np.where(own[None, :] < own[:, None], own[None, :], -1)
        near = np.concatenate([found.astype(np.int32), earlier], axis=1)
        rough = np.concatenate([np.einsum("ijk,ik->ij", self.rough[found], self.rough[lo:hi]), self.rough[lo:hi] @ self.rough[lo:hi].T], axis=1)
        rough[near < 0] = -np.inf
        width = min(CANDIDATES, near.shape[1])
        near = np.take_along_axis(near, np.argpartition(-rough, width - 1, axis=1)[:, :width], axis=1)
        self.links[lo:hi, :LINKS] = diverse(points, *self.sorted_by_distance(own, near), LINKS)
        self.link_back(np.repeat(own, LINKS), self.links[lo:hi, :LINKS].reshape(-1))

    def sorted_by_distance(self, rows: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dist = ((self.points[near] - self.points[rows][:, None, :]) ** 2).sum(axis=2)
        dist[near < 0] = np.inf
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(near, order, axis=1), np.take_along_axis(dist, order, axis=1)

    def link_back(self, frm: np.ndarray, to: np.ndarray) -> None:
        """Links from `to` to `frm`; a node without room for its new ones keeps diverse near
        ones of all."""
        frm, to = frm[to >= 0], to[to >= 0]
        order = np.lexsort((((self.points[frm] - self.points[to]) ** 2).sum(axis=1), to))
        frm, to = frm[order], to[order]
        nodes, first, new = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(first, new)
        fits = np.repeat(new <= self.room[nodes], new)
        self.links[to[fits], LINKS + self.back - self.room[to[fits]] + rank[fits]] = frm[fits]
        full = nodes[new > self.room[nodes]]
        self.room[nodes] = np.maximum(0, self.room[nodes] - new)
        if not len(full):
            return
        wanted = ~fits & (rank < 3 * CANDIDATES)
        row = np.searchsorted(full, to[wanted])
        near = np.full((len(full), self.back + int(rank[wanted].max()) + 1), -1, dtype=np.int32)
        near[:, : self.back] = self.links[full, LINKS:]
        near[row, self.back + rank[wanted]] = frm[wanted]
        self.links[full, LINKS:] = diverse(self.points, *self.sorted_by_distance(full, near), self.back)


class Graph:
    """A shard: vectors in order of insertion and, for each layer, its nodes and neighbours."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray, level: np.ndarray) -> Graph:
        """`level` is the highest layer of each node."""
        lengths = (vectors**2).sum(axis=1)
        points = np.column_stack([vectors, np.sqrt(np.maximum(0, lengths.max(initial=0) - lengths))])
        layers: list[Layer] = []
        for top in range(int(level.max(initial=0)) + 1):
            nodes = np.flatnonzero(level >= top).astype(np.int32)
            layers.append(Layer(nodes, points[nodes], LINKS if top else LINKS_BACK))
            if len(nodes) <= 64:
                break
        for lo in range(0, len(points), INSERTED):
            hi = min(len(points), lo + INSERTED)
            q = points[lo:hi].astype(np.float32)
            best: np.ndarray | None = None
            for depth in range(len(layers) - 1, -1, -1):
                layer = layers[depth]
                before, after = np.searchsorted(layer.nodes, [lo, hi])  # places of the block's own nodes
                found = np.full((hi - lo, 1), -1)
                if before:
                    found = cls.near(layer, before, q, best, UPPER_BEAM if depth else CANDIDATES)
                    best = np.where(found >= 0, layer.nodes[found], layer.nodes[found[:, :1]])
                if after > before:
                    layer.insert(before, after, found[layer.nodes[before:after] - lo])
        return cls(vectors, [(x.nodes, x.links) for x in layers])

    @classmethod
    def near(cls, layer: Layer, n: int, q: np.ndarray, start: np.ndarray | None, beam: int) -> np.ndarray:
        """Places of near nodes among the first n of a layer. All points have one length, so
        the largest inner product is the smallest distance."""
        vectors = layer.rough[:n]
        if start is None:  # no node on the layers above: few on this one
            score = q @ vectors.T
            inside = np.argsort(-score, axis=1, kind="stable")[:, :UPPER_BEAM]
            score = np.take_along_axis(score, inside, axis=1)
        else:
            inside = np.searchsorted(layer.nodes[:n], start)
            score = np.einsum("ijk,ik->ij", vectors[inside], q)
        return cls.walk(vectors, layer.links[:n], q, inside, score, beam)[0]

    def search(self, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Positions (-1: none) and single-precision scores of the best nodes of each query."""
        vectors, q = self.vectors.astype(np.float32), queries.astype(np.float32)
        nodes, _ = self.layers[-1]
        score = q @ vectors[nodes].T
        order = np.argsort(-score, axis=1, kind="stable")[:, :UPPER_BEAM]
        best, score = nodes[order], np.take_along_axis(score, order, axis=1)
        for depth in range(len(self.layers) - 1, -1, -1):
            nodes, links = self.layers[depth]
            inside = np.searchsorted(nodes, best)
            here, score = self.walk(vectors[nodes], links, q, inside, score, beam if depth == 0 else UPPER_BEAM)
            best = np.where(here >= 0, nodes[here], -1)
            if depth:
                found = best >= 0
                best = np.where(found, best, best[:, :1])
        return best, score

    @staticmethod
    def walk(vectors: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, start_score: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in step, one expansion of each query a step."""
        m = len(q)
        seen = np.zeros((m, len(vectors)), dtype=bool)
        ids, score, done = np.full((m, beam), -1, dtype=np.int64), np.full((m, beam), -np.inf, dtype=np.float32), np.ones((m, beam), dtype=bool)
        w = min(beam, start.shape[1])
        ids[:, :w], score[:, :w], done[:, :w] = start[:, :w], start_score[:, :w], False
        repeated = np.zeros((m, w), dtype=bool)
        order = np.argsort(ids[:, :w], axis=1, kind="stable")
        in_order = np.take_along_axis(ids[:, :w], order, axis=1)
        np.put_along_axis(repeated, order, np.concatenate([np.zeros((m, 1), dtype=bool), in_order[:, 1:] == in_order[:, :-1]], axis=1), axis=1)
        ids[:, :w][repeated], score[:, :w][repeated], done[:, :w][repeated] = -1, -np.inf, True
        rows, cols = np.nonzero(ids >= 0)
        seen[rows, ids[rows, cols]] = True
        live = np.arange(m)
        while len(live):
            open_score = np.where(done[live], -np.inf, score[live])
            pick = open_score.argmax(axis=1)
            going = open_score[np.arange(len(live)), pick] > -np.inf
            live, pick = live[going], pick[going]
            if not len(live):
                break
            done[live, pick] = True
            near = links[ids[live, pick]].astype(np.int64)
            new = (near >= 0) & ~seen[live[:, None], near]
            r, c = np.nonzero(new)
            seen[live[r], near[r, c]] = True
            value = np.full(near.shape, -np.inf, dtype=np.float32)
            value[r, c] = np.einsum("ij,ij->i", vectors[near[r, c]], q[live[r]])
            all_score = np.concatenate([score[live], value], axis=1)
            top = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
            all_ids = np.concatenate([ids[live], np.where(new, near, -1)], axis=1)
            all_done = np.concatenate([done[live], ~new], axis=1)
            score[live] = np.take_along_axis(all_score, top, axis=1)
            ids[live] = np.take_along_axis(all_ids, top, axis=1)
            done[live] = np.take_along_axis(all_done, top, axis=1)
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(score, order, axis=1)


def distinct_vectors(rows: DataFrame, vec_id: str, vector: str, most: int) -> DataFrame:
    """vector, its number of components, and its `most` smallest ids in order. Larger ids
    are dropped before the shuffle already."""
    source = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))
    few = source.withColumn("place", place).where(F.col("place") <= most)
    return few.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("width", F.size("vector"))


INDEX = "width int, shard long, n int, vectors binary, ids binary, copies binary, layers array<binary>"


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard with its graph. `vectors` has vector, ids and width."""
    most = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("width")))))
    shards = vectors.groupBy("width").agg(F.ceil(F.count("*") / F.first(most)).alias("shards"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order"], kind="stable")
        x = np.array(group["vector"].tolist(), dtype=np.float64)
        u = (group["height"].to_numpy(dtype=np.int64).view(np.uint64) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        level = np.floor(-np.log(np.maximum(u, 1e-12)) / math.log(LINKS)).astype(np.int64)
        graph = Graph.build(x, level)
        copies = np.array([len(i) for i in group["ids"]], dtype=np.int32)
        layers = [a.tobytes() for pair in graph.layers for a in (pair[0].astype(np.int32), pair[1].astype(np.int32))]
        ids = np.concatenate([np.asarray(i, dtype=np.int64) for i in group["ids"]])
        return pd.DataFrame([(int(group["width"].iloc[0]), int(group["shard"].iloc[0]), len(x), x.tobytes(), ids.tobytes(), copies.tobytes(), layers)], columns=[c.split()[0] for c in INDEX.split(", ")])

    # the order of insertion and the layer come from two independent hashes of the vector
    dealt = vectors.join(shards, "width").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards"))).drop("shards").withColumns({"order": F.xxhash64(F.lit(17), "vector"), "height": F.xxhash64(F.lit(29), "vector")})
    return dealt.groupBy("width", "shard").applyInPandas(build, INDEX)


def load_shard(row) -> tuple[Graph, np.ndarray, np.ndarray]:
    """The graph, the ids of all nodes in a row, and where each node's ids begin."""
    vectors = np.frombuffer(row.vectors, dtype=np.float64).reshape(row.n, -1)
    layers = []
    for i in range(0, len(row.layers), 2):
        nodes = np.frombuffer(row.layers[i], dtype=np.int32)
        layers.append((nodes, np.frombuffer(row.layers[i + 1], dtype=np.int32).reshape(len(nodes), -1)))
    copies = np.frombuffer(row.copies, dtype=np.int32)
    return Graph(vectors, layers), np.frombuffer(row.ids, dtype=np.int64), np.concatenate([[0], np.cumsum(copies)])


def search_index(index: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, beam: int = BEAM, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score. `queries` has id and vector; a query's own id is no
    result. Every shard sees the queries block by block."""
    blocks = max(1, math.ceil(queries.count() / block_rows))
    dealt = queries.withColumn("width", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    block = dealt.groupBy("width", "block").agg(F.collect_list(F.struct("id", F.col("vector").cast("array<double>").alias("vector"))).alias("queries"))
    everywhere = block.join(F.broadcast(index.groupBy("width").agg(F.collect_list("shard").alias("shards"))), "width").withColumn("shard", F.explode("shards")).drop("shards")
    work = everywhere.join(index, ["width", "shard"]).select("queries", "n", "vectors", "ids", "copies", "layers")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                graph, ids, first = load_shard(row)
                q_ids = np.array([x["id"] for x in row.queries], dtype=np.int64)
                q = np.array([x["vector"] for x in row.queries], dtype=np.float64)
                best, _ = graph.search(q, max(beam, k + 12))
                best = best[:, : k + 12]
                r, c = np.nonzero(best >= 0)
                node = best[r, c]
                exact = (graph.vectors[node] * q[r]).sum(axis=1)
                n_copies = first[node + 1] - first[node]
                rep = np.repeat(np.arange(len(node)), n_copies)
                at = np.arange(len(rep)) - np.repeat(np.cumsum(n_copies) - n_copies, n_copies)
                out = pd.DataFrame({"query_id": q_ids[r[rep]], "vec_id": ids[first[node[rep]] + at], "score": exact[rep]})
                out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
                yield out.groupby("query_id", sort=False).head(k)

    found = work.mapInPandas(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, every: int = 20, k: int = NEIGHBOURS, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """Neighbours of the rows whose id is divisible by `every`, among all rows."""
    vectors = checkpoint(distinct_vectors(rows, vec_id, vector, k + 1))
    index = checkpoint(build_index(vectors, shard_rows))
    queries = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector")).where((F.col("id") % every == 0) & usable(F.col("vector"))).dropDuplicates(["id"])
    return search_index(index, queries, k, beam)
