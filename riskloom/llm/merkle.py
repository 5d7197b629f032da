"""Merkle manifest of a dataset, in blocks of van Emde Boas layout.

The leaves of a group (a language) ascend by id; every FAN consecutive nodes have their hash
as parent until one is left, the group's root. A tree is cut into blocks, the aligned subtrees
of HEIGHT levels of edges (4,096 leaves), each built in one task and kept as one flat array of
digests. Inside a block the nodes lie in van Emde Boas order: the tree is split at half its
height, the top part comes first, then each of the parts below it, all laid out the same way.
`address` says where a node lies; building a level and finding the siblings of a node both go
through it. The roots of the blocks are the leaves of the next tier of blocks, until a group
has one block; its root is the group's. The groups' roots, in order, are leaves of one tree
more. What lies above a block is handed down from tier to tier, so a proof needs the row's own
block and nothing else.

Places of the leaves come from sums along range partitions: a group that holds most rows is
split like any other.

Defined results: a null field is `-` in the leaf, an empty one `0:`; a null id comes first,
counts as the empty text in crc32; rows of a group with the same id go by their leaf, and equal
rows are leaves each; a null group comes first and the empty one after it; extra columns take no
part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import hash_remainder
from riskloom.llm.sequence import along
from riskloom.session import checkpoint

#: Children of a node, and levels of edges in a block.
FAN, HEIGHT = 8, 4

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<before: binary, after: binary>>"


def nodes_in(levels: int, fan: int = FAN) -> int:
    """Nodes of a full tree with so many levels of nodes."""
    return (fan**levels - 1) // (fan - 1)


def address(levels: int, depth: int, index: np.ndarray, fan: int = FAN) -> np.ndarray:
    """Places, in the layout of a tree with so many levels of nodes, of nodes at a depth."""
    if levels == 1:
        return np.zeros(len(index), dtype=np.int64)
    top = levels // 2
    if depth < top:
        return address(top, depth, index, fan)
    below = fan ** (depth - top)
    return nodes_in(top, fan) + index // below * nodes_in(levels - top, fan) + address(levels - top, depth - top, index % below, fan)


@cache
def places(levels: int, depth: int, fan: int = FAN) -> np.ndarray:
    return address(levels, depth, np.arange(fan**depth), fan)


def parent(hexes: str) -> bytes:
    return hashlib.sha256(hexes.encode()).digest()


class Block:
    """One aligned subtree: the array of digests in layout order, and its number of leaves."""

    def __init__(self, nodes: np.ndarray, leaves: int, fan: int = FAN) -> None:
        self.nodes, self.leaves, self.fan = nodes, leaves, fan
        self.levels = next(k for k in range(1, 99) if nodes_in(k, fan) == len(nodes))

    @classmethod
    def build(cls, digests: list[bytes], levels: int, fan: int = FAN) -> Block:
        block = cls(np.zeros((nodes_in(levels, fan), 32), dtype=np.uint8), len(digests), fan)
        block.nodes[places(levels, levels - 1, fan)[: len(digests)]] = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 32)
        for depth in range(levels - 2, -1, -1):
            own = [parent(run) for run in block.runs(depth + 1)]
            block.nodes[places(levels, depth, fan)[: len(own)]] = np.frombuffer(b"".join(own), dtype=np.uint8).reshape(-1, 32)
        return block

    def runs(self, depth: int) -> list[str]:
        """The hex texts of the runs at a depth."""
        n = -(-self.leaves // self.fan ** (self.levels - 1 - depth))
        text, width = self.nodes[places(self.levels, depth, self.fan)[:n]].tobytes().hex(), 64 * self.fan
        return [text[i : i + width] for i in range(0, len(text), width)]

    def root(self) -> bytes:
        return self.nodes[0].tobytes()

    def siblings(self) -> list[list[str]]:
        """Runs by level, from the leaves up to the children of the root."""
        return [self.runs(depth) for depth in range(self.levels - 1, 0, -1)]


def around(levels: list[list[str]], place: int, fan: int = FAN) -> Iterator[tuple[str, str]]:
    """Hex texts before and after a leaf's ancestors in their runs, level by level."""
    for runs in levels:
        run, at = runs[place // fan], 64 * (place % fan)
        yield run[:at], run[at + 64 :]
        place //= fan


BLOCKS = "key string, block long, leaves int, nodes binary, root binary"


def grow(leaves: DataFrame, fan: int = FAN, height: int = HEIGHT) -> list[DataFrame]:
    """The blocks of the groups' trees by tier, from leaves (key, place, digest)."""
    span = fan**height

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        n, block = len(part), int(part["block"].iloc[0])
        # a block that is not the only one of its group goes up to full height
        levels = height + 1 if block or n == span else next(k for k in range(1, height + 2) if fan ** (k - 1) >= n)
        made = Block.build([bytes(d) for d in part["digest"]], levels, fan)
        return pd.DataFrame({"key": [part["key"].iloc[0]], "block": [block], "leaves": [n], "nodes": [made.nodes.tobytes()], "root": [made.root()]})

    tiers, level = [], leaves.select("key", "place", "digest")
    while True:
        numbered = level.withColumn("block", F.floor(F.col("place") / span).cast("long"))
        tiers.append(checkpoint(numbered.groupBy("key", "block").applyInPandas(build, BLOCKS)))
        roots = tiers[-1].select("key", F.col("block").alias("place"), F.col("root").alias("digest"))
        more = checkpoint(roots.where("place > 0").select("key").distinct())
        if more.isEmpty():
            return tiers
        level = roots.join(more, "key", "left_semi")


def block_of(nodes: bytes, leaves: int, fan: int = FAN) -> Block:
    return Block(np.frombuffer(nodes, dtype=np.uint8).reshape(-1, 32), leaves, fan)


def leaf_paths(blocks: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """key, place, path, subroot and root of every leaf of blocks that know what is above them."""
    span = fan**height

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                levels = block_of(r.nodes, r.leaves, fan).siblings()
                above = [(p["before"], p["after"]) for p in r.path]
                own = [[(bytes.fromhex(x), bytes.fromhex(y)) for x, y in around(levels, i, fan)] for i in range(r.leaves)]
                yield pd.DataFrame(
                    {"key": r.key, "place": np.arange(r.leaves) + r.block * span, "path": [[{"before": x, "after": y} for x, y in p + above] for p in own], "subroot": r.subroot, "root": r.top}
                )

    schema = f"key string, place long, path {PATH}, subroot binary, root binary"
    return blocks.select("key", "block", "leaves", "nodes", "path", "subroot", F.col("top")).mapInPandas(run, schema)


def paths_above(tiers: list[DataFrame], above: DataFrame | None, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """The blocks of the lowest tier, with the path above each, its group's root (subroot) and
    the root of all (top). `above` has key, path and top of each group's root."""
    out = None
    for t in reversed(range(len(tiers))):
        blocks = tiers[t]
        only = blocks.select("key", "block", F.col("root").alias("subroot"))
        if t + 1 < len(tiers):
            only = only.join(tiers[t + 1].select("key").distinct(), "key", "left_anti")
        if above is None:
            own = only.select("key", "block", F.array().cast(PATH).alias("path"), "subroot", F.col("subroot").alias("top"))
        else:
            own = only.join(above, "key").select("key", "block", "path", "subroot", "top")
        if out is not None:
            inner = leaf_paths(out, fan, height)
            own = own.union(inner.select("key", F.col("place").alias("block"), "path", "subroot", F.col("root").alias("top")))
        out = checkpoint(blocks.drop("root").join(own, ["key", "block"]))
    return out


def group_key(group: Column) -> Column:
    """Text keys that are never null and sort as the groups do, null first."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Of each field `-` if null, else its UTF-8 bytes counted, a colon and the value."""
    said = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in fields.values()]
    return F.unhex(F.sha2(F.concat(*said), 256))


def document_leaves(docs: DataFrame) -> DataFrame:
    """key, doc_id, digest and what the digest is after tampering."""
    own = {c: F.col(c).cast("string") for c in FIELDS}
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = leaf_digest(own | {"text": F.translate(own["text"], upper, upper.lower())})
    digest = leaf_digest(own)
    tampered = F.when(hash_remainder(F.col("doc_id").cast("long"), 3) == 0, lowered).otherwise(digest)
    return docs.select(group_key(F.col("lang")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), tampered.alias("tampered"))


def placed_leaves(rows: DataFrame) -> DataFrame:
    return along(rows.withColumn("one", F.lit(1).cast("long")), ["key"], ["doc_id", "digest"], {"place": "one"}).drop("one")


def tree_of(leaves: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """Blocks of the lowest tier with all that a proof needs, from (key, place, digest)."""
    tiers = grow(leaves, fan, height)
    roots = None
    for t, blocks in enumerate(tiers):
        only = blocks if t + 1 == len(tiers) else blocks.join(tiers[t + 1].select("key").distinct(), "key", "left_anti")
        own = only.select(F.lit("").alias("all"), F.col("key"), F.col("root").alias("digest"), F.lit(1).cast("long").alias("one"))
        roots = own if roots is None else roots.union(own)
    groups = checkpoint(along(checkpoint(roots), ["all"], ["key"], {"place": "one"}).drop("one"))
    top = paths_above(grow(groups.select(F.col("all").alias("key"), "place", "digest"), fan, height), None, fan, height)
    above = leaf_paths(top, fan, height).select("place", "path", F.col("root").alias("top")).join(groups.select("place", "key"), "place")
    return paths_above(tiers, checkpoint(above.select("key", "path", "top")), fan, height)


MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    leaves = checkpoint(placed_leaves(checkpoint(document_leaves(docs))))
    blocks, span = tree_of(leaves, fan, height), fan**height

    def prove(rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        b = block.iloc[0]
        levels = block_of(b["nodes"], b["leaves"], fan).siblings()
        above = [(p["before"].hex(), p["after"].hex()) for p in b["path"]]
        rest, root, out = "".join(x + y for x, y in above).encode(), b["top"], []
        for doc_id, place, digest, tampered in zip(rows["doc_id"].astype("Int64"), rows["place"], rows["digest"], rows["tampered"], strict=True):
            proof, folded = hashlib.sha256(), tampered.hex()
            for before, after in around(levels, place % span, fan):
                proof.update((before + after).encode())
                folded = hashlib.sha256((before + folded + after).encode()).hexdigest()
            proof.update(rest)
            for before, after in above:
                folded = hashlib.sha256((before + folded + after).encode()).hexdigest()
            out.append((doc_id, digest.hex(), b["subroot"].hex(), root.hex(), proof.hexdigest(), folded, folded == root.hex()))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in MANIFEST.split(", ")])
        return frame.astype({"doc_id": "Int64"})

    rows = leaves.withColumn("block", F.floor(F.col("place") / span).cast("long"))
    return rows.groupBy("key", "block").cogroup(blocks.groupBy("key", "block")).applyInPandas(prove, MANIFEST)


def proofs(docs: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, path (the siblings before and after, level by level), subroot and root, for
    those who check rows elsewhere."""
    leaves = checkpoint(placed_leaves(checkpoint(document_leaves(docs))))
    found = leaf_paths(tree_of(leaves, fan, height), fan, height)
    return leaves.join(found, ["key", "place"]).select("doc_id", F.col("digest").alias("leaf"), "path", "subroot", "root")
