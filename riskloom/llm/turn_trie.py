"""Prefix trie of conversations, by vertical bitmaps.

Conversations, in order of their ids, are cut into shards of SHARD, and the positions of their
turns into bands of BAND; a tile is a shard's part of a band. A tile's index holds, for each
(position, turn), the bitset of the shard's conversations that have this turn there, and for
each position the bitset of those that end there. A depth-first walk starts from the sets of
conversations with one and the same prefix before the band; a parent's bitset intersected with
the postings of the next position gives its children, the popcount their members, and the
intersection with the ends the list of those that end there. No tile is larger than
SHARD x BAND turns, however long a conversation or common a turn is.

Nodes of different tiles are one if depth and prefix are equal; a prefix is named by its depth
and two 64-bit sums of hashes of its turns, each hashed with its position, so that the names
come from sums along range partitions.

What a node has below it comes from its members alone. A node's owner is its smallest member.
The nodes that a conversation owns are those of its path from some depth k on. So the nodes of
a subtree below which nothing is are counted by its members that own their last node, if that
has no children; and (members - 1) times the bytes of each node, over a subtree, is the sum
over members of the bytes of their path in it above their k. A second walk sums both.

Defined results: `%` is SQL's, its sign that of the id; rows without a conversation id belong to none and are left out; of turns with
equal numbers the order is that of the SHA-256 of role and text; repeated rows are turns each;
extra columns take no part; a table without conversations gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.sequence import ordered, sums
from riskloom.session import checkpoint

#: Conversations of a shard, and positions of a band.
SHARD, BAND = 1024, 64
#: Conversations come in fives that share first turns, of which one takes 0 to 8.
FIVE, MOST = 5, 8

NODE = ["depth", "id1", "id2"]


def shared_turns(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(MOST + 1))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest of role and text, and the UTF-8 bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Ordered rows of the rebuilt conversations: conv_id, digest, bytes and position from 0. Each
    conversation, also one without turns, has a last row with no digest."""
    one = F.lit(1).cast("long").alias("one")
    own = checkpoint(sums(ordered(turns.select("*", one), ["conv_id"], ["turn", "digest"]), {"position": "one"}).drop("_group", "_pid", "one"))
    first = F.col("conv_id") - F.col("conv_id") % FIVE
    given = own.where((F.col("conv_id") % FIVE == 0) & (F.col("position") < MOST)).withColumnRenamed("conv_id", "giver")
    convs = own.select("conv_id").distinct()
    taken = convs.where(F.col("conv_id") != first).join(given, first == F.col("giver")).where(F.col("position") < shared_turns(F.col("conv_id")))
    kept = own.where((F.col("conv_id") == first) | (F.col("position") >= shared_turns(F.col("conv_id"))))
    parts = [
        taken.select("conv_id", F.lit(0).alias("part"), "position", "digest", "bytes"),
        kept.select("conv_id", F.lit(1).alias("part"), "position", "digest", "bytes"),
        convs.select("conv_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("position"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes")),
    ]
    both = checkpoint(parts[0].union(parts[1]).union(parts[2]).withColumnRenamed("position", "sorted").withColumn("one", F.lit(1).cast("long")))
    return sums(ordered(both, ["conv_id"], ["part", "sorted"]), {"position": "one"}).drop("part", "sorted", "one")


def cells_of(rows: DataFrame, shard: int, band: int) -> DataFrame:
    """The rows with their tile, the hashes h1 and h2 of the turn at its position, and the sums
    id1, id2 and before (bytes) of the turns before it."""
    named = rows.withColumns(
        {
            "h1": F.when(F.col("digest").isNull(), F.lit(0)).otherwise(F.xxhash64("digest", "position")).cast("long"),
            "h2": F.when(F.col("digest").isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit("second"), "position", "digest")).cast("long"),
            "starts": (F.col("position") == 0).cast("long"),
        }
    ).drop("digest")
    inside = sums(named, {"id1": "h1", "id2": "h2", "before": "bytes"})
    counted = sums(inside.withColumn("_group", F.lit(0).cast("long")), {"begun": "starts"})  # conversations begun before the row
    number = F.col("begun") + F.col("starts") - 1
    return counted.select(
        F.floor(number / shard).cast("long").alias("shard"), (number % shard).cast("int").alias("local"), F.floor(F.col("position") / band).cast("long").alias("band"),
        "conv_id", "position", F.col("_last").alias("last"), "h1", "h2", "bytes", "id1", "id2", "before",
    )


INDEX = (
    "shard long, band long, convs array<long>, locals array<int>, id1 array<long>, id2 array<long>, before array<long>, "
    "position array<long>, h1 array<long>, h2 array<long>, bytes array<long>, bits array<binary>, end_position array<long>, end_bits array<binary>"
)


def bits_of(members) -> bytes:
    """A bitset as little-endian bytes without the zeros at its end."""
    x = 0
    for m in members:
        x |= 1 << m
    return x.to_bytes(-(-x.bit_length() // 8), "little")


def index_tile(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["local", "position"], kind="stable")
    first = part.drop_duplicates("local")
    turns, ends = part[~part["last"]], part[part["last"]]
    postings = turns.groupby(["position", "h1", "h2"], sort=True).agg(members=("local", list), bytes=("bytes", "first")).reset_index()
    closing = ends.groupby("position", sort=True).agg(members=("local", list)).reset_index()
    row = {
        "shard": part["shard"].iloc[0],
        "band": part["band"].iloc[0],
        "convs": first["conv_id"].tolist(),
        "locals": first["local"].tolist(),
        **{c: first[c].tolist() for c in ("id1", "id2", "before")},
        **{c: postings[c].tolist() for c in ("position", "h1", "h2", "bytes")},
        "bits": [bits_of(m) for m in postings["members"]],
        "end_position": closing["position"].tolist(),
        "end_bits": [bits_of(m) for m in closing["members"]],
    }
    return pd.DataFrame({k: pd.Series([v], dtype=object if isinstance(v, list) else "int64") for k, v in row.items()})


def vertical_index(cells: DataFrame) -> DataFrame:
    return cells.groupBy("shard", "band").applyInPandas(index_tile, INDEX)


def _members(bits: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(-(-bits.bit_length() // 8), "little"), dtype=np.uint8), bitorder="little"))


_WIDE = 1 << 64


def _signed(x: int) -> int:
    return (x + (1 << 63)) % _WIDE - (1 << 63)


def walk(tile, band: int) -> Iterator[tuple]:
    """Depth-first: (depth, id1, id2, parent's id1 and id2, bytes, bytes of the whole prefix,
    bitset of members, bitset of those that end there, whether the tile counts the members). A
    node that an earlier band counts comes only for what ends there."""
    start = int(tile.band) * band
    postings: dict[int, list] = {}
    place: dict[int, dict[int, int]] = {}
    for position, h1, h2, size, bits in zip(tile.position, tile.h1, tile.h2, tile.bytes, tile.bits, strict=True):
        level, at = postings.setdefault(position, []), place.setdefault(position, {})
        whole = int.from_bytes(bits, "little")
        for m in _members(whole).tolist():
            at[m] = len(level)
        level.append((whole, int(h1), int(h2), int(size)))
    ends = {p: int.from_bytes(b, "little") for p, b in zip(tile.end_position, tile.end_bits, strict=True)}
    classes: dict[tuple[int, int], list[int]] = {}
    for m, id1, id2, before in zip(tile.locals, tile.id1, tile.id2, tile.before, strict=True):
        held = classes.setdefault((int(id1), int(id2)), [0, int(before)])
        held[0] |= 1 << int(m)
    stack = [(start, id1, id2, 0, 0, 0, before, members, start == 0) for (id1, id2), (members, before) in classes.items()]
    while stack:
        node = stack.pop()
        depth, id1, id2, _, _, _, before, members, counted = node
        closing = members & ends.get(depth, 0)
        # the node after the band's last turn closes in the next band, where it is a class
        if counted or closing:
            yield (*node[:8], closing, counted)
        rest, level, at = members & ~closing, postings.get(depth), place.get(depth)
        if level is None or depth >= start + band:
            continue
        while rest:
            bits, h1, h2, size = level[at[(rest & -rest).bit_length() - 1]]
            child = members & bits
            stack.append((depth + 1, _signed(id1 + h1), _signed(id2 + h2), id1, id2, size, before + size, child, True))
            rest &= ~child


NODES = "depth long, id1 long, id2 long, parent1 long, parent2 long, bytes long, prefix long, n long, conv_id long, shard long, ends string"


def walk_nodes(index: DataFrame, band: int) -> DataFrame:
    """The nodes of each tile: members, the smallest of them, and the list of the ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for tile in b.itertuples(index=False):
                ids, rows = dict(zip(tile.locals, map(int, tile.convs), strict=True)), []
                for depth, id1, id2, p1, p2, size, prefix, members, closing, counted in walk(tile, band):
                    least = ids[(members & -members).bit_length() - 1]  # local numbers go up with the ids
                    ends = ",".join([str(ids[m]) for m in _members(closing).tolist()]) if closing else None
                    rows.append((depth, id1, id2, p1, p2, size, prefix, members.bit_count() if counted else 0, least, tile.shard, ends))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])

    return index.mapInPandas(run, NODES)


def walk_sums(index: DataFrame, weights: DataFrame, band: int) -> DataFrame:
    """For the nodes of each tile, over their members: the last nodes owned, and the bytes that
    others own on the way from the node on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for tile in b.itertuples(index=False):
                top = max(max(tile.w_local), max(tile.locals)) + 1
                leaf, owned = np.zeros(top, dtype=np.int64), np.zeros(top, dtype=np.int64)
                leaf[np.asarray(tile.w_local)], owned[np.asarray(tile.w_local)] = tile.w_leaf, tile.w_owned
                rows = []
                for depth, id1, id2, _, _, size, prefix, members, _, counted in walk(tile, band):
                    if counted:
                        at = _members(members)
                        rows.append((depth, id1, id2, int(leaf[at].sum()), int(np.maximum(owned[at] - (prefix - size), 0).sum())))
                yield pd.DataFrame(rows, columns=[*NODE, "n_leaves", "saved_tokens"])

    by_shard = weights.groupBy("shard").agg(F.collect_list(F.struct("local", "leaf", "owned")).alias("w"))  # SHARD entries at most
    arrays = by_shard.select("shard", *[F.col("w")[c].alias(f"w_{c}") for c in ("local", "leaf", "owned")])
    return index.join(arrays, "shard").mapInPandas(run, "depth long, id1 long, id2 long, n_leaves long, saved_tokens long")


def end_digests(lists: DataFrame) -> DataFrame:
    """SHA-256 of the end lists of each node, shard by shard in order of the ids. One pass along
    sorted partitions keeps the state of one node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for b in batches:
            rows = []
            for depth, id1, id2, ends in zip(b["depth"], b["id1"], b["id2"], b["ends"], strict=True):
                if (depth, id1, id2) == node:
                    state.update(b"," + ends.encode())
                    continue
                if node is not None:
                    rows.append((*node, state.hexdigest()))
                node, state = (depth, id1, id2), hashlib.sha256(ends.encode())
            yield pd.DataFrame(rows, columns=[*NODE, "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    sorted_lists = lists.repartition(*NODE).sortWithinPartitions(*NODE, "shard").select(*NODE, "ends")
    return sorted_lists.mapInPandas(run, "depth long, id1 long, id2 long, ends_sha256 string")


def build_trie(conversations: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    rows = rebuilt(checkpoint(turns_of(conversations))).withColumn("_last", F.col("digest").isNull())
    cells = checkpoint(cells_of(rows, shard, band))
    index = checkpoint(vertical_index(cells))
    found = checkpoint(walk_nodes(index, band))
    nodes = checkpoint(
        found.groupBy(*NODE).agg(
            F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.max(F.when(F.col("n") > 0, F.col(c))).alias(c) for c in ("parent1", "parent2")],
            F.max("bytes").alias("bytes"), F.max("prefix").alias("prefix"),
        )
    )
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent1").alias("id1"), F.col("parent2").alias("id2")).agg(F.count("*").alias("n_children"))
    told = checkpoint(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    # prefix less bytes is what lies before a node: on a path it grows with the depth
    owners = told.groupBy("conv_id").agg(F.min(F.struct("depth", (F.col("prefix") - F.col("bytes")).alias("before"))).alias("k"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    whole = cells.where("last").select("conv_id", "shard", "local", "before")
    weights = whole.join(owners, "conv_id", "left").select("shard", "local", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("k.before", "before").alias("owned"))
    below = walk_sums(index, weights, band).groupBy(*NODE).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = end_digests(found.where("ends IS NOT NULL").select(*NODE, "shard", "ends"))
    parents = told.select((F.col("depth") + 1).alias("depth"), F.col("id1").alias("parent1"), F.col("id2").alias("parent2"), F.col("conv_id").alias("parent_conv_id"))
    full = told.join(below, NODE).join(ends, NODE, "left").join(parents, ["depth", "parent1", "parent2"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
