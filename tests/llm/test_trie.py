"""Tries against one built plainly from lists of turns."""

import hashlib
import math
import random
import zlib

from riskloom.llm.turn_trie import bits_of, build_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, shard string, id1 long"


def plain(rows):
    """Rows: conv_id, turn, role, text."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        ends = sorted(c for c in convs if len(paths[c]) == len(node))
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        childless = [m for m in below if not any(len(x) == len(m) + 1 and x[:-1] == m for x in below)]
        children = [m for m in below if len(m) == len(node) + 1]
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(convs), len(node), str(parent), len(convs), len(children), len(childless), saved, digest))
    return sorted(out)


def result(spark, rows, **settings):
    frame = spark.createDataFrame([(*r, 7, "x", 3) for r in rows], SCHEMA)
    got = build_trie(frame, **settings).collect()
    return sorted((r.conv_id, r.depth, str(r.parent_conv_id), r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got)


def drawn(seed, n, long=0):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.choice([0, 1, 2, 3, 5, 9, 12])):
            rows.append((3 * c if c % 4 else c, t if r.random() > 0.1 else None, r.choice(["user", "bot", None]), r.choice(["a", "é", "", None, "bb", "a"])))
    rows += [(1000, t, "user", "long" if t % 7 else "other") for t in range(long)]
    rows += [(1005, t, "user", "long" if t % 7 else "other") for t in range(long // 2)]
    rows += [(1010, t, "user", "long" if t % 7 else "other") for t in range(long // 2)]
    rows += [(None, 1, "user", "nobody's"), (-3, 0, "user", "below"), *rows[:3]]
    r.shuffle(rows)
    return rows


def test_against_a_plain_trie(spark):
    rows = drawn(3, 60)
    assert result(spark, rows) == plain(rows)


def test_many_shards_and_bands(spark):
    """Shards of few conversations, bands of few turns, ends on the seams of bands."""
    rows = drawn(4, 45, long=40)
    expected = plain(rows)
    for shard, band in ((3, 2), (7, 5), (1, 1)):
        assert result(spark, rows, shard=shard, band=band) == expected


def test_hot_turns_and_copies(spark):
    rows = [(c, t, "user", "the same") for c in range(40) for t in range(3)] + [(c, 0, "user", "the same") for c in range(40, 60)]
    assert result(spark, rows, shard=8) == plain(rows)


def test_turnless_and_empty(spark):
    number = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    rows = [(number, 0, "user", "taken by nobody")]
    assert result(spark, rows) == plain(rows) == [(number, 0, "None", 1, 0, 1, 0, hashlib.sha256(str(number).encode()).hexdigest())]
    assert result(spark, []) == []
    assert result(spark, [(None, 0, "user", "x")]) == []


def test_bitsets():
    for members in ([0], [7, 8], [3, 100, 1023]):
        x = int.from_bytes(bits_of(members), "little")
        assert [i for i in range(1100) if x >> i & 1] == members
