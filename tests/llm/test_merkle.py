"""Manifests against a tree built plainly, one list a level."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from riskloom.llm.merkle import Block, address, manifest, nodes_in, proofs
from riskloom.llm.sequence import along
from riskloom.session import checkpoint
from tests.llm.helpers import SCHEMA, hard_frame, hard_rows


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    said = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in said))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        start = i // 8 * 8
        yield level[start:i], level[i + 1 : start + 8]
        i //= 8


def plain(rows):
    """Rows: doc_id, text, lang, source, n_chars."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r[0], r[3], r[2], r[4], r[1]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = levels_of([trees[g][-1][0] for g in order])
    out = []
    for g in order:
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = [*siblings(trees[g], i), *siblings(top, order.index(g))]
            number = "" if r[0] is None else str(r[0])
            folded = leaf
            if zlib.crc32(number.encode()) % 3 == 0 and r[1] is not None:
                folded = leaf_of(r[0], r[3], r[2], r[4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for before, after in path:
                folded = h("".join(before) + folded + "".join(after))
            proof = h("".join(x for before, after in path for x in [*before, *after]))
            out.append((str(r[0]), leaf, trees[g][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out)


def result(frame, **settings):
    return sorted((str(r.doc_id), *r[1:]) for r in manifest(frame, **settings).collect())


def test_hard_rows(spark):
    words = ("the", "A", "Éa", "B c", "d$")
    rows = [r[:5] for r in hard_rows(vocabulary=words)]
    got = result(hard_frame(spark, vocabulary=words))
    assert got == plain(rows)
    assert {r[-1] for r in got} == {True, False}
    assert result(hard_frame(spark).limit(0)) == []


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_sizes_over_several_tiers(spark, n):
    """Blocks of one level and of two: up to three tiers of blocks, and many languages."""
    r = random.Random(n)
    rows = [(i // 2, f"Text {r.random()}", r.choice(["a", "a", "a", f"l{i % 20}"]), "s", i) for i in range(n)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for height in (1, 2):
        assert result(frame, height=height) == plain(rows)


def test_full_blocks(spark):
    for n in (64, 512):
        rows = [(i, f"T{i}", "en", "s", 1) for i in range(n)]
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        assert result(frame, height=2) == plain(rows)


def test_layout():
    """Each place is used once, and a subtree below half the height lies in one stretch."""
    for levels in range(1, 6):
        own = [address(levels, d, np.arange(8**d)) for d in range(levels)]
        assert sorted(np.concatenate(own).tolist()) == list(range(nodes_in(levels)))
        if levels > 1:
            top = levels // 2
            part = np.concatenate([own[d][: 8 ** (d - top)] for d in range(top, levels)])
            assert sorted(part.tolist()) == list(range(nodes_in(top), nodes_in(top) + nodes_in(levels - top)))


def test_a_block_finds_what_it_was_built_from():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(100)]
    block = Block.build(digests, 4)
    levels = levels_of([d.hex() for d in digests])
    assert block.runs(3) == ["".join(levels[0][i : i + 8]) for i in range(0, 100, 8)]
    assert block.root().hex() == h("".join(levels[2])) == levels[3][0]


def test_proofs_lead_to_the_root(spark):
    for r in proofs(hard_frame(spark), height=1).collect():
        digest = bytes(r.leaf).hex()
        for p in r.path:
            digest = h(bytes(p.before).hex() + digest + bytes(p.after).hex())
        assert digest == bytes(r.root).hex()


def test_sums_along_rows(spark):
    r = random.Random(2)
    rows = [(r.choice([None, 1, 1, 1, 1, 2, 3 + i]), r.randrange(40), r.randrange(-(2**62), 2**62), 1) for i in range(3000)]
    frame = checkpoint(spark.createDataFrame(rows, "g long, o long, w long, one long").repartition(8))
    got = along(frame, ["g"], ["o"], {"place": "one", "total": "w"}).collect()
    assert len(got) == len(rows)
    by_group = {}
    for x in got:
        by_group.setdefault(x.g, []).append(x)
    for part in by_group.values():
        part.sort(key=lambda x: x.place)
        assert [x.place for x in part] == list(range(len(part)))
        assert [x.o for x in part] == sorted(x.o for x in part)
        total = 0
        for x in part:
            assert x.total == (total + 2**63) % 2**64 - 2**63
            total += x.w
    assert along(frame.limit(0), ["g"], ["o"], {"place": "one"}).count() == 0


def test_schema_has_extra_columns():
    assert "component" in SCHEMA
