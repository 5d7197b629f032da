"""Sets and components against a comparison of all pairs."""

import random
import re

import numpy as np
import pytest

from riskloom.llm.jaccard_join import all_links, join_documents, keep_one, leaf_size, leaves, link_documents, near_sizes, odd_parts, part_counts, shingles
from tests.llm.helpers import hard_frame, hard_rows


def plain_set(text, k):
    if text is None:
        return frozenset()
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < k else frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k, least):
    """(id, set size, component) of each row; rows of an id are one document."""
    sets = [plain_set(r[1], k) for r in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            equal = a and a == b
            both = rows[i][0] is not None and rows[j][0] is not None
            if same or equal or both and a and b and 100 * len(a & b) >= least * len(a | b):
                top[find(i)] = find(j)
    least_id = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least_id[find(i)] = min(least_id.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), str(least_id.get(find(i)))) for i, r in enumerate(rows))


def result(frame, **settings):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in join_documents(frame, **settings).collect())


def variants(seed, n, sizes):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, k = [], 2 * n
    while len(rows) < n:
        first = [r.choice(words) for _ in range(r.choice(sizes))]
        for _ in range(r.choice([1, 1, 3, 8])):
            x = list(first)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                i = r.randrange(len(x))
                x[i : i + 1] = r.choice([[r.choice(words)], [x[i], r.choice(words)]])
            rows.append((k, r.choice([" ", "\n"]).join(x).replace("w1", "W1")))
            k -= 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("words, least", [(3, 90), (5, 80)])
def test_components(spark, words, least):
    rows = variants(4, 260, [1, 2, 3, 5, 9, 10, 11, 12, 13, 20, 40, 80, 200])
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), words=words, least=least) == brute(rows, words, least)


def test_leaves_meet_for_every_close_pair():
    r = random.Random(3)
    for least in (80, 90):
        size = leaf_size(least)
        for _ in range(1500):
            n = r.choice([1, 5, size, size + 1, size + 2, 30, 200])
            x = {r.getrandbits(64) for _ in range(n)}
            y = set(r.sample(sorted(x), max(1, n - r.randint(0, n // 5)))) | {r.getrandbits(64) for _ in range(r.randint(0, n // 8))}
            if 100 * len(x & y) >= least * len(x | y):
                a, b = (np.array(sorted(s), dtype=np.uint64) for s in (x, y))
                assert set(leaves(a, size).tolist()) & set(leaves(b, size).tolist())


def test_shingle_counts():
    for text in ("A b  c\td", "é É", "a a a a a", "", "  ", "x" * 1000, "a\x0bb\x0cc d"):
        assert len(shingles(text)) == len(plain_set(text, 3))


def test_hard_rows(spark):
    rows = hard_rows()
    assert result(hard_frame(spark)) == brute(rows, 3, 90)
    assert join_documents(hard_frame(spark).limit(0)).count() == 0


def test_batches_without_a_hit(spark):
    """One near pair among unrelated texts over 8 partitions: most batches have no candidate."""
    rows = [(i, " ".join(f"u{i}x{j}" for j in range(30))) for i in range(40)]
    base = [f"w{j}" for j in range(200)]
    rows += [(100, " ".join(base)), (101, " ".join([*base[:-1], "other"]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert result(frame) == brute(rows, 3, 90)
    assert sorted(r.doc_id for r in keep_one(frame).collect()) == [*range(40), 100]
    assert [(r.a, r.b) for r in all_links(frame).collect()] == [(101, 100)]


def test_one_id_heads_two_sets(spark):
    a, b = [f"a{j}" for j in range(100)], [f"b{j}" for j in range(100)]
    rows = [(7, " ".join(a)), (7, " ".join(b)), (8, " ".join([*a[:-1], "x"])), (9, " ".join([*b[:-1], "y"])), (10, "far from all of these")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert result(frame) == brute(rows, 3, 90)
    assert sorted((r.a, r.b) for r in all_links(frame).collect()) == [(8, 7), (9, 7)]
    assert sorted((r.doc_id, r.n_links) for r in link_documents(frame).collect()) == [(7, 1), (7, 1), (8, 1), (9, 1), (10, 0)]
    assert sorted(r.doc_id for r in keep_one(frame).collect()) == [7, 7, 10]


def test_hot_regions(spark, monkeypatch):
    """A passage that very many texts share, and texts that consist of little else."""
    monkeypatch.setattr("riskloom.llm.jaccard_join.HOT", 5)
    r = random.Random(12)
    passage = [f"p{j}" for j in range(60)]
    rows = []
    for i in range(150):
        own = [f"o{r.randrange(5000)}" for _ in range(r.choice([0, 1, 2, 4, 8, 20, 100, 400]))]
        cut = r.randint(0, len(own))
        rows.append((i, " ".join(own[:cut] + passage[: r.choice([60, 60, 58])] + own[cut:])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for words, least in ((3, 90), (5, 80)):
        assert result(frame, words=words, least=least) == brute(rows, words, least)


def test_rows_without_id_and_ids_with_two_texts(spark):
    text = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(30))
    rows = [(None, text), (5, text), (7, text), (7, other), (9, other), (None, "alone here now"), (None, "alone here now")]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 3, 90)


def test_keep_one(spark):
    rows = variants(9, 120, [1, 4, 20, 60])
    frame = spark.createDataFrame([(*r, "x") for r in rows + rows[:5]], "doc_id long, text string, component_id string")
    kept = keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(d for d, _, c in brute(rows, 5, 80) if d == c)
    assert keep_one(frame.limit(0)).count() == 0


@pytest.mark.parametrize("words, least", [(3, 90), (5, 80)])
def test_every_link(spark, words, least):
    rows = variants(6, 200, [1, 5, 12, 13, 20, 40, 80, 200]) + [(None, "no id here"), (1000, None), (1001, "")]
    rows += [(1002, rows[0][1]), rows[1]]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    heads = {}
    for i, t in rows:
        if i is not None and (own := plain_set(t, words)):
            heads[own] = min(heads.get(own, i), i)
    links = {(max(heads[x], heads[y]), min(heads[x], heads[y])) for x in heads for y in heads if x != y and 100 * len(x & y) >= least * len(x | y)}
    assert len(links) > 20
    got = [(r.a, r.b) for r in all_links(frame, words=words, least=least).collect()]
    assert sorted(got) == sorted(links)
    ends = [i for link in links for i in link]
    found = link_documents(frame, words=words, least=least).collect()
    expected = sorted((str(i), ends.count(heads.get(plain_set(t, words)))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_links) for r in found) == expected
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute(rows, words, least)


def test_three_near_copies_have_three_links(spark):
    text = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([f"new{k}" if k and i == 60 * k else w for i, w in enumerate(text)])) for k in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.a, r.b) for r in all_links(frame).collect()) == [(1, 0), (2, 0), (2, 1)]
    assert all(r.n_links == 2 for r in link_documents(frame).collect())


@pytest.mark.parametrize("least", [90, 80])
def test_windows_leave_few_pairs_that_are_no_links(spark, least):
    """A group of near texts of which hardly two are close enough: its pairs grow with the square
    of the group, so the windows have to drop them before they are rows. No link is dropped."""
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(400)]
    sets = []
    for _ in range(60):
        own = [r.getrandbits(64) if r.random() < (100 - least) * 0.0045 else v for v in base]
        sets.append(np.unique(np.array(own, dtype=np.uint64)))
    sets.append(np.append(sets[0], np.uint64((1 << 64) - 1)))  # a link of the first
    rows = [(k, len(s), part_counts(s).tolist(), odd_parts(s).tolist()) for k, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "key long, n long, parts array<tinyint>, signs array<long>")
    a, b = (frame.select(*[frame[c].alias(f"{c}_{side}") for c in frame.columns]) for side in "ab")
    passed = {(x.key_a, x.key_b) for x in a.join(b, a.key_a < b.key_b).where(near_sizes(least)).collect()}
    links, far = set(), 0
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            common = len(np.intersect1d(x, sets[j]))
            if 100 * common >= least * (len(x) + len(sets[j]) - common):
                links.add((i, j))
            else:
                far += 1
    assert links and links <= passed
    assert len(passed - links) <= far / 10
