"""Held-out accuracy of the trained scores, and the parts they are made of."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import quality as Q
from riskloom.llm import toxicity as T
from riskloom.llm.common import hash_remainder
from tests.llm.helpers import hard_frame

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("module, label, least", [(Q, "quality", 0.97), (T, "toxic", 0.97)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = module.score_documents(docs, labels).cache()
    assert out.count() == docs.count()
    assert out.where("score is null or score < 0 or score > 1 or predicted != cast(score >= 0.5 as int)").count() == 0
    held = out.where("held_out").join(labels, "doc_id")
    right = held.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= least


def test_hash_remainder(spark):
    ids = [0, 1, 7, -3, 10**12, None]
    got = [r.x for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(hash_remainder(F.col("doc_id"), 5).alias("x")).collect()]
    assert got == [zlib.crc32(b"" if i is None else str(i).encode()) % 5 for i in ids]


@pytest.mark.parametrize("module, label, none", [(Q, "quality", 0.5), (T, "toxic", 0.0)])
def test_hard_rows_and_missing_labels(spark, module, label, none):
    docs = hard_frame(spark)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1)], empty.schema)
    for labels in (empty, nulls):
        out = module.score_documents(docs, labels).collect()
        assert len(out) == docs.count() and all(r.score == none for r in out)
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(100)], empty.schema)
    out = module.score_documents(docs, some).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert module.score_documents(docs.limit(0), some).count() == 0


def test_filters_keep_all_columns(spark):
    docs = hard_frame(spark)
    trees = Q.fit_trees(np.zeros((0, len(Q.STATISTICS))), np.zeros(0))
    assert Q.keep_good(docs, trees).columns == docs.columns
    model = T.ToxicityModel({"token": 5.0}, frozenset(["token"]), frozenset(), np.array([9.0, 0, 0, 0]), -1.0)
    kept = T.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.where("lower(text) like '% token %'").count() == 0


def test_trees_split_like_a_plain_search():
    g = np.random.default_rng(0)
    x = g.normal(size=(400, 5))
    y = ((x[:, 2] > 0.3) ^ (x[:, 4] > 0)).astype(float)
    model = Q.fit_trees(x, y, trees=30, depth=3)
    p = model.predict(x)
    assert ((p >= 0.5) == y).mean() > 0.98
    one = []  # walked row by row
    for row in x[:50]:
        total = model.base
        for t in range(len(model.feature)):
            at = 0
            while at < model.feature.shape[1]:
                at = 2 * at + 1 + (row[model.feature[t, at]] > model.cut[t, at])
            total += model.leaf[t, at - model.feature.shape[1]]
        one.append(1 / (1 + np.exp(-total)))
    assert np.allclose(one, p[:50])


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def test_walk_finds_what_edit_distance_finds():
    r = random.Random(1)
    terms = ["abcab", "aabbc", "bcabca", "abc"]
    automaton = T.TermAutomaton(dict.fromkeys(terms, 1.0), frozenset(t for t in terms if len(t) >= 5))
    for _ in range(5000):
        word = "".join(r.choice("abc") for _ in range(r.randint(1, 8)))
        near = [(edits(word, t), t) for t in terms if edits(word, t) <= (len(t) >= 5)]
        got = automaton.walk(word)
        assert (got is None) == (not near) and (got is None or (got[1], got[0]) == min(near))


def test_stems_misspellings_and_quotation():
    automaton = T.TermAutomaton({"idiot": 5.0, "lowei*": 5.0}, frozenset(["idiot"]), frozenset(["idios"]))
    assert automaton.find("loweibel") == ("lowei*", 0) and automaton.find("idiott") == ("idiot", 1)
    assert automaton.find("idios") is None and automaton.find("lowe") is None
    abuse, quote = T.signs("you idiot there", automaton), T.signs('he said "you idiot there" to me', automaton)
    assert abuse[0] > 0 and abuse[1] == 0 and quote[0] == 0 and quote[1] > 0
    assert T.signs("> you idiot", automaton)[1] > 0 and T.signs("«you idiot»", automaton)[1] > 0


def test_quotation_is_found_on_lines_of_any_length():
    automaton = T.TermAutomaton({"idiot": 5.0}, frozenset(["idiot"]))
    far = "word " * 5_000
    told = lambda text: [x > 0 for x in T.signs(text, automaton)[:2]]
    assert told(f'"{far} idiot {far}"') == [False, True] and told(f"> {far} idiot") == [False, True]
    assert told(f'"{far}" idiot "{far}"') == [True, False] and told(f'"{far}\n idiot {far}"') == [True, False]
    assert told("„a“ idiot „b”") == [True, False] and told("„a idiot b”") == [False, True]
    assert told("«a» idiot «b»") == [True, False] and told("»a idiot b«") == [False, True]
    r = random.Random(4)
    for _ in range(300):
        head, tail = ("".join(r.choice('"\n> ab') for _ in range(40)) for _ in range(2))
        own, after = head.rsplit("\n", 1)[-1], tail.split("\n", 1)[0]
        expected = own.lstrip().startswith(">") or own.count('"') % 2 == 1 and '"' in after
        assert T.Quotation(f"{head}idiot{tail}").holds(40, 45) == expected


def test_ids_with_many_rows_give_one_row_to_learn_from(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i % 7} of {i % 50}" if i % 3 else None) for i in range(3_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = {r.doc_id: (r.text, r.label) for r in Q.labelled_sample(docs, labels, "quality", 40).collect()}
    assert len(got) <= 40 and Q.labelled_sample(docs, labels, "quality", 1_000).count() == 50
    assert all(y == i % 2 and t.startswith("text 0 ") for i, (t, y) in got.items())


def test_no_term_is_dropped_for_their_number(spark):
    rows = [(i, " ".join(f"t{k}x" for k in range(5_000)) if i % 2 else "plain words only") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    model = T.fit_toxicity(docs, labels)
    found = model.automaton()
    assert all(found.find(f"t{k}x") for k in range(0, 5_000, 7))
