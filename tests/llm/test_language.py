"""Held-out accuracy, mixtures of known proportions, and EM against a plain search."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm.language_mix import FEATURES, LanguageModel, em, fit_languages, identify, letter_table, mix_languages, ngrams
from tests.llm.helpers import hard_frame

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(DOCUMENTS)


@pytest.fixture(scope="module")
def texts(labelled):
    out = {}
    for r in labelled.where("lang IS NOT NULL AND length(text) > 600").select("doc_id", "lang", "text").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 3 == 1:
            out.setdefault(r.lang, []).append(r.text)
    return out


def test_held_out_accuracy(spark, labelled):
    got = identify(labelled).join(labelled.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(got) > 200
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 and abs(sum(x.share for x in r.languages) - 1) < 1e-6 for r in got)
    assert sum(len(r.languages) == 1 for r in got) / len(got) > 0.9


def test_mixtures_of_two(spark, labelled, texts):
    """Texts put together from two languages: the set, the greater one, and its share."""
    r, rows, truth = random.Random(1), [], {}
    for k in range(60):
        a, b = r.sample(sorted(texts), 2)
        share = r.choice([0.3, 0.5, 0.7, 0.8])
        n = 3000
        x, y = (" ".join(r.choices(texts[lang], k=8))[: int(n * s)] for lang, s in ((a, share), (b, 1 - share)))
        rows.append((k, x + " " + y))
        truth[k] = {a: share, b: 1 - share}
    model = fit_languages(labelled.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) != 1))
    right, close = 0, 0
    for x in mix_languages(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        found = {m.lang: m.share for m in x.languages}
        right += set(found) == set(truth[x.doc_id])
        close += all(abs(found.get(lang, 0) - s) < 0.12 for lang, s in truth[x.doc_id].items())
    assert right >= 54 and close >= 54


def test_em_finds_the_likeliest_proportions():
    r = np.random.default_rng(4)
    p = r.dirichlet(np.ones(50), size=2).T
    counts = [r.multinomial(n, p @ np.array([w, 1 - w])).astype(float) for n, w in ((4000, 0.3), (300, 0.9), (1000, 1.0))]
    used = [np.flatnonzero(c) for c in counts]
    length, n = np.array([len(u) for u in used]), np.array([c.sum() for c in counts])
    flat_p, flat_x = np.concatenate([p[u] for u in used]), np.concatenate([c[u] for c, u in zip(counts, used, strict=True)])
    share, fit = em(flat_p, flat_x, length, n, np.full((3, 2), 0.5))
    for i, c in enumerate(counts):
        grid = np.linspace(0, 1, 2001)
        value = [(c[c > 0] * np.log(p[c > 0] @ np.array([w, 1 - w]))).sum() for w in grid]
        assert abs(grid[int(np.argmax(value))] - share[i, 0]) < 0.01
        assert fit[i] >= max(value) - 0.1


def test_leaving_out_em_changes_nothing(labelled, texts):
    """Where the slopes leave EM out, EM would have chosen one language too."""
    model = fit_languages(labelled)
    sample = [t for own in texts.values() for t in own][:80] + ["ab", "the the la", "x"]
    letters = letter_table()
    for text, found in zip(sample, model.mixtures(sample), strict=True):
        counts = np.bincount(ngrams(text, letters), minlength=FEATURES)
        at = np.flatnonzero(counts)
        x = counts[at] / 3
        single = (x[:, None] * model.log_p[at]).sum(axis=0)
        best = model._mixed(model.p[at].astype(float), x, np.array([len(at)]), np.array([x.sum()]), np.array([single.max()]), np.array([4.0 * math.log(x.sum() + 1)]))
        assert [lang for lang, _ in found] == ([model.languages[j] for j in np.argsort(-best[0], kind="stable")[: (best[0] > 0).sum()]] or [model.languages[int(single.argmax())]])


def test_counts_against_a_plain_count(spark):
    """All n-grams of all rows, also repeated ones, by language."""
    rows = [("x", "Ab  ab"), ("x", "Ab  ab"), ("y", "a1b"), ("y", None), (None, "zzz"), ("z", "12")]
    model = fit_languages(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == ["x", "y"]  # z has no letters
    letters = letter_table()
    assert len(ngrams("Ab  ab", letters)) == len(" ab ab ") + len(" ab ab ") - 1 + len(" ab ab ") - 2
    assert sorted(ngrams("a1b", letters)) == sorted(ngrams("A, B!", letters))
    assert model.p.sum(axis=0) == pytest.approx([1, 1], abs=1e-3)


def test_hard_rows(spark):
    frame = hard_frame(spark)
    got = identify(frame).collect()
    assert len(got) == frame.count()
    text_of = {r.doc_id: r.text for r in frame.collect()}
    for r in got:
        text = text_of[r.doc_id]
        unknown = text is None or not any(c.isalpha() for c in text)
        assert (r.lang_pred == "und") == unknown and (r.score == 0) == unknown
        number = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(number.encode()) % 3 == 1)
    assert identify(frame.limit(0)).count() == 0
    nothing = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify(nothing).collect()} == {"und"}


def test_a_model_without_languages():
    assert LanguageModel([], np.zeros((FEATURES, 0))).mixtures(["some text", ""]) == [[], []]
