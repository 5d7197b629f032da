"""The prefix table against the library, and the pair test against plain merging."""

import hashlib
import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm.piece_bpe import PieceBpe, piece_digests, piece_ids, piece_text
from tests.llm.helpers import hard_frame, hard_rows

FILE = public_tokenizers.path("piece_bpe_32k.model")
MODEL = PieceBpe(FILE)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=FILE)
PARTS = ["a", "e", "the", " ", "  ", "     ", "\n", "é", "ñ", "▁", "<s>", "</s>", "<0x0A>", "\t", "😀", "中", "23", ".", "aaaa", "ing", "\x00", "İ", "==", " " * 17, "------"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=4), max_size=20))
def test_ids_and_text_equal_the_library(parts):
    text = "".join(parts)
    ids = LIBRARY.encode(text) + [2]
    assert MODEL.encode(text) == ids
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


def test_pair_test_equals_merging():
    r = random.Random(5)
    tokens = list(MODEL.order)
    few = [t for t in tokens if len(set(MODEL.pieces[t])) <= 2]
    for n in range(6000):
        a, b = (r.choice(tokens), r.choice(tokens)) if n % 2 else (r.choice(few), r.choice(few))
        x, y = MODEL.pieces[a], MODEL.pieces[b]
        if not y.startswith("▁"):
            assert MODEL.compatible(a, b) == (MODEL.merge(x + y) == [x, y])


def test_small_memory_gives_the_same():
    small = PieceBpe(FILE, kept=4)
    for text in ("one two three four five six seven eight", "  a  b\nc" * 50, "x" * 5000):
        assert small.digests(text) == MODEL.digests(text)


def test_rows(spark):
    rows = hard_rows()
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_digests(hard_frame(spark), FILE).collect())
    expected = []
    for r in rows:
        ids = LIBRARY.encode(r[1] or "") + [2]
        expected.append((str(r[0]), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert got == sorted(expected)
    assert piece_digests(hard_frame(spark).limit(0), FILE).count() == 0


def test_columns_of_ids_and_text(spark):
    frame = spark.createDataFrame([("Hello  world\n",), (None,), ("",)], "text string")
    back = frame.select(piece_text(piece_ids(frame["text"], FILE), FILE).alias("back")).collect()
    assert [r.back for r in back] == ["Hello  world\n", "", ""]
