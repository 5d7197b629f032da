"""Every id in exactly one piece, windows gapless and full, ids as the library gives them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskloom.llm.packing import OpenWindows, WordIds, pack
from tests.conftest import SF_ORACLE
from tests.llm.helpers import hard_frame, hard_rows

FILE = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(FILE)
CODER = WordIds(FILE)
PARTS = ["a", "e", "the", "'s", "'S", " ", "\n", "é", "é", "́", "\t", "😀", "中", "1", ".", "\xa0", "\x1c", "\x85", "　", "Σ", "ΑΣ", "İ", "<|endoftext|>", "<|", "\x00", "ﬁ", "ẞ", "K", "J̌", "ſ", "ǅ"]


def library_ids(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=3), max_size=14))
def test_word_ids_equal_the_library(parts):
    text = "".join(parts)
    assert next(CODER.encode_many([text])) == np.asarray(library_ids(text), dtype="<u4").tobytes()


def check(pieces, ids_of, window):
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_window[p.sequence_id].append(p)
    assert set(by_doc) == set(ids_of)
    for doc, own in by_doc.items():
        ids, at = ids_of[doc], 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    used = 0
    for own in by_window.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        used += at
    return used / (len(by_window) * window)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").repartition(6)
    ids = {r.doc_id: library_ids(r.text or "") + [2] for r in docs.collect()}
    assert check(pack(docs, FILE).collect(), ids, 4096) > 0.97


def test_hard_rows(spark):
    rows = [r for r in dict((r[0], r) for r in hard_rows()).values()]
    frame = spark.createDataFrame(rows, hard_frame(spark).schema)
    ids = {r[0]: library_ids(r[1] or "") + [2] for r in rows}
    for window, n_open, merged in ((4096, 64, 64), (16, 2, 1), (1, 1, 1)):
        if window == 1:
            frame, ids = frame.where("doc_id < 20"), {k: v for k, v in ids.items() if k is not None and k < 20}
        pieces = pack(frame.repartition(3), FILE, window=window, n_open=n_open, merged_partitions=merged).collect()
        check(pieces, ids, window)
    assert pack(frame.limit(0), FILE).count() == 0


def test_repeated_rows_are_packed_each(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    got = pack(frame, FILE, with_ids=True).collect()
    assert sorted((p.doc_id, p.length, len(p.ids)) for p in got) == [(1, 3, 3), (1, 3, 3), (2, 1, 1)]


def test_open_windows_stay_bounded():
    r, windows, total = random.Random(1), OpenWindows(100, 5), 0
    for _ in range(2000):
        length = r.randint(1, 100)
        for p in windows.put(length, length) or []:
            total += p or 0
        assert len(windows.room) <= 5 and all(0 < x < 100 for x in windows.room)


def letters(n, length=9):
    """Distinct words of letters."""
    r, out = random.Random(n), {}
    while len(out) < n:
        out["".join(r.choices("abcdeéñßœя", k=length))] = None
    return list(out)


def test_rare_words_with_marks_are_held_once():
    coder, words = WordIds(FILE), letters(12_000)
    texts = [" ".join(w + "," for w in words[i : i + 100]) for i in range(0, len(words), 100)]
    expected = [np.asarray(library_ids(t), dtype="<u4").tobytes() for t in texts]
    assert list(coder.encode_many(texts)) == expected
    assert len(coder.young) + len(coder.old) == len(words) + 1
    assert list(coder.encode_many(texts[:1])) == expected[:1] and all(w + "," in coder.young for w in words[:100])


def test_held_words_stay_bounded():
    coder, words = WordIds(FILE, kept=2000), letters(9_000)
    for i in range(0, len(words), 100):
        text = " ".join(words[i : i + 100] + words[:50])
        assert next(coder.encode_many([text])) == np.asarray(library_ids(text), dtype="<u4").tobytes()
        assert len(coder.young) + len(coder.old) <= 2 * (1000 + 150)
        assert words[0] in coder.young or words[0] in coder.old


def test_texts_are_taken_as_needed():
    taken = []
    texts = ((taken.append(n), "ab " * 40_000)[1] for n in range(50))
    assert len(next(CODER.encode_many(texts))) == 4 * 40_000
    assert len(taken) <= 3


def test_words_that_the_splitter_parts_or_keeps():
    """`encode_words` may only tell words apart where each has one last token."""
    words = letters(6_000)
    for odd in ([], ["ab1", "x-y", "don't"], ["ª", "ǆ", "中文", "x", "x"]):
        mixed = words[:40] + odd + words[40:]
        assert list(CODER.encode_words(mixed)) == [np.asarray(library_ids(w), dtype="<u4").tobytes() for w in mixed]
