"""Quality rules against a plain count."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from riskloom.llm.line_rules import apply_rules, remove_lines
from tests.llm.helpers import hard_frame, hard_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text)
    seen, repeated_lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated_lines += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated_lines, len(covered)


def brute(rows, min_documents, min_left):
    normal = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")
    texts = defaultdict(set)
    for r in rows:
        texts[r[3] or ""].add(r[1] or "")
    shared = defaultdict(set)
    for host, own in texts.items():
        held = Counter(line for t in own for line in {normal(x) for x in t.split("\n")} if line)
        shared[host] = {line for line, n in held.items() if n > min_documents}
    out = []
    for r in rows:
        text, host = r[1] or "", r[3] or ""
        n_words, *rest = base(text)
        removed = sum(len(x.split(" ")) for x in map(normal, text.split("\n")) if x in shared[host])
        failed = n_words < 50 or 100 * rest[-1] > 50 * n_words
        out.append((str(r[0]), n_words, *rest, failed, not failed and n_words - removed >= min_left * n_words, removed))
    return sorted(out)


def result(frame, **limits):
    return sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.n_removed_words) for r in apply_rules(frame, **limits).collect())


def test_hard_rows(spark):
    rows = hard_rows()
    assert result(hard_frame(spark), min_documents=3) == brute(rows, 3, 0.3)
    assert apply_rules(hard_frame(spark).limit(0)).count() == 0


def test_shared_lines_deplete_documents(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{line}\nown {i}", "en", "h", *[None] * 8) for i in range(30)]
    rows += [(100 + i, " ".join(f"x{j}" for j in range(60)), "en", "h", *[None] * 8) for i in range(40)]  # copies make no shared line
    frame = spark.createDataFrame(rows, hard_frame(spark).schema)
    got = result(frame)
    assert got == brute(rows, 20, 0.3)
    assert [g[-2] for g in got if int(g[0]) < 100] == [False] * 30 and all(g[-2] for g in got if int(g[0]) >= 100)


def test_texts_without_shared_lines(spark):
    normal = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")
    shared = [f"Shared  line {k} of\tall" for k in range(7)]
    rows = []
    for i in range(40):
        lines = [f"own {i}", "", shared[i % 7], " " + shared[(i + 1) % 7].upper(), f"Own  {i} again", shared[i % 7], "\t"]
        rows.append((i, "\n".join(lines[i % 3 :]), "en", "h", *[None] * 8))
    rows += [rows[3], (50, None, "en", "h", *[None] * 8), (51, "\n\n", "en", "h", *[None] * 8), (52, "\n".join(shared * 300), "en", "h", *[None] * 8), (53, shared[0] + "\nx", "en", None, *[None] * 8)]
    frame = spark.createDataFrame(rows, hard_frame(spark).schema)
    gone = {normal(x) for x in shared}
    clean = lambda r: r[1] if r[1] is None or r[3] is None else "\n".join(x for x in r[1].split("\n") if normal(x) not in gone)
    got = remove_lines(frame, min_documents=3)
    assert got.columns == frame.columns
    by_text = lambda x: (x[0], x[1] or "")
    cleaned = sorted(((r.doc_id, r.text) for r in got.collect()), key=by_text)
    assert cleaned == sorted(((r[0], clean(r)) for r in rows), key=by_text)
    words = {i: len(WORD.findall(t or "")) for i, t in cleaned}
    assert result(frame, min_documents=3) == brute(rows, 3, 0.3)
    for r in apply_rules(frame, min_documents=3).collect():
        assert r.n_words - r.n_removed_words == words[r.doc_id]


def test_the_size_of_a_host_changes_nothing(spark):
    line = " ".join(f"w{i}" for i in range(60))
    own = F.concat(F.lit("own text number "), F.col("id").cast("string"))
    for size in (400, 500, 100_000):
        for holders, gone in ((20, False), (21, True)):
            text = F.when(F.col("id") < holders, F.concat(F.lit(f"{line}\n"), own)).otherwise(own)
            docs = spark.range(size).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("h").alias("source"))
            left = remove_lines(docs).where(F.col("doc_id") < 25)
            assert {(r.doc_id, r.text.startswith("own")) for r in left.collect()} == {(i, gone or i >= holders) for i in range(25)}
