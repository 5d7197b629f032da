"""Kept tables and trigram bitmaps against plain scans."""

import random
import uuid

import numpy as np
from pyspark.sql import functions as F

from riskloom.operators import assets as AS
from riskloom.operators import textindex as TI
from riskloom.operators.forest import TreeEnsemble
from riskloom.operators.views import search_predicate
from riskloom.session import shared_path


def test_a_kept_table_is_found_and_replaced(spark):
    built, name = [], f"t-kept-{uuid.uuid4().hex}"

    def build(n):
        return lambda: built.append(n) or spark.range(n)

    assert AS.versions(spark, name) == []
    for key, n, reused in (("a", 3, False), ("a", 4, True), ("b", 5, False), ("b", 6, True), ("a", 7, False)):
        table, found = AS.keep_table(spark.newSession(), name, key, build(n))
        assert found == reused and table.count() == built[-1]
    assert built == [3, 5, 7] and AS.versions(spark, name) == ["a"]


def test_fingerprints_tell_files_and_models_apart(spark):
    path = shared_path(spark, "t-files")
    spark.range(5).coalesce(1).write.parquet(path)
    first = AS.files_fingerprint(spark, [path])
    assert AS.files_fingerprint(spark, [path]) == first
    spark.range(1).write.mode("append").parquet(path)
    assert AS.files_fingerprint(spark, [path]) != first
    rows = [(0, 0, "a", 0.5, 1, 2, 4.0, None), (0, 1, None, None, None, None, 2.0, 0.1), (0, 2, None, None, None, None, 2.0, 0.9)]
    one, two = (TreeEnsemble.from_node_rows([(*r[:7], v if r[7] == 0.9 else r[7]) for r in rows]) for v in (0.9, 0.8))
    assert AS.model_fingerprint(one) == AS.model_fingerprint(TreeEnsemble.from_node_rows(rows)) != AS.model_fingerprint(two)


def test_indexed_search_equals_a_full_scan(spark):
    r = random.Random(4)
    words = ["alpha", "Beta", "gamma", "Äpfel", "x", "12.5", "delta-9"]
    rows = [(i, " ".join(r.choices(words, k=3)) + (f" rare{i}" if i % 50 == 0 else ""), float(r.randrange(1000)) if r.random() > 0.2 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, text string, value double")
    path = shared_path(spark, "t-index")
    TI.write_indexed(df, path, ["id"], 12)
    total = spark.read.parquet(f"{path}/index").select("file").distinct().count()
    assert total == 12
    for term in ("rare50", "  RARE550 ", "alpha beta", "äpfel", "12.5", "x", "ha", "", "nowhere at all", "5.0", "gamma x 12"):
        expected = sorted(r.id for r in df.where(search_predicate(df, term)).select("id").collect())
        assert sorted(r.id for r in TI.search_indexed(spark, path, term).select("id").collect()) == expected, term
    assert TI.candidate_files(spark, path, "rare50").count() <= 3
    assert TI.candidate_files(spark, path, "nowhere at all").count() == 0
    assert TI.candidate_files(spark, path, "x").count() == total
    # the plan reads these files and no others
    assert len(TI.search_indexed(spark, path, "rare550").inputFiles()) < total


def test_trigrams_of_a_text(spark):
    got = spark.createDataFrame([("abcdé",), ("ab",), ("",), (None,)], "t string").select(TI.trigrams(F.col("t"))).collect()
    assert [r[0] for r in got][:3] == [["abc", "bcd", "cdé"], [], []]
    assert np.all([not r[0] for r in got[3:]])


def test_bitmaps_of_files_have_the_trigrams_of_their_texts_and_no_others(spark):
    """Made batch by batch inside the tasks: no row for each trigram is made."""
    import pyarrow as pa

    texts = ["", "ab", "abc", "a\U0001f600é z", "xyz xyz", "q" * 5, "", "w"] * 3
    files = ["f1"] * 5 + ["f2", "f1", "f3"] + [f"g{i}" for i in range(8)] + ["f1"] * 8
    batches = [pa.RecordBatch.from_arrays([pa.array(files[s : s + 7]), pa.array(texts[s : s + 7])], names=["file", "text"]) for s in range(0, 24, 7)]
    expected, got = {}, {}
    for file, text in zip(files, texts):
        expected.setdefault(file, set()).update(int(TI.trigram_bits(TI.code_points(text[i : i + 3]))[0]) for i in range(len(text) - 2))
    for batch in TI.file_bitmaps(batches):
        for file, number, bits in zip(*[c.to_pylist() for c in batch.columns]):
            places = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
            got.setdefault(file, set()).update(int(p) + (number - 1) * TI.BUCKET for p in places)
    assert got == {f: b for f, b in expected.items() if b}
    path = shared_path(spark, "t-bitmaps")
    TI.write_indexed(spark.createDataFrame([(t,) for t in texts], "t string"), path, ["t"], 2)
    stored = spark.read.parquet(f"{path}/index")
    assert stored.select(F.max(F.length("bits"))).first()[0] == TI.BUCKET // 8
    assert stored.count() == stored.select("file", "number").distinct().count()
