"""Each stage of the pipeline does its work on what the one before kept."""

import corpus_pipeline as P
from riskloom.llm import entries
from riskloom.llm.secrets_scan import scan_secrets
from riskloom.session import shared_path
from tests.conftest import SF_SMALL
from tests.llm.test_jaccard import brute

SCHEMA = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    seen = []
    for n, (_, stage) in enumerate(P.STAGES):
        path = shared_path(spark, f"test-{n}")
        stage(spark, docs, SF_SMALL).write.parquet(path)
        after = spark.read.parquet(path)
        if n < len(P.STAGES) - 1:
            assert after.columns == SCHEMA
            assert after.join(docs, "doc_id", "left_anti").count() == 0
        seen.append((docs, after))
        docs = after
    before, after = seen[2]
    expected = {d for d, _, c in brute([(r.doc_id, r.text) for r in before.collect()], 5, 80) if d == c}
    assert {str(r.doc_id) for r in after.collect()} == expected
    before, after = seen[3]
    assert before.count() == after.count()
    assert scan_secrets(after).where("n_assign + n_access + n_hex > 0").count() == 0
    assert after.where("n_chars != length(text)").count() == 0
    before, pieces = seen[4]
    assert pieces.select("doc_id").distinct().count() == before.count()
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    assert seen[0][1].join(labels, "doc_id").where("quality = 0").count() <= 0.1 * labels.where("quality = 0").count()
    assert seen[0][1].join(labels, "doc_id").where("quality = 1").count() >= 0.95 * labels.where("quality = 1").count()


def test_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in entries.QUERIES if k != "pipeline")
    assert numbers == list(range(1, 14)) and "pipeline" in entries.QUERIES
