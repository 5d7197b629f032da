"""The curve, the law of the shards and their slots."""

import itertools
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskloom.llm.sharding import hilbert_index, shard_documents, string_cuts, write_shards
from tests.llm.helpers import hard_frame, hard_rows


@pytest.mark.parametrize("axes, bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(spark, axes, bits):
    names = [f"a{i}" for i in range(axes)]
    cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=axes)), ", ".join(f"{n} int" for n in names))
    order = sorted(cells.withColumn("h", hilbert_index([F.col(n) for n in names], bits)).collect(), key=lambda r: r.h)
    assert [r.h for r in order] == list(range(1 << (axes * bits)))
    assert all(sum(abs(x - y) for x, y in zip(p[:-1], q[:-1], strict=True)) == 1 for p, q in itertools.pairwise(order))


@pytest.mark.parametrize("run_rows", [20_000, 7])
def test_shards(spark, run_rows):
    rows = hard_rows()
    got = shard_documents(hard_frame(spark), run_rows=run_rows).collect()
    expected = sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(g.doc_id), g["size"], g.text_crc32) for g in got) == expected
    slots = defaultdict(list)
    for g in got:
        slots[g.shard].append(g.slot)
    assert set(slots) == set(range(8))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_shard = sorted((g.shard, g.cell) for g in got)
    assert [c for _, c in by_shard] == sorted(g.cell for g in got)  # shards are runs of the curve


def test_small_and_empty_tables(spark):
    assert shard_documents(hard_frame(spark).limit(0)).count() == 0
    assert sorted(r.slot for r in shard_documents(hard_frame(spark).limit(3)).collect()) == [0, 0, 0]


def test_files(spark, tmp_path):
    frame = hard_frame(spark).union(hard_frame(spark)).withColumn("Shard", F.lit("own"))
    frame = frame.union(frame.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" again"))))  # ids with several texts
    write_shards(frame, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns[:-1] == frame.columns and back.columns[-1].lower() != "shard"
    rows = lambda f: Counter(f.select(F.to_json(F.struct(*[F.col(c) for c in frame.columns])).alias("j")).toPandas()["j"])
    assert rows(back) == rows(frame)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    written = Counter(map(tuple, back.select("doc_id", crc, F.col(back.columns[-1])).collect()))
    assert written == Counter(map(tuple, shard_documents(frame).select("doc_id", "text_crc32", "shard").collect()))


def test_sources_with_one_prefix_have_cells_of_their_own(spark):
    rows = [(7, "same text", "en", f"https://www.example.org/{i % 8}") for i in range(800)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert len({r.cell for r in shard_documents(frame).collect()}) == 8


def test_cuts_are_whole_strings(spark):
    values = [None] * 30 + [""] * 5 + [f"common_crawl_{i % 50:02}" for i in range(300)] + ["é"] * 65
    frame = spark.createDataFrame([(v,) for v in reversed(values)], "v string").repartition(7)
    shares = [i / 16 for i in range(1, 16)]
    order = sorted(values, key=lambda v: (v is not None, (v or "").encode()))
    expected = list(dict.fromkeys(order[-int(-s * len(order) // 1) - 1] for s in shares))
    assert string_cuts(frame, F.col("v"), shares) == expected
    assert string_cuts(frame.limit(0), F.col("v"), shares) == []
