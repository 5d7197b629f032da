"""Streaming upload scoring resumes from its checkpoint: a restart processes only new files."""

from pyspark.sql import functions as F

from riskloom.plans.workbench import Workbench
from riskloom.session import shared_path
from riskloom.streaming.scoring import read_scored, start_scoring
from tests.conftest import SF_SMALL


def test_stream_restart_processes_only_new_files(spark):
    b = Workbench.get(spark, SF_SMALL)
    src, sink, ckpt = (shared_path(spark, n) for n in ("t-uploads", "t-sink", "t-ckpt"))
    e = b.employees
    first = e.where(F.col("EmployeeNumber") % 2 == 0)
    second = e.where(F.col("EmployeeNumber") % 2 == 1)
    first.write.mode("append").parquet(src)
    start_scoring(spark, b, src, sink, ckpt).awaitTermination()
    n1 = read_scored(spark, sink).count()
    second.write.mode("append").parquet(src)
    start_scoring(spark, b, src, sink, ckpt).awaitTermination()
    out = read_scored(spark, sink)
    assert n1 == first.count()
    assert out.count() == e.count()
    assert out.select("EmployeeNumber").distinct().count() == e.count()
    expected = b.scored.select("EmployeeNumber", "PredictedAttritionRisk")
    diff = out.select("EmployeeNumber", "PredictedAttritionRisk").exceptAll(expected)
    assert diff.count() == 0
