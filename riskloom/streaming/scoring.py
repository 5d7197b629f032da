"""Structured Streaming: score employee files as they land in an upload folder.

Each micro-batch is the same projection as the batch path (the dictionary is a static
table joined to the stream, medians are literals, the forest is a compiled expression),
so the stream needs no state. ``availableNow`` processes everything present and stops; the checkpoint
folder makes restarts resume exactly where they left off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.plans.workbench import RISK, Workbench, with_risk_columns
from riskloom.sources.tables import nan_to_null


def scored_stream(spark: SparkSession, wbench: Workbench, source_dir: str, max_files_per_trigger: int = 64) -> DataFrame:
    schema = wbench.employees.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
    stream = nan_to_null(stream)
    stream = wbench.dictionary.join_codes(stream, wbench.ensemble.used_features())
    risk = wbench.risk_expr(stream)
    return with_risk_columns(stream.select("EmployeeNumber", risk.alias(RISK)))


def start_scoring(
    spark: SparkSession, wbench: Workbench, source_dir: str, sink_dir: str, checkpoint_dir: str, available_now: bool = True
) -> StreamingQuery:
    scored = scored_stream(spark, wbench, source_dir)
    writer = (
        scored.writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def read_scored(spark: SparkSession, sink_dir: str) -> DataFrame:
    return spark.read.parquet(sink_dir).select("EmployeeNumber", RISK, "PredictedOutcome", "RiskCategory").withColumn(
        RISK, F.col(RISK)
    )
