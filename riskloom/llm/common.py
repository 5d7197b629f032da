"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch where texts go to Python.
BATCH_ROWS, BATCH_BYTES = "2000", "16m"


def text_batches(spark: SparkSession) -> None:
    """Makes the session's Arrow batches small enough for long texts, where it has Spark's own
    sizes; sizes that a user has set stay."""
    for key, default, own in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", default) in (default, "64MB"):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", own)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_texts(column) -> list[str]:
    """Python strings of a pandas column; a null is the empty text."""
    return [t if isinstance(t, str) else "" for t in column]


def per_worker(key: str, make: Callable[[], Any]) -> Any:
    """An object kept by the Python worker process across the tasks that it runs.

    Functions reach the workers by value, so their module globals are new in each task;
    what is costly to load (a vocabulary) or worth keeping (a cache) is held here. A lost
    worker only loads it again."""
    kept = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    if key not in kept.__dict__:
        kept.__dict__[key] = make()
    return kept.__dict__[key]


def hash_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet."""
    name, n = stem, 0
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name
