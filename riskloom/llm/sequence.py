"""Sums along ordered rows of a group, without a group or the table in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import checkpoint


def ordered(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows by group and order, range-partitioned and checkpointed: a hot group lies in many
    partitions, and equal rows are split too. Nulls come first, equal rows in any order. Columns
    `_group` and `_pid` are for `sums`. Give it checkpointed rows: they are read twice."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [*group, *order, "_salt"]
    salted = df.withColumns({"_group": F.xxhash64(*group), "_salt": F.monotonically_increasing_id()})
    return checkpoint(salted.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_salt").withColumn("_pid", F.spark_partition_id()))


def sums(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds to ordered rows, for each `out: column`, the sum of the long column over the rows of
    the group that come before the row (64-bit, wrapping around); a row's place is the sum of a
    column of ones. The rows stay where they are; the driver sees two sums a partition."""
    outs, own = list(columns), list(columns.values())
    starts = _starts(rows.select("_pid", "_group", *[F.col(c).alias(f"s{i}") for i, c in enumerate(own)]), len(own))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(o, T.LongType()) for o in outs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, carry = None, None
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("_group").to_numpy(zero_copy_only=False)
            if group is None:
                group, carry = g[0], np.array(starts.get(b.column("_pid")[0].as_py(), [0] * len(own)), dtype=np.int64)
            w = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in own])
            before, group, carry = _before(g, w, group, carry)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(before[:, i]) for i in range(len(outs)))], names=schema.names)

    return rows.mapInArrow(run, schema)


def along(df: DataFrame, group: Sequence[str], order: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """`sums` over rows that are not in order yet."""
    return sums(ordered(df, group, order), columns).drop("_group", "_pid")


def _before(g: np.ndarray, w: np.ndarray, group: int, carry: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Sums before each row, and the group and its sums at the end."""
    run = np.cumsum(w, axis=0, dtype=np.int64)
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    base = np.where((start > 0)[:, None], run[np.maximum(start, 1) - 1], 0)
    if g[0] == group:
        base[0] -= carry
    length = np.diff(np.append(start, len(g)))
    before = run - w - np.repeat(base, length, axis=0)
    return before, g[-1], before[-1] + w[-1]


def _starts(narrow: DataFrame, k: int) -> dict[int, list[int]]:
    """For each partition, the sums that its first group has in earlier partitions."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, first, first_sum, last, last_sum = None, None, None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(1).to_numpy(zero_copy_only=False)
            w = np.column_stack([b.column(2 + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(k)])
            if pid is None:
                pid, first, last = b.column(0)[0].as_py(), g[0], g[0]
                first_sum = last_sum = np.zeros(k, dtype=np.int64)
            if last == first:
                first_sum = first_sum + w[: int(np.argmax(np.append(g != first, True)))].sum(axis=0)
            _, last, last_sum = _before(g, w, last, last_sum)
        if pid is not None:
            yield pa.RecordBatch.from_pylist([{"pid": pid, "first": int(first), "first_sum": first_sum.tolist(), "last": int(last), "last_sum": last_sum.tolist()}], schema=pa.schema([("pid", pa.int32()), ("first", pa.int64()), ("first_sum", pa.list_(pa.int64())), ("last", pa.int64()), ("last_sum", pa.list_(pa.int64()))]))

    rows = narrow.mapInArrow(ends, "pid int, first long, first_sum array<long>, last long, last_sum array<long>").collect()
    starts: dict[int, list[int]] = {}
    group, total = None, np.zeros(k, dtype=np.int64)
    for r in sorted(rows, key=lambda r: r["pid"]):
        goes_on = r["first"] == group
        if goes_on:
            starts[r["pid"]] = total.tolist()
        whole = r["first"] == r["last"]
        total = np.array(r["last_sum"], dtype=np.int64) + (total if whole and goes_on else 0)
        group = r["last"]
    return starts
