"""Scalable order statistics: running totals, exact medians, cumulative shares, ranks.

Spark's unpartitioned windows (``cume_dist().over(Window.orderBy(x))``) and the
exact ``percentile`` aggregate both end in one task holding every distinct value.
Here the same results come from a distributed prefix sum:

1. pre-aggregate to one row per distinct (group, key) with a weight (map-side
   partial aggregation, so a hot key is a single row);
2. range-partition by (group, key), sort inside the partitions and checkpoint (the
   partitions are fixed once, lineage is cut);
3. the weight of the first and the last group of each partition: two numbers a
   partition, which say where a group that goes on from an earlier partition stands;
4. a running sum along each partition as it lies, Arrow batch by Arrow batch: the data
   is shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import checkpoint

def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running_total(
    df: DataFrame,
    order_col: str,
    weight_col: str,
    group_cols: Sequence[str] = (),
    out: str = "cum_weight",
    total_out: str = "group_total",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out`` = sum of ``weight_col`` over rows of the same group with key <= own key
    (inclusive), and ``total_out`` = the group's total weight.

    ``df`` must hold one row per (group, key); pre-aggregate first.
    """
    group_cols = list(group_cols)
    n = _partitions(df, num_partitions)
    group = F.xxhash64(*group_cols) if group_cols else F.lit(0).cast("bigint")
    order = [*group_cols, order_col]
    ranged = checkpoint(
        df.withColumns({"_group": group, "_weight": F.col(weight_col).cast("bigint")})
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
    )
    starts = _starts(ranged)
    out_schema = T.StructType([*ranged.schema.fields, T.StructField(out, T.LongType())])

    def cumulate(batches):
        group, total = None, 0
        for batch in batches:
            g = batch.column(batch.schema.get_field_index("_group")).to_numpy(zero_copy_only=False)
            w = batch.column(batch.schema.get_field_index("_weight")).to_numpy(zero_copy_only=False)
            if not len(g):
                continue
            if group is None:
                group, total = g[0], starts.get(int(batch.column(batch.schema.get_field_index("_pid"))[0].as_py()), 0)
            first = np.flatnonzero(np.concatenate([[g[0] != group], g[1:] != g[:-1]]))
            run = np.cumsum(w)
            before = np.zeros(len(g), dtype=np.int64)
            before[: first[0] if len(first) else len(g)] = -total
            for i, j in zip(first, [*first[1:], len(g)]):
                before[i:j] = run[i - 1] if i else 0
            cum = run - before
            group, total = g[-1], int(cum[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cum, pa.int64())], names=[*batch.schema.names, out])

    cumulated = ranged.mapInArrow(cumulate, out_schema).drop("_group", "_weight", "_pid")
    totals = ranged.groupBy(*group_cols).agg(F.sum("_weight").alias(total_out))
    if not group_cols:
        return cumulated.withColumn(total_out, totals.scalar())
    # one row per group; the planner broadcasts it where it is small. Null-safe: a NULL
    # group is a group like any other.
    right = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group_cols)], total_out)
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group_cols)])
    return cumulated.join(right, same).drop(*[f"_g{i}" for i in range(len(group_cols))])


def _starts(ranged: DataFrame) -> dict[int, int]:
    """For each partition, the weight that its first group has in earlier partitions. The
    driver sees at most two rows a partition."""
    sums = ranged.groupBy("_pid", "_group").agg(F.sum("_weight").alias("w"))
    spans = sums.groupBy("_group").agg(F.count("*").alias("k"), F.collect_list(F.struct("_pid", "w")).alias("parts")).where("k > 1")
    starts: dict[int, int] = {}
    for r in spans.select("parts").collect():  # a group in k partitions; the sum of all k - 1 is below their number
        total = 0
        for pid, w in sorted((p["_pid"], p["w"]) for p in r["parts"]):
            if total:
                starts[pid] = total
            total += w
    return starts


def weighted_keys(df: DataFrame, key: Column | str, group_cols: Sequence[str] = (), weight: str = "n") -> DataFrame:
    """One row per distinct (group, key) with its row count (partial aggregation before the shuffle)."""
    key_col = F.col(key) if isinstance(key, str) else key
    return df.groupBy(*group_cols, key_col.alias("key")).agg(F.count(F.lit(1)).alias(weight))


def cumulative_share(df: DataFrame, key: str, out: str = "cume_dist", group_cols: Sequence[str] = ()) -> DataFrame:
    """``cume_dist()`` over (partition by group order by key): share of rows with key <= own key.

    Rows with a null key get a null share (they are excluded from the population)."""
    counts = weighted_keys(df.where(F.col(key).isNotNull()), key, group_cols)
    cum = running_total(counts, "key", "n", group_cols, out="_cum", total_out="_total")
    shares = cum.select(*group_cols, F.col("key").alias(key), (F.col("_cum") / F.col("_total")).alias(out))
    # one row per distinct key: AQE turns this into a broadcast when it is small at run time.
    return df.join(shares, [*group_cols, key], "left")


def share_at_or_below(
    probes: DataFrame, probe_key: str, reference: DataFrame, ref_key: str, out: str = "share"
) -> DataFrame:
    """For each probe row: share of reference rows with ref_key <= probe_key (a range lookup).

    Probe keys join the reference histogram with weight 0, so one running total
    over the union answers every probe."""
    ref = weighted_keys(reference.where(F.col(ref_key).isNotNull()), ref_key)
    probe_keys = (
        probes.where(F.col(probe_key).isNotNull())
        .select(F.col(probe_key).alias("key"))
        .distinct()
        .select("key", F.lit(0).cast("bigint").alias("n"))
    )
    both = ref.unionByName(probe_keys).groupBy("key").agg(F.sum("n").alias("n"))
    cum = running_total(both, "key", "n", (), out="_cum", total_out="_total")
    shares = cum.select(F.col("key").alias(probe_key), (F.col("_cum") / F.col("_total")).alias(out))
    return probes.join(shares, probe_key, "left")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, key, n) of the values that are not null of several columns."""
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
        ).alias("kv")
    ).select("kv.feature", "kv.v")
    return long.where(F.col("v").isNotNull()).groupBy("feature", F.col("v").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def quantile_aggregates(shares: Sequence[float]) -> list[Column]:
    """Aggregates ``_lo<i>``, ``_hi<i>`` over a running total of counts (n, _cum, _total): the keys
    on either side of the i-th share's place, (rows - 1) x share. All shares in one pass."""
    first, last = F.col("_cum") - F.col("n"), F.col("_cum") - 1  # 0-based ranks of the key's rows
    out = []
    for i, q in enumerate(shares):
        place = (F.col("_total") - 1) * F.lit(float(q))
        for name, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            out.append(F.max(F.when((first <= rank) & (rank <= last), F.col("key"))).alias(f"_{name}{i}"))
    return out


def interpolated(i: int, share: float) -> Column:
    """The i-th quantile from ``_lo<i>``, ``_hi<i>`` and the group's ``_total``."""
    place = (F.col("_total") - 1) * F.lit(float(share))
    return F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (place - F.floor(place))


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact interpolated median (pandas / ``percentile(x, 0.5)`` semantics, nulls skipped)
    of every column in one job: (feature, median). All-null columns get a null median."""
    cum = running_total(value_counts(df, columns), "key", "n", ["feature"], out="_cum", total_out="_total")
    picked = cum.groupBy("feature").agg(*quantile_aggregates([0.5]))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(picked, "feature", "left").select(
        "feature", ((F.col("_lo0") + F.col("_hi0")) / 2.0).alias("median")
    )


def dense_positions(df: DataFrame, order_cols: Sequence[str], out: str = "position", group_cols: Sequence[str] = ()) -> DataFrame:
    """1-based position of each row in (group; order) order — ``row_number`` without a
    single-task window. The order columns must be unique within a group."""
    tagged = df.withColumn("_key", F.struct(*[F.col(c) for c in order_cols])).withColumn(
        "_w", F.lit(1).cast("bigint")
    )
    cum = running_total(tagged, "_key", "_w", group_cols, out=out, total_out="_group_rows")
    return cum.drop("_key", "_w")
