"""Shards along a Hilbert curve over several metadata dimensions.

Language, source, size and id are quantised by quantile cuts into a small grid; a cell's
place on the Hilbert curve orders it, so that runs of the order are compact boxes of the
metadata and files cut from it can be pruned by any of the dimensions. The order is cut
into shards whose row counts differ by one at most (law `rows`).

The order's positions are counted without sorting the table in one place: rows are counted
by cell (a bounded number), a cell with many rows is dealt by hash into runs of a fixed
expected size, and rows are numbered within their run only. All of it is DataFrame functions.

Defined results: a null text has size 1 and the crc of the empty text; null metadata go
before all values; repeated rows are placed each, side by side; an empty table gives no
rows; extra columns are left out of the placement.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import fresh_name
from riskloom.session import checkpoint, shared_path

#: Bits of each of the four quantised dimensions: at most 4096 cells.
BITS = 3
#: Expected rows of a run, which one task sorts.
RUN_ROWS = 20_000
SHARDS = 8


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a grid cell with the given coordinates. The state of
    the loop over bit planes, an array, is a lambda's argument, so nothing is computed twice."""
    n = len(axes)
    plane = lambda x, q: x.bitwiseAND(q) != 0

    def undo(x: Column, q: Column) -> Column:
        """One bit plane: each axis in turn inverts the low bits of the first axis, or swaps
        them with its own."""
        low = q - 1

        def turn(state: Column, i: Column) -> Column:
            first, own = F.get(state, F.lit(0)), F.get(state, i)
            swap = first.bitwiseXOR(own).bitwiseAND(low)
            new = F.when(plane(own, q), first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
            kept = F.when(plane(own, q), own).otherwise(own.bitwiseXOR(swap))
            return F.transform(state, lambda v, j: F.when(j == 0, new).when(j == i, kept).otherwise(v))

        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), x, turn)

    start = F.array(*[a.cast("int") for a in axes])
    planes = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    turned = F.aggregate(planes, start, undo)
    # Gray code along the axes, and the parity of the planes above each one
    gray = F.aggregate(
        F.sequence(F.lit(1), F.lit(n - 1)), turned, lambda s, i: F.transform(s, lambda v, j: F.when(j == i, v.bitwiseXOR(F.get(s, i - 1))).otherwise(v))
    )

    def finish(s: Column) -> Column:
        last = F.get(s, F.lit(n - 1))
        mask = F.aggregate(planes, F.lit(0), lambda t, q: F.when(plane(last, q), t.bitwiseXOR(q - 1)).otherwise(t))
        fixed = F.transform(s, lambda v: v.bitwiseXOR(mask))
        bit = lambda v, q: F.when(plane(v, q), 1).otherwise(0).cast("long")
        all_planes = F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)])
        return F.aggregate(all_planes, F.lit(0).cast("long"), lambda acc, q: F.aggregate(fixed, acc, lambda a, v: a * 2 + bit(v, q)))

    return F.transform(F.array(gray), finish)[0]


def string_cuts(docs: DataFrame, value: Column, shares: list[float]) -> list[str | None]:
    """The values at the given shares of the rows, in the order of the strings, null first;
    equal cuts once. Rows are counted by distinct value; the running total goes over ranges
    of values, so no task has them all."""
    counts = docs.groupBy(value.alias("v")).agg(F.count("*").alias("n"))
    ranged = checkpoint(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = ranged.groupBy("part").agg(F.sum("n").alias("n"))  # one row a partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(everything).alias("total"))
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = ranged.withColumn("reach", F.sum("n").over(inside)).join(F.broadcast(parts), "part")
    at = lambda s: F.min(F.when(F.col("before") + F.col("reach") >= s * F.col("total"), F.struct("v")))
    found = reach.agg(*[at(s).alias(f"c{i}") for i, s in enumerate(shares)]).first()  # one row
    return list(dict.fromkeys(c["v"] for c in found if c is not None))


def grid(docs: DataFrame, dimensions: dict[str, Column], bits: int = BITS, names: tuple[str, ...] = ()) -> DataFrame:
    """Adds `cell`, the Hilbert place of each row. Cuts of numbers are approximate quantiles,
    of which a sketch of fixed size is kept, those of the columns `names` are whole strings;
    equal cuts fall together."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = docs.agg(*[F.array_distinct(F.percentile_approx(v, F.array(*map(F.lit, shares)), F.lit(1000))).alias(k) for k, v in dimensions.items()]).first().asDict()  # one row
    dimensions = {**{n: F.col(n) for n in names}, **dimensions}
    cuts |= {n: string_cuts(docs, F.col(n), shares) for n in names}
    above = lambda v, c: v.isNotNull() if c is None else v > c
    code = lambda k, v: reduce(lambda a, c: a + F.when(above(v, c), 1).otherwise(0), cuts[k] or [], F.lit(0))
    coded = docs.withColumns({f"code_{k}": F.coalesce(code(k, v), F.lit(0)) for k, v in dimensions.items()})
    codes = [f"code_{k}" for k in dimensions]
    cells = coded.select(*codes).distinct()  # at most 2 ** (bits * dimensions)
    cells = cells.withColumn("cell", hilbert_index([F.col(c) for c in codes], bits))
    return coded.join(F.broadcast(cells), codes).drop(*codes)


def positions(rows: DataFrame, order: list[str], run_rows: int = RUN_ROWS) -> DataFrame:
    """Adds `position`, gapless from 0, along `cell`, and `total`, the number of rows."""
    cells = rows.groupBy("cell").agg(F.count("*").alias("cell_rows"))  # at most one row a cell of the grid
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select("cell", F.ceil(F.col("cell_rows") / run_rows).alias("runs"), F.coalesce(F.sum("cell_rows").over(before), F.lit(0)).alias("cell_start"), F.sum("cell_rows").over(everything).alias("total"))
    dealt = rows.join(F.broadcast(cells), "cell").withColumn("run", F.pmod(F.xxhash64(*order), F.col("runs")))
    runs = dealt.groupBy("cell", "run").agg(F.count("*").alias("run_rows"))
    earlier = Window.partitionBy("cell").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("cell", "run", F.coalesce(F.sum("run_rows").over(earlier), F.lit(0)).alias("run_start"))
    inside = Window.partitionBy("cell", "run").orderBy(*order)
    numbered = dealt.withColumn("n", F.row_number().over(inside) - 1).join(runs, ["cell", "run"])
    return numbered.withColumn("position", F.col("cell_start") + F.col("run_start") + F.col("n")).drop("runs", "cell_start", "run_start", "run", "n")


def narrow(doc_id: str, text: str, lang: str, source: str) -> dict[str, Column]:
    """What places a row."""
    body = F.coalesce(F.col(text), F.lit(""))
    return {
        "doc_id": F.col(doc_id),
        "size": (F.octet_length(body) + 1).cast("long"),
        "text_crc32": F.crc32(body.cast("binary")),
        "lang": F.col(lang).cast("string"),
        "source": F.col(source).cast("string"),
    }


def place(rows: DataFrame, shards: int, bits: int, run_rows: int) -> DataFrame:
    """Adds cell, shard and slot to rows with the columns of `narrow`; others go with them."""
    dimensions = {"size": F.col("size").cast("double"), "id": F.col("doc_id").cast("double")}
    placed = positions(grid(rows, dimensions, bits, ("lang", "source")), ["doc_id", "size", "text_crc32"], run_rows)
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    exact = placed.withColumn("shard", F.expr(f"(position * {shards}) div total").cast("int"))
    return exact.withColumn("slot", F.col("position") - first).drop("position", "total")


def shard_documents(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", bits: int = BITS, run_rows: int = RUN_ROWS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, cell, shard, slot."""
    # the texts are read once; what follows counts and joins these narrow rows
    rows = checkpoint(docs.select(*[v.alias(k) for k, v in narrow(doc_id, text, lang, source).items()]))
    return place(rows, shards, bits, run_rows).select("doc_id", "size", "text_crc32", "cell", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", bits: int = BITS, run_rows: int = RUN_ROWS) -> None:
    """The documents as one folder per shard, rows in the order of the curve, so that the
    column statistics of files and row groups bound each dimension. A row goes where it is
    placed itself, whatever rows share its id. The folder column is `shard`, or `shard_1`
    and so on where the documents have such a column."""
    spark = docs.sparkSession
    kept = shared_path(spark, "to-shard")  # a columnar copy, of which the counting reads narrow columns
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    docs.select(*[v.alias(k) for k, v in narrow(doc_id, text, lang, source).items()], whole).write.parquet(kept)
    folder = fresh_name(docs, "shard")
    rows = place(spark.read.parquet(kept), shards, bits, run_rows).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
