"""Scans of the given tables, the fixture projections, CSV upload scans and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import spread
from riskloom.sources.fixtures import EMPLOYEES_SQL, WORKERS_CUSTOM_SQL

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan (lazy; Catalyst prunes columns and pushes filters into it)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Make NaN and NULL one thing for floating columns (pandas treats both as missing)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def employees(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Standard-layout employee table (35 columns), one row per order. ``dealt`` deals the orders
    out anew: they are narrow, and a file of a few megabytes is read by one task, which would then
    do all that follows on its rows."""
    tables = {t: read_table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region")}
    if dealt:
        tables["orders"] = spread(tables["orders"], "o_orderkey")
    return nan_to_null(spark.sql(EMPLOYEES_SQL, **tables))


def workers_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfamiliar-layout employee table (15 columns) derived from ``employees``."""
    return spark.sql(WORKERS_CUSTOM_SQL, employees=employees(spark, sf_dir))


def duckdb_sql(template: str) -> str:
    """The same fixture statement for DuckDB views."""
    return template.format(
        orders="orders", customer="customer", nation="nation", region="region", employees="employees", part="part"
    )


# FIXED VALUES: unquoted texts that pandas reads as missing.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
CORRUPT = "_corrupt_record"


def _csv_reader(spark: SparkSession):
    """Quotes are doubled inside quotes and records may run over lines, as pandas writes them."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)


def scan_csv_text(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text, null tokens as null, and ``_corrupt_record``: the whole record
    where it does not have the header's number of fields, else null."""
    names = columns or _csv_reader(spark).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    text = _csv_reader(spark).schema(schema).csv(path)
    return text.select(*[F.when(~F.col(f"`{c}`").isin(NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in names], CORRUPT)


#: What a text must look like to be a whole number or a double at all: a cast that fails costs an
#: exception, which is caught and slower than all else that a cell takes.
MAYBE_WHOLE = r"^[^0-9A-Za-z.+-]*[+-]?[0-9]+[^0-9A-Za-z.+-]*$"
MAYBE_DOUBLE = r"^[\x00-\x20]*[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?[dDfF]?|\.[0-9].*|0[xX].*|[iI][nN][fF].*|[nN][aA][nN])[\x00-\x20]*$"
MAYBE = {**dict.fromkeys(("tinyint", "smallint", "int", "bigint"), MAYBE_WHOLE), "double": MAYBE_DOUBLE}


def _try_cast(column: Column, kind: str) -> Column:
    """``try_cast`` of a text, to a number only where it may be one."""
    return F.when(column.rlike(MAYBE[kind]), column.try_cast(kind)) if kind in MAYBE else column.try_cast(kind)


def csv_types(text: DataFrame) -> T.StructType:
    """Type of each text column by its values, from one aggregate over (column, value): bigint,
    double, date or string. All columns side by side would make one method of generated code
    that is too long to be compiled."""
    names = [c for c in text.columns if c != CORRUPT]
    kinds = ["bigint", "double", "date"]
    cells = text.select(F.posexplode(F.array(*[F.col(f"`{c}`") for c in names])).alias("i", "v")).where("v IS NOT NULL") if names else None
    fits = [F.bool_and(_try_cast(F.col("v"), k).isNotNull()).alias(k) for k in kinds]
    found = {r["i"]: r for r in cells.groupBy("i").agg(*fits).collect()} if names else {}  # one row a column
    pick = lambda i: next((k for k in kinds if i in found and found[i][k]), "string")
    return T.StructType([T.StructField(c, {"bigint": T.LongType(), "double": T.DoubleType(), "date": T.DateType()}.get(pick(i), T.StringType())) for i, c in enumerate(names)])


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, keep_corrupt: bool = False) -> DataFrame:
    """CSV upload scan with a header, in the declared schema or that found from the values.
    Values that do not fit become null; records with another number of fields keep their
    text in ``_corrupt_record`` if asked for (``csv_rejects`` counts them)."""
    text = scan_csv_text(spark, path, schema.names if schema is not None else None)
    schema = schema if schema is not None else csv_types(text)
    cols = [(F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else _try_cast(F.col(f"`{f.name}`"), f.dataType.simpleString())).alias(f.name) for f in schema.fields]
    return nan_to_null(text.select(*cols, *[CORRUPT] * keep_corrupt))


def csv_rejects(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """(records, rejected): all records of the files, and those with the wrong number of fields."""
    text = scan_csv_text(spark, path, columns)
    whole = F.hash(*[F.col(f"`{c}`") for c in text.columns])  # reads all fields, so that none is pruned before they are counted
    return text.agg(F.count(whole).alias("records"), F.count(F.when(F.col(CORRUPT).isNotNull(), whole)).alias("rejected"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink (one folder of part files, header in each); quotes are doubled inside quotes."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet sink, optionally partitioned (e.g. by RiskCategory for pruning)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


REPORT_END = "\x1e\n"


def write_text(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """Text sink of reports that may run over lines: each ends with a record separator."""
    df.select(F.concat(F.col(column), F.lit(REPORT_END[:-1])).alias("value")).write.mode(mode).text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """The reports of ``write_text``, one row each."""
    parts = spark.read.option("lineSep", REPORT_END).text(path)
    return parts.select("value")
