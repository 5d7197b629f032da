"""Dataset profiling: shape, missing cells, per-column statistics, quality score.

All per-column statistics of a table come from ONE aggregate pass (never one job
per column); the results are a handful of numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import config as C


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def column_profile(df: DataFrame) -> DataFrame:
    """(col_name, col_ord, is_numeric, non_null, nulls, all_null, any_null) in one pass."""
    fields = df.schema.fields
    stats = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(F.col(f.name)).alias(f"c{i}") for i, f in enumerate(fields)],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("col_name"),
                F.lit(i).alias("col_ord"),
                F.lit(is_numeric(f.dataType)).alias("is_numeric"),
                F.col(f"c{i}").alias("non_null"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return stats.select("__rows", F.explode(entries).alias("s")).select(
        "s.col_name",
        "s.col_ord",
        "s.is_numeric",
        F.col("s.non_null").alias("non_null"),
        (F.col("__rows") - F.col("s.non_null")).alias("nulls"),
        (F.col("s.non_null") == 0).alias("all_null"),
        (F.col("s.non_null") < F.col("__rows")).alias("any_null"),
    )


KINDS = {"integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "float": (T.FloatType, T.DoubleType, T.DecimalType), "text": (T.StringType,), "date": (T.DateType, T.TimestampType)}


def column_kinds(df: DataFrame) -> DataFrame:
    """(kind, columns, non_null, nulls): columns of each kind of type and their cells, from
    one pass over the table."""
    kind_of = {f.name: next((k for k, types in KINDS.items() if isinstance(f.dataType, types)), "other") for f in df.schema.fields}
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in kind_of.items() for x in pair]), F.col("col_name"))
    return column_profile(df).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("columns"), F.sum("non_null").alias("non_null"), F.sum("nulls").alias("nulls"))


def shape_and_missing(df: DataFrame) -> dict:
    """Rows, columns, missing cells and percentage (0 cells -> divide by 1)."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))).alias("missing"),
    ).collect()[0]
    rows, cols = row["rows"], len(df.columns)
    missing = row["missing"] or 0
    cells = rows * cols if rows * cols > 0 else 1
    return {"rows": rows, "columns": cols, "missing": missing, "missing_pct": missing / cells * 100.0}


def quality_score_columns(
    profile: DataFrame,
    n_features: int = len(C.STANDARD_FEATURES),
) -> DataFrame:
    """H10/H11 on a one-row profile (rows, columns, missing_pct, mapped, derived, unknown,
    is_standard, missing_names): adds score and suggestions, all Column expressions."""
    missing_feats = F.lit(n_features) - F.col("mapped_columns_count") - F.col("derived_columns_count")
    raw = (
        F.lit(100.0)
        - missing_feats * F.lit(C.PENALTY_PER_MISSING_FEATURE)
        - F.col("missing_pct") * F.lit(C.PENALTY_PER_MISSING_PCT)
        - F.when(~F.col("is_standard") & (F.col("columns") > 0), F.col("unknown_columns_count") / F.col("columns") * F.lit(C.PENALTY_UNKNOWN_SHARE)).otherwise(F.lit(0.0))
    )
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
    score = F.bround(clamped, 0).cast("int")
    miss_text = F.format_string(
        C.SUGGEST_MISSING_FEATURES.replace("{}", "%s"), missing_feats.cast("string"), F.col("missing_names")
    )
    cells_text = F.format_string(
        C.SUGGEST_MISSING_CELLS.replace("{}", "%s"), F.format_string("%.1f", F.round(F.col("missing_pct"), 1))
    )
    unk_text = F.format_string(C.SUGGEST_UNKNOWN.replace("{}", "%s"), F.col("unknown_columns_count").cast("string"))
    verdict = (
        F.when(clamped > C.SCORE_EXCELLENT, F.lit(C.SUGGEST_EXCELLENT))
        .when(clamped > C.SCORE_GOOD, F.lit(C.SUGGEST_GOOD))
        .otherwise(F.lit(C.SUGGEST_POOR))
    )
    suggestions = F.filter(
        F.array(
            F.when(missing_feats > 0, miss_text),
            F.when(F.col("missing_pct") > C.MISSING_PCT_WARN, cells_text),
            F.when(F.col("unknown_columns_count") > 0, unk_text),
            verdict,
        ),
        lambda x: x.isNotNull(),
    )
    return profile.withColumn("score", score).withColumn("suggestions", suggestions)


def profile_summary(
    spark: SparkSession,
    df: DataFrame,
    decisions: DataFrame,
    dataset: str,
    features: Sequence[str] = C.STANDARD_FEATURES,
) -> DataFrame:
    """One-row profile of an upload given its mapping decisions (FIXTURES §6 schema, arrays
    rendered as text: names joined by ", ", suggestions by newline)."""
    sm = shape_and_missing(df)
    numeric = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    categorical = [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
    is_standard = set(features).issubset(set(df.columns))
    req = F.array(*[F.lit(f) for f in features])
    counts = decisions.where(F.col("dataset") == dataset).agg(
        F.count_if(F.col("kind") == "mapped").cast("int").alias("mapped_columns_count"),
        F.count_if(F.col("kind") == "derive").cast("int").alias("derived_columns_count"),
        F.count_if(F.col("kind") == "unknown").cast("int").alias("unknown_columns_count"),
        F.collect_set(F.when(F.col("kind").isin("mapped", "derive"), F.col("target"))).alias("_have"),
    )
    missing_names = F.array_join(
        F.slice(F.filter(req, lambda f: ~F.array_contains(F.col("_have"), f)), 1, C.MISSING_FEATURES_SHOWN), ", "
    )
    base = counts.select(
        F.lit(sm["rows"]).cast("long").alias("rows"),
        F.lit(sm["columns"]).cast("int").alias("columns"),
        F.lit(float(sm["missing_pct"])).alias("missing_pct"),
        F.lit(", ".join(numeric)).alias("numeric_columns"),
        F.lit(", ".join(categorical)).alias("categorical_columns"),
        "mapped_columns_count",
        "derived_columns_count",
        "unknown_columns_count",
        F.lit(is_standard).alias("is_standard"),
        missing_names.alias("missing_names"),
    )
    out = quality_score_columns(base, len(features))
    return out.select(
        "rows", "columns", F.round("missing_pct", 6).alias("missing_pct"), "numeric_columns", "categorical_columns",
        "mapped_columns_count", "derived_columns_count", "unknown_columns_count", "score",
        F.array_join("suggestions", "\n").alias("suggestions"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A3/A4: (value, n, share) of the non-null values (pandas ``value_counts`` semantics);
    the total is a scalar subquery."""
    present = df.where(F.col(col).isNotNull())
    counts = present.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = present.select(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.round(F.col("n") / total, 9))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """A5: counts of ``row`` x ``col`` with the column values pivoted (fixed list: one pass)."""
    return (
        df.groupBy(row)
        .pivot(col, list(values))
        .agg(F.count(F.lit(1)))
        .select(row, *[F.coalesce(F.col(v), F.lit(0)).cast("bigint").alias(v) for v in values])
    )
