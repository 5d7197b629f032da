"""Category dictionaries, model frames, imputation and encoding.

A fitted dictionary is the same thing as a ``StringIndexerModel`` with
alphabetical order: it is fitted by a distributed distinct and written as a table.
Dictionaries whose number of categories is known to be small are broadcast; all others
are applied together in one shuffle of the rows, not one for each column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import config as C
from riskloom.functions.expressions import label_to_int, to_number
from riskloom.operators.stats import dense_positions, exact_medians
from riskloom.session import shared_path

# A dictionary of more categories than this is not broadcast.
BROADCAST_CATEGORIES = 20_000
# Buckets used to take the first unknown categories without one task per column.
UNKNOWN_SALT_BUCKETS = 64


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def fit_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, category, code): distinct non-null values per column, code = sorted position.

    Positions come from a distributed running total over (feature, category), so even a
    column with a huge number of categories is never ranked inside one task."""
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in columns])
        ).alias("kv")
    ).select("kv.feature", "kv.category")
    distinct = long.where(F.col("category").isNotNull()).distinct()
    ranked = dense_positions(distinct, ["category"], out="_pos", group_cols=["feature"])
    return ranked.select("feature", "category", (F.col("_pos") - 1).cast("int").alias("code"))


@dataclass
class Dictionary:
    """Category dictionary: a written table (feature, category, code), code = sorted
    position, and the number of categories of each feature."""

    sizes: dict[str, int]
    table: DataFrame

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "Dictionary":
        """Distinct categories coded by distributed positions; only their number per column
        comes to the driver."""
        spark = df.sparkSession
        path = shared_path(spark, "dictionary")
        fit_dictionary(df, columns).write.partitionBy("feature").parquet(path)
        table = spark.read.schema("category string, code int, feature string").parquet(path)
        sizes = {c: 0 for c in columns}
        sizes.update({r["feature"]: r["n"] for r in table.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()})
        return cls(sizes, table)

    def __contains__(self, feature: str) -> bool:
        return feature in self.sizes

    def size(self, feature: str) -> int:
        return self.sizes[feature]

    def join_codes(self, df: DataFrame, columns: Sequence[str], broadcast_up_to: int = BROADCAST_CATEGORIES) -> DataFrame:
        """Add ``__code_<col>`` for the dictionary columns among ``columns``; null when unseen."""
        wanted = [c for c in columns if c in self.sizes and f"__code_{c}" not in df.columns]
        large = [c for c in wanted if self.sizes[c] > broadcast_up_to]
        for c in wanted:
            if c not in large:
                d = self.table.where(F.col("feature") == c).select(
                    F.col("category").alias(f"__cat_{c}"), F.col("code").alias(f"__code_{c}")
                )
                df = df.join(F.broadcast(d), F.col(c).cast("string") == F.col(f"__cat_{c}"), "left").drop(f"__cat_{c}")
        return self._join_large(df, large) if large else df

    def _join_large(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """The codes of several columns by one join on (feature, category) and one aggregate
        back. Each row sends a narrow entry for each column, and once itself, under a key of its
        own so that it does not follow a common category; a common category itself is what
        adaptive execution splits."""
        names, row = df.columns, F.monotonically_increasing_id()
        texts = {f"__k{i}": F.col(f"`{c}`").cast("string") for i, c in enumerate(columns)}
        whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
        kept = df.select(row.alias("__row"), whole.alias("__whole"), *[x.alias(k) for k, x in texts.items()])
        self_entry = F.struct(F.lit("").alias("feature"), F.col("__row").cast("string").alias("category"), F.col("__whole").alias("whole"))
        none = F.lit(None).cast(kept.schema["__whole"].dataType)
        entries = [F.struct(F.lit(c).alias("feature"), F.col(k).alias("category"), none.alias("whole")) for c, k in zip(columns, texts)]
        long = kept.select("__row", F.explode(F.array(self_entry, *entries)).alias("e")).select("__row", "e.*").where("category IS NOT NULL")
        known = self.table.where(F.col("feature").isin(columns)).select("feature", "category", "code")
        coded = long.join(known, ["feature", "category"], "left")
        back = coded.groupBy("__row").agg(
            F.first("whole", ignorenulls=True).alias("whole"), *[F.max(F.when(F.col("feature") == c, F.col("code"))).alias(f"__code_{c}") for c in columns]
        )
        return back.select(*[F.col(f"whole.c{i}").alias(c) for i, c in enumerate(names)], *[f"__code_{c}" for c in columns])

    def code(self, feature: str) -> Column:
        """Code expression over a frame from ``join_codes``."""
        return F.col(f"__code_{feature}")


def model_frame(employees: DataFrame, dictionary: Dictionary, id_col: str = C.ID_ROLE) -> DataFrame:
    """Training frame: id, 30 encoded features (categorical codes as int), label as 0/1.

    Drops the uninformative columns; every text feature is encoded with ``dictionary``."""
    employees = dictionary.join_codes(employees, C.STANDARD_FEATURES)
    cols = [F.col(id_col).alias("id")]
    for f in C.STANDARD_FEATURES:
        if f in dictionary:
            cols.append(dictionary.code(f).alias(f))
        else:
            cols.append(F.col(f))
    if C.LABEL in employees.columns:
        cols.append(label_to_int(F.col(C.LABEL)).alias(C.LABEL))
    return employees.select(*cols)


def training_medians(
    frame: DataFrame, features: Sequence[str] = C.STANDARD_FEATURES, approx_accuracy: int | None = None
) -> dict[str, float | None]:
    """Medians of the model frame, collected: 30 numbers.

    Exact by default (distributed running totals). ``approx_accuracy`` opts into one
    ``percentile_approx`` pass (rank error <= rows / accuracy) for very large tables."""
    if approx_accuracy:
        row = frame.agg(
            *[F.percentile_approx(F.col(f).cast("double"), 0.5, approx_accuracy).alias(f) for f in features]
        ).collect()[0]
        return {f: (float(row[f]) if row[f] is not None else None) for f in features}
    return {r["feature"]: r["median"] for r in exact_medians(frame, features).collect()}


def training_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent category of each column (the first in order among equals), collected:
    one value a column. Counted per category first, so no task sees a column's rows."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in columns])).alias("kv")
    ).select("kv.feature", "kv.category")
    counts = long.where(F.col("category").isNotNull()).groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("feature").agg(F.min_by("category", F.struct(-F.col("n"), "category")).alias("category"))
    return {r["feature"]: r["category"] for r in best.collect()}


def fill_medians(frame: DataFrame, medians: dict[str, float | None], features: Sequence[str] = C.STANDARD_FEATURES) -> DataFrame:
    """Null -> training median (constants fold into ``coalesce``); features become double."""
    out = []
    for c in frame.columns:
        if c in features:
            m = medians.get(c)
            expr = F.col(c).cast("double")
            if m is not None:
                expr = F.coalesce(expr, F.lit(float(m)))
            out.append(expr.alias(c))
        else:
            out.append(F.col(c))
    return frame.select(*out)


def column_flags(df: DataFrame, dictionary: Dictionary, columns: Sequence[str]) -> dict[str, dict]:
    """One aggregate pass: per column, is it entirely numeric codes within range, and null counts."""
    aggs = []
    for c in columns:
        num = to_number(F.col(c))
        if c in dictionary:
            n = dictionary.size(c)
            ok = num.isNotNull() & (num >= 0) & (num <= n - 1)
            aggs.append(F.coalesce(F.bool_and(ok), F.lit(True)).alias(f"{c}__codes"))
        aggs.append(F.count(F.col(c)).alias(f"{c}__nonnull"))
    aggs.append(F.count(F.lit(1)).alias("__rows"))
    row = df.agg(*aggs).collect()[0].asDict()
    out = {}
    for c in columns:
        out[c] = {
            "codes": row.get(f"{c}__codes", False),
            "nonnull": row[f"{c}__nonnull"],
            "rows": row["__rows"],
        }
    return out


def encode_lenient(df: DataFrame, dictionary: Dictionary, columns: Sequence[str] | None = None) -> DataFrame:
    """Lenient encoding: a column of in-range numeric codes is truncated to int; otherwise
    categories are looked up and unseen values fall back to the first class (code 0).
    Columns without a dictionary are coerced to numbers, unparsable -> 0."""
    columns = list(columns if columns is not None else df.columns)
    flags = column_flags(df, dictionary, [c for c in columns if c in dictionary])
    df = dictionary.join_codes(df, [c for c in columns if c in dictionary and not flags[c]["codes"]])
    out = []
    for c in df.columns:
        if c.startswith("__code_"):
            continue
        if c not in columns:
            out.append(F.col(c))
        elif c in dictionary:
            if flags[c]["codes"]:
                out.append(to_number(F.col(c)).cast("int").alias(c))
            else:
                out.append(F.coalesce(dictionary.code(c), F.lit(0)).alias(c))
        else:
            out.append(F.coalesce(to_number(F.col(c)), F.lit(0.0)).alias(c))
    return df.select(*out)


def unknown_categories(df: DataFrame, dictionary: Dictionary, columns: Sequence[str]) -> DataFrame:
    """(feature, unknown_count, unknown_shown): distinct non-null text values absent from the
    dictionary, sorted, the first 8 shown. One job for all columns (anti join on the dictionary)."""
    cols = [c for c in columns if c in dictionary]
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in cols])
        ).alias("kv")
    ).select("kv.feature", "kv.category")
    observed = long.where(F.col("category").isNotNull()).distinct()
    known = dictionary.table.select("feature", "category")
    unknown = observed.join(known, ["feature", "category"], "left_anti")
    counts = unknown.groupBy("feature").agg(F.count(F.lit(1)).alias("unknown_count"))
    # first 8 in sort order without gathering every unknown value of a column in one task:
    # top-8 inside each (feature, salt) bucket, then top-8 of those at most 8 x buckets rows
    shown = C.UNKNOWN_CATEGORIES_SHOWN
    salted = unknown.withColumn("_salt", F.abs(F.xxhash64("category")) % UNKNOWN_SALT_BUCKETS)
    w = Window.partitionBy("feature", "_salt").orderBy("category")
    first = salted.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= shown)
    heads = first.groupBy("feature").agg(
        F.array_join(F.slice(F.array_sort(F.collect_list("category")), 1, shown), ", ").alias("unknown_shown")
    )
    per = counts.join(heads, "feature", "left")
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return names.join(per, "feature", "left").select(
        "feature",
        F.coalesce("unknown_count", F.lit(0)).cast("bigint").alias("unknown_count"),
        F.coalesce("unknown_shown", F.lit("")).alias("unknown_shown"),
    )


def encode_strict(df: DataFrame, dictionary: Dictionary, features: Sequence[str]) -> DataFrame:
    """Standard-schema encoding: numeric columns pass through; text columns must be in-range
    codes or known categories, otherwise an error lists the unknown ones."""
    text_cols = [c for c in features if c in dictionary and c in string_columns(df)]
    flags = column_flags(df, dictionary, text_cols) if text_cols else {}
    need_check = [c for c in text_cols if not flags[c]["codes"]]
    if need_check:
        bad = [r for r in unknown_categories(df, dictionary, need_check).collect() if r["unknown_count"] > 0]
        if bad:
            r = bad[0]
            raise ValueError(C.UNKNOWN_CATEGORIES_ERROR.format(r["feature"], r["unknown_shown"]))
    df = dictionary.join_codes(df, need_check)
    out = []
    for c in df.columns:
        if c.startswith("__code_"):
            continue
        if c not in features:
            out.append(F.col(c))
        elif c in text_cols:
            if flags[c]["codes"]:
                out.append(to_number(F.col(c)).cast("int").alias(c))
            else:
                out.append(dictionary.code(c).alias(c))
        else:
            out.append(to_number(F.col(c)).alias(c) if c in string_columns(df) else F.col(c))
    return df.select(*out)
