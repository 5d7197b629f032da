"""Filters, search, top-k views, percentiles and comparisons over a scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.expressions import percent_text
from riskloom.operators.stats import cumulative_share, share_at_or_below

ALL = "All"


def present(df: DataFrame, preferred: Sequence[str]) -> list[str]:
    return [c for c in preferred if c in df.columns]


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """All columns rendered as text and joined by one space (null -> empty), lower-cased."""
    cols = list(columns or df.columns)
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


# Every character that can occur in the text of a number (digits, sign, point, exponent,
# NaN, Infinity) — a search term using any other character cannot match a numeric column.
_NUMBER_CHARS = set("0123456789+-.e") | set("nan") | set("infinity")


def search_predicate(df: DataFrame, term: str, columns: Sequence[str] | None = None) -> Column:
    """Literal, case-insensitive substring of the row text (columns joined by one space).

    Exact fast path: a term without a space cannot span two columns, so it matches the
    joined text iff it matches one column's text; numeric columns are skipped when the term
    holds a character no number rendering contains. Otherwise the joined text is searched."""
    cols = list(columns or df.columns)
    term = term.strip().lower()
    if " " in term:
        return F.contains(row_text(df, cols), F.lit(term))
    types = dict(df.dtypes)
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    if not set(term) <= _NUMBER_CHARS:
        cols = [c for c in cols if types[c] not in numeric and not types[c].startswith("decimal")]
    if not cols:
        return F.lit(False)
    pred = None
    for c in cols:
        p = F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(term)), F.lit(False))
        pred = p if pred is None else (pred | p)
    return pred


def filter_predicate(
    df: DataFrame,
    risk: str = ALL,
    department: str = ALL,
    role: str = ALL,
    search: str = "",
    search_columns: Sequence[str] | None = None,
) -> Column:
    """F1-F4 as one predicate: risk category, department and role equality on the text
    value, literal case-insensitive substring over the row text ("All"/"" skip)."""
    pred = F.lit(True)
    if risk != ALL:
        pred = pred & (F.col("RiskCategory") == risk)
    if department != ALL and "Department" in df.columns:
        pred = pred & (F.col("Department").cast("string") == department)
    if role != ALL and "JobRole" in df.columns:
        pred = pred & (F.col("JobRole").cast("string") == role)
    if search.strip():
        pred = pred & search_predicate(df, search, search_columns)
    return pred


def filter_or_all(df: DataFrame, pred: Column) -> DataFrame:
    """matching rows, or the whole table when nothing matches — decided inside the plan:
    the match count is a scalar subquery, so there is no driver branch and no join."""
    matched_count = df.where(pred).select(F.count(F.lit(1))).scalar()
    return df.where(pred | (matched_count == 0))


def filter_counts(df: DataFrame, pred: Column) -> DataFrame:
    """Matched vs total in one aggregate."""
    return df.agg(F.count_if(F.coalesce(pred, F.lit(False))).alias("matched"), F.count(F.lit(1)).alias("total"))


def top_by_risk(df: DataFrame, k: int, risk: str, id_col: str, columns: Sequence[str]) -> DataFrame:
    """O1-O3: highest risk first, id breaks ties; ``limit`` becomes TakeOrderedAndProject."""
    return df.orderBy(F.col(risk).desc(), F.col(id_col).asc()).select(*columns).limit(k)


def risk_percentile(df: DataFrame, risk: str, out: str = "percentile") -> DataFrame:
    """Share of rows with risk <= own risk, x100 (distributed cume_dist)."""
    res = cumulative_share(df, risk, out="_share")
    return res.withColumn(out, F.col("_share") * 100.0).drop("_share")


def percentile_vs_reference(probes: DataFrame, probe_risk: str, reference: DataFrame, ref_risk: str, out: str = "percentile") -> DataFrame:
    """Share of the reference population at or below each probe's risk, x100."""
    res = share_at_or_below(probes, probe_risk, reference, ref_risk, out="_share")
    return res.withColumn(out, F.coalesce(F.col("_share"), F.lit(0.0)) * 100.0).drop("_share")


def with_average(df: DataFrame, risk: str, out: str = "dataset_avg") -> DataFrame:
    """Every row next to the population average (a scalar subquery, computed once)."""
    avg = df.select(F.avg(risk)).scalar()
    return df.withColumn(out, avg)


def selection_label(id_col: str, employee_col: str | None, risk: str, with_department: bool) -> Column:
    """P13: "idx | Employee n | [Department |] category | xx.xx%"."""
    who = (
        F.concat(F.lit("Employee "), F.col(employee_col).cast("string"))
        if employee_col
        else F.concat(F.lit("Uploaded row "), (F.col(id_col) + 1).cast("string"))
    )
    parts = [F.col(id_col).cast("string"), who]
    if with_department:
        parts.append(F.coalesce(F.col("Department").cast("string"), F.lit("")))
    parts += [F.col("RiskCategory"), percent_text(F.col(risk))]
    return F.concat_ws(" | ", *parts)


def distinct_options(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, option) — sorted distinct non-null text values of each field, one job."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("option")) for f in fields])).alias("kv")
    ).select("kv.field", "kv.option")
    return long.where(F.col("option").isNotNull()).distinct().orderBy("field", "option")


__all__ = [
    "ALL", "present", "row_text", "filter_predicate", "filter_or_all", "filter_counts", "top_by_risk",
    "risk_percentile", "percentile_vs_reference", "with_average", "selection_label", "distinct_options",
]
