"""Upload preparation: derive, rename, impute, encode and align to the model.

The mapping decisions of one upload are a handful of rows (one per column); they
are collected to build a single projection. All row work is in that projection:
one narrow stage, no shuffle, plus one aggregate pass for the column statistics
the imputation rules depend on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.functions.expressions import to_number, to_timestamp_lenient
from riskloom.operators.encode import Dictionary


@dataclass
class Plan:
    """Collected mapping decisions of one upload."""

    columns: list[str]
    mapped: dict[str, str] = field(default_factory=dict)  # raw -> target
    derived: dict[str, str] = field(default_factory=dict)  # target -> raw source
    ignored: list[str] = field(default_factory=list)
    unknown: list[str] = field(default_factory=list)
    label: str | None = None
    id_col: str | None = None

    @classmethod
    def from_decisions(cls, decisions: DataFrame, dataset: str, columns: Sequence[str]) -> "Plan":
        rows = decisions.where(F.col("dataset") == dataset).orderBy("col_ord").collect()
        plan = cls(list(columns))
        for r in rows:
            k, c, t = r["kind"], r["col_name"], r["target"]
            if k == "mapped":
                plan.mapped[c] = t
            elif k == "derive":
                plan.derived[t] = c
            elif k == "ignored":
                plan.ignored.append(c)
            elif k == "unknown":
                plan.unknown.append(c)
            elif k == "label" and plan.label is None:
                plan.label = c
            elif k == "id" and plan.id_col is None:
                plan.id_col = c
        if plan.label is None:
            plan.label = next((c for c in columns if c.lower() == C.LABEL.lower()), None)
        return plan

    def present(self) -> set[str]:
        return set(self.mapped.values()) | set(self.derived)


def derived_column(target: str, source: Column, as_of: str, dtype: str = "string") -> Column:
    """The four derivations from a source of type ``dtype``; ``as_of`` replaces the wall clock
    so results are reproducible."""
    as_of_date = F.to_date(F.lit(as_of))
    if target == "YearsAtCompany":
        return (F.year(as_of_date) - F.year(to_timestamp_lenient(source, dtype))).cast("double")
    if target == "Age":
        days = F.datediff(as_of_date, F.to_date(to_timestamp_lenient(source, dtype)))
        return (days / F.lit(365.25)).cast("int").cast("double")
    if target == "MonthlyIncome":
        return to_number(source, dtype) / F.lit(12.0)
    if target == "JobSatisfaction":
        return to_number(source, dtype)  # rescaled below, needs the column maximum
    raise ValueError(target)


SURVEY_TOP = "__survey_top"


def with_survey_top(upload: DataFrame, plan: Plan) -> DataFrame:
    """Adds the maximum of the survey source, which its rescale needs: a one-row aggregate of
    that column, planned once."""
    raw = plan.derived.get("JobSatisfaction")
    if raw is None:
        return upload
    top = upload.agg(F.max(to_number(F.col(raw), dict(upload.dtypes)[raw])).alias(SURVEY_TOP))
    return upload.crossJoin(F.broadcast(top))


def derived_feature(upload: DataFrame, target: str, raw: str, as_of: str) -> Column:
    """A derived feature over a frame from ``with_survey_top``."""
    value = derived_column(target, F.col(raw), as_of, dict(upload.dtypes)[raw])
    if target != "JobSatisfaction":
        return value
    top = F.col(SURVEY_TOP)
    return F.when(top > 4, F.bround(value / top * F.lit(3.0) + F.lit(1.0), 0)).otherwise(value)


def harmonize(upload: DataFrame, plan: Plan, as_of: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rename mapped columns to standard names and add derived features, keeping only the
    standard features (plus ``_id`` and ``_label`` roles when present, and ``keep``). The
    survey rescale needs the column maximum: a one-row aggregate inside the same plan."""
    cols: list[Column] = [F.col(c) for c in keep]
    if plan.id_col:
        cols.append(F.col(plan.id_col).cast("string").alias("_id"))
    if plan.label:
        cols.append(F.col(plan.label).cast("string").alias("_label"))
    for raw, target in plan.mapped.items():
        cols.append(F.col(raw).alias(target))
    for target, raw in plan.derived.items():
        cols.append(derived_feature(upload, target, raw, as_of).alias(target))
    return with_survey_top(upload, plan).select(*cols)


@dataclass
class Imputation:
    feature: str
    method: str
    value: object


def fill_value(feature: str, is_text: bool, medians: dict[str, float | None] | None, modes: dict[str, str] | None) -> tuple[object, str]:
    """What fills a feature and where it comes from: text columns take the most frequent
    training category, others the training median; without either, the default or 0."""
    if is_text and modes and modes.get(feature) is not None:
        return modes[feature], C.FILLED_BY_MODE
    if not is_text and medians and medians.get(feature) is not None:
        return medians[feature], C.FILLED_BY_MEDIAN
    return C.INTELLIGENT_DEFAULTS.get(feature, 0), C.FILLED_BY_DEFAULT


def impute(
    harmonized: DataFrame,
    medians: dict[str, float | None] | None,
    features: Sequence[str] = C.STANDARD_FEATURES,
    modes: dict[str, str] | None = None,
):
    """Absent or all-null feature -> constant; partly null -> filled with the same value (see
    ``fill_value``; an absent feature with training categories counts as text). Returns
    (frame, [Imputation])."""
    types = dict(harmonized.dtypes)
    present = [f for f in features if f in harmonized.columns]
    counts = {}
    if present:
        row = harmonized.agg(
            F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(f)).alias(f) for f in present]
        ).collect()[0]
        counts = {f: (row[f], row["__rows"]) for f in present}
    out = [F.col(c) for c in harmonized.columns if c not in features]
    report = []
    for f in features:
        is_text = types[f] == "string" if f in types else bool(modes and f in modes)
        value, kind = fill_value(f, is_text, medians, modes)
        if f not in counts or counts[f][0] == 0:
            out.append(F.lit(value).alias(f))
            report.append(Imputation(f, f"{kind} ({value})", value))
        elif counts[f][0] < counts[f][1]:
            col = F.col(f)
            fill = F.lit(value)
            if isinstance(value, str) or dict(harmonized.dtypes)[f] == "string":
                col, fill = col.cast("string"), fill.cast("string")
            out.append(F.coalesce(col, fill).alias(f))
            report.append(Imputation(f, f"{kind} for subset ({value})", value))
        else:
            out.append(F.col(f))
    return harmonized.select(*out), report


def align(frame: DataFrame, features: Sequence[str] = C.STANDARD_FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    """Select and order exactly the model features (features as double)."""
    missing = [f for f in features if f not in frame.columns]
    if missing:
        raise ValueError(C.MISSING_COLUMNS_ERROR.format(", ".join(missing)))
    return frame.select(*[c for c in keep if c in frame.columns], *[F.col(f).cast("double").alias(f) for f in features])


def prepare_custom(
    upload: DataFrame,
    plan: Plan,
    dictionary: Dictionary,
    medians: dict[str, float] | None,
    as_of: str,
    modes: dict[str, str] | None = None,
):
    """Custom-layout path: harmonize -> impute -> lenient encode -> align, with the statistics
    both rules need (non-null counts, "column is all in-range codes") taken in ONE aggregate
    pass. Returns (model frame with _id/_label, imputation report)."""
    h = harmonize(upload, plan, as_of)
    features = C.STANDARD_FEATURES
    present = [f for f in features if f in h.columns]
    text = dict(h.dtypes)
    is_text = {f: text[f] == "string" if f in text else bool(modes and f in modes) for f in features}
    fill = {f: fill_value(f, is_text[f], medians, modes) for f in features}

    def filled(f):  # the imputed column (what the reference encodes)
        v = fill[f][0]
        if isinstance(v, str) or text[f] == "string":
            return F.coalesce(F.col(f).cast("string"), F.lit(v).cast("string"))
        return F.coalesce(F.col(f), F.lit(v))

    def number(x, f):
        return to_number(x, "string" if isinstance(fill[f][0], str) else text.get(f, "double"))

    def in_range(x, f):
        num = number(x, f)
        return num.isNotNull() & (num >= 0) & (num <= dictionary.size(f) - 1)

    aggs = [F.count(F.lit(1)).alias("__rows")]
    for f in present:
        aggs.append(F.count(F.col(f)).alias(f"{f}__n"))
        if f in dictionary:
            aggs.append(F.coalesce(F.bool_and(in_range(filled(f), f)), F.lit(True)).alias(f"{f}__codes"))
    stats = h.agg(*aggs).collect()[0].asDict()

    report, cols = [], [F.col(c) for c in ("_id", "_label") if c in h.columns]
    need_join = []
    for f in features:
        v, kind = fill[f]
        n = stats.get(f"{f}__n", 0) if f in present else 0
        if n == 0:
            report.append(Imputation(f, f"{kind} ({v})", v))
            x = F.lit(v)
            codes = f in dictionary and (isinstance(v, (int, float)) and 0 <= v <= dictionary.size(f) - 1)
        else:
            if n < stats["__rows"]:
                report.append(Imputation(f, f"{kind} for subset ({v})", v))
                x = filled(f)
            else:
                x = F.col(f)
            codes = stats.get(f"{f}__codes", False)
        if f in dictionary:
            if codes:
                expr = number(x, f).cast("int")
            else:
                need_join.append(f)
                expr = F.coalesce(dictionary.code(f), F.lit(0))
                h = h.withColumn(f, x)
        else:
            expr = F.coalesce(number(x, f), F.lit(0.0))
        cols.append(expr.cast("double").alias(f))
    h = dictionary.join_codes(h, need_join)
    return h.select(*cols), report


def display_frame(upload: DataFrame, plan: Plan, as_of: str, id_expr: Column) -> DataFrame:
    """P10: the upload as shown to people: raw columns (display targets renamed), the
    resolved EmployeeNumber, every default-bearing feature that is not present (derived
    value if derived, else the default), all rendered as text with nulls shown as "-"."""
    renames = {raw: t for raw, t in plan.mapped.items() if t in C.DISPLAY_RENAMED}
    cols: list[tuple[str, Column]] = [(renames.get(c, c), F.col(c)) for c in upload.columns]
    names = [n for n, _ in cols]
    if C.ID_ROLE not in names:
        cols.append((C.ID_ROLE, id_expr))
        names.append(C.ID_ROLE)
    for key, default in C.INTELLIGENT_DEFAULTS.items():
        if key in names:
            continue
        if key in plan.derived:
            expr = derived_feature(upload, key, plan.derived[key], as_of)
        else:
            expr = F.lit(default)
        cols.append((key, expr))
        names.append(key)
    return with_survey_top(upload, plan).select(*[F.coalesce(e.cast("string"), F.lit("-")).alias(n) for n, e in cols])
