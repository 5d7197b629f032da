"""Per-row outputs computed in bulk: recommendations, profile shape, drivers, reports,
risk assessments and what-if scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.functions.expressions import percent_text, risk_bucket, signed_text, slug, to_number

_OPS = {"==": lambda a, b: a == b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def recommendations(df: DataFrame) -> Column:
    """Retention messages whose rule fires; absent columns skip their rule."""
    msgs = [
        F.when(_OPS[op](F.col(feat), F.lit(val)), F.lit(text))
        for feat, op, val, text in C.RECOMMENDATION_RULES
        if feat in df.columns
    ]
    if not msgs:
        return F.array().cast("array<string>")
    return F.filter(F.array(*msgs), lambda x: x.isNotNull())


def recommendation_text(df: DataFrame) -> Column:
    recs = recommendations(df)
    return F.when(F.size(recs) > 0, F.array_join(recs, "\n")).otherwise(F.lit(C.NO_CONCERNS))


def profile_shape(df: DataFrame) -> list[Column]:
    """C20: the satisfaction / performance fields, null or text -> 0, divided by 4 (radar data).
    Returns no columns when fewer than 3 fields are present."""
    fields = [f for f in C.PROFILE_SHAPE_FIELDS if f in df.columns]
    if len(fields) < C.PROFILE_SHAPE_MIN_FIELDS:
        return []
    return [
        (F.coalesce(to_number(F.col(f)), F.lit(0.0)) / F.lit(C.PROFILE_SHAPE_SCALE)).alias(f"{f}_shape") for f in fields
    ]


def direction(phi: Column, up: str, down: str) -> Column:
    """C14: > 0 increases, otherwise decreases."""
    return F.when(phi > 0, F.lit(up)).otherwise(F.lit(down))


def driver_line(feature: Column, value: Column, phi: Column) -> Column:
    """M11: "Feature = value increases flight risk (impact: +0.1234)"."""
    return F.concat(
        feature, F.lit(" = "), F.coalesce(value, F.lit("")), F.lit(" "),
        direction(phi, C.FLIGHT_RISK_UP, C.FLIGHT_RISK_DOWN),
        F.lit(" (impact: "), signed_text(phi + F.lit(0.0)), F.lit(")"),
    )


def report_text(label: Column, risk: Column, drivers: Column, k: int, title: str = C.REPORT_EMPLOYEE_TITLE) -> Column:
    """The downloadable per-employee report (lines joined by newline) under either title.

    ``drivers`` is an array of struct(feature, phi) in rank order with ``k`` entries."""
    lines = [
        F.concat(F.lit(title), label),
        F.concat(F.lit(C.REPORT_CATEGORY), risk_bucket(risk)),
        F.concat(F.lit(C.REPORT_LEAVING), percent_text(risk)),
        F.concat(F.lit(C.REPORT_STAYING), percent_text(F.lit(1.0) - risk)),
        F.lit(""),
        F.lit(C.REPORT_DRIVERS),
    ]
    for j in range(k):
        d = drivers[j]
        lines.append(F.concat(F.lit("- "), d["feature"], F.lit(": "), signed_text(d["phi"])))
    return F.concat_ws("\n", *lines)


def report_file_name(label: Column) -> Column:
    """C22: "<label slug>_risk_report.txt"."""
    return F.concat(slug(label), F.lit("_risk_report.txt"))


def factor_texts(drivers: Column, k: int) -> Column:
    """C15: "Feature (increases risk)" for each of the ``k`` driver structs (feature, phi)."""
    return F.array(
        *[
            F.concat(drivers[j]["feature"], F.lit(" ("), direction(drivers[j]["phi"], "increases", "decreases"), F.lit(" risk)"))
            for j in range(k)
        ]
    )


def sparse_to_full(records: DataFrame, features: Sequence[str], id_col: str = "id") -> DataFrame:
    """Absent features -> 0, present nulls -> 0; model order."""
    cols = [F.col(id_col)]
    for f in features:
        if f in records.columns:
            cols.append(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f))
        else:
            cols.append(F.lit(0.0).alias(f))
    return records.select(*cols)


def apply_scenarios(frame: DataFrame, scenarios: Sequence[dict], features: Sequence[str]) -> DataFrame:
    """Each row once per scenario with the scenario's non-null overrides applied.

    Scenarios are a short, fixed list of parameters: they become one literal array that
    is exploded per row (a bounded fan-out, no join)."""
    keys = [k for k in scenarios[0] if k != "scenario"] if scenarios else []
    arr = F.array(
        *[
            F.struct(
                F.lit(s["scenario"]).alias("scenario"),
                *[F.lit(s.get(k)).cast("double").alias(k) for k in keys],
            )
            for s in scenarios
        ]
    )
    exploded = frame.withColumn("_s", F.explode(arr))
    cols = [F.col(c) for c in frame.columns if c not in features]
    cols.append(F.col("_s.scenario").alias("scenario"))
    for f in features:
        if f in keys:
            cols.append(F.coalesce(F.col(f"_s.{f}"), F.col(f)).alias(f))
        else:
            cols.append(F.col(f))
    return exploded.select(*cols)
