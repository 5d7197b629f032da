"""Every registered query runs on the given tables; oracle queries equal DuckDB at sf0.01."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from tests.conftest import SF_ORACLE, SF_SMALL


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, pd.Timestamp) or hasattr(v, "isoformat"):
        s = str(v)
        return s[:10] if s.endswith("00:00:00") else s
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in E.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_ORACLE}/{t}.parquet')")
    return con


#: Filters that the smallest table may have no row for.
MAY_BE_EMPTY = {"filter_employees", "search_text"}

#: Queries that build a plan and nothing else once the assets are fitted.
PLAN_ONLY = [
    "scan_employees", "model_frame", "score_employees", "filter_employees", "filtered_view", "filter_or_all", "explain_all", "explain_topk",
    "risk_report_text", "assess_risk", "what_if", "preprocess_custom", "score_custom_upload", "harmonize", "derive_features", "fuzzy_column_map", "label_match_rate",
]


def test_building_a_query_starts_no_job(spark):
    for name in PLAN_ONLY:
        E.queries()[name](spark, SF_SMALL)  # fits what it needs
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in PLAN_ONLY:
            spark.sparkContext.setJobGroup(f"build {name}", name)
            E.queries()[name](spark, SF_SMALL)
            assert not spark.sparkContext.statusTracker().getJobIdsForGroup(f"build {name}"), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 30
    assert df.columns[0] == "EmployeeNumber" and "PredictedAttritionRisk" in df.columns


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_runs_small(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert len(set(df.columns)) == len(df.columns) > 0
    assert df.count() > 0 or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    got = E.queries()[name](spark, SF_ORACLE).toPandas()
    exp = duck.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert len(got) == len(exp)
    assert _rows(got) == _rows(exp)
