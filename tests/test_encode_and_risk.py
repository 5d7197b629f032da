"""Encoding rules, imputation edge cases and risk thresholds."""

import pytest
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.functions.expressions import predicted_outcome, risk_bucket
from riskloom.operators import encode as EN
from riskloom.operators import prepare as PP


@pytest.fixture()
def dictionary(spark):
    df = spark.createDataFrame([("Yes", "Sales"), ("No", "HR"), ("No", "Sales")], "OverTime string, Department string")
    return EN.Dictionary.fit(df, ["OverTime", "Department"])


def test_dictionary_codes_are_sorted_positions(dictionary):
    rows = sorted((r.feature, r.code, r.category) for r in dictionary.table.collect())
    assert rows == [("Department", 0, "HR"), ("Department", 1, "Sales"), ("OverTime", 0, "No"), ("OverTime", 1, "Yes")]
    assert dictionary.sizes == {"OverTime": 2, "Department": 2}


def test_lenient_unseen_to_first_class_and_numeric_codes(spark, dictionary):
    df = spark.createDataFrame([("Yes", "IT", "7"), ("No", "Sales", "x")], "OverTime string, Department string, Age string")
    out = EN.encode_lenient(df, dictionary).collect()
    assert [(r.OverTime, r.Department, r.Age) for r in out] == [(1, 0, 7.0), (0, 1, 0.0)]
    codes = spark.createDataFrame([("1",), ("0",)], "OverTime string")
    assert [r.OverTime for r in EN.encode_lenient(codes, dictionary).collect()] == [1, 0]


def test_strict_unknown_categories_raise(spark, dictionary):
    df = spark.createDataFrame([("Maybe",), ("Yes",), ("Perhaps",)], "OverTime string")
    with pytest.raises(ValueError, match="Maybe, Perhaps"):
        EN.encode_strict(df, dictionary, ["OverTime"])


def test_many_categories_are_joined(spark):
    df = spark.range(3000).select(F.format_string("c%05d", "id").alias("x"), F.col("id"))
    d = EN.Dictionary.fit(df, ["x"])
    assert d.size("x") == 3000
    assert EN.encode_lenient(df, d, ["x"]).where("x != id").count() == 0


def test_large_dictionaries_in_one_shuffle(spark):
    """Eight columns too large to broadcast: codes as by a join each, rows and their order of
    columns kept, the rows moved twice in all."""
    cols = [f"t{i}" for i in range(8)]
    df = spark.range(2000).select(
        "id", F.lit(None).cast("string").alias("empty"), F.struct("id").alias("nested"),
        *[F.when(F.col("id") % (i + 7) != 0, F.concat(F.lit("v"), (F.col("id") * (i + 3) % (50 * i + 9)).cast("string"))).alias(c) for i, c in enumerate(cols)],
    )
    d = EN.Dictionary.fit(df.where("id % 3 != 0"), cols)
    twice = df.unionByName(df.where("id < 50"))
    one, each = d.join_codes(twice, cols, broadcast_up_to=0), d.join_codes(twice, cols)
    assert one.columns == each.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, each.collect()))
    assert d.join_codes(twice.limit(0), cols, broadcast_up_to=0).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = d.join_codes(twice, cols, broadcast_up_to=0)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3  # rows to the join, rows back, and the dictionary
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_text_is_filled_by_mode(spark):
    df = spark.createDataFrame([("Male", 1.0), ("Male", None), ("Female", 2.0), (None, 3.0)], "Gender string, Age double")
    modes = EN.training_modes(spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "Gender string"), ["Gender"])
    assert modes == {"Gender": "a"}
    out, report = PP.impute(df, {"Gender": 1.0, "Age": 9.0}, ["Gender", "Age"], {"Gender": "Male"})
    assert [(r.Gender, r.Age) for r in out.collect()] == [("Male", 1.0), ("Male", 9.0), ("Female", 2.0), ("Male", 3.0)]
    assert [i.method for i in report] == ["training mode for subset (Male)", "training median for subset (9.0)"]


@pytest.mark.parametrize(
    "text, expected",
    [("2020-01-05T10:00:00", "2020-01-05 10:00:00"), ("Jan 5, 2020", "2020-01-05 00:00:00"), ("5-Jan-2020", "2020-01-05 00:00:00"), ("2020-1-5", "2020-01-05 00:00:00"),
     ("1/5/2020", "2020-01-05 00:00:00"), ("2020-01-05 10:00", "2020-01-05 10:00:00"), ("25/12/2020", "2020-12-25 00:00:00"), ("20200105", "2020-01-05 00:00:00"),
     ("1/5/2020 1:05 PM", "2020-01-05 13:05:00"), ("5 january 2020", "2020-01-05 00:00:00"), ("soon", None), ("2020-13-01", None), ("", None), (None, None)],
)
def test_dates(spark, text, expected):
    from riskloom.functions.expressions import to_timestamp_lenient

    got = spark.createDataFrame([(text,)], "t string").select(to_timestamp_lenient(F.col("t")).cast("string")).first()[0]
    assert got == expected


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="DailyRate"):
        PP.align(spark.createDataFrame([(1.0,)], "Age double"), ["Age", "DailyRate"])


def test_impute_absent_all_null_partial(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "Age double, DailyRate double")
    out, report = PP.impute(df, {"Age": 30.0, "DailyRate": 2.0, "Education": 3.0}, ["Age", "DailyRate", "Education", "Gender"])
    rows = out.collect()
    assert [(r.Age, r.DailyRate, r.Education, r.Gender) for r in rows] == [(30.0, 1.0, 3.0, "Male"), (30.0, 2.0, 3.0, "Male")]
    methods = {i.feature: i.method for i in report}
    assert methods["Age"].startswith("training median (") and "subset" in methods["DailyRate"]
    assert methods["Gender"] == "intelligent default (Male)"


def test_empty_frame_profile(spark):
    from riskloom.operators.profile import shape_and_missing

    df = spark.createDataFrame([], "a int, b string")
    assert shape_and_missing(df) == {"rows": 0, "columns": 2, "missing": 0, "missing_pct": 0.0}


@pytest.mark.parametrize(
    "p,bucket,outcome",
    [(0.0, C.LOW_RISK, C.LIKELY_STAY), (0.30, C.LOW_RISK, C.LIKELY_STAY), (0.3000001, C.MEDIUM_RISK, C.LIKELY_STAY),
     (0.50, C.MEDIUM_RISK, C.LIKELY_STAY), (0.5000001, C.MEDIUM_RISK, C.LIKELY_LEAVE), (0.70, C.MEDIUM_RISK, C.LIKELY_LEAVE),
     (0.7000001, C.HIGH_RISK, C.LIKELY_LEAVE), (None, None, C.LIKELY_STAY)],
)
def test_risk_boundaries(spark, p, bucket, outcome):
    df = spark.createDataFrame([(p,)], "p double")
    r = df.select(risk_bucket(F.col("p")).alias("b"), predicted_outcome(F.col("p")).alias("o")).first()
    assert (r.b, r.o) == (bucket, outcome)


def test_search_fast_path_equals_joined_text(spark):
    from riskloom.operators.views import row_text, search_predicate

    df = spark.createDataFrame(
        [(1, "Sales Rep", 1.5e7, None), (2, "x", 0.25, "nan"), (3, "abc", -3.0, "2-HIGH")],
        "id int, a string, v double, s string",
    )
    for term in ["sales", "1.5e7", "rep 1", "0.25", "-3", "nan", "2-high", "zz", "e", "3 2", "abc -3.0"]:
        fast = sorted(r.id for r in df.where(search_predicate(df, term)).collect())
        full = sorted(r.id for r in df.where(F.contains(row_text(df), F.lit(term.strip().lower()))).collect())
        assert fast == full, term
