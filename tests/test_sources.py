"""CSV as pandas writes and reads it, reports in text files, and the shared folder."""

import pandas as pd
import pytest

from riskloom import session
from riskloom.sources import tables as TB


def test_csv_of_pandas(spark, tmp_path):
    frame = pd.DataFrame({"name": ['a "q" b', "two\nlines", "NA", "x,y", ""], "age": [1, 2, None, 4, 5], "day": ["2020-01-05", None, "2020-02-01", "2020-03-01", "2020-04-01"]})
    frame.to_csv(tmp_path / "p.csv", index=False)
    got = TB.scan_csv(spark, str(tmp_path / "p.csv"))
    back = pd.read_csv(tmp_path / "p.csv")
    assert dict(got.dtypes) == {"name": "string", "age": "double", "day": "date"}
    rows = got.collect()
    assert [r.name for r in rows] == [None if pd.isna(x) else x for x in back["name"]]
    assert [r.age for r in rows] == [None if pd.isna(x) else x for x in back["age"]]


def test_records_of_another_width_are_counted(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a,b\n1,2\n3\n4,5,6\n7,8\n")
    path = str(tmp_path / "c.csv")
    assert TB.csv_rejects(spark, path).first().asDict() == {"records": 4, "rejected": 2}
    kept = [(r.a, r.b) for r in TB.scan_csv(spark, path, keep_corrupt=True).where(f"{TB.CORRUPT} is null").collect()]
    assert kept == [(1, 2), (7, 8)]


def test_written_csv_comes_back(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a "b" \n c,', 0.1), (2, None, None), (3, "x", 1e300)], "i long, t string, d double")
    TB.write_csv(df, str(tmp_path / "w"))
    assert sorted(map(tuple, TB.scan_csv(spark, str(tmp_path / "w"), df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_reports_stay_whole(spark, tmp_path):
    df = spark.createDataFrame([("one\ntwo",), ("three\n\nfour",)], "r string")
    TB.write_text(df, "r", str(tmp_path / "t"))
    assert sorted(r.value for r in TB.read_text(spark, str(tmp_path / "t")).collect()) == ["one\ntwo", "three\n\nfour"]


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_filters_reach_the_scan(spark):
    from riskloom.plans.queries import QUERIES
    from tests.conftest import SF_SMALL

    for name in ("filter_employees", "filtered_view"):
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(c_mktsegment,BUILDING)" in plan
        assert plan.count("orders.parquet") <= 1


def test_texts_that_cannot_be_numbers_are_not_cast(spark):
    """Each failed cast costs an exception; what may be a number is cast as before."""
    from pyspark.sql import functions as F

    numbers = ["1", " 7 ", "+5", "-0", "\t12\n", "007", "9223372036854775807", "\x001", "1\x7f", "1.0", "1.5", ".5", "-.5e3", "1.", "1e5", "1.e-3", "1d", "2F", "0x1p3", "-0X1.8P1", "inf", "-Infinity", "+INF", "NaN", "nan"]
    words = ["", " ", "+", "-", ".", "Male", "1-URGENT", "2024-01-05", "Infant", "Nan1", "1 2", "1,5", "e5", "Non-Travel", "9223372036854775808", "1_0", "٣", " 1", "d"]
    df = spark.createDataFrame([(x,) for x in [*numbers, *words, None]], "t string")
    for kind in ("tinyint", "smallint", "int", "bigint", "double", "date"):
        both = df.select("t", F.col("t").try_cast(kind).alias("own"), TB._try_cast(F.col("t"), kind).alias("got"))
        assert [r.t for r in both.where("own IS DISTINCT FROM got").collect()] == [], kind
    left_out = [r.t for r in df.where(~F.col("t").rlike(TB.MAYBE_WHOLE) & ~F.col("t").rlike(TB.MAYBE_DOUBLE)).collect()]
    assert {"Male", "1-URGENT", "2024-01-05", "Non-Travel", ""} <= set(left_out)
    kinds = spark.createDataFrame([("1", "1.5", "2024-01-05", "x", None, "1"), ("2", None, None, "2", None, "y")], "a string, b string, c string, d string, e string, `f.g` string")
    assert [f.dataType.simpleString() for f in TB.csv_types(kinds)] == ["bigint", "double", "date", "string", "string", "string"]
