"""Distributed order statistics against pandas, including a key holding a third of all rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskloom.operators import stats


def skewed(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 500, n).astype(float)
    v[: n // 3] = 42.0  # hot key: a third of all rows
    v[rng.random(n) < 0.05] = np.nan
    g = rng.integers(0, 3, n)
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": v})
    return pdf, spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))


def test_exact_medians_match_pandas(spark):
    pdf, df = skewed(spark)
    df = df.withColumn("w", F.col("id") * 1.5).withColumn("none", F.lit(None).cast("double"))
    got = {r["feature"]: r["median"] for r in stats.exact_medians(df, ["v", "w", "none"]).collect()}
    assert got["v"] == pdf["v"].median()
    assert got["w"] == (pdf["id"] * 1.5).median()
    assert got["none"] is None


def test_cumulative_share_matches_rank(spark):
    pdf, df = skewed(spark)
    got = stats.cumulative_share(df, "v", out="cd").toPandas().set_index("id")["cd"]
    valid = pdf.dropna(subset=["v"])
    expected = valid["v"].rank(method="max") / len(valid)
    pd.testing.assert_series_equal(got.loc[valid["id"]].sort_index(), expected.set_axis(valid["id"]).sort_index(), check_names=False)
    assert got.loc[pdf[pdf.v.isna()].id].isna().all()


def test_grouped_running_total_and_positions(spark):
    pdf, df = skewed(spark)
    pos = stats.dense_positions(df, ["v", "id"], out="pos", group_cols=["g"]).toPandas()
    exp = pdf.sort_values(["g", "v", "id"], na_position="first").assign(pos=lambda d: d.groupby("g").cumcount() + 1)
    m = pos.merge(exp[["id", "pos"]], on="id", suffixes=("", "_exp"))
    assert (m["pos"] == m["pos_exp"]).all()
    assert len(m) == len(pdf)


def test_share_at_or_below_reference(spark):
    pdf, ref = skewed(spark)
    probes = spark.createDataFrame(pd.DataFrame({"pid": range(6), "r": [-1.0, 0.0, 42.0, 41.5, 499.0, 1000.0]}))
    got = stats.share_at_or_below(probes, "r", ref, "v", out="s").toPandas().set_index("pid")["s"]
    valid = pdf["v"].dropna()
    for pid, r in zip(range(6), [-1.0, 0.0, 42.0, 41.5, 499.0, 1000.0]):
        exp = (valid <= r).mean()
        assert (0.0 if np.isnan(got[pid]) else got[pid]) == exp


def test_approx_medians_opt_in_close_to_exact(spark):
    from riskloom.operators.encode import training_medians

    pdf, df = skewed(spark)
    df = df.withColumn("w", F.col("id") * 1.0)
    exact = training_medians(df, ["v", "w"])
    approx = training_medians(df, ["v", "w"], approx_accuracy=10000)
    assert exact["v"] == pdf["v"].median()
    for col, values in (("w", pdf["id"] * 1.0), ("v", pdf["v"].dropna())):
        # percentile_approx guarantees a rank error of at most n / accuracy
        n = len(values)
        lo, hi = (values < approx[col]).sum(), (values <= approx[col]).sum()
        assert lo - 1 <= n / 2 + n / 10000 and hi + 1 >= n / 2 - n / 10000


def test_running_total_over_many_small_partitions(spark):
    pdf, df = skewed(spark)
    df = df.withColumn("w", F.col("id") % 7)
    got = stats.running_total(df, "id", "w", ["g"], num_partitions=13).toPandas().sort_values("id")
    exp = pdf.assign(w=pdf["id"] % 7).sort_values("id")
    assert (got["cum_weight"].to_numpy() == exp.groupby("g")["w"].cumsum().to_numpy()).all()
    assert (got["group_total"].to_numpy() == exp.groupby("g")["w"].transform("sum").to_numpy()).all()


def test_running_total_shuffles_the_data_once(spark):
    _, df = skewed(spark)
    plan = stats.running_total(df.select("id", F.lit(1).alias("w")), "id", "w")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "rangepartitioning" not in plan  # the one exchange is behind the checkpoint


def test_all_quantiles_from_one_running_total(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from riskloom.operators.stats import interpolated, quantile_aggregates, running_total, value_counts

    rng = np.random.default_rng(3)
    rows = [(float(rng.integers(0, 9)) if rng.random() > 0.1 else None, float(rng.normal())) for _ in range(501)]
    df = spark.createDataFrame(rows, "a double, b double")
    shares = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    cum = running_total(value_counts(df, ["a", "b"]), "key", "n", ["feature"], out="_cum", total_out="_total")
    got = cum.groupBy("feature", "_total").agg(*quantile_aggregates(shares)).select("feature", *[interpolated(i, q).alias(f"q{i}") for i, q in enumerate(shares)])
    for r in got.collect():
        values = [x[0 if r.feature == "a" else 1] for x in rows]
        np.testing.assert_allclose(list(r)[1:], np.quantile([v for v in values if v is not None], shares), atol=1e-12)
