"""Exact stratified split against brute force; trained forest contributions close to Spark."""

import math

import pandas as pd
from pyspark.sql import functions as F

from riskloom.operators.encode import model_frame
from riskloom.operators.training import stratified_split


def test_split_takes_smallest_hash_keys_per_class(spark):
    pdf = pd.DataFrame({"id": range(2500), "y": [1 if i % 3 == 0 else (None if i % 97 == 0 else 0) for i in range(2500)]})
    df = spark.createDataFrame(pdf, "id long, y int")
    out = stratified_split(df, "y").withColumn("h", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("42")))).toPandas()
    assert len(out) == len(pdf) and out["id"].is_unique
    for cls, g in out.groupby(out["y"].fillna(-1)):
        k = math.ceil(len(g) * 0.2)
        expected = set(g.sort_values(["h", "id"]).head(k)["id"])
        assert set(g[g.split == "test"]["id"]) == expected, cls


def test_reloaded_model_agrees_and_contributions_close(spark):
    import numpy as np
    from pyspark.ml import PipelineModel

    from riskloom.operators.forest import TreeEnsemble
    from riskloom.operators.training import forest_pipeline, leave_probability
    from riskloom.session import shared_path

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.2)).astype(int)
    rows = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int")
    model = forest_pipeline(["a", "b", "c"], "y", num_trees=8, max_depth=12).fit(df)
    path = shared_path(spark, "t-forest")
    model.write().save(path)
    scored = leave_probability(model.transform(df)).select("id", "a", "b", "c", "p_leave")
    again = leave_probability(PipelineModel.load(path).transform(df)).select("id", "p_leave")
    assert scored.select("id", "p_leave").exceptAll(again).count() == 0
    ens = TreeEnsemble.from_spark_model(spark, model.stages[-1], ["a", "b", "c"], path + "-trees")
    for r in ens.explain(scored, "id", carry=["p_leave"]).collect():
        assert abs(r.base + sum(r.phi) - r.p_leave) < 1e-9


def test_importance_equals_sparks_own(spark):
    """From the written node table, for shallow and deep trees."""
    import numpy as np

    from riskloom.operators.forest import TreeEnsemble, impurity_importance, saved_nodes
    from riskloom.operators.training import forest_pipeline, leave_probability
    from riskloom.session import ensure_checkpoint_dir, shared_path

    ensure_checkpoint_dir(spark)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=600) * 0.7 > 0).astype(int)
    names = list("abcde")
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, e double, y int")
    for depth in (3, 20):
        model = forest_pipeline(names, "y", num_trees=10, max_depth=depth).fit(df)
        path = shared_path(spark, "t-importance")
        ens = TreeEnsemble.from_spark_model(spark, model.stages[-1], names, path)
        got = {r.feature: r.importance for r in impurity_importance(saved_nodes(spark, path, names)).collect()}
        for name, own in zip(names, model.stages[-1].featureImportances.toArray()):
            assert abs(got.get(name, 0.0) - own) < 1e-9
        scored = leave_probability(model.transform(df)).withColumn("own", ens.predict_column([F.col(c) for c in names]))
        assert scored.where("abs(own - p_leave) > 1e-9").count() == 0
        assert max(len(w.levels) for w in ens.walks()) > (8 if depth == 20 else 2)
        for r in ens.explain(scored, "id", carry=["p_leave"]).limit(50).collect():
            assert abs(r.base + sum(r.phi) - r.p_leave) < 1e-9


def test_importance_without_gain(spark):
    from riskloom.operators.forest import impurity_importance

    nodes = [(0, 0, "a", 1, 2, 4.0, 2.0), (0, 1, None, -1, -1, 2.0, 1.0), (0, 2, None, -1, -1, 2.0, 1.0), (1, 0, "b", 1, 2, 4.0, 2.0), (1, 1, None, -1, -1, 2.0, 2.0), (1, 2, None, -1, -1, 2.0, 0.0)]
    got = impurity_importance(spark.createDataFrame(nodes, "tree int, node int, feature string, left int, right int, weight double, positives double"))
    assert [(r.feature, r.importance) for r in got.collect()] == [("b", 1.0)]


def test_trees_of_any_depth_keep_the_places_of_rows(spark):
    """The same trees as by walking every row from the root, which takes longer a level."""
    import numpy as np

    from riskloom.operators.training import forest_pipeline
    from riskloom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    x = np.random.default_rng(3).normal(size=(300, 3))
    df = spark.createDataFrame([(*map(float, r), int(r[0] + r[1] > 0)) for r in x], "a double, b double, c double, y int").repartition(2).cache()
    pipeline = forest_pipeline(["a", "b", "c"], "y", num_trees=5, max_depth=4)
    forest = pipeline.getStages()[-1]
    assert forest.getCacheNodeIds()
    kept = pipeline.fit(df).stages[-1].toDebugString
    forest.setCacheNodeIds(False)
    assert kept.split("\n", 1)[1] == pipeline.fit(df).stages[-1].toDebugString.split("\n", 1)[1]


def test_a_forest_is_read_from_the_saved_pipeline(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from riskloom.operators.forest import TreeEnsemble
    from riskloom.operators.training import forest_pipeline, saved_stage
    from riskloom.session import ensure_checkpoint_dir, shared_path

    ensure_checkpoint_dir(spark)
    x = np.random.default_rng(5).normal(size=(300, 2))
    df = spark.createDataFrame([(*map(float, r), int(r[0] * r[1] > 0)) for r in x], "a double, b double, y int")
    model = forest_pipeline(["a", "b"], "y", num_trees=4, max_depth=5).fit(df)
    path = shared_path(spark, "t-pipeline")
    model.write().save(path)
    ens = TreeEnsemble.from_saved_model(spark, ["a", "b"], saved_stage(model, path, 1))
    for tree, own in zip(ens.trees, model.stages[-1].trees):
        assert len(tree.feature) == own.numNodes and np.array_equal(tree.feature < 0, tree.left < 0) and np.array_equal(np.isnan(tree.value), tree.feature >= 0)
    assert ens.depth() == max(t.depth for t in model.stages[-1].trees) == max(len(w.levels) for w in ens.walks())
    got = np.array([model.stages[-1].predictProbability(Vectors.dense(v))[1] for v in x[:50]])
    assert np.abs(got - ens.predict_numpy(x[:50])).max() < 1e-12


def test_the_split_is_written_once_and_read_by_the_queries(spark):
    """Rows held out come from files of their own, equal to the split, without joins or ranks."""
    from riskloom.plans import workbench as W
    from tests.conftest import SF_SMALL

    b = W.Workbench.get(spark, SF_SMALL)
    rows = W.test_rows(b)
    assert W.kept_split(b) is W.kept_split(b)
    own = W.split_frame(b)
    assert W.kept_split(b).columns == own.columns
    assert W.kept_split(b).exceptAll(own).count() == 0 and own.exceptAll(W.kept_split(b)).count() == 0
    assert rows.where("split != 'test'").count() == 0 and rows.count() == own.where("split = 'test'").count()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" not in plan and "PartitionFilters: [isnotnull(split" in plan


def test_the_deep_forest_scores_in_more_than_one_task(spark):
    """However small the files: rows held out are dealt out to score, each once, and so are the
    orders that the frame to fit on is made from."""
    from riskloom.plans import queries as Q
    from riskloom.plans import workbench as W
    from tests.conftest import SF_SMALL

    b = W.Workbench.get(spark, SF_SMALL)
    scored, held_out = Q.score_deep_forest(spark, SF_SMALL), W.test_rows(b)
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scored.rdd.getNumPartitions() == asked > held_out.rdd.getNumPartitions()
    assert scored.select("id").exceptAll(held_out.select("id")).count() == 0 and scored.count() == held_out.count()
    assert scored.where("abs(spark_probability - score) > 1e-8").count() == 0
    assert "hashpartitioning(o_orderkey" in b.model_frame._jdf.queryExecution().executedPlan().toString()
    assert b.model_frame.exceptAll(model_frame(b.employees, b.dictionary)).count() == 0 and b.model_frame.count() == b.employees.count()


def test_the_check_of_the_deep_forest_scores_every_row_dealt_out(spark):
    from riskloom.plans import queries as Q
    from riskloom.plans import workbench as W
    from tests.conftest import SF_SMALL

    check = Q.score_deep_forest_check(spark, SF_SMALL)
    assert check._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(id") >= 1
    assert [tuple(r) for r in check.collect()] == [(W.test_rows(W.Workbench.get(spark, SF_SMALL)).count(), True, True)]


def test_no_more_tasks_to_fit_than_cores(spark):
    """Each task of a level makes statistics of all its nodes: where many shuffle partitions are
    asked for, a fit takes one a core, more where there are rows for more."""
    from riskloom.plans import workbench as W
    from riskloom.session import FEW_TASKS, TASK_ROWS, few_tasks
    from tests.conftest import SF_SMALL

    cores, asked = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    rows = W.test_rows(W.Workbench.get(spark, SF_SMALL))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "500")
        assert W.in_few_tasks(rows).rdd.getNumPartitions() == max(FEW_TASKS, cores) < 500
        assert few_tasks(spark, 40 * cores * TASK_ROWS + 1) == min(500, 40 * cores + 1)
        assert few_tasks(spark, 10_000 * TASK_ROWS) == 500
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert W.in_few_tasks(rows).rdd.getNumPartitions() == 3 and W.in_few_tasks(rows).exceptAll(rows).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", asked)
