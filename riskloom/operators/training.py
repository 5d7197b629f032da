"""Model training with Spark ML: exact stratified split, random forest, evaluation,
importance and persistence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import PipelineSharedReadWrite
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.operators.stats import running_total


def stratified_split(
    frame: DataFrame, label: str, id_col: str = "id", test_share: float = C.TEST_SHARE, seed: int = C.SEED
) -> DataFrame:
    """Adds ``split`` ('train' / 'test'): within each label class, rows are ordered by a seeded
    hash of the id and the first ceil(share x class size) go to test — an exact per-class
    share, reproducible and distributed.

    Only the narrow key table (label, hash, id) is ranked (range-partitioned running totals,
    so a class holding most rows is still spread over all tasks); that yields one threshold
    key per class, broadcast (bounded by the number of classes) and compared row by row —
    the wide frame itself is never shuffled."""
    key = F.struct(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))).alias("h"), F.col(id_col).alias("i"))
    keys = frame.select(F.col(label).alias("_label"), key.alias("_key")).withColumn("_w", F.lit(1).cast("bigint"))
    ranked = running_total(keys, "_key", "_w", ["_label"], out="_pos", total_out="_n")
    # decimal arithmetic: 15 x 0.2 must be exactly 3, not 3.0000000000000004 -> 4
    n_test = F.ceil(F.col("_n").cast("decimal(38,0)") * F.lit(str(test_share)).cast("decimal(10,6)"))
    thresholds = ranked.where(F.col("_pos") == n_test).select("_label", F.col("_key").alias("_threshold"))
    tagged = frame.withColumn("_label", F.col(label)).withColumn("_key", key)
    joined = tagged.join(F.broadcast(thresholds), tagged["_label"].eqNullSafe(thresholds["_label"]), "left")
    is_test = F.coalesce(F.col("_key") <= F.col("_threshold"), F.lit(False))
    return joined.select(
        *[tagged[c] for c in frame.columns], F.when(is_test, F.lit("test")).otherwise(F.lit("train")).alias("split")
    )


def forest_pipeline(
    features: Sequence[str],
    label: str = C.LABEL,
    num_trees: int = C.NUM_TREES,
    max_depth: int = 8,
    seed: int = C.SEED,
) -> Pipeline:
    """VectorAssembler -> RandomForestClassifier (sqrt feature subsets, bootstrap, gini).
    Features stay continuous, so every split is a threshold (contributions stay exact). Trees
    may be as deep as Spark allows, 30: the rows' place in each tree is kept and written to
    the checkpoint folder now and then, so a level needs neither the whole tree shipped, nor
    each row walked down from the root, nor all levels before it recomputed after a loss."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol=label,
        numTrees=num_trees,
        maxDepth=max_depth,
        seed=seed,
        featureSubsetStrategy="sqrt",
        impurity="gini",
        cacheNodeIds=True,
        checkpointInterval=10,
    )
    return Pipeline(stages=[assembler, forest])


def leave_probability(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("p_leave", vector_to_array(F.col("probability"))[1])


def evaluate(predictions: DataFrame, label: str = C.LABEL) -> DataFrame:
    """Accuracy and size of the evaluated set (one aggregate)."""
    return predictions.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((F.col("prediction") == F.col(label).cast("double")).cast("double")).alias("accuracy"),
    )


def confusion_counts(pairs: DataFrame) -> DataFrame:
    """One row (tn, fp, fn, tp) of (label, pred), each 0 or 1."""
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return pairs.agg(*[F.count_if((F.col("label") == y) & (F.col("pred") == p)).alias(c) for c, (y, p) in cells.items()])


def class_report(pairs: DataFrame) -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted averages of
    (label, pred), from one aggregate pass (four confusion counts)."""

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    p0, r0 = ratio(tn, tn + fn), ratio(tn, tn + fp)
    p1, r1 = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f0, f1 = ratio(2 * p0 * r0, p0 + r0), ratio(2 * p1 * r1, p1 + r1)
    s0, s1 = tn + fp, fn + tp
    n = s0 + s1
    acc = ratio(tn + tp, n)

    def row(name, p, r, f, sup):
        return F.struct(
            F.lit(name).alias("class"), p.cast("double").alias("precision"), r.cast("double").alias("recall"),
            f.cast("double").alias("f1_score"), sup.alias("support"),
        )

    none = F.lit(None).cast("double")
    rows = F.array(
        row("Stayed", p0, r0, f0, s0),
        row("Left", p1, r1, f1, s1),
        row("accuracy", none, none, acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", ratio(p0 * s0 + p1 * s1, n), ratio(r0 * s0 + r1 * s1, n), ratio(f0 * s0 + f1 * s1, n), n),
    )
    return confusion_counts(pairs).select(F.explode(rows).alias("r")).select(
        F.col("r.class").alias("class"),
        F.round("r.precision", 9).alias("precision"),
        F.round("r.recall", 9).alias("recall"),
        F.round("r.f1_score", 9).alias("f1_score"),
        F.col("r.support").cast("bigint").alias("support"),
    )


def saved_stage(model: PipelineModel, path: str, stage: int) -> str:
    """Where ``model.write().save(path)`` puts one of the model's stages."""
    return PipelineSharedReadWrite.getStagePath(model.stages[stage].uid, stage, len(model.stages), f"{path}/stages")


def save_and_reload(model: PipelineModel, path: str) -> PipelineModel:
    model.write().overwrite().save(path)
    return PipelineModel.load(path)
