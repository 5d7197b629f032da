"""Fitted assets over one data directory: employees history, dictionary, medians, forest.

Fitting runs a few small distributed jobs (distinct categories, exact medians);
the results are model-sized and cached per (session, directory), like the
reference's cached model assets. Everything else is lazy DataFrames.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.functions.expressions import predicted_outcome, risk_bucket
from riskloom.operators.assets import keep_scored
from riskloom.operators.encode import Dictionary, fill_medians, model_frame, training_medians, training_modes
from riskloom.operators.forest import TreeEnsemble
from riskloom.sources import tables
from riskloom.sources.fixtures import FIXED_FOREST_NODES

_CACHE: dict[tuple, "Workbench"] = {}


def session_key(spark: SparkSession, sf_dir: str) -> tuple:
    """Cache key: the application (a restarted context never reuses cached plans), the
    session object and the data directory."""
    return (spark.sparkContext.applicationId, id(spark), sf_dir)

RISK = "PredictedAttritionRisk"


def fixed_forest() -> TreeEnsemble:
    return TreeEnsemble.from_node_rows(FIXED_FOREST_NODES, C.STANDARD_FEATURES)


class Workbench:
    def __init__(self, spark: SparkSession, sf_dir: str, ensemble: TreeEnsemble | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.ensemble = ensemble or fixed_forest()
        self._tables: dict[str, DataFrame] = {}
        self._fitted: dict = {}  # upload plans and statistics (small, driver-side)

    @classmethod
    def get(cls, spark: SparkSession, sf_dir: str) -> "Workbench":
        key = session_key(spark, sf_dir)
        if key not in _CACHE:
            _CACHE[key] = cls(spark, sf_dir)
        return _CACHE[key]

    # -- inputs -----------------------------------------------------------------

    # Analysed once and reused: a DataFrame is an immutable plan, so reuse costs nothing
    # and saves repeated driver-side analysis of the fixture projections.

    @cached_property
    def employees(self) -> DataFrame:
        return tables.employees(self.spark, self.sf_dir)

    @cached_property
    def workers(self) -> DataFrame:
        return tables.workers_custom(self.spark, self.sf_dir)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = tables.read_table(self.spark, self.sf_dir, name)
        return self._tables[name]

    # -- fitted assets ------------------------------------------------------------

    @cached_property
    def dictionary(self) -> Dictionary:
        return Dictionary.fit(self.employees, C.CATEGORICAL_FEATURES)

    @cached_property
    def model_frame(self) -> DataFrame:
        """id, 30 encoded features (nulls kept), Attrition 0/1: the frame that medians, split and
        fits are made from, much work a row, so its rows are dealt out anew."""
        return model_frame(tables.employees(self.spark, self.sf_dir, dealt=True), self.dictionary)

    @cached_property
    def medians(self) -> dict[str, float | None]:
        return training_medians(self.model_frame)

    @cached_property
    def modes(self) -> dict[str, str]:
        return training_modes(self.employees, C.CATEGORICAL_FEATURES)

    @cached_property
    def filled_frame(self) -> DataFrame:
        """Model frame with nulls replaced by training medians (features as double)."""
        return fill_medians(self.model_frame, self.medians)

    # -- scoring ----------------------------------------------------------------------

    def model_inputs(self, df: DataFrame) -> list[Column]:
        """Encoded, median-filled feature expressions over a standard-layout raw table that
        ``join_codes`` has given the codes wanted; a text feature without them is null, for
        trees that do not look at it."""
        cols = []
        for f in C.STANDARD_FEATURES:
            x = F.col(f"__code_{f}") if f"__code_{f}" in df.columns else F.lit(None) if f in self.dictionary else F.col(f)
            x = x.cast("double")
            m = self.medians.get(f)
            cols.append(F.coalesce(x, F.lit(float(m))) if m is not None else x)
        return cols

    def risk_expr(self, df: DataFrame) -> Column:
        return self.ensemble.score_expr(self.model_inputs(df))

    def score_frame(self, frame: DataFrame) -> Column:
        """Risk over an already encoded+filled frame."""
        return self.ensemble.score_expr([F.col(f) for f in self.ensemble.features])

    def kept_scored(self) -> tuple[DataFrame, bool]:
        """The scored history from the shared folder, and whether an earlier session (with the same
        files and model) had written it."""
        sources = [f"{self.sf_dir}/{t}.parquet" for t in ("orders", "customer", "nation", "region")]
        return keep_scored(self.spark, "scored-history", sources, self.ensemble, lambda: self.scored)

    @cached_property
    def scored(self) -> DataFrame:
        """History table + PredictedAttritionRisk, PredictedOutcome, RiskCategory (one projection)."""
        e = self.dictionary.join_codes(self.employees, self.ensemble.used_features())
        risk = self.risk_expr(e)
        out = e.select(*[F.col(c) for c in self.employees.columns], risk.alias(RISK))
        return with_risk_columns(out)


def register_views(wbench: Workbench) -> None:
    """SQL views ``employees``, ``scored`` and ``explanations`` of the session."""
    from riskloom.operators.forest import explanations_long

    wbench.employees.createOrReplaceTempView("employees")
    wbench.scored.createOrReplaceTempView("scored")
    explanations_long(explained_history(wbench), wbench.ensemble.features).createOrReplaceTempView("explanations")


def with_risk_columns(df: DataFrame, p: str = RISK) -> DataFrame:
    return df.withColumns(
        {"PredictedOutcome": predicted_outcome(F.col(p)), "RiskCategory": risk_bucket(F.col(p))}
    )


# --- custom-layout uploads ------------------------------------------------------------------

from riskloom.operators import mapping as MP  # noqa: E402
from riskloom.operators import prepare as PP  # noqa: E402
from riskloom.sources.fixtures import LAKE_CATALOG_SQL, OVERRIDE_TABLE_SQL, REPEATED_CATALOG_SQL, WORKERS_AS_OF, WORKERS_OVERRIDES  # noqa: E402

WORKERS = "workers_custom"


def lake_catalog(wbench: Workbench) -> DataFrame:
    """(dataset, col_name, col_ord) of a lake of datasets, read from a table."""
    return wbench.spark.sql(LAKE_CATALOG_SQL, part=wbench.table("part"))


def repeated_catalog(wbench: Workbench) -> DataFrame:
    """(dataset, col_name, col_ord) of a lake whose datasets repeat names."""
    return wbench.spark.sql(REPEATED_CATALOG_SQL, part=wbench.table("part"))


def override_table(wbench: Workbench) -> DataFrame:
    """(dataset, raw_col, target) for many datasets, read from a table."""
    return wbench.spark.sql(OVERRIDE_TABLE_SQL, part=wbench.table("part"))


def fixture_catalog(wbench: Workbench) -> DataFrame:
    """(dataset, col_name, col_ord) of the lake and of the two fixture layouts."""
    own = MP.catalog_of(wbench.spark, {"employees": wbench.employees, WORKERS: wbench.workers})
    return lake_catalog(wbench).unionByName(own)


def table_catalog(wbench: Workbench) -> DataFrame:
    """(dataset, col_name, col_ord) of the lake and of every given table."""
    return lake_catalog(wbench).unionByName(MP.catalog_of(wbench.spark, {t: wbench.table(t) for t in tables.TABLES}))


def workers_decisions(wbench: Workbench, with_overrides: bool) -> DataFrame:
    ov = MP.overrides_of(wbench.spark, WORKERS, WORKERS_OVERRIDES if with_overrides else None)
    cat = MP.catalog_of(wbench.spark, {WORKERS: wbench.workers})
    return MP.map_columns(cat, ov)


def workers_plan(wbench: Workbench, with_overrides: bool) -> PP.Plan:
    """Collected mapping decisions of the custom upload (one row per column), cached."""
    key = ("plan", with_overrides)
    if key not in wbench._fitted:
        wbench._fitted[key] = PP.Plan.from_decisions(
            workers_decisions(wbench, with_overrides), WORKERS, wbench.workers.columns
        )
    return wbench._fitted[key]


def workers_prepared(wbench: Workbench, with_overrides: bool = True):
    """Custom path on the fixture upload: (model frame with _id/_label, imputation report), cached."""
    key = ("prepared", with_overrides)
    if key not in wbench._fitted:
        plan = workers_plan(wbench, with_overrides)
        wbench._fitted[key] = PP.prepare_custom(wbench.workers, plan, wbench.dictionary, wbench.medians, WORKERS_AS_OF, wbench.modes)
    return wbench._fitted[key]


def explained_history(wbench: Workbench, carry_raw: bool = False) -> DataFrame:
    """(id, [__raw0..__raw29], score, base, phi, order) for every history row; the raw feature
    columns (their own types) ride along for the driver texts."""
    ens = wbench.ensemble
    e = wbench.dictionary.join_codes(wbench.employees, ens.used_features())
    inputs = wbench.model_inputs(e)
    cols = [F.col("EmployeeNumber").alias("id")]
    carry = []
    if carry_raw:
        carry = [f"__raw{i}" for i in range(len(C.STANDARD_FEATURES))]
        cols += [F.col(f).alias(r) for f, r in zip(C.STANDARD_FEATURES, carry)]
    frame = e.select(*cols, *[x.alias(f) for f, x in zip(C.STANDARD_FEATURES, inputs)])
    return ens.explain(frame, "id", ens.features, carry=carry)


def raw_value_text(wbench: Workbench, idx: Column) -> Column:
    """Text of feature ``idx`` (1-based) of the row's raw columns ``__raw*``; a missing raw
    value falls back to the value the model saw (the training median)."""
    out = None
    for i, f in enumerate(C.STANDARD_FEATURES):
        m = wbench.medians.get(f)
        fallback = F.lit(float(m)).cast("string") if m is not None else F.lit(None).cast("string")
        v = F.coalesce(F.col(f"__raw{i}").cast("string"), fallback)
        out = F.when(idx == i + 1, v) if out is None else out.when(idx == i + 1, v)
    return out


# --- trained forest -----------------------------------------------------------------------------

from riskloom.operators import training as TR  # noqa: E402
from riskloom.session import ensure_checkpoint_dir, few_tasks, shared_path  # noqa: E402

_TRAINED: dict[tuple, dict] = {}


def split_frame(wbench: Workbench) -> DataFrame:
    """Median-filled model frame with an exact stratified train/test split. The split is a
    deterministic function of a checkpointed input (the range-partitioned keys inside the
    running total), so train and test always see the same assignment, even after recomputation."""
    key = session_key(wbench.spark, wbench.sf_dir)
    state = _TRAINED.setdefault(key, {})
    if "split" not in state:
        state["split"] = TR.stratified_split(wbench.filled_frame, C.LABEL)
    return state["split"]


def kept_split(wbench: Workbench) -> DataFrame:
    """The split frame, written once a session: the fit and everything that scores the rows held
    out read numbers from files, by split and column, and join, encode and rank no row again."""
    state = _TRAINED.setdefault(session_key(wbench.spark, wbench.sf_dir), {})
    if "kept" not in state:
        split = split_frame(wbench)
        path = shared_path(wbench.spark, "split")
        split.write.partitionBy("split").parquet(path)
        state["kept"] = wbench.spark.read.schema(split.schema).parquet(path)
    return state["kept"]


def test_rows(wbench: Workbench) -> DataFrame:
    """The rows held out of the fit."""
    return kept_split(wbench).where(F.col("split") == "test")


def in_few_tasks(rows: DataFrame) -> DataFrame:
    """Rows of the kept split dealt by id over ``few_tasks`` partitions: at every level of a fit each
    task makes and sends statistics of all the level's nodes, and each task that scores gets the
    forest as a whole."""
    return rows.repartition(few_tasks(rows.sparkSession, rows.count()), "id")


#: Depth of the forest of most queries, and of the deep one (the reference sets no limit).
DEPTH, DEEP = 8, 20


def trained(wbench: Workbench, depth: int = DEPTH) -> dict:
    """Fit the forest on the train split once: {'model', 'path', 'nodes', 'ensemble'}."""
    key = (*session_key(wbench.spark, wbench.sf_dir), depth)
    state = _TRAINED.setdefault(key, {})
    if "model" not in state:
        # The forest makes several passes over its input (size, split candidates, binning)
        # before it caches its own binned copy, which every level reads: the input is kept on
        # disk for the duration of the fit, so that the memory is left to that copy.
        ensure_checkpoint_dir(wbench.spark)  # trees write the places of rows there
        train = in_few_tasks(kept_split(wbench).where(F.col("split") == "train")).persist(StorageLevel.DISK_ONLY)
        try:
            model = TR.forest_pipeline(C.STANDARD_FEATURES, max_depth=depth).fit(train)
        finally:
            train.unpersist()
        state["model"] = model
        state["path"] = shared_path(wbench.spark, "forest")
        model.write().overwrite().save(state["path"])
        state["nodes"] = TR.saved_stage(model, state["path"], len(model.stages) - 1)
        state["ensemble"] = TreeEnsemble.from_saved_model(wbench.spark, C.STANDARD_FEATURES, state["nodes"])
    return state
