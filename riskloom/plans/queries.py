"""The query catalogue: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads the given tables (through the fixture projections) and runs
over whole tables. Registered with ``@query("name")``; the DuckDB oracle for the
same name lives in :mod:`riskloom.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.functions.expressions import percent_text, predicted_class, risk_bucket, round_double
from riskloom.operators.encode import fit_dictionary
from riskloom.operators.stats import exact_medians, interpolated, quantile_aggregates, running_total
from riskloom.plans.workbench import RISK, Workbench

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def wb(spark: SparkSession, sf_dir: str) -> Workbench:
    return Workbench.get(spark, sf_dir)


# --- sources / model frame -------------------------------------------------------


@query("scan_employees")
def scan_employees(spark, sf_dir):
    """The standard-layout table as scanned (35 columns)."""
    return wb(spark, sf_dir).employees


@query("model_frame")
def q_model_frame(spark, sf_dir):
    """Drop ignored columns, label 1/0, text features encoded, model order."""
    return wb(spark, sf_dir).model_frame


@query("fit_dictionary")
def q_fit_dictionary(spark, sf_dir):
    """Sorted distinct categories per text feature, code = position."""
    return fit_dictionary(wb(spark, sf_dir).employees, C.CATEGORICAL_FEATURES)


@query("feature_medians")
def q_feature_medians(spark, sf_dir):
    """A10: exact median of every model feature, distributed (no single-task percentile)."""
    return exact_medians(wb(spark, sf_dir).model_frame, C.STANDARD_FEATURES).select(
        "feature", F.round("median", 9).alias("median")
    )


@query("impute_medians")
def q_impute_medians(spark, sf_dir):
    """Nulls replaced by the training medians (constants folded into coalesce)."""
    frame = wb(spark, sf_dir).filled_frame
    return frame.select("id", *[F.round(f, 9).alias(f) for f in C.STANDARD_FEATURES], C.LABEL)


# --- scoring ---------------------------------------------------------------------------


@query("score_employees")
def score_employees(spark, sf_dir):
    """History + risk, outcome and category (fixed forest)."""
    return wb(spark, sf_dir).scored


@query("risk_buckets")
def risk_buckets(spark, sf_dir):
    """Category, outcome, class and stay probability per row."""
    s = wb(spark, sf_dir).scored
    return s.select(
        F.col("EmployeeNumber").alias("id"),
        F.col(RISK),
        (F.lit(1.0) - F.col(RISK)).alias("stay_probability"),
        predicted_class(F.col(RISK)).alias("prediction"),
        "PredictedOutcome",
        "RiskCategory",
        percent_text(F.col(RISK)).alias("risk_text"),
    )


@query("upload_summary")
def upload_summary(spark, sf_dir):
    """Rows scored, average risk, > 0.70 count, > 0.50 count, High share — one aggregate."""
    s = wb(spark, sf_dir).scored
    return s.agg(
        F.count(F.lit(1)).alias("employees_scored"),
        F.round(F.avg(RISK), 9).alias("avg_risk"),
        F.count_if(F.col(RISK) > C.MEDIUM_RISK_MAX).alias("high_risk_count"),
        F.count_if(F.col(RISK) > C.DECISION_THRESHOLD).alias("projected_attrition"),
        F.round(F.avg((F.col("RiskCategory") == C.HIGH_RISK).cast("double")), 9).alias("high_risk_share"),
    ).withColumn("avg_risk_text", percent_text(F.col("avg_risk")))


# --- filters, search, views --------------------------------------------------------

from riskloom.functions.expressions import label_truthy  # noqa: E402
from riskloom.operators import actions as A  # noqa: E402
from riskloom.operators import profile as PR  # noqa: E402
from riskloom.operators import views as V  # noqa: E402

# Filter parameters used by the registered views (values present in the fixture).
FILTER_RISK = C.MEDIUM_RISK
FILTER_DEPARTMENT = "BUILDING"
FILTER_ROLE = "1-URGENT"
SEARCH_TERM = "  Urgent "
NO_MATCH_TERM = "no-such-employee"
COUNT_SEARCH = "2-high"


def _result_view(df):
    return df.select(*V.present(df, C.RESULT_VIEW_COLUMNS))


@query("filter_employees")
def filter_employees(spark, sf_dir):
    """Risk category, department and role equality."""
    s = wb(spark, sf_dir).scored
    pred = V.filter_predicate(s, FILTER_RISK, FILTER_DEPARTMENT, FILTER_ROLE)
    return _result_view(s.where(pred))


@query("search_text")
def search_text(spark, sf_dir):
    """Trimmed, case-insensitive literal substring over every column's text."""
    s = wb(spark, sf_dir).scored
    return _result_view(s.where(V.filter_predicate(s, search=SEARCH_TERM)))


def _indexed(b):
    """The scored history written with the trigram bitmaps of its files, once a session."""
    from riskloom.operators.textindex import write_indexed
    from riskloom.session import shared_path

    if "indexed" not in b._fitted:
        b._fitted["indexed"] = shared_path(b.spark, "indexed")
        write_indexed(b.scored, b._fitted["indexed"], ["Department", "JobRole", "EducationField"], 32)
    return b._fitted["indexed"]


@query("search_indexed")
def search_indexed(spark, sf_dir):
    """F4/C21 over a written table: files without the term's trigrams are not read."""
    from riskloom.operators import textindex as TI

    return _result_view(TI.search_indexed(spark, _indexed(wb(spark, sf_dir)), SEARCH_TERM))


@query("search_files")
def search_files(spark, sf_dir):
    """of each department's name as a term, rows found, and whether files were left out."""
    from riskloom.operators import textindex as TI

    b = wb(spark, sf_dir)
    path = _indexed(b)
    total = spark.read.parquet(f"{path}/index").select("file").distinct().count()
    terms = sorted(r[0] for r in b.scored.select("Department").distinct().where("Department IS NOT NULL").collect())
    parts = []
    for term in terms:
        read = TI.candidate_files(spark, path, term).agg(F.count(F.lit(1)).alias("read"))
        found = TI.search_indexed(spark, path, term).agg(F.count(F.lit(1)).alias("rows"))
        parts.append(found.select(F.lit(term).alias("term"), "rows", (read.scalar() < total).alias("skipped")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("kept_scores")
def kept_scores(spark, sf_dir):
    """The scored upload kept in the shared folder: written, found again by another session,
    replaced when the model changes and when a file is added."""
    import uuid

    from riskloom.operators.assets import keep_scored, versions
    from riskloom.operators.forest import TreeEnsemble
    from riskloom.session import shared_path

    b = wb(spark, sf_dir)
    source, name = shared_path(spark, "kept-source"), f"scored-{uuid.uuid4().hex[:8]}"
    encoded = b.filled_frame
    encoded.write.parquet(source)
    smaller = TreeEnsemble(b.ensemble.features, b.ensemble.trees[:1])

    def step(number, session, ensemble):
        def score():
            table = session.read.parquet(source)
            return table.select("id", ensemble.score_expr([F.col(f) for f in ensemble.features]).alias(RISK))

        kept, reused = keep_scored(session, name, [source], ensemble, score)
        stats = kept.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(RISK), 9).alias("avg_risk")).first()
        return (number, reused, stats["rows"], stats["avg_risk"], len(versions(session, name)))

    rows = [step(1, spark, b.ensemble), step(2, spark.newSession(), b.ensemble), step(3, spark, smaller), step(4, spark.newSession(), smaller)]
    encoded.where("id % 10 = 0").write.mode("append").parquet(source)
    rows.append(step(5, spark, smaller))
    return spark.createDataFrame(rows, "step int, reused boolean, rows long, avg_risk double, versions int")


@query("filter_or_all")
def filter_or_all(spark, sf_dir):
    """nothing matches -> the whole table (decided in-plan by a scalar subquery)."""
    s = wb(spark, sf_dir).scored
    return _result_view(V.filter_or_all(s, V.filter_predicate(s, search=NO_MATCH_TERM)))


@query("filter_counts")
def filter_counts(spark, sf_dir):
    """Matched vs total after department + search filters."""
    s = wb(spark, sf_dir).scored
    return V.filter_counts(s, V.filter_predicate(s, department=FILTER_DEPARTMENT, search=COUNT_SEARCH))


@query("filtered_view")
def filtered_view(spark, sf_dir):
    """Department-filtered rows, preferred columns, highest risk first."""
    s = wb(spark, sf_dir).scored
    v = s.where(V.filter_predicate(s, department=FILTER_DEPARTMENT))
    return _result_view(v.orderBy(F.col(RISK).desc(), F.col("EmployeeNumber")))


@query("highest_risk")
def highest_risk(spark, sf_dir):
    """Top 15 with risk above 0.30."""
    s = wb(spark, sf_dir).scored
    return V.top_by_risk(s.where(F.col(RISK) > C.LOW_RISK_MAX), C.HIGHEST_RISK_ROWS, RISK, "EmployeeNumber", V.present(s, C.RESULT_VIEW_COLUMNS))


@query("history_top30")
def history_top30(spark, sf_dir):
    """The 30 highest-risk history rows with their recorded status."""
    s = wb(spark, sf_dir).scored.withColumn(
        "HistoricalStatus", F.when(F.col(C.LABEL) == "Yes", F.lit(C.STATUS_LEFT)).otherwise(F.lit(C.STATUS_ACTIVE))
    )
    return V.top_by_risk(s, C.HISTORY_ROWS, RISK, "EmployeeNumber", V.present(s, C.HISTORY_VIEW_COLUMNS) + ["HistoricalStatus"])


@query("template_rows")
def template_rows(spark, sf_dir):
    """The first 25 rows (by id) as an upload template."""
    e = wb(spark, sf_dir).employees
    return e.orderBy("EmployeeNumber").limit(C.TEMPLATE_ROWS)


@query("risk_percentile")
def risk_percentile(spark, sf_dir):
    """Share of the population at or below each row's risk (x100), distributed."""
    s = wb(spark, sf_dir).scored.select(F.col("EmployeeNumber").alias("id"), RISK)
    p = V.risk_percentile(s, RISK)
    return p.select(
        "id", RISK, F.round("percentile", 9).alias("percentile"),
        F.format_string("%.0f%%", F.round("percentile", 0)).alias("percentile_text"),
    )


@query("risk_vs_average")
def risk_vs_average(spark, sf_dir):
    """Each row's risk next to the population average."""
    s = wb(spark, sf_dir).scored.select(F.col("EmployeeNumber").alias("id"), RISK)
    a = V.with_average(s, RISK)
    return a.select(
        "id", RISK, F.round("dataset_avg", 9).alias("dataset_avg"),
        F.round(F.col(RISK) - F.col("dataset_avg"), 9).alias("diff_from_avg"),
    )


@query("employee_labels")
def employee_labels(spark, sf_dir):
    """Selection labels with and without department."""
    s = wb(spark, sf_dir).scored.withColumn("id", F.col("EmployeeNumber"))
    return s.select(
        "id",
        V.selection_label("id", "EmployeeNumber", RISK, True).alias("history_label"),
        V.selection_label("id", "EmployeeNumber", RISK, False).alias("upload_label"),
        V.selection_label("id", None, RISK, False).alias("row_label"),
    )


@query("distinct_options")
def distinct_options(spark, sf_dir):
    """Department and role option lists."""
    return V.distinct_options(wb(spark, sf_dir).scored, ["Department", "JobRole"])


# --- labels and counts ---------------------------------------------------------------


@query("label_counts")
def label_counts(spark, sf_dir):
    """A3/A4: label value counts and rates."""
    return PR.value_counts(wb(spark, sf_dir).employees, C.LABEL).select(
        F.col("value").alias(C.LABEL), "n", "share"
    )


@query("overtime_crosstab")
def overtime_crosstab(spark, sf_dir):
    """A5: OverTime x Attrition counts."""
    return PR.crosstab(wb(spark, sf_dir).employees, "OverTime", C.LABEL, ["No", "Yes"])


@query("label_match_rate")
def label_match_rate(spark, sf_dir):
    """Actual rate and model match rate over labelled rows. Yes/No labels map
    to 1/0; only if that maps nothing, numbers are parsed instead (a column-level switch)."""
    return _match_rate(wb(spark, sf_dir).scored, C.LABEL)


def _match_rate(s, label):
    """Both readings of the label in one aggregate; the choice is made on its one row."""
    yes_no = F.when(F.col(label) == "Yes", F.lit(1.0)).when(F.col(label) == "No", F.lit(0.0))
    number = F.col(label).cast("string").try_cast("double")
    pred = predicted_class(F.col(RISK)).cast("double")
    both = s.agg(*[
        x.alias(f"{n}_{k}")
        for k, actual in (("text", yes_no), ("number", number))
        for n, x in (("n", F.count(actual)), ("rate", F.avg(actual)), ("match", F.avg(F.when(actual.isNotNull(), (pred == actual).cast("double")))))
    ])
    pick = lambda n: F.when(F.col("n_text") > 0, F.col(f"{n}_text")).otherwise(F.col(f"{n}_number"))
    out = both.select(pick("n").alias("labelled"), F.round(pick("rate"), 9).alias("actual_rate"), F.round(pick("match"), 9).alias("match_rate"))
    return out.select("*", percent_text(F.col("actual_rate")).alias("actual_rate_text"), percent_text(F.col("match_rate")).alias("match_rate_text"))


@query("label_match_numeric")
def label_match_numeric(spark, sf_dir):
    """Labels written as numbers (and some as neither), read by the numeric branch."""
    s = wb(spark, sf_dir).scored
    label = F.when(F.col("EmployeeNumber") % 10 == 0, F.lit("left?")).when(F.col(C.LABEL) == "Yes", F.lit("1.0")).otherwise(F.lit("0"))
    return _match_rate(s.select(label.alias(C.LABEL), RISK), C.LABEL)


@query("label_truth")
def label_truth(spark, sf_dir):
    """Actual label truthiness and status text per row."""
    e = wb(spark, sf_dir).employees
    return e.select(
        F.col("EmployeeNumber").alias("id"),
        F.col(C.LABEL),
        label_truthy(F.col(C.LABEL)).alias("is_leaver"),
        F.when(F.col(C.LABEL) == "Yes", F.lit(C.STATUS_LEFT)).otherwise(F.lit(C.STATUS_ACTIVE)).alias("HistoricalStatus"),
    )


# --- per-row profile outputs ------------------------------------------------------------


@query("profile_long")
def profile_long(spark, sf_dir):
    """Every row's profile fields transposed to (id, field, value) — all ids at once."""
    e = wb(spark, sf_dir).employees
    fields = V.present(e, C.PROFILE_COLUMNS)
    return e.select(
        F.col("EmployeeNumber").alias("id"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("kv"),
    ).select("id", "kv.field", "kv.value")


@query("recommendations")
def q_recommendations(spark, sf_dir):
    """Retention recommendations from the model-frame values."""
    f = wb(spark, sf_dir).filled_frame
    return f.select(
        "id",
        F.size(A.recommendations(f)).alias("n_recommendations"),
        A.recommendation_text(f).alias("recommendations"),
    )


@query("profile_shape")
def q_profile_shape(spark, sf_dir):
    """C20: radar data — satisfaction fields / 4, null -> 0."""
    e = wb(spark, sf_dir).employees
    return e.select(F.col("EmployeeNumber").alias("id"), *A.profile_shape(e))


@query("coerce_numeric")
def coerce_numeric(spark, sf_dir):
    """Text -> number and text -> date coercion, bad values -> null."""
    from riskloom.functions.expressions import to_number, to_timestamp_lenient

    w = wb(spark, sf_dir).workers
    types = dict(w.dtypes)
    return w.select(
        "emp_code",
        to_number(F.col("happiness"), types["happiness"]).alias("happiness_num"),
        to_number(F.col("annual_income"), types["annual_income"]).alias("annual_income_num"),
        F.to_date(to_timestamp_lenient(F.col("hire_date"), types["hire_date"])).alias("hire_date_parsed"),
    )


# --- harmonisation ------------------------------------------------------------------------

from riskloom.operators import encode as EN  # noqa: E402
from riskloom.operators import mapping as MP  # noqa: E402
from riskloom.operators import prepare as PP  # noqa: E402
from riskloom.plans import workbench as W  # noqa: E402
from riskloom.sources.fixtures import WORKERS_AS_OF, WORKERS_OVERRIDES  # noqa: E402


@query("schema_check")
def schema_check(spark, sf_dir):
    """Standard-schema detection and the missing required names, per table."""
    return MP.schema_check(W.fixture_catalog(wb(spark, sf_dir)))


@query("fuzzy_column_map")
def fuzzy_column_map(spark, sf_dir):
    """Mapping decisions for both fixture layouts (overrides on the custom one)."""
    b = wb(spark, sf_dir)
    ov = MP.overrides_of(spark, W.WORKERS, WORKERS_OVERRIDES)
    return MP.map_columns(W.fixture_catalog(b), ov)


@query("catalog_column_map")
def catalog_column_map(spark, sf_dir):
    """H2 over a catalog: every column of every given table mapped in one job."""
    return MP.map_columns(W.table_catalog(wb(spark, sf_dir)))


@query("string_similarity")
def string_similarity(spark, sf_dir):
    """Similarity of every fixture column name to every standard feature name."""
    from riskloom.functions.expressions import clean_string, similarity_of_clean

    cat = W.fixture_catalog(wb(spark, sf_dir))
    names = F.array(*[F.lit(f) for f in C.STANDARD_FEATURES])
    clean = clean_string(F.col("col_name"))
    return cat.select("dataset", "col_name", F.explode(names).alias("target")).select(
        "dataset", "col_name", "target",
        F.round(similarity_of_clean(clean, clean_string(F.col("target"))), 9).alias("similarity"),
    )


@query("suggest_mapping")
def suggest_mapping(spark, sf_dir):
    """H3: keyword suggestions for every fixture column."""
    return MP.suggest_mapping(W.fixture_catalog(wb(spark, sf_dir)))


@query("effective_mapping")
def effective_mapping(spark, sf_dir):
    """Override, else automatic target, else Ignore — for every column of the lake and of
    the fixture layouts."""
    ov = MP.overrides_of(spark, W.WORKERS, WORKERS_OVERRIDES)
    return MP.effective_mapping(MP.map_columns(W.fixture_catalog(wb(spark, sf_dir)), ov))


@query("override_table_map")
def override_table_map(spark, sf_dir):
    """A lake whose datasets repeat column names under a table of overrides: one claimant
    for each target, doubled overrides as conflicts."""
    b = wb(spark, sf_dir)
    decided = MP.map_columns(W.repeated_catalog(b), W.override_table(b))
    return decided.join(MP.effective_mapping(decided).drop("col_name"), ["dataset", "col_ord"])


@query("profile_summary")
def profile_summary(spark, sf_dir):
    """One-row profile and quality score of the custom upload."""
    b = wb(spark, sf_dir)
    return PR.profile_summary(spark, b.workers, W.workers_decisions(b, False), W.WORKERS)


@query("column_profile")
def column_profile(spark, sf_dir):
    """Per-column non-null counts and null flags in one pass."""
    return PR.column_profile(wb(spark, sf_dir).workers)


@query("derive_features")
def derive_features(spark, sf_dir):
    """Tenure, age, monthly income and rescaled survey derived from source columns."""
    b = wb(spark, sf_dir)
    plan = W.workers_plan(b, False)
    h = PP.harmonize(b.workers, plan, WORKERS_AS_OF, keep=["emp_code"])
    return h.select("emp_code", *sorted(plan.derived))


@query("harmonize")
def harmonize(spark, sf_dir):
    """Raw columns renamed to standard names (with overrides), derived features added."""
    b = wb(spark, sf_dir)
    return PP.harmonize(b.workers, W.workers_plan(b, True), WORKERS_AS_OF)


@query("impute_defaults")
def impute_defaults(spark, sf_dir):
    """H5 without training medians: absent / null features get the built-in defaults."""
    b = wb(spark, sf_dir)
    h = PP.harmonize(b.workers, W.workers_plan(b, True), WORKERS_AS_OF)
    out, _ = PP.impute(h, None)
    return out.select("_id", *[F.col(f).cast("string").alias(f) for f in C.STANDARD_FEATURES])


@query("encode_categories")
def encode_categories(spark, sf_dir):
    """Lenient encoding of the upload's text features with the history dictionary."""
    b = wb(spark, sf_dir)
    h = PP.harmonize(b.workers, W.workers_plan(b, True), WORKERS_AS_OF)
    imputed, _ = PP.impute(h, b.medians, modes=b.modes)
    enc = EN.encode_lenient(imputed, b.dictionary, C.STANDARD_FEATURES)
    return enc.select("_id", *[F.col(f).cast("int").alias(f) for f in C.CATEGORICAL_FEATURES])


@query("preprocess_custom")
def preprocess_custom(spark, sf_dir):
    """H12 (custom): map -> derive -> rename -> impute -> encode -> align."""
    frame, _ = W.workers_prepared(wb(spark, sf_dir), True)
    return frame.select("_id", "_label", *[F.round(f, 9).alias(f) for f in C.STANDARD_FEATURES])


@query("preprocess_standard")
def preprocess_standard(spark, sf_dir):
    """H12 (standard)/H7/H8: strict encoding (unknown categories raise), median fill."""
    b = wb(spark, sf_dir)
    e = b.employees.withColumnRenamed("EmployeeNumber", "id")
    enc = EN.encode_strict(e, b.dictionary, C.STANDARD_FEATURES)
    filled = PP.align(EN.fill_medians(enc, b.medians), keep=["id"])
    return filled.select("id", *[F.round(f, 9).alias(f) for f in C.STANDARD_FEATURES])


@query("unknown_categories")
def unknown_categories(spark, sf_dir):
    """Upload categories absent from the history dictionary (first 8 shown)."""
    b = wb(spark, sf_dir)
    h = PP.harmonize(b.workers, W.workers_plan(b, True), WORKERS_AS_OF)
    cols = [c for c in C.CATEGORICAL_FEATURES if c in h.columns]
    return EN.unknown_categories(h, b.dictionary, cols)


@query("mapping_report")
def mapping_report(spark, sf_dir):
    """H9: mapped / derived / ignored / unknown decisions plus imputed features, long form."""
    b = wb(spark, sf_dir)
    dec = W.workers_decisions(b, True)
    _, report = W.workers_prepared(b, True)
    imputed = spark.createDataFrame(
        [(None, "imputed", r.feature, None, r.method) for r in report],
        "raw_col string, kind string, target string, score double, method string",
    )
    return dec.select(F.col("col_name").alias("raw_col"), "kind", "target", "score", "method").unionByName(imputed)


@query("score_custom_upload")
def score_custom_upload(spark, sf_dir):
    """Upload flow: custom upload prepared and scored with the forest."""
    b = wb(spark, sf_dir)
    frame, _ = W.workers_prepared(b, True)
    s = frame.select("_id", b.score_frame(frame).alias(RISK))
    return W.with_risk_columns(s)


@query("percentile_vs_reference")
def percentile_vs_reference(spark, sf_dir):
    """Each uploaded row's risk percentile against the scored history."""
    b = wb(spark, sf_dir)
    frame, _ = W.workers_prepared(b, True)
    up = frame.select("_id", b.score_frame(frame).alias(RISK))
    ref = b.scored.select(F.col(RISK).alias("ref_risk"))
    p = V.percentile_vs_reference(up, RISK, ref, "ref_risk")
    return p.select("_id", RISK, F.round("percentile", 9).alias("percentile"))


@query("resolve_ids")
def resolve_ids(spark, sf_dir):
    """Row ids — mapped id column if any, else sequential EMP-n by an explicit order
    (distributed positions, no single-task row_number)."""
    from riskloom.operators.stats import dense_positions

    b = wb(spark, sf_dir)
    plan = W.workers_plan(b, False)
    w = b.workers
    id_col = plan.id_col or next((c for c in w.columns if c.lower() in C.ID_COLUMN_NAMES), None)
    if id_col is not None:
        return w.select("emp_code", F.col(id_col).cast("string").alias(C.ID_ROLE))
    pos = dense_positions(w.select("emp_code"), ["emp_code"], out="_pos")
    return pos.select("emp_code", F.concat(F.lit("EMP-"), (F.col("_pos") + 1000).cast("string")).alias(C.ID_ROLE))


# --- explanations, assessments, reports ------------------------------------------------------

from riskloom.operators import forest as FO  # noqa: E402
from riskloom.sources.fixtures import SCENARIOS  # noqa: E402

# Features present in the sparse scoring records (the rest are absent -> 0).
SPARSE_FEATURES = [
    "Age", "MonthlyIncome", "OverTime", "JobSatisfaction", "YearsAtCompany", "TotalWorkingYears",
    "DistanceFromHome", "NumCompaniesWorked", "JobLevel", "EnvironmentSatisfaction", "WorkLifeBalance",
]


@query("explain_all")
def explain_all(spark, sf_dir):
    """Additive contributions of every feature for every row, ranked by |phi|."""
    b = wb(spark, sf_dir)
    ex = W.explained_history(b)
    return FO.explanations_long(ex, b.ensemble.features).select(
        "id", "feature", round_double(F.col("phi"), 9).alias("phi"), "rank"
    )


@query("explain_topk")
def explain_topk(spark, sf_dir):
    """Top-5 drivers per row with the raw value and the driver sentence."""
    b = wb(spark, sf_dir)
    ex = W.explained_history(b, carry_raw=True)
    raw = [f"__raw{i}" for i in range(len(C.STANDARD_FEATURES))]
    rows = FO.explanations_long(ex, b.ensemble.features, k=C.TOP_DRIVERS, carry=raw).select(
        "id", "rank", "feature", "phi", W.raw_value_text(b, F.col("idx")).alias("value")
    )
    return rows.select(
        "id", "rank", "feature", round_double(F.col("phi"), 9).alias("phi"), "value",
        A.direction(F.col("phi"), C.FLIGHT_RISK_UP, C.FLIGHT_RISK_DOWN).alias("direction"),
        A.driver_line(F.col("feature"), F.col("value"), F.col("phi")).alias("driver"),
    )


#: Shares of the distribution behind the summary plot.
QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


@query("global_explanations")
def global_explanations(spark, sf_dir):
    """Distribution of contributions per feature over all rows (summary-plot data), with
    exact quantiles: equal contributions are counted first, and one running total over the counts
    answers all shares of all features."""
    b = wb(spark, sf_dir)
    long = FO.explanations_long(W.explained_history(b), b.ensemble.features)
    counts = long.groupBy("feature", F.col("phi").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    cum = running_total(counts, "key", "n", ["feature"], out="_cum", total_out="_total")
    weighted = [(F.sum(x * F.col("n")) / F.sum("n")).alias(name) for name, x in (("mean_abs_phi", F.abs("key")), ("mean_phi", F.col("key")))]
    per = cum.groupBy("feature", "_total").agg(*weighted, F.min("key").alias("min_phi"), F.max("key").alias("max_phi"), *quantile_aggregates(QUANTILES))
    shares = [F.round(interpolated(i, q), 9).alias(f"q{round(100 * q):02d}_phi") for i, q in enumerate(QUANTILES)]
    return per.select("feature", *[F.round(c, 9).alias(c) for c in ("mean_abs_phi", "mean_phi", "min_phi", "max_phi")], *shares)


@query("risk_report_text")
def risk_report_text(spark, sf_dir):
    """The per-employee text report for every row (file name + text)."""
    b = wb(spark, sf_dir)
    ex = W.explained_history(b)
    label = F.concat(F.lit("Employee "), F.col("id").cast("string"))
    top = FO.ranked_contributions(b.ensemble.features, C.TOP_DRIVERS)
    return ex.select(
        "id",
        A.report_file_name(label).alias("file_name"),
        A.report_text(label, F.col("score"), top, C.TOP_DRIVERS).alias("report_text"),
    )


def _sparse_records(b):
    return b.model_frame.select("id", *SPARSE_FEATURES)


@query("score_sparse_records")
def score_sparse_records(spark, sf_dir):
    """Partial records (absent features -> 0) scored with the forest."""
    b = wb(spark, sf_dir)
    full = A.sparse_to_full(_sparse_records(b), C.STANDARD_FEATURES)
    risk = b.ensemble.score_expr([F.col(f) for f in b.ensemble.features])
    return full.select("id", risk.alias(RISK)).withColumn("risk_level", risk_bucket(F.col(RISK)))


@query("assess_risk")
def assess_risk(spark, sf_dir):
    """Level, probability text and the top-3 factors for every partial record."""
    b = wb(spark, sf_dir)
    full = A.sparse_to_full(_sparse_records(b), C.STANDARD_FEATURES)
    ex = b.ensemble.explain(full, "id")
    top = FO.ranked_contributions(b.ensemble.features, C.TOP_FACTORS)
    return ex.select(
        "id",
        risk_bucket(F.col("score")).alias("risk_level"),
        percent_text(F.col("score")).alias("probability"),
        F.array_join(A.factor_texts(top, C.TOP_FACTORS), "; ").alias("top_factors"),
    )


@query("what_if")
def what_if(spark, sf_dir):
    """Every employee under every scenario, rescored; delta against the base risk."""
    b = wb(spark, sf_dir)
    feats = b.ensemble.features
    frame = b.filled_frame.withColumn("base_risk", b.ensemble.score_expr([F.col(f) for f in feats]))
    sc = A.apply_scenarios(frame, SCENARIOS, feats)
    risk = b.ensemble.score_expr([F.col(f) for f in feats])
    return sc.select(
        "id", "scenario", F.round("base_risk", 9).alias("base_risk"), F.round(risk, 9).alias("risk"),
        F.round(risk - F.col("base_risk"), 9).alias("delta"),
    )


def _label_pred(b):
    s = b.scored
    return s.select(
        F.when(F.col(C.LABEL) == "Yes", F.lit(1)).when(F.col(C.LABEL) == "No", F.lit(0)).alias("label"),
        predicted_class(F.col(RISK)).alias("pred"),
    ).where(F.col("label").isNotNull())


@query("confusion_matrix")
def confusion_matrix(spark, sf_dir):
    """Actual x predicted counts."""
    lp = _label_pred(wb(spark, sf_dir))
    return PR.crosstab(lp.withColumn("pred", F.concat(F.lit("pred_"), F.col("pred").cast("string"))), "label", "pred", ["pred_0", "pred_1"])


@query("classification_report")
def classification_report(spark, sf_dir):
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted averages
    — from one aggregate pass (four confusion counts)."""
    return TR.class_report(_label_pred(wb(spark, sf_dir)))


@query("forest_importance")
def forest_importance(spark, sf_dir):
    """Impurity importance of the fixed forest's features on the whole history: rows and
    leavers that come through each node, impurity taken away by tree and feature."""
    b = wb(spark, sf_dir)
    stats = b.ensemble.node_statistics(b.filled_frame, F.col(C.LABEL))
    nodes = b.ensemble.node_table(spark).join(stats, ["tree", "node"], "left").fillna(0.0, ["weight", "positives"])
    return FO.impurity_importance(nodes).select("feature", F.round("importance", 9).alias("importance"))


# --- training, evaluation, persistence (trained forests differ from the reference's numerically:
# rows-only checks plus own tests) -----------------------------------------------------------------

from riskloom.operators import training as TR  # noqa: E402
from riskloom.session import shared_path  # noqa: E402
from riskloom.sources import tables as TB  # noqa: E402


@query("stratified_split")
def stratified_split(spark, sf_dir):
    """Exact per-class 80/20 split; row counts per (split, label)."""
    s = W.split_frame(wb(spark, sf_dir))
    return s.groupBy("split", C.LABEL).agg(F.count(F.lit(1)).alias("n"))


@query("train_forest")
def train_forest(spark, sf_dir):
    """M3/M4/M5: random forest (100 trees, seed 42) fitted on the train split; test predictions."""
    b = wb(spark, sf_dir)
    model = W.trained(b)["model"]
    test = W.test_rows(b)
    pred = TR.leave_probability(model.transform(test))
    return pred.select(
        "id", C.LABEL, F.col("prediction").cast("int").alias("prediction"), F.round("p_leave", 9).alias("p_leave"),
        F.when(F.col("prediction") == 1, F.lit(C.WILL_LEAVE)).otherwise(F.lit(C.WILL_STAY)).alias("outcome"),
    )


@query("evaluate_model")
def evaluate_model(spark, sf_dir):
    """Hold-out accuracy of the trained forest."""
    b = wb(spark, sf_dir)
    test = W.test_rows(b)
    return TR.evaluate(W.trained(b)["model"].transform(test))


def _trained_importance(spark, sf_dir):
    return FO.impurity_importance(FO.saved_nodes(spark, W.trained(wb(spark, sf_dir))["nodes"], C.STANDARD_FEATURES))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    """Impurity importance of the trained forest from its written node table, top 10."""
    return _trained_importance(spark, sf_dir).orderBy(F.col("importance").desc(), "feature").limit(10)


def _holdout(spark, sf_dir):
    """(label, pred) of the test rows by the trained forest."""
    b = wb(spark, sf_dir)
    test = W.test_rows(b).where(F.col(C.LABEL).isNotNull())
    return W.trained(b)["model"].transform(test).select(F.col(C.LABEL).cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"))


@query("holdout_report")
def holdout_report(spark, sf_dir):
    """The whole report of the trained forest on the rows held out."""
    return TR.class_report(_holdout(spark, sf_dir))


@query("holdout_confusion")
def holdout_confusion(spark, sf_dir):
    """Actual x predicted counts of the trained forest on the rows held out."""
    lp = _holdout(spark, sf_dir)
    return PR.crosstab(lp.withColumn("pred", F.concat(F.lit("pred_"), F.col("pred").cast("string"))), "label", "pred", ["pred_0", "pred_1"])


@query("holdout_check")
def holdout_check(spark, sf_dir):
    """Support of each class in the report, and that matrix and report agree."""
    matrix = holdout_confusion(spark, sf_dir)
    right = F.when(F.col("label") == 0, F.col("pred_0")).otherwise(F.col("pred_1"))
    name = F.when(F.col("label") == 0, F.lit("Stayed")).otherwise(F.lit("Left"))
    own = matrix.select(name.alias("class"), (F.col("pred_0") + F.col("pred_1")).alias("n"), right.alias("right"))
    report = holdout_report(spark, sf_dir).where(F.col("class").isin("Stayed", "Left"))
    return report.join(own, "class").select("class", "support", ((F.col("support") == F.col("n")) & (F.abs(F.col("recall") * F.col("n") - F.col("right")) < 0.01)).alias("agrees"))


@query("score_deep_forest")
def score_deep_forest(spark, sf_dir):
    """M3/M5: a forest of depth 20 fitted on the train split; test rows scored by Spark's own
    transform and by walking the node arrays."""
    b = wb(spark, sf_dir)
    state = W.trained(b, W.DEEP)
    test = TR.leave_probability(state["model"].transform(W.in_few_tasks(W.test_rows(b))))
    own = state["ensemble"].predict_column([F.col(f) for f in C.STANDARD_FEATURES])
    return test.select("id", F.round("p_leave", 9).alias("spark_probability"), F.round(own, 9).alias("score"))


@query("score_deep_forest_check")
def score_deep_forest_check(spark, sf_dir):
    """M3: both scores of the deep forest agree on every test row, and trees are deeper than 8."""
    deepest = W.trained(wb(spark, sf_dir), W.DEEP)["ensemble"].depth()
    gap = F.max(F.abs(F.col("spark_probability") - F.col("score")))
    return score_deep_forest(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), (gap < 1e-8).alias("agrees"), F.lit(deepest > 8).alias("deep"))


@query("column_kinds")
def column_kinds(spark, sf_dir):
    """Columns of each kind of type, with their cells, of the custom upload."""
    return PR.column_kinds(wb(spark, sf_dir).workers)


@query("encode_many_categories")
def encode_many_categories(spark, sf_dir):
    """Columns whose dictionaries are too large to broadcast, coded together in one shuffle:
    every order under its customer's and its part's name and its priority, with a dictionary of
    every second customer."""
    b = wb(spark, sf_dir)
    orders = b.table("orders").join(b.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"), "o_custkey")
    rows = orders.select("o_orderkey", "c_name", "c_mktsegment", "o_orderpriority")
    cols = ["c_name", "c_mktsegment", "o_orderpriority"]
    key = ("names", tuple(cols))
    if key not in b._fitted:
        b._fitted[key] = EN.Dictionary.fit(orders.where("o_custkey % 2 = 0").select(*cols), cols)
    coded = b._fitted[key].join_codes(rows, cols, broadcast_up_to=0)
    return coded.select("o_orderkey", *[F.col(f"__code_{c}").alias(c) for c in cols])


@query("model_reload_check")
def model_reload_check(spark, sf_dir):
    """Save, load and re-predict — the reloaded model must agree on every test row."""
    from pyspark.ml import PipelineModel

    b = wb(spark, sf_dir)
    state = W.trained(b)
    reloaded = PipelineModel.load(state["path"])
    test = W.test_rows(b).select("id", *C.STANDARD_FEATURES, C.LABEL)
    first = state["model"].transform(test).withColumnRenamed("prediction", "p1").drop("features", "rawPrediction", "probability")
    both = reloaded.transform(first)
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("p1") != F.col("prediction")).alias("mismatches"))


@query("explain_trained")
def explain_trained(spark, sf_dir):
    """M6 on the trained Spark forest (read back from its saved node data): contributions
    close to Spark's own probability for every test row (closure error reported)."""
    b = wb(spark, sf_dir)
    state = W.trained(b)
    test = W.test_rows(b)
    both = TR.leave_probability(state["model"].transform(test)).select("id", *C.STANDARD_FEATURES, "p_leave")
    out = state["ensemble"].explain(both, "id", carry=["p_leave"]).select(
        "id", F.round("p_leave", 9).alias("spark_probability"), F.round("score", 9).alias("score"),
        F.round("base", 9).alias("base"),
        F.round(F.aggregate("phi", F.lit(0.0), lambda acc, x: acc + x), 9).alias("sum_phi"),
    )
    return out.withColumn("closure_error", F.round(F.abs(F.col("base") + F.col("sum_phi") - F.col("spark_probability")), 9))


@query("sink_roundtrip")
def sink_roundtrip(spark, sf_dir):
    """Scored table written as Parquet partitioned by RiskCategory to the shared folder,
    read back with partition pruning available; counts and mean risk per category."""
    path = shared_path(spark, "scored")
    TB.write_parquet(wb(spark, sf_dir).scored, path, partition_by=["RiskCategory"])
    back = spark.read.parquet(path)
    return back.groupBy("RiskCategory").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(RISK), 9).alias("avg_risk"))


@query("csv_roundtrip")
def csv_roundtrip(spark, sf_dir):
    """The history written as CSV with a header and scanned back with its declared schema."""
    e = wb(spark, sf_dir).employees
    path = shared_path(spark, "employees-csv")
    TB.write_csv(e, path)
    return TB.scan_csv(spark, path, e.schema)


@query("stream_scoring")
def stream_scoring(spark, sf_dir):
    """Streaming upload scoring: history files land in a folder, an availableNow stream scores
    them with checkpointing, the sink is read back."""
    from riskloom.streaming.scoring import read_scored, start_scoring

    b = wb(spark, sf_dir)
    src, sink, ckpt = (shared_path(spark, n) for n in ("uploads", "stream-sink", "stream-ckpt"))
    b.employees.write.mode("overwrite").parquet(src)
    q = start_scoring(spark, b, src, sink, ckpt)
    q.awaitTermination()
    return read_scored(spark, sink)


# Standard layout: dropped columns are ignored, label and id take their roles.
STANDARD_ROLES = {**{c: C.IGNORE for c in C.IGNORED_COLUMNS if c != C.ID_ROLE}, C.ID_ROLE: C.ID_ROLE, C.LABEL: C.LABEL}


@query("display_frame")
def display_frame(spark, sf_dir):
    """P10: display table of the custom upload (overrides applied)."""
    b = wb(spark, sf_dir)
    plan = W.workers_plan(b, True)
    id_expr = F.col(plan.id_col).cast("string") if plan.id_col else F.lit(None).cast("string")
    return PP.display_frame(b.workers, plan, WORKERS_AS_OF, id_expr)


@query("profile_summary_standard")
def profile_summary_standard(spark, sf_dir):
    """H10 on the standard layout: identity mapping first, so no feature counts as missing."""
    b = wb(spark, sf_dir)
    cat = MP.catalog_of(spark, {"employees": b.employees})
    ov = MP.overrides_of(spark, "employees", STANDARD_ROLES)
    return PR.profile_summary(spark, b.employees, MP.map_columns(cat, ov), "employees")


@query("quality_suggestions")
def quality_suggestions(spark, sf_dir):
    """The quality suggestions of both fixture uploads, one row each, in order."""
    b = wb(spark, sf_dir)
    cat_w = MP.catalog_of(spark, {W.WORKERS: b.workers})
    cat_e = MP.catalog_of(spark, {"employees": b.employees})
    ov_e = MP.overrides_of(spark, "employees", STANDARD_ROLES)
    parts = []
    for name, df, cat, ov in ((W.WORKERS, b.workers, cat_w, None), ("employees", b.employees, cat_e, ov_e)):
        prof = PR.profile_summary(spark, df, MP.map_columns(cat, ov), name)
        parts.append(prof.select(F.lit(name).alias("dataset"), F.posexplode(F.split("suggestions", "\n")).alias("ord", "suggestion")))
    return parts[0].unionByName(parts[1])


@query("fuzzy_column_map_strict")
def fuzzy_column_map_strict(spark, sf_dir):
    """H2 in reference-strict mode: derivation sources (birth date, hire date, annual income,
    survey score) are mapped as plain aliases, as the reference does."""
    b = wb(spark, sf_dir)
    ov = MP.overrides_of(spark, W.WORKERS, WORKERS_OVERRIDES)
    return MP.map_columns(W.fixture_catalog(b), ov, strict_reference=True)


# --- further uploads, views and checks of the trained model ------------------------------------

from riskloom.sources.fixtures import DATE_TEXTS_SQL  # noqa: E402


@query("parse_dates")
def parse_dates(spark, sf_dir):
    """Dates in many written forms; what is no date becomes null and is flagged."""
    from riskloom.functions.expressions import to_timestamp_lenient

    texts = spark.sql(DATE_TEXTS_SQL, orders=wb(spark, sf_dir).table("orders"))
    return texts.select("o_orderkey", F.to_date(to_timestamp_lenient(F.col("text"))).alias("parsed")).withColumn("unparsed", F.col("parsed").isNull())


@query("resolve_ids_named")
def resolve_ids_named(spark, sf_dir):
    """An upload with a column whose name is one of the id names uses that column."""
    w = wb(spark, sf_dir).workers.select("emp_code", F.concat(F.lit("x"), "emp_code").alias("EmpID"))
    id_col = next(c for c in w.columns if c.lower() in C.ID_COLUMN_NAMES)
    return w.select("emp_code", F.col(id_col).cast("string").alias(C.ID_ROLE))


@query("csv_hostile_text")
def csv_hostile_text(spark, sf_dir):
    """Whole texts with quotes and line breaks through CSV and back."""
    docs = wb(spark, sf_dir).table("documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = shared_path(spark, "documents-csv")
    TB.write_csv(docs, path)
    return TB.scan_csv(spark, path, docs.schema)


@query("scored_csv")
def scored_csv(spark, sf_dir):
    """The scored table as CSV, read back with the types found from its values."""
    s = wb(spark, sf_dir).scored
    path = shared_path(spark, "scored-csv")
    TB.write_csv(s, path)
    return TB.scan_csv(spark, path).select(*[F.col(c).cast(t) for c, t in s.dtypes])


@query("template_csv")
def template_csv(spark, sf_dir):
    """S3: the upload template written as CSV and read back."""
    t = template_rows(spark, sf_dir)
    path = shared_path(spark, "template-csv")
    TB.write_csv(t, path)
    return TB.scan_csv(spark, path, t.schema)


@query("sql_views")
def sql_views(spark, sf_dir):
    """The session's SQL views, queried with SQL."""
    W.register_views(wb(spark, sf_dir))
    return spark.sql(
        "SELECT s.RiskCategory, count(*) AS n, round(avg(x.phi), 9) AS mean_overtime_phi FROM scored s JOIN employees e ON e.EmployeeNumber = s.EmployeeNumber "
        "JOIN explanations x ON x.id = s.EmployeeNumber AND x.feature = 'OverTime' GROUP BY s.RiskCategory"
    )


@query("profile_lookup")
def profile_lookup(spark, sf_dir):
    """F8: rows of a list of ids (each customer's latest order), by a semi join."""
    b = wb(spark, sf_dir)
    wanted = b.table("orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("EmployeeNumber"))
    return b.scored.join(wanted, "EmployeeNumber", "left_semi").select(*V.present(b.scored, C.RESULT_VIEW_COLUMNS))


@query("filter_caption")
def filter_caption(spark, sf_dir):
    """Matched and total rows with thousands separators."""
    s = wb(spark, sf_dir).scored
    counts = V.filter_counts(s, V.filter_predicate(s, department=FILTER_DEPARTMENT))
    return counts.select("matched", "total", F.format_number("matched", 0).alias("matched_text"), F.format_number("total", 0).alias("total_text"))


@query("report_files")
def report_files(spark, sf_dir):
    """The second report layout, written as records to text files and read back whole."""
    b = wb(spark, sf_dir)
    label = F.concat(F.lit("employee_"), F.col("id").cast("string"))
    top = FO.ranked_contributions(b.ensemble.features, C.TOP_DRIVERS)
    reports = W.explained_history(b).select(A.report_text(label, F.col("score"), top, C.TOP_DRIVERS, title=C.REPORT_PROFILE_TITLE).alias("report"))
    path = shared_path(spark, "reports")
    TB.write_text(reports, "report", path)
    return TB.read_text(spark, path).select(F.col("value").alias("report_text"))


@query("split_assignment")
def split_assignment(spark, sf_dir):
    """The split of every row; within a class, rows go by a seeded hash of the id."""
    return W.split_frame(wb(spark, sf_dir)).select("id", C.LABEL, "split")


@query("train_forest_check")
def train_forest_check(spark, sf_dir):
    """M3-M5: every test row has a probability and the class that goes with it."""
    p = F.col("p_leave")
    return train_forest(spark, sf_dir).select("id", C.LABEL, p.between(0, 1).alias("has_probability"), (F.col("prediction") == (p > 0.5).cast("int")).alias("agrees"))


@query("evaluate_model_check")
def evaluate_model_check(spark, sf_dir):
    """Accuracy equals that of the confusion counts and beats guessing the larger class."""
    b = wb(spark, sf_dir)
    test = W.test_rows(b)
    right = (F.col("prediction") == F.col(C.LABEL)).cast("int")
    counts = W.trained(b)["model"].transform(test).groupBy(C.LABEL).agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("right"))
    own = counts.agg(F.sum("n").alias("rows"), (F.sum("right") / F.sum("n")).alias("from_counts"), (F.max("n") / F.sum("n")).alias("guess"))
    return evaluate_model(spark, sf_dir).drop("rows").crossJoin(own).select(
        "rows", (F.abs(F.col("accuracy") - F.col("from_counts")) < 1e-9).alias("matches_counts"), (F.col("accuracy") >= F.col("guess") - 0.01).alias("beats_guess")
    )


@query("feature_importance_check")
def feature_importance_check(spark, sf_dir):
    """Importances of all features, which sum to 1."""
    all_of_them = spark.createDataFrame([(f,) for f in C.STANDARD_FEATURES], "feature string").join(_trained_importance(spark, sf_dir), "feature", "left").fillna(0.0)
    return all_of_them.agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("importance"), 6).alias("total"), F.min(F.col("importance") >= 0).alias("none_negative"))


@query("explain_trained_check")
def explain_trained_check(spark, sf_dir):
    """M6: contributions of the trained forest add up to its own probabilities."""
    return explain_trained(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), (F.max("closure_error") <= 1e-8).alias("closes"))
