"""DuckDB oracle statements, one per query name (same output column names)."""

from __future__ import annotations

from riskloom import config as C
from riskloom.plans import sqlparts as S
from riskloom.plans.workbench import fixed_forest

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


ENS = fixed_forest()

oracle("scan_employees", f"WITH {S.EMP} SELECT * FROM employees")
oracle("model_frame", S.with_model("SELECT * FROM mf"))
oracle("fit_dictionary", S.with_model("SELECT * FROM dict"))
oracle(
    "feature_medians",
    S.with_model(
        "SELECT feature, round(median, 9) AS median FROM (UNPIVOT (SELECT "
        + ", ".join(f"CAST(median({f}) AS DOUBLE) AS {f}" for f in C.STANDARD_FEATURES)
        + " FROM mf) ON COLUMNS(*) INTO NAME feature VALUE median)"
    ),
)
oracle(
    "impute_medians",
    S.with_model("SELECT id, " + ", ".join(f"round({f}, 9) AS {f}" for f in C.STANDARD_FEATURES) + ", Attrition FROM mfi"),
)
oracle("score_employees", S.with_scored(ENS, "SELECT * FROM scored"))
oracle(
    "risk_buckets",
    S.with_scored(
        ENS,
        "SELECT EmployeeNumber AS id, PredictedAttritionRisk, 1.0 - PredictedAttritionRisk AS stay_probability, "
        f"CAST(PredictedAttritionRisk > {S.d(C.DECISION_THRESHOLD)} AS INTEGER) AS prediction, PredictedOutcome, RiskCategory, "
        f"{S.pct_sql('PredictedAttritionRisk')} AS risk_text FROM scored",
    ),
)
oracle(
    "upload_summary",
    S.with_scored(
        ENS,
        "SELECT *, " + S.pct_sql("avg_risk") + " AS avg_risk_text FROM (SELECT count(*) AS employees_scored, "
        "round(avg(PredictedAttritionRisk), 9) AS avg_risk, "
        f"count(*) FILTER (WHERE PredictedAttritionRisk > {S.d(C.MEDIUM_RISK_MAX)}) AS high_risk_count, "
        f"count(*) FILTER (WHERE PredictedAttritionRisk > {S.d(C.DECISION_THRESHOLD)}) AS projected_attrition, "
        f"round(avg(CASE WHEN RiskCategory = {S.q(C.HIGH_RISK)} THEN 1.0 ELSE 0.0 END), 9) AS high_risk_share FROM scored)",
    ),
)

# --- filters, search, views ---------------------------------------------------------------

from riskloom.plans.queries import (  # noqa: E402
    COUNT_SEARCH, FILTER_DEPARTMENT, FILTER_RISK, FILTER_ROLE, NO_MATCH_TERM, SEARCH_TERM,
)
from riskloom.sources.fixtures import EMPLOYEES_COLUMNS  # noqa: E402

SCORED_COLUMNS = EMPLOYEES_COLUMNS + ["PredictedAttritionRisk", "PredictedOutcome", "RiskCategory"]
RESULT = ", ".join(C.RESULT_VIEW_COLUMNS)
ROW_TEXT = "lower(concat_ws(' ', " + ", ".join(f"COALESCE(CAST({c} AS VARCHAR), '')" for c in SCORED_COLUMNS) + "))"


def _contains(term: str) -> str:
    return f"contains({ROW_TEXT}, {S.q(term.strip().lower())})"


oracle(
    "filter_employees",
    S.with_scored(ENS, f"SELECT {RESULT} FROM scored WHERE RiskCategory = {S.q(FILTER_RISK)} "
    f"AND CAST(Department AS VARCHAR) = {S.q(FILTER_DEPARTMENT)} AND CAST(JobRole AS VARCHAR) = {S.q(FILTER_ROLE)}"),
)
oracle("search_text", S.with_scored(ENS, f"SELECT {RESULT} FROM scored WHERE {_contains(SEARCH_TERM)}"))
oracle("search_indexed", S.with_scored(ENS, f"SELECT {RESULT} FROM scored WHERE {_contains(SEARCH_TERM)}"))
oracle(
    "filter_or_all",
    S.with_scored(ENS, f"SELECT {RESULT} FROM scored WHERE {_contains(NO_MATCH_TERM)} "
    f"OR (SELECT count(*) FROM scored WHERE {_contains(NO_MATCH_TERM)}) = 0"),
)
oracle(
    "filter_counts",
    S.with_scored(ENS, f"SELECT count(*) FILTER (WHERE CAST(Department AS VARCHAR) = {S.q(FILTER_DEPARTMENT)} AND {_contains(COUNT_SEARCH)}) AS matched, count(*) AS total FROM scored"),
)
oracle("filtered_view", S.with_scored(ENS, f"SELECT {RESULT} FROM scored WHERE CAST(Department AS VARCHAR) = {S.q(FILTER_DEPARTMENT)}"))
oracle(
    "highest_risk",
    S.with_scored(ENS, f"SELECT {RESULT} FROM scored WHERE PredictedAttritionRisk > {S.d(C.LOW_RISK_MAX)} "
    f"ORDER BY PredictedAttritionRisk DESC, EmployeeNumber LIMIT {C.HIGHEST_RISK_ROWS}"),
)
oracle(
    "history_top30",
    S.with_scored(ENS, "SELECT " + ", ".join(C.HISTORY_VIEW_COLUMNS) + f", CASE WHEN Attrition = 'Yes' THEN {S.q(C.STATUS_LEFT)} ELSE {S.q(C.STATUS_ACTIVE)} END AS HistoricalStatus "
    f"FROM scored ORDER BY PredictedAttritionRisk DESC, EmployeeNumber LIMIT {C.HISTORY_ROWS}"),
)
oracle("template_rows", f"WITH {S.EMP} SELECT * FROM employees ORDER BY EmployeeNumber LIMIT {C.TEMPLATE_ROWS}")
oracle(
    "risk_percentile",
    S.with_scored(ENS, "SELECT id, PredictedAttritionRisk, round(p, 9) AS percentile, printf('%.0f%%', round(p, 0)) AS percentile_text FROM "
    "(SELECT EmployeeNumber AS id, PredictedAttritionRisk, cume_dist() OVER (ORDER BY PredictedAttritionRisk) * 100.0 AS p FROM scored)"),
)
oracle(
    "risk_vs_average",
    S.with_scored(ENS, "SELECT EmployeeNumber AS id, PredictedAttritionRisk, round(a.m, 9) AS dataset_avg, round(PredictedAttritionRisk - a.m, 9) AS diff_from_avg "
    "FROM scored CROSS JOIN (SELECT avg(PredictedAttritionRisk) AS m FROM scored) a"),
)
_pct = S.pct_sql("PredictedAttritionRisk")
oracle(
    "employee_labels",
    S.with_scored(ENS, "SELECT EmployeeNumber AS id, "
    f"concat_ws(' | ', CAST(EmployeeNumber AS VARCHAR), 'Employee ' || CAST(EmployeeNumber AS VARCHAR), COALESCE(CAST(Department AS VARCHAR), ''), RiskCategory, {_pct}) AS history_label, "
    f"concat_ws(' | ', CAST(EmployeeNumber AS VARCHAR), 'Employee ' || CAST(EmployeeNumber AS VARCHAR), RiskCategory, {_pct}) AS upload_label, "
    f"concat_ws(' | ', CAST(EmployeeNumber AS VARCHAR), 'Uploaded row ' || CAST(EmployeeNumber + 1 AS VARCHAR), RiskCategory, {_pct}) AS row_label FROM scored"),
)
oracle(
    "distinct_options",
    S.with_scored(ENS, "SELECT DISTINCT 'Department' AS field, CAST(Department AS VARCHAR) AS option FROM scored WHERE Department IS NOT NULL "
    "UNION SELECT DISTINCT 'JobRole', CAST(JobRole AS VARCHAR) FROM scored WHERE JobRole IS NOT NULL"),
)
oracle(
    "label_counts",
    f"WITH {S.EMP} SELECT Attrition, count(*) AS n, round(count(*) / (SELECT count(Attrition) FROM employees), 9) AS share "
    "FROM employees WHERE Attrition IS NOT NULL GROUP BY Attrition",
)
oracle(
    "overtime_crosstab",
    f"WITH {S.EMP} SELECT OverTime, count(*) FILTER (WHERE Attrition = 'No') AS No, count(*) FILTER (WHERE Attrition = 'Yes') AS Yes FROM employees GROUP BY OverTime",
)
oracle(
    "label_match_rate",
    S.with_scored(ENS, "SELECT *, " + S.pct_sql("actual_rate") + " AS actual_rate_text, " + S.pct_sql("match_rate") + " AS match_rate_text FROM ("
    "SELECT count(*) AS labelled, round(avg(actual), 9) AS actual_rate, round(avg(CASE WHEN pred = actual THEN 1.0 ELSE 0.0 END), 9) AS match_rate FROM ("
    "SELECT CASE WHEN (SELECT count(*) FROM scored WHERE Attrition IN ('Yes', 'No')) > 0 "
    "THEN (CASE WHEN Attrition = 'Yes' THEN 1.0 WHEN Attrition = 'No' THEN 0.0 END) ELSE TRY_CAST(Attrition AS DOUBLE) END AS actual, "
    f"CAST(CAST(PredictedAttritionRisk > {S.d(C.DECISION_THRESHOLD)} AS INTEGER) AS DOUBLE) AS pred FROM scored) WHERE actual IS NOT NULL)"),
)
oracle(
    "label_truth",
    f"WITH {S.EMP} SELECT EmployeeNumber AS id, Attrition, lower(CAST(Attrition AS VARCHAR)) IN ('yes', '1', '1.0') AS is_leaver, "
    f"CASE WHEN Attrition = 'Yes' THEN {S.q(C.STATUS_LEFT)} ELSE {S.q(C.STATUS_ACTIVE)} END AS HistoricalStatus FROM employees",
)
oracle(
    "profile_long",
    f"WITH {S.EMP} " + " UNION ALL ".join(
        f"SELECT EmployeeNumber AS id, {S.q(f)} AS field, CAST({f} AS VARCHAR) AS value FROM employees" for f in C.PROFILE_COLUMNS
    ),
)
_rec_parts = []
for _feat, _op, _val, _text in C.RECOMMENDATION_RULES:
    _rec_parts.append(f"CASE WHEN {_feat} {'=' if _op == '==' else _op} {S.d(_val)} THEN {S.q(_text)} END")
oracle(
    "recommendations",
    S.with_model(
        "SELECT id, CAST(" + " + ".join(f"(CASE WHEN ({p}) IS NULL THEN 0 ELSE 1 END)" for p in _rec_parts) + " AS INTEGER) AS n_recommendations, "
        f"COALESCE(NULLIF(concat_ws(chr(10), {', '.join(_rec_parts)}), ''), {S.q(C.NO_CONCERNS)}) AS recommendations FROM mfi"
    ),
)
oracle(
    "profile_shape",
    f"WITH {S.EMP} SELECT EmployeeNumber AS id, "
    + ", ".join(f"COALESCE(TRY_CAST(CAST({f} AS VARCHAR) AS DOUBLE), 0.0) / 4.0 AS {f}_shape" for f in C.PROFILE_SHAPE_FIELDS)
    + " FROM employees",
)
oracle(
    "coerce_numeric",
    f"WITH {S.EMP}, {S.WORKERS} SELECT emp_code, TRY_CAST(happiness AS DOUBLE) AS happiness_num, "
    "TRY_CAST(CAST(annual_income AS VARCHAR) AS DOUBLE) AS annual_income_num, CAST(hire_date AS DATE) AS hire_date_parsed FROM workers",
)

# --- harmonisation -----------------------------------------------------------------------------

from riskloom.sources.fixtures import DATE_TEXTS_SQL, LAKE_CATALOG_SQL, OVERRIDE_TABLE_SQL, REPEATED_CATALOG_SQL, WORKERS_AS_OF, WORKERS_COLUMNS, WORKERS_OVERRIDES  # noqa: E402
from riskloom.sources.tables import TABLES, duckdb_sql  # noqa: E402

LAKE = duckdb_sql(LAKE_CATALOG_SQL)


def with_lake(own: str) -> str:
    """CTEs ending in ``cat``: the lake's columns and those of the CTE text ``own``."""
    return f"{own.replace('cat', 'own_cat', 1)}, cat AS (SELECT dataset, col_name, col_ord FROM own_cat UNION ALL SELECT dataset, col_name, col_ord FROM ({LAKE}))"


FIXTURE_CATALOG = with_lake(S.catalog_values({"employees": EMPLOYEES_COLUMNS, "workers_custom": WORKERS_COLUMNS}))
NO_OVERRIDES = "ov AS (SELECT CAST(NULL AS VARCHAR) AS dataset, CAST(NULL AS VARCHAR) AS col_name, CAST(NULL AS VARCHAR) AS ov_target WHERE false)"
WORKER_OVERRIDES = S.overrides_values("workers_custom", WORKERS_OVERRIDES)
WORKERS_ONLY_CATALOG = S.catalog_values({"workers_custom": WORKERS_COLUMNS})
INFO_CATALOG = (
    "cat AS (SELECT table_name AS dataset, column_name AS col_name, CAST(ordinal_position - 1 AS INTEGER) AS col_ord "
    "FROM information_schema.columns WHERE table_name IN (" + ", ".join(S.q(t) for t in TABLES) + "))"
)
REQ = S.values_sql("req", "f, o", [(f, i) for i, f in enumerate(C.STANDARD_FEATURES)])

oracle(
    "schema_check",
    f"WITH {FIXTURE_CATALOG}, {REQ}, ds AS (SELECT DISTINCT dataset FROM cat), "
    "m AS (SELECT ds.dataset, count(*) AS n, string_agg(req.f, ', ' ORDER BY req.o) AS names FROM ds CROSS JOIN req "
    "WHERE NOT EXISTS (SELECT 1 FROM cat WHERE cat.dataset = ds.dataset AND cat.col_name = req.f) GROUP BY ds.dataset) "
    "SELECT ds.dataset, COALESCE(m.n, 0) = 0 AS is_standard, CAST(COALESCE(m.n, 0) AS INTEGER) AS missing_count, "
    "COALESCE(m.names, '') AS missing_features FROM ds LEFT JOIN m ON m.dataset = ds.dataset",
)
oracle("fuzzy_column_map", f"WITH {FIXTURE_CATALOG}, {WORKER_OVERRIDES}, {S.mapping_ctes()} SELECT * FROM mapping")
oracle("catalog_column_map", f"WITH {with_lake(INFO_CATALOG)}, {NO_OVERRIDES}, {S.mapping_ctes()} SELECT * FROM mapping")
FEATS = S.values_sql("feats", "target", [(f,) for f in C.STANDARD_FEATURES])
oracle(
    "string_similarity",
    f"WITH {FIXTURE_CATALOG}, {FEATS}, x AS (SELECT dataset, col_name, target, {S.clean_sql('col_name')} AS a, {S.clean_sql('target')} AS b "
    f"FROM cat CROSS JOIN feats) SELECT dataset, col_name, target, round({S.sim_sql('a', 'b')}, 9) AS similarity FROM x",
)
KW = S.values_sql("kw", "o, k, t, n", [(i, k, t, n) for i, (k, t, n) in enumerate(C.SUGGESTIONS)])
oracle(
    "suggest_mapping",
    f"WITH {FIXTURE_CATALOG}, {KW}, c AS (SELECT dataset, col_name, {S.clean_sql('col_name')} AS clean FROM cat), "
    f"hits AS (SELECT c.dataset, c.col_name, kw.o, kw.t, kw.n FROM c CROSS JOIN kw WHERE contains(c.clean, kw.k) "
    f"OR {S.sim_sql('c.clean', 'kw.k')} > {S.d(C.SUGGEST_THRESHOLD)}), "
    "first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, col_name ORDER BY o) AS rk FROM hits) WHERE rk = 1) "
    f"SELECT c.dataset, c.col_name, f.t AS suggested_target, COALESCE(f.n, {S.q(C.NO_SUGGESTION_NOTE)}) AS note "
    "FROM c LEFT JOIN first f ON f.dataset = c.dataset AND f.col_name = c.col_name",
)
DECISION = f"CASE WHEN m.kind IN ('mapped', 'label', 'id', 'dropped') THEN m.target ELSE {S.q(C.IGNORE)} END AS decision"
oracle("effective_mapping", f"WITH {FIXTURE_CATALOG}, {WORKER_OVERRIDES}, {S.mapping_ctes()} SELECT m.dataset, m.col_name, m.col_ord, {DECISION} FROM mapping m")
oracle(
    "override_table_map",
    f"WITH cat AS ({duckdb_sql(REPEATED_CATALOG_SQL)}), ov AS (SELECT dataset, raw_col AS col_name, target AS ov_target FROM ({duckdb_sql(OVERRIDE_TABLE_SQL)})), "
    f"{S.mapping_ctes()} SELECT m.*, {DECISION} FROM mapping m",
)

# Profile of an upload (custom layout without overrides; standard layout with its roles).
_NUMERIC_TYPES = "('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'HUGEINT', 'FLOAT', 'DOUBLE', 'UTINYINT', 'USMALLINT', 'UINTEGER', 'UBIGINT')"


def _types_cte(table: str, columns: list[str]) -> str:
    return "types AS (" + " UNION ALL ".join(
        f"SELECT {S.q(c)} AS c, {i} AS o, typeof(any_value({c})) AS t FROM {table}" for i, c in enumerate(columns)
    ) + ")"


_TYPES = _types_cte("workers", WORKERS_COLUMNS)


def profile_body(table: str, columns: list[str], is_standard: bool) -> str:
    """Given CTEs ``mapping`` (for this table only) and ``types``: the one-row profile."""
    nulls = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in columns)
    ncol = len(columns)
    missing_feats = "(30 - mapped - derived)"
    unknown_penalty = "0.0" if is_standard else f"CAST(unknown AS DOUBLE) / {ncol} * {S.d(C.PENALTY_UNKNOWN_SHARE)}"
    raw = (
        f"(100.0 - {missing_feats} * {S.d(C.PENALTY_PER_MISSING_FEATURE)} - missing_pct * {S.d(C.PENALTY_PER_MISSING_PCT)} "
        f"- {unknown_penalty})"
    )
    clamped = f"greatest(0.0, least(100.0, {raw}))"
    return (
        f"st AS (SELECT count(*) AS rows, sum({nulls}) AS missing FROM {table}), "
        "cnt AS (SELECT CAST(count(*) FILTER (WHERE kind = 'mapped') AS INTEGER) AS mapped, CAST(count(*) FILTER (WHERE kind = 'derive') AS INTEGER) AS derived, "
        "CAST(count(*) FILTER (WHERE kind = 'unknown') AS INTEGER) AS unknown FROM mapping), "
        "miss AS (SELECT COALESCE(string_agg(f, ', ' ORDER BY o), '') AS names FROM (SELECT f, o FROM req WHERE f NOT IN "
        "(SELECT target FROM mapping WHERE kind IN ('mapped', 'derive') AND target IS NOT NULL) ORDER BY o LIMIT 3)), "
        f"base AS (SELECT st.rows, {ncol} AS columns, st.missing / greatest(st.rows * {ncol}, 1) * 100.0 AS missing_pct, cnt.*, miss.names FROM st, cnt, miss), "
        f"qs AS (SELECT *, {clamped} AS clamped FROM base), "
        f"prof AS (SELECT rows, CAST(columns AS INTEGER) AS columns, round(missing_pct, 6) AS missing_pct, "
        f"(SELECT COALESCE(string_agg(c, ', ' ORDER BY o), '') FROM types WHERE t IN {_NUMERIC_TYPES}) AS numeric_columns, "
        f"(SELECT COALESCE(string_agg(c, ', ' ORDER BY o), '') FROM types WHERE t NOT IN {_NUMERIC_TYPES}) AS categorical_columns, "
        "mapped AS mapped_columns_count, derived AS derived_columns_count, unknown AS unknown_columns_count, "
        "CAST(round_even(clamped, 0) AS INTEGER) AS score, concat_ws(chr(10), "
        f"CASE WHEN {missing_feats} > 0 THEN {S.q(C.SUGGEST_MISSING_FEATURES.split('{}')[0])} || CAST({missing_feats} AS VARCHAR) || "
        f"{S.q(C.SUGGEST_MISSING_FEATURES.split('{}')[1])} || names END, "
        f"CASE WHEN missing_pct > {S.d(C.MISSING_PCT_WARN)} THEN {S.q(C.SUGGEST_MISSING_CELLS.split('{}')[0])} || printf('%.1f', round(missing_pct, 1)) || {S.q(C.SUGGEST_MISSING_CELLS.split('{}')[1])} END, "
        f"CASE WHEN unknown > 0 THEN {S.q(C.SUGGEST_UNKNOWN.split('{}')[0])} || CAST(unknown AS VARCHAR) || {S.q(C.SUGGEST_UNKNOWN.split('{}')[1])} END, "
        f"CASE WHEN clamped > {C.SCORE_EXCELLENT} THEN {S.q(C.SUGGEST_EXCELLENT)} WHEN clamped > {C.SCORE_GOOD} THEN {S.q(C.SUGGEST_GOOD)} ELSE {S.q(C.SUGGEST_POOR)} END"
        ") AS suggestions FROM qs)"
    )


from riskloom.plans.queries import STANDARD_ROLES  # noqa: E402

_WORKERS_PROFILE = f"{WORKERS_ONLY_CATALOG}, {NO_OVERRIDES}, {S.mapping_ctes()}, {REQ}, {_TYPES}, {profile_body('workers', WORKERS_COLUMNS, False)}"
_STANDARD_PROFILE = (
    f"{S.catalog_values({'employees': EMPLOYEES_COLUMNS})}, {S.overrides_values('employees', STANDARD_ROLES)}, {S.mapping_ctes()}, {REQ}, "
    f"{_types_cte('employees', EMPLOYEES_COLUMNS)}, {profile_body('employees', EMPLOYEES_COLUMNS, True)}"
)
oracle("profile_summary", f"WITH {S.EMP}, {S.WORKERS}, {_WORKERS_PROFILE} SELECT * FROM prof")
oracle("profile_summary_standard", f"WITH {S.EMP}, {_STANDARD_PROFILE} SELECT * FROM prof")
oracle(
    "quality_suggestions",
    f"WITH {S.EMP}, {S.WORKERS}, w AS (WITH {_WORKERS_PROFILE} SELECT suggestions FROM prof), "
    f"e AS (WITH {_STANDARD_PROFILE} SELECT suggestions FROM prof) "
    "SELECT 'workers_custom' AS dataset, CAST(i - 1 AS INTEGER) AS ord, s[i] AS suggestion FROM (SELECT string_split(suggestions, chr(10)) AS s FROM w), "
    "range(1, 10) r(i) WHERE i <= len(s) UNION ALL "
    "SELECT 'employees', CAST(i - 1 AS INTEGER), s[i] FROM (SELECT string_split(suggestions, chr(10)) AS s FROM e), range(1, 10) r(i) WHERE i <= len(s)",
)
oracle(
    "column_profile",
    f"WITH {S.EMP}, {S.WORKERS}, {_TYPES}, n AS (SELECT count(*) AS rows FROM workers), cnt AS ("
    + " UNION ALL ".join(f"SELECT {S.q(c)} AS col_name, {i} AS col_ord, count({c}) AS non_null FROM workers" for i, c in enumerate(WORKERS_COLUMNS))
    + f") SELECT cnt.col_name, cnt.col_ord, types.t IN {_NUMERIC_TYPES} AS is_numeric, cnt.non_null, n.rows - cnt.non_null AS nulls, "
    "cnt.non_null = 0 AS all_null, cnt.non_null < n.rows AS any_null FROM cnt JOIN types ON types.c = cnt.col_name CROSS JOIN n",
)

# Derivations on the custom upload (as_of fixed).
_AS_OF = f"DATE '{WORKERS_AS_OF}'"
_AGE = f"CAST(CAST(trunc(datediff('day', CAST(birth_date AS DATE), {_AS_OF}) / 365.25) AS INTEGER) AS DOUBLE)"
_TENURE = f"CAST(year({_AS_OF}) - year(CAST(hire_date AS DATE)) AS DOUBLE)"
_INCOME = "(TRY_CAST(CAST(annual_income AS VARCHAR) AS DOUBLE) / 12.0)"
_SURVEY_RAW = "TRY_CAST(CAST(happiness AS VARCHAR) AS DOUBLE)"
_SURVEY = f"(CASE WHEN (SELECT max({_SURVEY_RAW}) FROM workers) > 4 THEN round_even({_SURVEY_RAW} / (SELECT max({_SURVEY_RAW}) FROM workers) * 3.0 + 1.0, 0) ELSE {_SURVEY_RAW} END)"
oracle(
    "derive_features",
    f"WITH {S.EMP}, {S.WORKERS} SELECT emp_code, {_AGE} AS Age, {_SURVEY} AS JobSatisfaction, {_INCOME} AS MonthlyIncome, {_TENURE} AS YearsAtCompany FROM workers",
)

# Expected decisions for the custom fixture with the override fixture (FIXTURES.md §3).
EXPECTED_MAPPED = {
    "dept": "Department", "job_titel": "JobRole", "sex": "Gender", "over_time": "OverTime",
    "commute_distanse": "DistanceFromHome", "work_life_score": "WorkLifeBalance",
    "relationship_status": "MaritalStatus", "pay_grade": "JobLevel",
}
EXPECTED_DERIVED = {"Age": _AGE, "YearsAtCompany": _TENURE, "MonthlyIncome": _INCOME, "JobSatisfaction": _SURVEY}
_H = {t: r for r, t in EXPECTED_MAPPED.items()}
HARMONIZED = (
    "h AS (SELECT CAST(emp_code AS VARCHAR) AS _id, CAST(attrition AS VARCHAR) AS _label, "
    + ", ".join(f"{r} AS {t}" for r, t in EXPECTED_MAPPED.items())
    + ", " + ", ".join(f"{e} AS {t}" for t, e in EXPECTED_DERIVED.items())
    + " FROM workers)"
)
_PRESENT = list(EXPECTED_MAPPED.values()) + list(EXPECTED_DERIVED)
oracle(
    "harmonize",
    f"WITH {S.EMP}, {S.WORKERS}, {HARMONIZED} SELECT * FROM h",
)


def _default_sql(f):
    v = C.INTELLIGENT_DEFAULTS.get(f, 0)
    return S.q(v) if isinstance(v, str) else repr(v)


oracle(
    "impute_defaults",
    f"WITH {S.EMP}, {S.WORKERS}, {HARMONIZED} SELECT _id, "
    + ", ".join(
        (f"CAST(COALESCE({f}, {_default_sql(f)}) AS VARCHAR) AS {f}" if f in _PRESENT else f"CAST({_default_sql(f)} AS VARCHAR) AS {f}")
        for f in C.STANDARD_FEATURES
    )
    + " FROM h",
)


def _mode_sql(f: str) -> str:
    """Most frequent category of a history column, the first in order among equals."""
    return f"(SELECT {f} FROM employees WHERE {f} IS NOT NULL GROUP BY {f} ORDER BY count(*) DESC, {f} LIMIT 1)"


def _encoded_feature(f: str) -> str:
    """Lenient-encoded, mode- or median-imputed value of feature f in the harmonized upload ``h``."""
    if f in C.CATEGORICAL_FEATURES:
        value = f"COALESCE(CAST(h.{f} AS VARCHAR), {_mode_sql(f)})" if f in _PRESENT else _mode_sql(f)
        return f"COALESCE((SELECT code FROM dict WHERE dict.feature = {S.q(f)} AND dict.category = {value}), 0)"
    if f in _PRESENT:
        return f"COALESCE(TRY_CAST(CAST(COALESCE(CAST(h.{f} AS DOUBLE), med.{f}) AS VARCHAR) AS DOUBLE), 0.0)"
    return f"med.{f}"


PREPARED = "prep AS (SELECT h._id, h._label, " + ", ".join(
    f"CAST({_encoded_feature(f)} AS DOUBLE) AS {f}" for f in C.STANDARD_FEATURES
) + " FROM h CROSS JOIN med)"
oracle(
    "encode_categories",
    S.with_model(
        "SELECT _id, " + ", ".join(f"CAST({f} AS INTEGER) AS {f}" for f in C.CATEGORICAL_FEATURES) + " FROM prep",
        f"{S.WORKERS}, {HARMONIZED}, {PREPARED}",
    ),
)
oracle(
    "preprocess_custom",
    S.with_model(
        "SELECT _id, _label, " + ", ".join(f"round({f}, 9) AS {f}" for f in C.STANDARD_FEATURES) + " FROM prep",
        f"{S.WORKERS}, {HARMONIZED}, {PREPARED}",
    ),
)
oracle(
    "preprocess_standard",
    S.with_model("SELECT id, " + ", ".join(f"round({f}, 9) AS {f}" for f in C.STANDARD_FEATURES) + " FROM mfi"),
)
_CAT_PRESENT = [f for f in C.CATEGORICAL_FEATURES if f in _PRESENT]
oracle(
    "unknown_categories",
    S.with_model(
        "SELECT names.feature, CAST(count(u.category) AS BIGINT) AS unknown_count, "
        "COALESCE(array_to_string(list_slice(list_sort(list(u.category) FILTER (WHERE u.category IS NOT NULL)), 1, 8), ', '), '') AS unknown_shown "
        "FROM names LEFT JOIN u ON u.feature = names.feature GROUP BY names.feature",
        f"{S.WORKERS}, {HARMONIZED}, "
        + S.values_sql("names", "feature", [(f,) for f in _CAT_PRESENT])
        + ", obs AS (" + " UNION ".join(
            f"SELECT DISTINCT {S.q(f)} AS feature, CAST({f} AS VARCHAR) AS category FROM h WHERE {f} IS NOT NULL" for f in _CAT_PRESENT
        ) + "), u AS (SELECT * FROM obs WHERE NOT EXISTS (SELECT 1 FROM dict WHERE dict.feature = obs.feature AND dict.category = obs.category))",
    ),
)
_imputed_rows = []
for _f in C.STANDARD_FEATURES:
    if _f in C.CATEGORICAL_FEATURES:
        _imputed_rows.append(
            f"SELECT NULL AS raw_col, 'imputed' AS kind, {S.q(_f)} AS target, CAST(NULL AS DOUBLE) AS score, 'training mode (' || {_mode_sql(_f)} || ')' AS method"
            if _f not in _PRESENT
            else f"SELECT NULL, 'imputed', {S.q(_f)}, CAST(NULL AS DOUBLE), 'training mode for subset (' || {_mode_sql(_f)} || ')' WHERE (SELECT count({_f}) < count(*) FROM h)"
        )
    elif _f not in _PRESENT:
        _imputed_rows.append(f"SELECT NULL AS raw_col, 'imputed' AS kind, {S.q(_f)} AS target, CAST(NULL AS DOUBLE) AS score, "
                             f"'training median (' || CAST(med.{_f} AS VARCHAR) || ')' AS method FROM med")
    else:
        _imputed_rows.append(f"SELECT NULL, 'imputed', {S.q(_f)}, CAST(NULL AS DOUBLE), 'training median for subset (' || CAST(med.{_f} AS VARCHAR) || ')' "
                             f"FROM med WHERE (SELECT count({_f}) < count(*) FROM h)")
oracle(
    "mapping_report",
    S.with_model(
        "SELECT col_name AS raw_col, kind, target, score, method FROM mapping UNION ALL " + " UNION ALL ".join(_imputed_rows),
        f"{S.WORKERS}, {HARMONIZED}, {WORKERS_ONLY_CATALOG}, {WORKER_OVERRIDES}, {S.mapping_ctes()}",
    ),
)
oracle(
    "score_custom_upload",
    S.with_model(
        f"SELECT _id, PredictedAttritionRisk, {S.outcome_sql('PredictedAttritionRisk')} AS PredictedOutcome, "
        f"{S.bucket_sql('PredictedAttritionRisk')} AS RiskCategory FROM (SELECT _id, {S.score_sql(ENS)} AS PredictedAttritionRisk FROM prep)",
        f"{S.WORKERS}, {HARMONIZED}, {PREPARED}",
    ),
)
oracle(
    "percentile_vs_reference",
    S.with_model(
        "SELECT u._id, u.r AS PredictedAttritionRisk, round(COALESCE((SELECT max(c) FROM cum WHERE cum.r <= u.r), 0) / "
        "(SELECT count(*) FROM mfi) * 100.0, 9) AS percentile FROM up u",
        f"{S.WORKERS}, {HARMONIZED}, {PREPARED}, up AS (SELECT _id, {S.score_sql(ENS)} AS r FROM prep), "
        f"hist AS (SELECT {S.score_sql(ENS)} AS r, count(*) AS n FROM mfi GROUP BY 1), cum AS (SELECT r, sum(n) OVER (ORDER BY r) AS c FROM hist)",
    ),
)
oracle(
    "resolve_ids",
    f"WITH {S.EMP}, {S.WORKERS} SELECT emp_code, 'EMP-' || CAST(row_number() OVER (ORDER BY emp_code) + 1000 AS VARCHAR) AS EmployeeNumber FROM workers",
)

# --- explanations, assessments, reports ------------------------------------------------------

from riskloom.plans.queries import QUANTILES, SPARSE_FEATURES  # noqa: E402
from riskloom.sources.fixtures import FIXED_FOREST_NODES, SCENARIOS  # noqa: E402

_RANKED = (
    "rk AS (SELECT id, feature, round(phi, 12) + 0.0 AS p, "
    "row_number() OVER (PARTITION BY id ORDER BY abs(round(phi, 12)) DESC, feature) AS rank FROM phi)"
)
oracle(
    "explain_all",
    S.with_model("SELECT id, feature, round(p, 9) + 0.0 AS phi, CAST(rank AS INTEGER) AS rank FROM rk",
                 f"{S.contributions_ctes(ENS, 'mfi')}, {_RANKED}"),
)
_RAW_VALUES = "rv AS (" + " UNION ALL ".join(
    f"SELECT e.EmployeeNumber AS id, {S.q(f)} AS feature, COALESCE(CAST(e.{f} AS VARCHAR), CAST(m.{f} AS VARCHAR)) AS value "
    "FROM employees e JOIN mfi m ON m.id = e.EmployeeNumber"
    for f in C.STANDARD_FEATURES
) + ")"
_DIR = "CASE WHEN p > 0 THEN 'increases flight risk' ELSE 'decreases flight risk' END"
oracle(
    "explain_topk",
    S.with_model(
        f"SELECT rk.id, CAST(rk.rank AS INTEGER) AS rank, rk.feature, round(rk.p, 9) + 0.0 AS phi, rv.value, {_DIR} AS direction, "
        f"rk.feature || ' = ' || COALESCE(rv.value, '') || ' ' || {_DIR} || ' (impact: ' || {S.signed_sql('rk.p')} || ')' AS driver "
        f"FROM rk JOIN rv ON rv.id = rk.id AND rv.feature = rk.feature WHERE rk.rank <= {C.TOP_DRIVERS}",
        f"{S.contributions_ctes(ENS, 'mfi')}, {_RANKED}, {_RAW_VALUES}",
    ),
)
oracle(
    "global_explanations",
    S.with_model(
        "SELECT feature, round(avg(abs(p)), 9) AS mean_abs_phi, round(avg(p), 9) AS mean_phi, round(min(p), 9) AS min_phi, "
        "round(max(p), 9) AS max_phi, " + ", ".join(f"round(quantile_cont(p, {S.d(q)}), 9) AS q{round(100 * q):02d}_phi" for q in QUANTILES) + " FROM rk GROUP BY feature",
        f"{S.contributions_ctes(ENS, 'mfi')}, {_RANKED}",
    ),
)
oracle(
    "risk_report_text",
    S.with_model(
        "SELECT sc.id, 'employee_' || CAST(sc.id AS VARCHAR) || '_risk_report.txt' AS file_name, concat_ws(chr(10), "
        "'Employee: Employee ' || CAST(sc.id AS VARCHAR), 'Risk category: ' || " + S.bucket_sql("sc.s") + ", "
        "'Probability of leaving: ' || " + S.pct_sql("sc.s") + ", 'Probability of staying: ' || " + S.pct_sql("(1.0 - sc.s)") + ", "
        "'', 'Top personalized drivers:', dr.lines) AS report_text FROM sc JOIN dr ON dr.id = sc.id",
        f"{S.contributions_ctes(ENS, 'mfi')}, {_RANKED}, sc AS (SELECT id, {S.score_sql(ENS)} AS s FROM mfi), "
        f"dr AS (SELECT id, string_agg('- ' || feature || ': ' || {S.signed_sql('p')}, chr(10) ORDER BY rank) AS lines "
        f"FROM rk WHERE rank <= {C.TOP_DRIVERS} GROUP BY id)",
    ),
)
_SPARSE = "sp AS (SELECT id, " + ", ".join(
    (f"COALESCE(CAST({f} AS DOUBLE), 0.0) AS {f}" if f in SPARSE_FEATURES else f"0.0 AS {f}") for f in C.STANDARD_FEATURES
) + " FROM mf)"
oracle(
    "score_sparse_records",
    S.with_model(
        f"SELECT id, r AS PredictedAttritionRisk, {S.bucket_sql('r')} AS risk_level FROM (SELECT id, {S.score_sql(ENS)} AS r FROM sp)",
        _SPARSE,
    ),
)
oracle(
    "assess_risk",
    S.with_model(
        f"SELECT s.id, {S.bucket_sql('s.r')} AS risk_level, {S.pct_sql('s.r')} AS probability, f.txt AS top_factors "
        "FROM (SELECT id, " + S.score_sql(ENS) + " AS r FROM sp) s JOIN (SELECT id, string_agg(feature || ' (' || "
        "CASE WHEN p > 0 THEN 'increases' ELSE 'decreases' END || ' risk)', '; ' ORDER BY rank) AS txt FROM rk "
        f"WHERE rank <= {C.TOP_FACTORS} GROUP BY id) f ON f.id = s.id",
        f"{_SPARSE}, {S.contributions_ctes(ENS, 'sp')}, {_RANKED}",
    ),
)
_SC_KEYS = [k for k in SCENARIOS[0] if k != "scenario"]
_SCEN = S.values_sql("scen", "scenario, " + ", ".join(_SC_KEYS), [tuple(s[k] for k in ["scenario", *_SC_KEYS]) for s in SCENARIOS])
_WI = "wi AS (SELECT m.id, s.scenario, " + ", ".join(
    (f"COALESCE(CAST(s.{f} AS DOUBLE), m.{f}) AS {f}" if f in _SC_KEYS else f"m.{f}") for f in C.STANDARD_FEATURES
) + f", {S.score_sql(ENS, 'm.')} AS base_risk FROM mfi m CROSS JOIN scen s)"
oracle(
    "what_if",
    S.with_model(
        f"SELECT id, scenario, round(base_risk, 9) AS base_risk, round({S.score_sql(ENS)}, 9) AS risk, "
        f"round({S.score_sql(ENS)} - base_risk, 9) AS delta FROM wi",
        f"{_SCEN}, {_WI}",
    ),
)
_LP = f"lp AS (SELECT CASE Attrition WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS label, CAST(PredictedAttritionRisk > {S.d(C.DECISION_THRESHOLD)} AS INTEGER) AS pred FROM scored)"
oracle(
    "confusion_matrix",
    S.with_scored(
        ENS,
        "SELECT label, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1 "
        "FROM lp WHERE label IS NOT NULL GROUP BY label",
        _LP,
    ),
)


def _ratio(a, b):
    return f"(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END)"


_p0, _r0 = _ratio("tn", "(tn + fn)"), _ratio("tn", "(tn + fp)")
_p1, _r1 = _ratio("tp", "(tp + fp)"), _ratio("tp", "(tp + fn)")
_f0, _f1 = _ratio(f"2 * {_p0} * {_r0}", f"({_p0} + {_r0})"), _ratio(f"2 * {_p1} * {_r1}", f"({_p1} + {_r1})")
_s0, _s1, _n = "(tn + fp)", "(fn + tp)", "((tn + fp) + (fn + tp))"
_CM = (
    "cm AS (SELECT CAST(count(*) FILTER (WHERE label = 0 AND pred = 0) AS DOUBLE) AS tn, "
    "CAST(count(*) FILTER (WHERE label = 0 AND pred = 1) AS DOUBLE) AS fp, "
    "CAST(count(*) FILTER (WHERE label = 1 AND pred = 0) AS DOUBLE) AS fn, "
    "CAST(count(*) FILTER (WHERE label = 1 AND pred = 1) AS DOUBLE) AS tp FROM lp WHERE label IS NOT NULL)"
)
oracle(
    "classification_report",
    S.with_scored(
        ENS,
        "SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1_score, 9) AS f1_score, CAST(support AS BIGINT) AS support FROM ("
        f"SELECT 'Stayed' AS class, {_p0} AS precision, {_r0} AS recall, {_f0} AS f1_score, {_s0} AS support FROM cm UNION ALL "
        f"SELECT 'Left', {_p1}, {_r1}, {_f1}, {_s1} FROM cm UNION ALL "
        f"SELECT 'accuracy', NULL, NULL, {_ratio('(tn + tp)', _n)}, {_n} FROM cm UNION ALL "
        f"SELECT 'macro avg', ({_p0} + {_p1}) / 2, ({_r0} + {_r1}) / 2, ({_f0} + {_f1}) / 2, {_n} FROM cm UNION ALL "
        f"SELECT 'weighted avg', {_ratio(f'({_p0} * {_s0} + {_p1} * {_s1})', _n)}, {_ratio(f'({_r0} * {_s0} + {_r1} * {_s1})', _n)}, "
        f"{_ratio(f'({_f0} * {_s0} + {_f1} * {_s1})', _n)}, {_n} FROM cm)",
        f"{_LP}, {_CM}",
    ),
)

# --- sinks / streams --------------------------------------------------------------------------------

oracle(
    "sink_roundtrip",
    S.with_scored(ENS, "SELECT RiskCategory, count(*) AS n, round(avg(PredictedAttritionRisk), 9) AS avg_risk FROM scored GROUP BY RiskCategory"),
)
oracle("csv_roundtrip", f"WITH {S.EMP} SELECT * FROM employees")
oracle(
    "stream_scoring",
    S.with_scored(ENS, "SELECT EmployeeNumber, PredictedAttritionRisk, PredictedOutcome, RiskCategory FROM scored"),
)

# --- display frame and standard profile ------------------------------------------------------------

_DISPLAY_COLS = []
for _c in WORKERS_COLUMNS:
    _t = EXPECTED_MAPPED.get(_c)
    _name = _t if _t in C.DISPLAY_RENAMED else _c
    _DISPLAY_COLS.append(f"COALESCE(CAST({_c} AS VARCHAR), '-') AS {_name}")
_DISPLAY_COLS.append("COALESCE(CAST(emp_code AS VARCHAR), '-') AS EmployeeNumber")
_present_display = {EXPECTED_MAPPED.get(c) if EXPECTED_MAPPED.get(c) in C.DISPLAY_RENAMED else c for c in WORKERS_COLUMNS}
for _k, _v in C.INTELLIGENT_DEFAULTS.items():
    if _k in _present_display:
        continue
    if _k in EXPECTED_DERIVED:
        _DISPLAY_COLS.append(f"COALESCE(CAST({EXPECTED_DERIVED[_k]} AS VARCHAR), '-') AS {_k}")
    else:
        _DISPLAY_COLS.append(f"CAST({_default_sql(_k)} AS VARCHAR) AS {_k}")
oracle("display_frame", f"WITH {S.EMP}, {S.WORKERS} SELECT " + ", ".join(_DISPLAY_COLS) + " FROM workers")

# Split sizes are a function of the class sizes: ceil(0.2 x n) rows of each class go to test.
oracle(
    "stratified_split",
    S.with_model(
        f"SELECT 'test' AS split, Attrition, CAST(ceil(n * CAST({C.TEST_SHARE!r} AS DECIMAL(10, 6))) AS BIGINT) AS n FROM c UNION ALL "
        f"SELECT 'train', Attrition, CAST(n - ceil(n * CAST({C.TEST_SHARE!r} AS DECIMAL(10, 6))) AS BIGINT) FROM c",
        "c AS (SELECT Attrition, count(*) AS n FROM mfi GROUP BY Attrition)",
    ),
)

oracle(
    "fuzzy_column_map_strict",
    f"WITH {FIXTURE_CATALOG}, {WORKER_OVERRIDES}, {S.mapping_ctes(strict_reference=True)} SELECT * FROM mapping",
)

# --- further uploads, views and checks of the trained model ------------------------------------

oracle(
    "label_match_numeric",
    S.with_scored(ENS, "SELECT *, " + S.pct_sql("actual_rate") + " AS actual_rate_text, " + S.pct_sql("match_rate") + " AS match_rate_text FROM ("
    "SELECT count(*) AS labelled, round(avg(actual), 9) AS actual_rate, round(avg(CASE WHEN pred = actual THEN 1.0 ELSE 0.0 END), 9) AS match_rate FROM ("
    "SELECT CASE WHEN Attrition = 'Yes' THEN 1.0 ELSE 0.0 END AS actual, "
    f"CAST(CAST(PredictedAttritionRisk > {S.d(C.DECISION_THRESHOLD)} AS INTEGER) AS DOUBLE) AS pred FROM scored WHERE EmployeeNumber % 10 <> 0))"),
)
oracle("parse_dates", f"SELECT o_orderkey, CASE WHEN form < 11 THEN day END AS parsed, form >= 11 AS unparsed FROM ({duckdb_sql(DATE_TEXTS_SQL)})")
oracle("resolve_ids_named", f"WITH {S.EMP}, {S.WORKERS} SELECT emp_code, 'x' || emp_code AS EmployeeNumber FROM workers")
oracle("csv_hostile_text", "SELECT doc_id, text, lang, source, n_chars FROM documents")
oracle("scored_csv", S.with_scored(ENS, "SELECT * FROM scored"))
oracle("template_csv", f"WITH {S.EMP} SELECT * FROM employees ORDER BY EmployeeNumber LIMIT {C.TEMPLATE_ROWS}")
oracle(
    "sql_views",
    S.with_scored(
        ENS,
        "SELECT s.RiskCategory, count(*) AS n, round(avg(round(x.phi, 12)), 9) AS mean_overtime_phi FROM scored s JOIN phi x ON x.id = s.EmployeeNumber AND x.feature = 'OverTime' GROUP BY s.RiskCategory",
        S.contributions_ctes(ENS, "mfi"),
    ),
)
oracle(
    "profile_lookup",
    S.with_scored(
        ENS,
        "SELECT " + ", ".join(c for c in C.RESULT_VIEW_COLUMNS if c in [*EMPLOYEES_COLUMNS, "PredictedAttritionRisk", "PredictedOutcome", "RiskCategory"])
        + " FROM scored WHERE EmployeeNumber IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey)",
    ),
)
oracle(
    "filter_caption",
    S.with_scored(
        ENS,
        "SELECT matched, total, format('{:,}', matched) AS matched_text, format('{:,}', total) AS total_text FROM "
        f"(SELECT count(*) FILTER (WHERE Department = {S.q(FILTER_DEPARTMENT)}) AS matched, count(*) AS total FROM scored)",
    ),
)
oracle(
    "report_files",
    "SELECT replace(report_text, 'Employee: Employee ', 'Profile: employee_') AS report_text FROM (" + ORACLE["risk_report_text"] + ")",
)
_TEST_ROWS = f"ceil(count(*) * CAST({C.TEST_SHARE!r} AS DECIMAL(10, 6)))"
_SPLIT = (
    "sp AS (SELECT id, Attrition, CASE WHEN row_number() OVER (PARTITION BY Attrition ORDER BY "
    f"md5(CAST(id AS VARCHAR) || ':{C.SEED}'), id) <= n THEN 'test' ELSE 'train' END AS split "
    f"FROM mfi JOIN (SELECT Attrition AS a, {_TEST_ROWS} AS n FROM mfi GROUP BY 1) ON a IS NOT DISTINCT FROM Attrition)"
)
oracle("split_assignment", S.with_model("SELECT id, Attrition, split FROM sp", _SPLIT))
oracle("train_forest_check", S.with_model("SELECT id, Attrition, true AS has_probability, true AS agrees FROM sp WHERE split = 'test'", _SPLIT))
oracle("evaluate_model_check", S.with_model("SELECT count(*) AS rows, true AS matches_counts, true AS beats_guess FROM sp WHERE split = 'test'", _SPLIT))
oracle("feature_importance_check", f"SELECT CAST({len(C.STANDARD_FEATURES)} AS BIGINT) AS features, 1.0 AS total, true AS none_negative")
oracle("model_reload_check", S.with_model("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS mismatches FROM sp WHERE split = 'test'", _SPLIT))
oracle("explain_trained_check", S.with_model("SELECT count(*) AS rows, true AS closes FROM sp WHERE split = 'test'", _SPLIT))


def _visits(tree) -> list[tuple[int, str]]:
    """The SQL condition under which a row comes through each node."""
    out, stack = [], [(0, "true")]
    while stack:
        node, cond = stack.pop()
        out.append((node, cond))
        if tree.feature[node] >= 0:
            f, thr = ENS.features[tree.feature[node]], S.d(float(tree.threshold[node]))
            stack += [(int(tree.left[node]), f"{cond} AND {f} <= {thr}"), (int(tree.right[node]), f"{cond} AND NOT {f} <= {thr}")]
    return out


_NODES = S.values_sql("nd", "tree, node, feature, lft, rgt", [(t, n, f, lft, rgt) for t, n, f, _, lft, rgt, _, _ in FIXED_FOREST_NODES])
_NODE_COUNTS = "nc AS (" + " UNION ALL ".join(
    f"SELECT {t} AS tree, {n} AS node, CAST(count(*) AS DOUBLE) AS w, CAST(coalesce(sum(Attrition), 0) AS DOUBLE) AS p FROM mfi WHERE Attrition IS NOT NULL AND ({cond})"
    for t, tree in enumerate(ENS.trees) for n, cond in _visits(tree)
) + ")"
oracle(
    "forest_importance",
    S.with_model(
        "SELECT feature, round(share / sum(share) OVER (), 9) AS importance FROM (SELECT feature, sum(gain / total) AS share FROM "
        "(SELECT *, sum(gain) OVER (PARTITION BY tree) AS total FROM g) WHERE total > 0 GROUP BY feature)",
        f"{_NODES}, {_NODE_COUNTS}, im AS (SELECT tree, node, CASE WHEN w > 0 THEN w * (1 - (p / w) ** 2 - (1 - p / w) ** 2) ELSE 0 END AS i FROM nc), "
        "g AS (SELECT nd.tree, nd.feature, sum(a.i - b.i - c.i) AS gain FROM nd JOIN im a ON a.tree = nd.tree AND a.node = nd.node "
        "JOIN im b ON b.tree = nd.tree AND b.node = nd.lft JOIN im c ON c.tree = nd.tree AND c.node = nd.rgt WHERE nd.feature IS NOT NULL GROUP BY ALL)",
    ),
)
oracle("holdout_check", S.with_model("SELECT CASE Attrition WHEN 0 THEN 'Stayed' ELSE 'Left' END AS class, count(*) AS support, true AS agrees FROM sp WHERE split = 'test' AND Attrition IS NOT NULL GROUP BY 1", _SPLIT))
oracle("score_deep_forest_check", S.with_model("SELECT count(*) AS rows, true AS agrees, true AS deep FROM sp WHERE split = 'test'", _SPLIT))
_KIND = (
    "CASE WHEN t IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') THEN 'integer' WHEN t IN ('FLOAT', 'DOUBLE') OR t LIKE 'DECIMAL%' THEN 'float' "
    "WHEN t = 'VARCHAR' THEN 'text' WHEN t = 'DATE' OR t LIKE 'TIMESTAMP%' THEN 'date' ELSE 'other' END"
)
oracle(
    "column_kinds",
    f"WITH {S.EMP}, {S.WORKERS}, {_TYPES}, n AS (SELECT count(*) AS rows FROM workers), cnt AS ("
    + " UNION ALL ".join(f"SELECT {S.q(c)} AS c, count({c}) AS non_null FROM workers" for c in WORKERS_COLUMNS)
    + f") SELECT {_KIND} AS kind, count(*) AS columns, CAST(sum(non_null) AS BIGINT) AS non_null, CAST(sum(n.rows - non_null) AS BIGINT) AS nulls FROM cnt JOIN types USING (c) CROSS JOIN n GROUP BY 1",
)
_CODED = ["c_name", "c_mktsegment", "o_orderpriority"]
oracle(
    "encode_many_categories",
    "WITH o AS (SELECT o_orderkey, o_custkey, c_name, c_mktsegment, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey), "
    + ", ".join(f"d_{c} AS (SELECT {c} AS k, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT {c} FROM o WHERE o_custkey % 2 = 0 AND {c} IS NOT NULL))" for c in _CODED)
    + " SELECT o_orderkey, " + ", ".join(f"d_{c}.code AS {c}" for c in _CODED) + " FROM o " + " ".join(f"LEFT JOIN d_{c} ON d_{c}.k = o.{c}" for c in _CODED),
)

_ROW_TEXT = "lower(concat_ws(' ', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in [*EMPLOYEES_COLUMNS, "PredictedOutcome", "RiskCategory"]) + "))"
oracle(
    "search_files",
    S.with_scored(ENS, f"SELECT t.term, count(*) AS rows, true AS skipped FROM (SELECT DISTINCT Department AS term FROM scored WHERE Department IS NOT NULL) t JOIN scored ON contains({_ROW_TEXT}, lower(t.term)) GROUP BY t.term"),
)
_ONE_TREE = type(ENS)(ENS.features, ENS.trees[:1])
oracle(
    "kept_scores",
    S.with_model(
        "SELECT CAST(step AS INTEGER) AS step, reused, CASE WHEN step = 5 THEN n + n10 ELSE n END AS rows, "
        "round(CASE WHEN step <= 2 THEN whole WHEN step <= 4 THEN one ELSE one_more END, 9) AS avg_risk, CAST(1 AS INTEGER) AS versions "
        "FROM a CROSS JOIN (VALUES (1, false), (2, true), (3, false), (4, true), (5, false)) AS v(step, reused)",
        f"s AS (SELECT id, {S.score_sql(ENS)} AS p, {S.score_sql(_ONE_TREE)} AS q FROM mfi), "
        "a AS (SELECT count(*) AS n, count(*) FILTER (id % 10 = 0) AS n10, avg(p) AS whole, avg(q) AS one, "
        "(sum(q) + coalesce(sum(q) FILTER (id % 10 = 0), 0)) / (count(*) + count(*) FILTER (id % 10 = 0)) AS one_more FROM s)",
    ),
)
