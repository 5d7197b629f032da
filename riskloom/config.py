"""Configuration constants of the standard workforce-risk schema.

Everything below the "FIXED VALUES" marker must stay exactly as written: the
mapping, derivation, imputation, suggestion and bucketing results depend on
these names, words, numbers and their order (the order breaks ties).
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the reference behaviour, do not reorder.
# ---------------------------------------------------------------------------

# Standard feature -> alternative column names (dictionary order breaks ties).
STANDARD_ALIASES: dict[str, list[str]] = {
    "Age": ["age", "employeeage", "workerage", "currentage", "dob", "birthdate", "dateofbirth"],
    "BusinessTravel": ["businesstravel", "travel", "travelfrequency", "travelstatus"],
    "DailyRate": ["dailyrate", "dailyrate", "dayrate", "daily pay"],
    "Department": ["department", "dept", "departmentname", "team", "businessunit"],
    "DistanceFromHome": ["distancefromhome", "distance", "commute", "distfromhome", "commutedistance"],
    "Education": ["education", "educationlevel", "edu", "qualification"],
    "EducationField": ["educationfield", "field", "studyfield", "major", "specialization"],
    "EnvironmentSatisfaction": ["environmentsatisfaction", "envsatisfaction", "workenvironmentsatisfaction", "workplaceconditions"],
    "Gender": ["gender", "sex"],
    "HourlyRate": ["hourlyrate", "hourrate", "hourlypay"],
    "JobInvolvement": ["jobinvolvement", "involvement", "engagement", "jobengagement"],
    "JobLevel": ["joblevel", "grade", "level", "salaryband", "paygrade"],
    "JobRole": ["jobrole", "role", "designation", "position", "jobtitle"],
    "JobSatisfaction": ["jobsatisfaction", "employeesurvey", "satisfactionscore", "engagementscore", "happiness", "employeehappiness"],
    "MaritalStatus": ["maritalstatus", "marital", "status", "relationshipstatus"],
    "MonthlyIncome": ["monthlyincome", "salary", "income", "monthlysalary", "pay", "ctc", "annualincome", "yearlyincome", "annualsalary"],
    "MonthlyRate": ["monthlyrate", "monthrate"],
    "NumCompaniesWorked": ["numcompaniesworked", "companiesworked", "previouscompanies", "numbercompaniesworked"],
    "OverTime": ["overtime", "extrahours", "ot", "overtimehours"],
    "PercentSalaryHike": ["percentsalaryhike", "salaryhike", "hikepercent", "percenthike", "salaryraise"],
    "PerformanceRating": ["performancerating", "performance", "rating", "performancescore"],
    "RelationshipSatisfaction": ["relationshipsatisfaction", "relationsatisfaction", "peersatisfaction"],
    "StockOptionLevel": ["stockoptionlevel", "stockoptions", "equity", "stocklevel"],
    "TotalWorkingYears": ["totalworkingyears", "totalexperience", "experience", "workingyears"],
    "TrainingTimesLastYear": ["trainingtimeslastyear", "trainingtimes", "trainings", "traininghours"],
    "WorkLifeBalance": ["worklifebalance", "wlb", "worklifescore", "lifebalance"],
    "YearsAtCompany": ["yearsatcompany", "tenure", "yearsworked", "joindate", "hiredate", "datejoined", "companytenure"],
    "YearsInCurrentRole": ["yearsincurrentrole", "roleexperience", "yearsrole", "tenureinrole"],
    "YearsSinceLastPromotion": ["yearssincelastpromotion", "lastpromotion", "promotionyears", "yearssincepromotion"],
    "YearsWithCurrManager": ["yearswithcurrmanager", "manageryears", "yearsmanager", "tenurewithmanager"],
}

# Source columns from which a feature is derived instead of mapped.
DERIVATION_SOURCES: dict[str, list[str]] = {
    "Age": ["dob", "birthdate", "dateofbirth", "birth_date"],
    "YearsAtCompany": ["joindate", "hiredate", "datejoined", "join_date", "hire_date"],
    "MonthlyIncome": ["annualincome", "yearlyincome", "annualsalary", "annual_income", "yearly_income", "annual_salary"],
    "JobSatisfaction": ["employeesurvey", "satisfactionscore", "engagementscore", "happiness"],
}

# Derivation method labels, as reported.
DERIVATION_METHODS: dict[str, str] = {
    "YearsAtCompany": "CurrentYear - JoinYear",
    "Age": "CurrentDate - DOB",
    "MonthlyIncome": "AnnualIncome / 12",
    "JobSatisfaction": "Scaled score from survey",
}

# Fallback values when no training median is available.
INTELLIGENT_DEFAULTS: dict[str, object] = {
    "StockOptionLevel": 1,
    "JobLevel": 1,
    "BusinessTravel": "Travel_Rarely",
    "OverTime": "No",
    "EnvironmentSatisfaction": 3,
    "JobSatisfaction": 3,
    "WorkLifeBalance": 3,
    "PerformanceRating": 3,
    "JobInvolvement": 3,
    "Age": 35,
    "MonthlyIncome": 5000,
    "DistanceFromHome": 10,
    "YearsAtCompany": 5,
    "TotalWorkingYears": 8,
    "YearsInCurrentRole": 3,
    "YearsSinceLastPromotion": 1,
    "YearsWithCurrManager": 3,
    "DailyRate": 800,
    "HourlyRate": 65,
    "MonthlyRate": 15000,
    "NumCompaniesWorked": 1,
    "PercentSalaryHike": 12,
    "RelationshipSatisfaction": 3,
    "TrainingTimesLastYear": 2,
    "Education": 3,
    "Gender": "Male",
    "MaritalStatus": "Single",
    "EducationField": "Life Sciences",
    "Department": "Research & Development",
    "JobRole": "Sales Executive",
}

# Keyword -> (suggested target, note); first matching keyword wins.
SUGGESTIONS: list[tuple[str, str, str]] = [
    ("happiness", "JobSatisfaction", "Possibly JobSatisfaction"),
    ("employeehappiness", "JobSatisfaction", "Possibly JobSatisfaction"),
    ("satisfactionscore", "JobSatisfaction", "Satisfaction rating"),
    ("salaryband", "JobLevel", "Could relate to JobLevel or MonthlyIncome"),
    ("paygrade", "JobLevel", "Could relate to JobLevel or MonthlyIncome"),
    ("grade", "JobLevel", "Could relate to JobLevel"),
    ("level", "JobLevel", "Could relate to JobLevel"),
    ("tenure", "YearsAtCompany", "Could relate to YearsAtCompany"),
    ("yearsworked", "YearsAtCompany", "Could relate to YearsAtCompany"),
    ("experience", "TotalWorkingYears", "Could relate to TotalWorkingYears"),
    ("worklifescore", "WorkLifeBalance", "Could relate to WorkLifeBalance"),
    ("engagement", "JobInvolvement", "Could relate to JobInvolvement"),
    ("extrahours", "OverTime", "Could relate to OverTime"),
    ("ot", "OverTime", "Could relate to OverTime"),
]
NO_SUGGESTION_NOTE = "No strong heuristic match found"

# Columns dropped before modelling; label column and its values.
IGNORED_COLUMNS = ["EmployeeCount", "EmployeeNumber", "Over18", "StandardHours"]
LABEL = "Attrition"
LABEL_VALUES = {"Yes": 1, "No": 0}
ID_ROLE = "EmployeeNumber"
IGNORE = "Ignore"

# Lower-case column names recognised as a row identifier, in priority order of the table.
ID_COLUMN_NAMES = ["id", "empid", "employeename", "employeenumber", "employeenum", "number"]

# Similarity thresholds: automatic mapping (>=) and keyword suggestion (>).
AUTO_MAP_THRESHOLD = 0.8
SUGGEST_THRESHOLD = 0.75

# Risk thresholds: bucket upper bounds (inclusive) and the decision threshold (strict).
LOW_RISK_MAX = 0.30
MEDIUM_RISK_MAX = 0.70
DECISION_THRESHOLD = 0.50
LOW_RISK, MEDIUM_RISK, HIGH_RISK = "Low Risk", "Medium Risk", "High Risk"
LIKELY_LEAVE, LIKELY_STAY = "Likely to Leave", "Likely to Stay"
WILL_LEAVE, WILL_STAY = "Will Leave", "Will Stay"
STATUS_LEFT, STATUS_ACTIVE = "Left Company", "Currently Active (Stayed)"
TRUTHY_LABELS = ["yes", "1", "1.0"]

# Data-quality score weights.
PENALTY_PER_MISSING_FEATURE = 2.0
PENALTY_PER_MISSING_PCT = 1.5
PENALTY_UNKNOWN_SHARE = 15.0
MISSING_PCT_WARN = 5.0
SCORE_EXCELLENT = 85
SCORE_GOOD = 60

# Quality suggestion texts ({} are filled in).
SUGGEST_MISSING_FEATURES = "⚠️ {} required model features are missing and will be imputed using defaults. Consider adding columns for: {}"
SUGGEST_MISSING_CELLS = "📉 The dataset has {}% missing values. Ensure data completeness to reduce bias."
SUGGEST_UNKNOWN = "🔍 {} columns were not mapped. Use the column mapping utility to map them if they contain salary, age, or tenure data."
SUGGEST_EXCELLENT = "✅ Excellent dataset quality! Ready for accurate predictions."
SUGGEST_GOOD = "ℹ️ Good dataset quality, but some features are missing or need mapping."
SUGGEST_POOR = "⚠️ Poor dataset quality. High risk of prediction errors due to heavy imputation."

# Retention recommendation rules: feature, comparison, threshold, message.
RECOMMENDATION_RULES: list[tuple[str, str, float, str]] = [
    ("OverTime", "==", 1, "Reduce overtime burden to improve employee satisfaction."),
    ("WorkLifeBalance", "<=", 2, "Improve work-life balance through flexible policies."),
    ("StockOptionLevel", "==", 0, "Consider stock options or financial incentives."),
    ("YearsSinceLastPromotion", ">=", 3, "Review promotion and career growth opportunities."),
]
NO_CONCERNS = "No major retention concerns detected for this employee."

# Profile-shape fields (radar data), each divided by 4; needs at least 3 present.
PROFILE_SHAPE_FIELDS = [
    "JobSatisfaction",
    "EnvironmentSatisfaction",
    "RelationshipSatisfaction",
    "JobInvolvement",
    "WorkLifeBalance",
    "PerformanceRating",
]
PROFILE_SHAPE_SCALE = 4.0
PROFILE_SHAPE_MIN_FIELDS = 3

# Columns shown in result / history / profile views (kept if present).
RESULT_VIEW_COLUMNS = [
    "EmployeeNumber", "Age", "Department", "JobRole", "MonthlyIncome", "OverTime",
    "YearsAtCompany", "PredictedAttritionRisk", "RiskCategory", "PredictedOutcome",
]
HISTORY_VIEW_COLUMNS = [
    "EmployeeNumber", "Age", "Department", "JobRole", "MonthlyIncome", "OverTime",
    "YearsAtCompany", "Attrition", "PredictedAttritionRisk", "RiskCategory",
]
PROFILE_COLUMNS = [
    "Age", "Gender", "Department", "JobRole", "MonthlyIncome", "OverTime", "YearsAtCompany",
    "TotalWorkingYears", "JobSatisfaction", "EnvironmentSatisfaction", "WorkLifeBalance",
    "PerformanceRating",
]
# Standard targets whose raw column is renamed in the display frame.
DISPLAY_RENAMED = ["Age", "Gender", "Department", "JobRole", "MonthlyIncome", "YearsAtCompany", "OverTime"]

# Top-k sizes: drivers per profile, factors per assessment, highest-risk list, history list.
TOP_DRIVERS = 5
TOP_FACTORS = 3
HIGHEST_RISK_ROWS = 15
HISTORY_ROWS = 30
TEMPLATE_ROWS = 25
UNKNOWN_CATEGORIES_SHOWN = 8
MISSING_FEATURES_SHOWN = 3

# Model defaults: trees, seed, test share.
NUM_TREES = 100
SEED = 42
TEST_SHARE = 0.2

# ---------------------------------------------------------------------------
# Derived (not fixed) values
# ---------------------------------------------------------------------------

# The 30 standard features in dictionary order; this is also the model's input order.
STANDARD_FEATURES: list[str] = list(STANDARD_ALIASES)

# Categorical (text) standard features; the rest are numeric.
CATEGORICAL_FEATURES = [f for f in STANDARD_FEATURES if isinstance(INTELLIGENT_DEFAULTS.get(f), str)]
NUMERIC_FEATURES = [f for f in STANDARD_FEATURES if f not in CATEGORICAL_FEATURES]

# FIXED VALUES: report lines, driver wording, imputation sources.
REPORT_EMPLOYEE_TITLE = "Employee: "
REPORT_PROFILE_TITLE = "Profile: "
REPORT_CATEGORY = "Risk category: "
REPORT_LEAVING = "Probability of leaving: "
REPORT_STAYING = "Probability of staying: "
REPORT_DRIVERS = "Top personalized drivers:"
FLIGHT_RISK_UP = "increases flight risk"
FLIGHT_RISK_DOWN = "decreases flight risk"
FILLED_BY_MEDIAN = "training median"
FILLED_BY_MODE = "training mode"
FILLED_BY_DEFAULT = "intelligent default"
MISSING_COLUMNS_ERROR = "Uploaded dataset is missing required model columns: {}"
UNKNOWN_CATEGORIES_ERROR = "Column '{}' contains unknown categories: {}"
