"""Fixture projections of the given tables into employee-style layouts.

The SQL text is written once with ``{table}`` placeholders: Spark receives the
DataFrames as ``spark.sql`` arguments, DuckDB receives the bare view names, so
both engines run the same statement.
"""

from __future__ import annotations

# Standard layout: one row per order (orders ⋈ customer ⋈ nation ⋈ region).
EMPLOYEES_SQL = """
SELECT CAST(o.o_orderkey AS BIGINT) AS EmployeeNumber,
 1 AS EmployeeCount, 'Y' AS Over18, 80 AS StandardHours,
 CAST(18 + (o.o_orderkey*7 + o.o_custkey) % 43 AS INT) AS Age,
 CASE o.o_orderstatus WHEN 'F' THEN 'Travel_Frequently' WHEN 'O' THEN 'Travel_Rarely' ELSE 'Non-Travel' END AS BusinessTravel,
 CAST(100 + (o.o_orderkey*13) % 1400 AS INT) AS DailyRate,
 c.c_mktsegment AS Department,
 CAST(1 + o.o_custkey % 29 AS INT) AS DistanceFromHome,
 CAST(1 + o.o_orderkey % 5 AS INT) AS Education,
 r.r_name AS EducationField,
 CAST(1 + (o.o_orderkey + o.o_custkey) % 4 AS INT) AS EnvironmentSatisfaction,
 CASE WHEN o.o_custkey % 5 < 2 THEN 'Female' ELSE 'Male' END AS Gender,
 CAST(30 + (o.o_orderkey*3) % 71 AS INT) AS HourlyRate,
 CAST(1 + (o.o_orderkey*5) % 4 AS INT) AS JobInvolvement,
 CAST(1 + o.o_custkey % 5 AS INT) AS JobLevel,
 o.o_orderpriority AS JobRole,
 CASE WHEN o.o_orderkey % 19 = 0 THEN NULL ELSE CAST(1 + (o.o_orderkey*3 + o.o_custkey) % 4 AS INT) END AS JobSatisfaction,
 CASE o.o_custkey % 3 WHEN 0 THEN 'Single' WHEN 1 THEN 'Married' ELSE 'Divorced' END AS MaritalStatus,
 CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE c.c_acctbal END AS MonthlyIncome,
 CAST(2000 + (o.o_orderkey*11) % 25000 AS INT) AS MonthlyRate,
 CAST(o.o_custkey % 10 AS INT) AS NumCompaniesWorked,
 CASE WHEN o.o_orderkey % 7 < 2 THEN 'Yes' ELSE 'No' END AS OverTime,
 CAST(11 + o.o_orderkey % 15 AS INT) AS PercentSalaryHike,
 CAST(3 + (o.o_custkey % 6) % 2 AS INT) AS PerformanceRating,
 CAST(1 + (o.o_orderkey*7) % 4 AS INT) AS RelationshipSatisfaction,
 CAST(o.o_custkey % 4 AS INT) AS StockOptionLevel,
 CAST((o.o_orderkey + o.o_custkey) % 41 AS INT) AS TotalWorkingYears,
 CAST(o.o_orderkey % 7 AS INT) AS TrainingTimesLastYear,
 CAST(1 + (o.o_custkey*3) % 4 AS INT) AS WorkLifeBalance,
 CAST(2002 - year(o.o_orderdate) AS INT) AS YearsAtCompany,
 CAST(o.o_orderkey % 8 AS INT) AS YearsInCurrentRole,
 CAST(o.o_custkey % 16 AS INT) AS YearsSinceLastPromotion,
 CAST(o.o_custkey % 9 AS INT) AS YearsWithCurrManager,
 CASE WHEN (CASE WHEN o.o_orderkey % 7 < 2 THEN 3 ELSE 0 END)
   + (CASE WHEN c.c_acctbal < 1000 THEN 3 ELSE 0 END)
   + (CASE WHEN o.o_custkey % 4 = 0 THEN 2 ELSE 0 END)
   + (o.o_orderkey*31 + o.o_custkey*17) % 4 >= 6 THEN 'Yes' ELSE 'No' END AS Attrition
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
 JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

# Unfamiliar layout derived from the standard one (use as_of 2002-01-01).
WORKERS_CUSTOM_SQL = """
SELECT CONCAT('W', CAST(EmployeeNumber AS VARCHAR(20))) AS emp_code,
 make_date(CAST(2002 - Age AS INT), CAST(1 + EmployeeNumber % 12 AS INT), CAST(1 + EmployeeNumber % 28 AS INT)) AS birth_date,
 make_date(CAST(2002 - YearsAtCompany AS INT), 6, 15) AS hire_date,
 CASE WHEN EmployeeNumber % 29 = 0 THEN NULL WHEN EmployeeNumber % 31 = 0 THEN 'ROBOTICS' ELSE Department END AS dept,
 JobRole AS job_titel, CASE WHEN EmployeeNumber % 37 = 0 THEN NULL ELSE Gender END AS sex,
 MonthlyIncome * 12 AS annual_income, OverTime AS over_time,
 DistanceFromHome AS commute_distanse,
 CASE WHEN EmployeeNumber % 23 = 0 THEN 'n/a' ELSE CAST(1 + EmployeeNumber % 10 AS VARCHAR(4)) END AS happiness,
 WorkLifeBalance AS work_life_score,
 CASE WHEN EmployeeNumber % 41 = 0 THEN CONCAT('Status-', CAST(EmployeeNumber % 11 AS VARCHAR(4))) ELSE MaritalStatus END AS relationship_status,
 JobLevel AS pay_grade, EmployeeNumber % 1000 AS badge_color, Attrition AS attrition
FROM {employees}
"""

WORKERS_AS_OF = "2002-01-01"
WORKERS_ID_COLUMN = "emp_code"

# Override fixture for the custom layout: raw column -> target (or role).
WORKERS_OVERRIDES: dict[str, str] = {
    "job_titel": "JobRole",
    "badge_color": "Ignore",
    "emp_code": "EmployeeNumber",
    "attrition": "Attrition",
}

# What-if scenarios: feature overrides on the encoded model frame (None = unchanged).
SCENARIOS: list[dict] = [
    {"scenario": "no_overtime", "OverTime": 0.0, "StockOptionLevel": None, "WorkLifeBalance": None, "MonthlyIncome": None},
    {"scenario": "grant_stock", "OverTime": None, "StockOptionLevel": 2.0, "WorkLifeBalance": None, "MonthlyIncome": None},
    {"scenario": "raise", "OverTime": None, "StockOptionLevel": None, "WorkLifeBalance": None, "MonthlyIncome": 6500.0},
    {"scenario": "all", "OverTime": 0.0, "StockOptionLevel": 2.0, "WorkLifeBalance": 4.0, "MonthlyIncome": 6500.0},
]

# Fixed 3-tree forest (literal node table): tree, node, feature, threshold, left, right, cover, value.
FIXED_FOREST_NODES: list[tuple] = [
    (0, 0, "OverTime", 0.5, 1, 2, 1000.0, None),
    (0, 1, "MonthlyIncome", 1000.0, 3, 4, 710.0, None),
    (0, 2, "StockOptionLevel", 0.5, 5, 6, 290.0, None),
    (0, 3, None, None, None, None, 130.0, 0.30),
    (0, 4, None, None, None, None, 580.0, 0.08),
    (0, 5, None, None, None, None, 75.0, 0.80),
    (0, 6, None, None, None, None, 215.0, 0.45),
    (1, 0, "MonthlyIncome", 2500.0, 1, 2, 1000.0, None),
    (1, 1, "OverTime", 0.5, 3, 4, 320.0, None),
    (1, 2, "MonthlyIncome", 6000.0, 5, 6, 680.0, None),
    (1, 3, None, None, None, None, 230.0, 0.35),
    (1, 4, None, None, None, None, 90.0, 0.75),
    (1, 5, None, None, None, None, 390.0, 0.20),
    (1, 6, None, None, None, None, 290.0, 0.10),
    (2, 0, "StockOptionLevel", 0.5, 1, 2, 1000.0, None),
    (2, 1, "OverTime", 0.5, 3, 4, 250.0, None),
    (2, 2, "JobSatisfaction", 2.5, 5, 6, 750.0, None),
    (2, 3, None, None, None, None, 180.0, 0.40),
    (2, 4, "MonthlyIncome", 3000.0, 7, 8, 70.0, None),
    (2, 5, None, None, None, None, 380.0, 0.25),
    (2, 6, None, None, None, None, 370.0, 0.10),
    (2, 7, None, None, None, None, 40.0, 0.90),
    (2, 8, None, None, None, None, 30.0, 0.70),
]

# Column lists of the two fixture layouts (checked against the Spark schemas in tests).
EMPLOYEES_COLUMNS = [
    "EmployeeNumber", "EmployeeCount", "Over18", "StandardHours", "Age", "BusinessTravel", "DailyRate",
    "Department", "DistanceFromHome", "Education", "EducationField", "EnvironmentSatisfaction", "Gender",
    "HourlyRate", "JobInvolvement", "JobLevel", "JobRole", "JobSatisfaction", "MaritalStatus", "MonthlyIncome",
    "MonthlyRate", "NumCompaniesWorked", "OverTime", "PercentSalaryHike", "PerformanceRating",
    "RelationshipSatisfaction", "StockOptionLevel", "TotalWorkingYears", "TrainingTimesLastYear",
    "WorkLifeBalance", "YearsAtCompany", "YearsInCurrentRole", "YearsSinceLastPromotion",
    "YearsWithCurrManager", "Attrition",
]
WORKERS_COLUMNS = [
    "emp_code", "birth_date", "hire_date", "dept", "job_titel", "sex", "annual_income", "over_time",
    "commute_distanse", "happiness", "work_life_score", "relationship_status", "pay_grade", "badge_color",
    "attrition",
]

# Column names as they occur in a lake of small datasets: 25 rows of ``part`` make one
# dataset, each row one column, named by a known name (some mistyped) or by the part.
LAKE_NAMES = [
    "Age", "BusinessTravel", "daily_rate", "Department", "Distance From Home", "Education", "EducationField", "EnvironmentSatisfaction", "Gendr", "HourlyRate",
    "JobInvolvement", "Job Level", "job_titel", "JobSatisfaction", "MaritalStatus", "monthly income", "MonthlyRate", "NumCompaniesWorkd", "OverTime", "PercentSalaryHike",
    "PerformanceRating", "RelationshipSatisfaction", "StockOptionLevel", "TotalWorkingYears", "TrainingTimesLastYear", "WorkLifeBalance", "YearsAtCompany", "YearsInCurrentRole", "YearsSinceLastPromotion", "YearsWithCurrManager",
    "birth_date", "hire_date", "annual_income", "dept", "salary", "emp_id", "attrition", "happiness", "sex", "ovr time",
]
LAKE_CATALOG_SQL = """
SELECT CONCAT('set-', CAST(p.p_partkey - p.p_partkey % 25 AS VARCHAR(20))) AS dataset,
 CASE WHEN p.p_size % 3 = 0 THEN CONCAT(REPLACE(p.p_name, ' ', '_'), '_', CAST(p.p_partkey AS VARCHAR(20)))
  WHEN p.p_size % 7 = 0 THEN REPLACE(v.name, 'a', 'aa') ELSE v.name END AS col_name,
 CAST(p.p_partkey % 25 AS INT) AS col_ord
FROM {part} p JOIN (VALUES """ + ", ".join(f"({i}, '{n}')" for i, n in enumerate(LAKE_NAMES)) + """) AS v(i, name) ON v.i = (p.p_partkey * 7) % 40
"""

# The same lake with names that a dataset repeats, and a table of overrides as users of many
# datasets leave it: some give two columns one target, some give one column two.
REPEATED_CATALOG_SQL = """
SELECT l.dataset, CASE WHEN p.p_size % 9 = 0 THEN 'age' WHEN p.p_size % 8 = 0 THEN 'Daily Rate' ELSE l.col_name END AS col_name, l.col_ord
FROM (""" + LAKE_CATALOG_SQL + """) l JOIN {part} p ON CONCAT('set-', CAST(p.p_partkey - p.p_partkey % 25 AS VARCHAR(20))) = l.dataset AND p.p_partkey % 25 = l.col_ord
"""
OVERRIDE_TARGETS = ["Age", "Gender", "JobLevel", "Attrition", "Ignore", "NotAFeature", "EmployeeNumber", "DailyRate"]
OVERRIDE_TABLE_SQL = """
SELECT c.dataset, c.col_name AS raw_col, v.target
FROM (""" + REPEATED_CATALOG_SQL + """) c JOIN (VALUES """ + ", ".join(f"({i}, '{t}')" for i, t in enumerate(OVERRIDE_TARGETS)) + """) AS v(i, target)
ON v.i = (c.col_ord * 5 + LENGTH(c.dataset)) % 8 OR (c.col_ord = 7 AND v.i = 2) WHERE c.col_ord % 3 = 1
"""

# Order dates as uploads write them; two of the forms are no dates.
DATE_TEXTS_SQL = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey % 13 AS INT) AS form,
 CASE o_orderkey % 13
  WHEN 0 THEN CONCAT(y, '-', mm, '-', dd) WHEN 1 THEN CONCAT(y, '-', mm, '-', dd, 'T10:00:00') WHEN 2 THEN CONCAT(mon, ' ', d, ', ', y)
  WHEN 3 THEN CONCAT(dd, '-', mon, '-', y) WHEN 4 THEN CONCAT(y, '-', m, '-', d) WHEN 5 THEN CONCAT(m, '/', d, '/', y)
  WHEN 6 THEN CONCAT(y, '-', mm, '-', dd, ' 10:00') WHEN 7 THEN CONCAT(y, mm, dd) WHEN 8 THEN CONCAT(dd, '.', mm, '.', y)
  WHEN 9 THEN CONCAT(y, '/', mm, '/', dd) WHEN 10 THEN CONCAT(m, '/', d, '/', y, ' 1:05 PM') WHEN 11 THEN 'soon' ELSE CONCAT(y, '-13-45') END AS text
FROM (SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS VARCHAR(4)) AS y, CAST(month(o_orderdate) AS VARCHAR(2)) AS m, CAST(day(o_orderdate) AS VARCHAR(2)) AS d,
 LPAD(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0') AS mm, LPAD(CAST(day(o_orderdate) AS VARCHAR(2)), 2, '0') AS dd,
 CASE month(o_orderdate) WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'Mar' WHEN 4 THEN 'Apr' WHEN 5 THEN 'May' WHEN 6 THEN 'Jun'
  WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug' WHEN 9 THEN 'Sep' WHEN 10 THEN 'Oct' WHEN 11 THEN 'Nov' ELSE 'Dec' END AS mon FROM {orders}) t
"""
