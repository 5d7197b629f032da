"""Column mapping: the fixture's documented verdicts, overrides, suggestions, similarity."""

import pytest

from riskloom import config as C
from riskloom.operators import mapping as MP
from riskloom.sources.fixtures import WORKERS_COLUMNS, WORKERS_OVERRIDES


def py_clean(s):
    return "".join(c for c in s.lower() if c.isalnum()) if isinstance(s, str) else ""


def py_lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def py_sim(a, b):
    a, b = py_clean(a), py_clean(b)
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    return 1.0 - py_lev(a, b) / max(len(a), len(b))


def decide(spark, overrides=None, columns=WORKERS_COLUMNS):
    cat = spark.createDataFrame([("w", c, i) for i, c in enumerate(columns)], "dataset string, col_name string, col_ord int")
    ov = MP.overrides_of(spark, "w", overrides)
    return {r["col_name"]: r for r in MP.map_columns(cat, ov).collect()}


def test_fixture_verdicts_without_overrides(spark):
    d = decide(spark)
    for col, target in [("birth_date", "Age"), ("hire_date", "YearsAtCompany"), ("annual_income", "MonthlyIncome"), ("happiness", "JobSatisfaction")]:
        assert d[col]["kind"] == "derive" and d[col]["target"] == target
    for col, target in [("dept", "Department"), ("sex", "Gender"), ("over_time", "OverTime"), ("work_life_score", "WorkLifeBalance"),
                        ("relationship_status", "MaritalStatus"), ("pay_grade", "JobLevel")]:
        assert (d[col]["kind"], d[col]["target"], d[col]["score"]) == ("mapped", target, 1.0)
    assert d["commute_distanse"]["kind"] == "mapped" and d["commute_distanse"]["score"] == pytest.approx(0.933333, abs=1e-6)
    assert d["job_titel"]["kind"] == "unknown" and d["job_titel"]["score"] == 0.75
    assert d["attrition"]["score"] == pytest.approx(0.555556, abs=1e-6)
    assert d["emp_code"]["score"] == pytest.approx(0.454545, abs=1e-6)
    assert d["badge_color"]["target"] == "YearsWithCurrManager" and d["badge_color"]["score"] == pytest.approx(1 / 3, abs=1e-6)


def test_fixture_overrides(spark):
    d = decide(spark, WORKERS_OVERRIDES)
    assert (d["job_titel"]["kind"], d["job_titel"]["target"]) == ("mapped", "JobRole")
    assert d["badge_color"]["kind"] == "ignored"
    assert d["emp_code"]["kind"] == "id" and d["attrition"]["kind"] == "label"


def test_first_claimant_wins_and_override_claims(spark):
    d = decide(spark, None, ["gender", "sex", "Gender_"])
    assert d["gender"]["kind"] == "mapped" and d["sex"]["kind"] == "unknown" and d["Gender_"]["kind"] == "unknown"
    d = decide(spark, {"x": "Gender"}, ["sex", "x"])
    assert d["x"]["kind"] == "mapped" and d["sex"]["kind"] == "unknown"


def test_two_overrides_to_one_target_rejected(spark):
    with pytest.raises(ValueError):
        MP.overrides_of(spark, "w", {"a": "Age", "b": "Age"})


def test_similarity_matches_python_reference(spark):
    from pyspark.sql import functions as F

    from riskloom.functions.expressions import levenshtein_similarity

    names = ["commute_distanse", "job_titel", "Attrition", "", "ÄrgerLevel", "emp-code", "x"]
    targets = list(C.STANDARD_ALIASES) + ["happiness", "dailyrate"]
    rows = [(a, b) for a in names for b in targets]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(levenshtein_similarity(F.col("a"), F.col("b"))).collect()]
    for (a, b), g in zip(rows, got):
        assert g == pytest.approx(py_sim(a, b), abs=1e-12)


def test_suggestions(spark):
    cat = spark.createDataFrame([("w", c, i) for i, c in enumerate(["OT_flag", "employee_happiness", "zzz", "salary band"])],
                                "dataset string, col_name string, col_ord int")
    got = {r["col_name"]: (r["suggested_target"], r["note"]) for r in MP.suggest_mapping(cat).collect()}
    assert got["OT_flag"][0] == "OverTime"
    assert got["employee_happiness"][0] == "JobSatisfaction"
    assert got["zzz"] == (None, C.NO_SUGGESTION_NOTE)
    assert got["salary band"][0] == "JobLevel"


def test_constant_cleaning_equals_spark_cleaning(spark):
    from pyspark.sql import functions as F

    from riskloom.functions.expressions import clean_string

    names = [n for _, _, n in MP._alias_entries()] + [k for k, _, _ in C.SUGGESTIONS]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(clean_string(F.col("n"))).collect()]
    assert got == spark.range(1).select(MP.cleaned(names)).first()[0]


def test_override_to_unknown_target_is_dropped_and_strict_mode(spark):
    d = decide(spark, {"x": "NotAFeature"}, ["x", "dob"])
    assert d["x"]["kind"] == "dropped" and d["x"]["target"] == "NotAFeature"
    assert (d["dob"]["kind"], d["dob"]["target"]) == ("derive", "Age")
    cat = spark.createDataFrame([("w", "dob", 0), ("w", "age", 1)], "dataset string, col_name string, col_ord int")
    strict = {r["col_name"]: r for r in MP.map_columns(cat, None, strict_reference=True).collect()}
    assert (strict["dob"]["kind"], strict["dob"]["target"]) == ("mapped", "Age")
    assert strict["age"]["kind"] == "unknown"  # first claimant (dob) took Age
    relaxed = {r["col_name"]: r for r in MP.map_columns(cat).collect()}
    assert relaxed["age"]["kind"] == "mapped" and relaxed["dob"]["kind"] == "unknown"  # Age mapped, no derivation


def test_repeated_names_and_overrides_from_a_table(spark):
    cat = spark.createDataFrame([("a", "age", 0), ("a", "age", 1), ("a", "x", 2), ("a", "y", 3), ("a", "z", 4), ("a", "w", 5), ("b", "x", 0)], "dataset string, col_name string, col_ord int")
    ov = spark.createDataFrame(
        [("a", "x", "Gender"), ("a", "y", "Gender"), ("a", "z", "Age"), ("a", "z", "JobLevel"), ("a", "w", "Ignore"), ("a", "w", "Ignore"), ("b", "x", "Attrition")],
        "dataset string, raw_col string, target string",
    )
    rows = {(r.dataset, r.col_ord): r for r in MP.map_columns(cat, ov).collect()}
    assert len(rows) == 7
    assert rows["a", 0].kind == "mapped" and rows["a", 1].kind == "unknown"
    assert (rows["a", 2].kind, rows["a", 2].target) == ("mapped", "Gender")
    assert (rows["a", 3].kind, rows["a", 3].method) == ("conflict", "override: target taken")
    assert (rows["a", 4].kind, rows["a", 4].target, rows["a", 4].method) == ("conflict", None, "override: several targets")
    assert rows["a", 5].kind == "ignored" and rows["b", 0].kind == "label"
    decided = {(r.dataset, r.col_ord): r.decision for r in MP.effective_mapping(MP.map_columns(cat, ov)).collect()}
    assert decided == {("a", 0): "Age", ("a", 1): "Ignore", ("a", 2): "Gender", ("a", 3): "Ignore", ("a", 4): "Ignore", ("a", 5): "Ignore", ("b", 0): "Attrition"}


def test_bounded_search_finds_the_first_best_entry(spark):
    """Over mistyped and foreign names: score and entry as by scoring all entries."""
    import random

    r = random.Random(8)
    names = [n for _, _, n in MP._alias_entries()] + ["", "Ärger", "zzz", "ab", "jobjobjob", "x" * 60]
    for n in list(names):
        x = list(n)
        for _ in range(r.randint(1, 6)):
            i = r.randrange(len(x) + 1)
            x[i : i + r.randint(0, 2)] = r.choice(["", "e", "qq", "Z", "é"])
        names.append("".join(x))
    cat = spark.createDataFrame([("d", n, i) for i, n in enumerate(names)], "dataset string, col_name string, col_ord int")
    got = {r.clean: (round(r.score, 9), r.best) for r in MP.scored_names(cat).collect()}
    for n in names:
        score, at = max(((py_sim(n, e), -i) for i, (_, _, e) in enumerate(MP._alias_entries())), key=lambda t: (round(t[0], 12), t[1]))
        assert got[py_clean(n)] == (round(score, 9), MP.ALIAS_TARGET[-at] if score > 0 else None)


def test_names_are_scored_once(spark):
    """One edit distance in the whole plan, none in the decisions."""
    import contextlib
    import io

    cat = spark.createDataFrame([("d", "age", 0)], "dataset string, col_name string, col_ord int")
    with contextlib.redirect_stdout(io.StringIO()) as out:
        MP.map_columns(cat).explain("extended")
    optimized = out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert sum("levenshtein" in line for line in optimized.splitlines()) == 1
