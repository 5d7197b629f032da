"""Building blocks of the DuckDB oracle statements (plain SQL text).

They restate the semantics independently of the Spark code path: dictionary by
``row_number`` over sorted distinct values, exact ``median``, nested ``CASE``
per tree, ``cume_dist`` windows, cross joins with one-row aggregates.
"""

from __future__ import annotations

from riskloom import config as C
from riskloom.operators.forest import TreeEnsemble
from riskloom.sources.fixtures import EMPLOYEES_SQL, FIXED_FOREST_NODES, WORKERS_CUSTOM_SQL
from riskloom.sources.tables import duckdb_sql


def d(x: float) -> str:
    """A DOUBLE literal (DuckDB reads 0.5 as DECIMAL)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


EMP = f"employees AS ({duckdb_sql(EMPLOYEES_SQL)})"
WORKERS = f"workers AS ({duckdb_sql(WORKERS_CUSTOM_SQL)})"

DICT = "dict AS (SELECT feature, category, CAST(row_number() OVER (PARTITION BY feature ORDER BY category) - 1 AS INTEGER) AS code FROM (" + " UNION ".join(
    f"SELECT {q(f)} AS feature, CAST({f} AS VARCHAR) AS category FROM employees WHERE {f} IS NOT NULL"
    for f in C.CATEGORICAL_FEATURES
) + "))"


def _mf_select(src: str = "employees", alias: str = "e") -> str:
    cols = [f"{alias}.EmployeeNumber AS id"]
    joins = []
    for f in C.STANDARD_FEATURES:
        if f in C.CATEGORICAL_FEATURES:
            joins.append(f"LEFT JOIN dict d_{f} ON d_{f}.feature = {q(f)} AND d_{f}.category = {alias}.{f}")
            cols.append(f"d_{f}.code AS {f}")
        else:
            cols.append(f"{alias}.{f}")
    cols.append(f"CASE {alias}.Attrition WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS Attrition")
    return f"SELECT {', '.join(cols)} FROM {src} {alias} {' '.join(joins)}"


MF = f"mf AS ({_mf_select()})"
MED = "med AS (SELECT " + ", ".join(f"median({f}) AS {f}" for f in C.STANDARD_FEATURES) + " FROM mf)"
MFI = (
    "mfi AS (SELECT mf.id, "
    + ", ".join(f"COALESCE(CAST(mf.{f} AS DOUBLE), med.{f}) AS {f}" for f in C.STANDARD_FEATURES)
    + ", mf.Attrition FROM mf CROSS JOIN med)"
)


def tree_case(ens: TreeEnsemble, t: int, node: int = 0, prefix: str = "") -> str:
    tree = ens.trees[t]
    if tree.feature[node] < 0:
        return d(tree.value[node])
    f = ens.features[tree.feature[node]]
    return (
        f"(CASE WHEN {prefix}{f} <= {d(tree.threshold[node])} THEN {tree_case(ens, t, int(tree.left[node]), prefix)} "
        f"ELSE {tree_case(ens, t, int(tree.right[node]), prefix)} END)"
    )


def score_sql(ens: TreeEnsemble, prefix: str = "") -> str:
    parts = [tree_case(ens, t, 0, prefix) for t in range(len(ens.trees))]
    return "((" + " + ".join(parts) + f") / {d(len(ens.trees))})"


def bucket_sql(p: str) -> str:
    return (
        f"CASE WHEN {p} IS NULL THEN NULL WHEN {p} <= {d(C.LOW_RISK_MAX)} THEN {q(C.LOW_RISK)} "
        f"WHEN {p} <= {d(C.MEDIUM_RISK_MAX)} THEN {q(C.MEDIUM_RISK)} ELSE {q(C.HIGH_RISK)} END"
    )


def outcome_sql(p: str) -> str:
    return f"CASE WHEN {p} > {d(C.DECISION_THRESHOLD)} THEN {q(C.LIKELY_LEAVE)} ELSE {q(C.LIKELY_STAY)} END"


def pct_sql(p: str, decimals: int = 2) -> str:
    return f"printf('%.{decimals}f%%', round({p} * 100.0, {decimals}))"


def signed_sql(x: str, decimals: int = 4) -> str:
    return f"printf('%+.{decimals}f', round({x}, {decimals}) + 0.0)"


def scored_ctes(ens: TreeEnsemble) -> str:
    """CTEs employees, dict, mf, med, mfi, risk, scored."""
    risk = f"risk AS (SELECT id, {score_sql(ens)} AS PredictedAttritionRisk FROM mfi)"
    scored = (
        "scored AS (SELECT e.*, r.PredictedAttritionRisk, "
        f"{outcome_sql('r.PredictedAttritionRisk')} AS PredictedOutcome, {bucket_sql('r.PredictedAttritionRisk')} AS RiskCategory "
        "FROM employees e JOIN risk r ON e.EmployeeNumber = r.id)"
    )
    return ", ".join([EMP, DICT, MF, MED, MFI, risk, scored])


def with_scored(ens: TreeEnsemble, body: str, extra: str = "") -> str:
    ctes = scored_ctes(ens) + (f", {extra}" if extra else "")
    return f"WITH {ctes} {body}"


def with_model(body: str, extra: str = "") -> str:
    ctes = [EMP, DICT, MF, MED, MFI]
    if extra:
        ctes.append(extra)
    return "WITH " + ", ".join(ctes) + " " + body


def gauss_nodes_sql() -> str:
    """Two-point Gauss-Legendre on [0, 1] (exact for paths of up to 4 distinct features)."""
    return "g(t, w) AS (VALUES (0.5 - 0.5 / sqrt(3.0), 0.5), (0.5 + 0.5 / sqrt(3.0), 0.5))"


def leaf_conditions_sql() -> str:
    """CTEs ending in ``lc(tree, leaf, feature, lo, hi, z, c)`` for the fixed forest, found by
    SQL from its node table: the splits above each leaf, merged by feature. Its trees are at
    most three splits deep."""
    level = "SELECT s.tree, s.leaf, s.value, ed.parent AS at, ed.feature, ed.threshold, ed.is_left, ed.ratio FROM {} s JOIN ed ON ed.tree = s.tree AND ed.child = s.at"
    return ", ".join([
        values_sql("nd", "tree, node, feature, threshold, l, r, cover, value", FIXED_FOREST_NODES),
        "ed AS (SELECT c.tree, c.node AS child, p.node AS parent, p.feature, CAST(p.threshold AS DOUBLE) AS threshold, p.l = c.node AS is_left, "
        "CAST(c.cover AS DOUBLE) / CAST(p.cover AS DOUBLE) AS ratio FROM nd c JOIN nd p ON p.tree = c.tree AND (p.l = c.node OR p.r = c.node))",
        "lf AS (SELECT tree, node AS leaf, CAST(value AS DOUBLE) AS value, node AS at FROM nd WHERE feature IS NULL)",
        f"s1 AS ({level.format('lf')}), s2 AS ({level.format('s1')}), s3 AS ({level.format('s2')})",
        "lc AS (SELECT tree, leaf, feature, max(CASE WHEN NOT is_left THEN threshold END) AS lo, min(CASE WHEN is_left THEN threshold END) AS hi, "
        "product(ratio) AS z, value AS c FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) GROUP BY tree, leaf, feature, value)",
    ])


def contributions_ctes(ens: TreeEnsemble, frame: str = "mfi") -> str:
    """CTEs ending in ``phi(id, feature, phi)`` for every row of ``frame`` and every feature."""
    feats = sorted({f for _, _, f, *_ in FIXED_FOREST_NODES if f})
    unpivot = " UNION ALL ".join(f"SELECT id, {q(f)} AS feature, CAST({f} AS DOUBLE) AS x FROM {frame}" for f in feats)
    n_trees = len(ens.trees)
    parts = [
        leaf_conditions_sql(),
        gauss_nodes_sql(),
        f"fx AS ({unpivot})",
        "o AS (SELECT fx.id, lc.tree, lc.leaf, lc.feature, lc.z, lc.c, "
        "CASE WHEN (lc.lo IS NULL OR fx.x > lc.lo) AND (lc.hi IS NULL OR fx.x <= lc.hi) THEN 1.0 ELSE 0.0 END AS o "
        "FROM lc JOIN fx ON fx.feature = lc.feature)",
        "pg AS (SELECT a.id, a.tree, a.leaf, a.feature, g.t, g.w, "
        "COALESCE(product(b.o * g.t + b.z * (1 - g.t)), 1.0) AS prod "
        "FROM o a CROSS JOIN g LEFT JOIN o b ON b.id = a.id AND b.tree = a.tree AND b.leaf = a.leaf AND b.feature <> a.feature "
        "GROUP BY a.id, a.tree, a.leaf, a.feature, g.t, g.w)",
        "pl AS (SELECT a.id, a.tree, a.leaf, a.feature, a.c * (a.o - a.z) * sum(pg.w * pg.prod) AS v "
        "FROM o a JOIN pg ON pg.id = a.id AND pg.tree = a.tree AND pg.leaf = a.leaf AND pg.feature = a.feature "
        "GROUP BY a.id, a.tree, a.leaf, a.feature, a.c, a.o, a.z)",
        "fl(feature) AS (VALUES " + ", ".join(f"({q(f)})" for f in C.STANDARD_FEATURES) + ")",
        f"phi AS (SELECT r.id, fl.feature, COALESCE(s.v, 0.0) / {d(n_trees)} AS phi FROM {frame} r CROSS JOIN fl "
        "LEFT JOIN (SELECT id, feature, sum(v) AS v FROM pl GROUP BY id, feature) s ON s.id = r.id AND s.feature = fl.feature)",
    ]
    return ", ".join(parts)


# --- harmonisation -----------------------------------------------------------------------


def clean_sql(x: str) -> str:
    return f"regexp_replace(lower(COALESCE(CAST({x} AS VARCHAR), '')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def sim_sql(a: str, b: str) -> str:
    """Similarity of two already cleaned strings."""
    return (
        f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 WHEN {a} = {b} THEN 1.0 "
        f"ELSE 1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END)"
    )


def values_sql(name: str, cols: str, rows: list[tuple]) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return q(v)
        return repr(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({cols}) AS (VALUES {body})"


def catalog_values(tables: dict[str, list[str]]) -> str:
    rows = [(t, c, i) for t, cols in tables.items() for i, c in enumerate(cols)]
    return values_sql("cat", "dataset, col_name, col_ord", rows)


def overrides_values(dataset: str, overrides: dict[str, str]) -> str:
    rows = [(dataset, k, v) for k, v in overrides.items()] or [(None, None, None)]
    return values_sql("ov", "dataset, col_name, ov_target", rows)


def mapping_ctes(strict_reference: bool = False) -> str:
    """Given CTEs ``cat`` and ``ov``: CTEs ending in ``mapping(dataset, col_name, col_ord, kind, target, score, method)``.
    ``strict_reference``: derivation sources are plain aliases (no derive decisions)."""
    alias_rows = []
    for target, aliases in C.STANDARD_ALIASES.items():
        for name in [target, *aliases]:
            alias_rows.append((len(alias_rows), target, name))
    sources = [(target, s) for target, own in C.DERIVATION_SOURCES.items() for s in own]
    derive_rows = [(i, s, target) for i, (target, s) in enumerate(sources)]
    feats = "(" + ", ".join(q(f) for f in C.STANDARD_FEATURES) + ")"
    methods = "CASE derive_target " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in C.DERIVATION_METHODS.items()) + " END"
    return ", ".join([
        values_sql("al", "o, target, name", alias_rows),
        (
            "ds AS (SELECT CAST(NULL AS VARCHAR) AS dclean, CAST(NULL AS VARCHAR) AS derive_target WHERE false)"
            if strict_reference
            else values_sql("dl", "o, name, target", derive_rows)
            + f", ds AS (SELECT {clean_sql('name')} AS dclean, arg_min(target, o) AS derive_target FROM dl GROUP BY 1)"
        ),
        "ov2 AS (SELECT dataset, col_name, min(ov_target) AS ov_target, count(DISTINCT ov_target) > 1 AS several FROM ov GROUP BY dataset, col_name)",
        f"c AS (SELECT cat.dataset, cat.col_name, cat.col_ord, ov2.ov_target, coalesce(ov2.several, false) AS several, {clean_sql('cat.col_name')} AS clean "
        "FROM cat LEFT JOIN ov2 ON ov2.dataset = cat.dataset AND ov2.col_name = cat.col_name)",
        f"an AS (SELECT o, target, {clean_sql('name')} AS aclean FROM al)",
        f"sc AS (SELECT c.clean, an.o, an.target, {sim_sql('c.clean', 'an.aclean')} AS score FROM (SELECT DISTINCT clean FROM c) c CROSS JOIN an)",
        "best AS (SELECT clean, score, CASE WHEN score > 0 THEN target END AS best FROM "
        "(SELECT *, row_number() OVER (PARTITION BY clean ORDER BY score DESC, o) AS rk FROM sc) WHERE rk = 1)",
        f"c2 AS (SELECT c.*, b.score, b.best, ds.derive_target, NOT several AND ov_target IN ({', '.join(q(f) for f in [*C.STANDARD_FEATURES, C.LABEL, C.ID_ROLE])}) AS claims "
        "FROM c JOIN best b ON b.clean = c.clean LEFT JOIN ds ON ds.dclean = c.clean)",
        "claimed AS (SELECT dataset, ov_target AS best, min(col_ord) AS col_ord FROM c2 WHERE claims GROUP BY ALL)",
        f"auto AS (SELECT * FROM c2 WHERE ov_target IS NULL AND derive_target IS NULL AND score >= {d(C.AUTO_MAP_THRESHOLD)} "
        "AND NOT EXISTS (SELECT 1 FROM claimed k WHERE k.dataset = c2.dataset AND k.best = c2.best))",
        "auto_won AS (SELECT dataset, best, min(col_ord) AS col_ord FROM auto GROUP BY ALL)",
        "taken AS (SELECT dataset, best FROM claimed UNION SELECT dataset, best FROM auto_won)",
        "der AS (SELECT * FROM c2 WHERE ov_target IS NULL AND derive_target IS NOT NULL "
        "AND NOT EXISTS (SELECT 1 FROM taken k WHERE k.dataset = c2.dataset AND k.best = c2.derive_target))",
        "der_won AS (SELECT dataset, derive_target, min(col_ord) AS col_ord FROM der GROUP BY ALL)",
        "dec AS (SELECT c2.*, coalesce(claims AND k.col_ord IS NULL, false) AS late, "
        "CASE WHEN aw.col_ord IS NOT NULL THEN 'mapped' WHEN dw.col_ord IS NOT NULL THEN 'derive' END AS kind0 FROM c2 "
        "LEFT JOIN claimed k ON k.dataset = c2.dataset AND k.col_ord = c2.col_ord AND k.best = c2.ov_target "
        "LEFT JOIN auto_won aw ON aw.dataset = c2.dataset AND aw.col_ord = c2.col_ord "
        "LEFT JOIN der_won dw ON dw.dataset = c2.dataset AND dw.col_ord = c2.col_ord)",
        "mapping AS (SELECT dataset, col_name, col_ord, "
        f"CASE WHEN several OR late THEN 'conflict' WHEN ov_target = {q(C.IGNORE)} THEN 'ignored' WHEN ov_target IN {feats} THEN 'mapped' "
        f"WHEN ov_target = {q(C.LABEL)} THEN 'label' WHEN ov_target = {q(C.ID_ROLE)} THEN 'id' "
        "WHEN ov_target IS NOT NULL THEN 'dropped' WHEN kind0 IS NOT NULL THEN kind0 ELSE 'unknown' END AS kind, "
        f"CASE WHEN ov_target IS NOT NULL THEN (CASE WHEN NOT several AND ov_target <> {q(C.IGNORE)} THEN ov_target END) WHEN kind0 = 'derive' THEN derive_target "
        "ELSE best END AS target, round(score, 6) AS score, "
        f"CASE WHEN several THEN 'override: several targets' WHEN late THEN 'override: target taken' WHEN ov_target IS NOT NULL THEN 'override' WHEN kind0 = 'derive' THEN {methods} "
        "WHEN kind0 = 'mapped' THEN (CASE WHEN score >= 1.0 THEN 'exact' ELSE 'fuzzy' END) "
        "WHEN score > 0 THEN 'best below threshold or taken' END AS method FROM dec)",
    ])
