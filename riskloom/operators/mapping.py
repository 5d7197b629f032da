"""Schema harmonisation as a relational job over a catalog of column names.

Input is a table ``(dataset, col_name, col_ord)`` (any number of uploaded
tables) plus optional overrides ``(dataset, raw_col, target)``. Every distinct
cleaned name is scored once against the alias dictionary, a fixed-size literal: the
search keeps the best score so far and runs the edit distance only where an upper
bound of the similarity, from lengths and letter counts, beats it. The "one claimant
per target" rule is one window over (dataset, target), whose groups are at most
one table's columns; columns are told apart by their order, so a table may repeat
a name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.functions.expressions import clean_string, similarity_of_clean

ROLE_TARGETS = {C.LABEL: "label", C.ID_ROLE: "id"}


def catalog_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, col_name, col_ord) from DataFrame schemas."""
    rows = [(name, c, i) for name, df in tables.items() for i, c in enumerate(df.columns)]
    return spark.createDataFrame(rows, "dataset string, col_name string, col_ord int")


def overrides_of(spark: SparkSession, dataset: str, overrides: dict[str, str] | None) -> DataFrame:
    rows = [(dataset, raw, tgt) for raw, tgt in (overrides or {}).items()]
    df = spark.createDataFrame(rows, "dataset string, raw_col string, target string")
    dup = [t for t in set(v for v in (overrides or {}).values()) if t in C.STANDARD_FEATURES]
    for t in dup:
        if sum(1 for v in overrides.values() if v == t) > 1:
            raise ValueError(f"Two raw columns are overridden to the same target: {t}")
    return df


def _alias_entries() -> list[tuple[int, str, str]]:
    """(ord, target, name) in dictionary order: each target's own name, then its aliases."""
    out = []
    for target, aliases in C.STANDARD_ALIASES.items():
        for name in [target, *aliases]:
            out.append((len(out), target, name))
    return out


def cleaned(names: Sequence[str]) -> Column:
    """Array of the cleaned names; constant, so the optimizer folds it."""
    return F.array(*[clean_string(F.lit(n)) for n in names])


_ENTRIES = _alias_entries()
ALIAS_TARGET = [t for _, t, _ in _ENTRIES]


def letter_masks(name: str) -> tuple[int, int]:
    """Bits of the letters (code point modulo 32) that occur once or more, and twice or more."""
    once = twice = 0
    for c in name:
        bit = 1 << ord(c) % 32
        twice |= once & bit
        once |= bit
    return once, twice


def letter_masks_of(clean: Column) -> Column:
    """The same as struct(once, twice) of a text column."""

    def add(seen: Column, letter: Column) -> Column:
        # by name: a shift by a column
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(letter), F.lit(32)))
        return F.struct(seen["once"].bitwiseOR(bit).alias("once"), seen["twice"].bitwiseOR(seen["once"].bitwiseAND(bit)).alias("twice"))

    none = F.struct(F.lit(0).cast("long").alias("once"), F.lit(0).cast("long").alias("twice"))
    return F.aggregate(F.filter(F.split(clean, ""), lambda c: c != ""), none, add)


def best_target(clean: Column, masks: Column) -> Column:
    """struct(score, at): highest similarity over every name and alias and the place of the first
    entry that has it (0 if none is similar). Letters that one name has and the other has not,
    counted up to two each, and the difference of the lengths are edits at least."""
    rows = [(plain := python_clean(name), len(plain), *letter_masks(plain), i + 1) for i, (_, _, name) in enumerate(_ENTRIES)]
    # as one text: building hundreds of literals call by call takes longer than the search
    entries = F.expr("array(" + ", ".join(f"named_struct('name', '{n}', 'size', {k}, 'once', {x}L, 'twice', {y}L, 'at', {i})" for n, k, x, y, i in rows) + ")")

    def more(a: Column, b: Column) -> Column:
        lacking = [F.bit_count(a[k].bitwiseAND(F.bitwise_not(b[k]))) for k in ("once", "twice")]
        return lacking[0] + lacking[1]

    def better(best: Column, e: Column) -> Column:
        longer = F.greatest(F.length(clean), e["size"])
        edits = F.greatest(F.abs(F.length(clean) - e["size"]), more(masks, e), more(e, masks))
        # the edit distance is not looked for beyond what would still be better
        enough = F.floor((F.lit(1.0) - best["score"]) * longer).cast("int") + 1
        distance = F.call_function("levenshtein", clean, e["name"], enough)
        score = F.when((F.length(clean) > 0) & (F.lit(1.0) - edits / longer > best["score"]) & (distance >= 0), F.lit(1.0) - distance / longer)
        return F.when(score > best["score"], F.struct(score.alias("score"), e["at"].alias("at"))).otherwise(best)

    return F.aggregate(entries, F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("at")), better)


def python_clean(name: str) -> str:
    """``clean_string`` of a constant."""
    return "".join(c for c in name.lower() if c.isalnum())


def scored_names(catalog: DataFrame) -> DataFrame:
    """clean, score and best target of each distinct cleaned name."""
    n = int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # narrow rows with much work each: a stated number of partitions is not coalesced
    names = catalog.select(clean_string(F.col("col_name")).alias("clean")).repartition(n, "clean").distinct()
    found = names.withColumn("_masks", letter_masks_of(F.col("clean"))).withColumn("_best", best_target(F.col("clean"), F.col("_masks")))
    targets = F.expr("array(" + ", ".join(f"'{t}'" for t in ALIAS_TARGET) + ")")
    return found.select("clean", F.col("_best.score").alias("score"), F.when(F.col("_best.score") > 0, F.element_at(targets, F.col("_best.at"))).alias("best"))


def derivation_target(clean: Column) -> Column:
    """Target that a cleaned source name derives; the first one that lists the name."""
    entries = [(s, target) for target, sources in C.DERIVATION_SOURCES.items() for s in sources]
    position = F.array_position(cleaned([s for s, _ in entries]), clean)
    return F.when(position > 0, F.element_at(F.array(*[F.lit(t) for _, t in entries]), position.cast("int")))


def settled_overrides(overrides: DataFrame) -> DataFrame:
    """dataset, col_name, ov_target and whether the table gives the column several targets; repeated
    rows are one."""
    per = overrides.groupBy("dataset", F.col("raw_col").alias("col_name")).agg(F.min("target").alias("ov_target"), F.max("target").alias("_last"))
    return per.select("dataset", "col_name", "ov_target", (F.col("ov_target") != F.col("_last")).alias("ov_several"))


def map_columns(catalog: DataFrame, overrides: DataFrame | None = None, strict_reference: bool = False) -> DataFrame:
    """Mapping decisions for every catalog column:
    (dataset, col_name, col_ord, kind, target, score, method).

    kind: mapped | derive | ignored | label | id | dropped | unknown | conflict.
    A target goes to one column of a dataset: to an override before a name that is similar
    enough, to that before a derivation, and among equals to the first column. An override
    whose target another override has taken is a ``conflict``, and so is a column that the
    table of overrides gives several targets (it claims none of them).
    ``strict_reference=True`` treats derivation sources as plain aliases (reference quirk)."""
    spark = catalog.sparkSession
    if overrides is None:
        overrides = spark.createDataFrame([], "dataset string, raw_col string, target string")
    named = catalog.withColumn("clean", clean_string(F.col("col_name")))
    cols = named.join(settled_overrides(overrides), ["dataset", "col_name"], "left").join(scored_names(catalog), "clean")
    cols = cols.withColumn("derive_target", F.lit(None).cast("string") if strict_reference else derivation_target(F.col("clean")))
    given, several = F.col("ov_target").isNotNull(), F.coalesce(F.col("ov_several"), F.lit(False))
    claimable = F.array(*[F.lit(f) for f in [*C.STANDARD_FEATURES, *ROLE_TARGETS]])
    overridden = given & ~several & F.array_contains(claimable, F.col("ov_target"))
    derived = ~given & F.col("derive_target").isNotNull()
    similar = ~given & F.col("derive_target").isNull() & (F.col("score") >= C.AUTO_MAP_THRESHOLD)
    cols = cols.withColumns(
        {
            "_claim": F.when(overridden, F.col("ov_target")).when(derived, F.col("derive_target")).when(similar, F.col("best")),
            "_rank": F.when(overridden, F.lit(0)).when(similar, F.lit(1)).otherwise(F.lit(2)),
        }
    )
    # a column that claims nothing is a group of its own
    own_group = F.when(F.col("_claim").isNull(), F.col("col_ord"))
    w = Window.partitionBy("dataset", "_claim", own_group).orderBy("_rank", "col_ord", "col_name")
    cols = cols.withColumn("_won", (F.row_number().over(w) == 1) & F.col("_claim").isNotNull())
    role = F.create_map(*[x for k, v in ROLE_TARGETS.items() for x in (F.lit(k), F.lit(v))])
    won = F.col("_won")
    kind = (
        F.when(several, F.lit("conflict"))
        .when(F.col("ov_target") == C.IGNORE, F.lit("ignored"))
        .when(overridden & ~won, F.lit("conflict"))
        .when(overridden, F.coalesce(F.try_element_at(role, F.col("ov_target")), F.lit("mapped")))
        .when(given, F.lit("dropped"))
        .when(won & derived, F.lit("derive"))
        .when(won, F.lit("mapped"))
        .otherwise(F.lit("unknown"))
    )
    target = (
        F.when(given & ~several & (F.col("ov_target") != C.IGNORE), F.col("ov_target"))
        .when(won & derived, F.col("derive_target"))
        .when(~given, F.col("best"))
    )
    methods = F.create_map(*[x for k, v in C.DERIVATION_METHODS.items() for x in (F.lit(k), F.lit(v))])
    method = (
        F.when(several, F.lit("override: several targets"))
        .when(overridden & ~won, F.lit("override: target taken"))
        .when(given, F.lit("override"))
        .when(won & derived, F.try_element_at(methods, F.col("derive_target")))
        .when(won, F.when(F.col("score") >= 1.0, F.lit("exact")).otherwise(F.lit("fuzzy")))
        .when(F.col("score") > 0, F.lit("best below threshold or taken"))
    )
    return cols.select(
        "dataset", "col_name", "col_ord",
        kind.alias("kind"),
        target.alias("target"),
        F.round(F.col("score"), 6).alias("score"),
        method.alias("method"),
    )


def suggest_mapping(catalog: DataFrame) -> DataFrame:
    """(dataset, col_name, suggested_target, note): first keyword contained in the cleaned name
    or with similarity > 0.75; else no target and the default note."""
    kws = cleaned([k for k, _, _ in C.SUGGESTIONS])
    clean = clean_string(F.col("col_name"))
    hits = F.filter(
        F.sequence(F.lit(1), F.lit(len(C.SUGGESTIONS))),
        lambda i: F.contains(clean, F.element_at(kws, i))
        | (similarity_of_clean(clean, F.element_at(kws, i)) > C.SUGGEST_THRESHOLD),
    )
    first = F.try_element_at(hits, F.lit(1))
    targets = F.array(*[F.lit(t) for _, t, _ in C.SUGGESTIONS])
    notes = F.array(*[F.lit(n) for _, _, n in C.SUGGESTIONS])
    return catalog.select(
        "dataset",
        "col_name",
        F.try_element_at(targets, first).alias("suggested_target"),
        F.coalesce(F.try_element_at(notes, first), F.lit(C.NO_SUGGESTION_NOTE)).alias("note"),
    )


def effective_mapping(decisions: DataFrame) -> DataFrame:
    """Every column becomes an explicit decision: override if given, else the automatic target,
    else Ignore; a conflict is ignored. (dataset, col_name, col_ord, decision)."""
    chosen = F.when(F.col("kind").isin("mapped", "label", "id", "dropped"), F.col("target"))
    return decisions.select("dataset", "col_name", "col_ord", F.coalesce(chosen, F.lit(C.IGNORE)).alias("decision"))


def schema_check(catalog: DataFrame, features: Sequence[str] = C.STANDARD_FEATURES) -> DataFrame:
    """Per dataset: does it hold every required feature (exact names), and which are missing (in order)."""
    req = F.array(*[F.lit(f) for f in features])
    per = catalog.groupBy("dataset").agg(F.collect_set("col_name").alias("_cols"))
    missing = F.filter(req, lambda f: ~F.array_contains(F.col("_cols"), f))
    return per.select(
        "dataset",
        (F.size(missing) == 0).alias("is_standard"),
        F.size(missing).alias("missing_count"),
        F.array_join(missing, ", ").alias("missing_features"),
    )
