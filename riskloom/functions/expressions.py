"""Scalar Column expressions (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import config as C

# --- text ------------------------------------------------------------------


def clean_string(c: Column) -> Column:
    """Lower-case and keep only letters and digits; null -> empty string."""
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]", "")


def similarity_of_clean(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length on already cleaned strings; empty -> 0, equal -> 1."""
    la, lb = F.length(a), F.length(b)
    return (
        F.when((la == 0) | (lb == 0), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .otherwise(F.lit(1.0) - F.levenshtein(a, b) / F.greatest(la, lb))
    )


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return similarity_of_clean(clean_string(a), clean_string(b))


# --- coercion --------------------------------------------------------------


NUMBER_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def to_number(c: Column, dtype: str = "string") -> Column:
    """Numeric coercion, unparsable -> null (ANSI-safe). Numbers (by ``dtype``, the column's
    type name) are cast as they are."""
    return c.cast("double") if dtype.startswith(NUMBER_TYPES) else c.cast("string").try_cast("double")


# Month-first before day-first where both are possible, as pandas reads dates.
DATE_PATTERNS = [
    "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy.M.d", "yyyyMMdd",
    "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "d-MMMM-yyyy", "MMM-d-yyyy", "yyyy-MMM-d",
]
TIME_PATTERNS = ["", " H:m:s", " H:m", " h:m:s a", " h:m a"]
_TIME_TAIL = r"[ T]+(\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)\s*([AaPp][Mm])?\s*(Z|[+-]\d{2}:?\d{2})?$"


def to_timestamp_lenient(c: Column, dtype: str = "string") -> Column:
    """Date coercion, unparsable -> null. Dates and timestamps (by ``dtype``) are taken as they
    are. Text is read as Spark casts it (ISO dates with or without a time and a zone, one- or
    two-digit months and days); otherwise a time of day at the end is set aside, the date
    is read by its separators and month names, and the time is put back."""
    if dtype.startswith(("date", "timestamp")):
        return c.cast("timestamp")
    s = F.regexp_replace(F.trim(c.cast("string")), r"\s+", " ")
    compact = s.rlike(r"^\d{8}$")  # a cast would read it as a year
    iso = F.when(~compact & s.rlike(r"^\d{4}-"), s.try_cast("timestamp"))
    day = F.initcap(F.regexp_replace(s, _TIME_TAIL, ""))
    date = F.coalesce(*[F.try_to_timestamp(day, F.lit(p)) for p in DATE_PATTERNS])
    clock = F.upper(F.regexp_extract(s, _TIME_TAIL, 1))
    half = F.upper(F.regexp_extract(s, _TIME_TAIL, 4))
    hour = F.split(clock, ":")[0].try_cast("int")
    hour = F.when(half == "PM", hour % 12 + 12).when(half == "AM", hour % 12).otherwise(hour)
    seconds = hour * 3600 + F.split(clock, ":")[1].try_cast("int") * 60 + F.coalesce(F.try_element_at(F.split(clock, ":"), F.lit(3)).try_cast("double"), F.lit(0.0))
    with_time = F.when(clock == "", date).otherwise(F.timestamp_seconds(F.unix_timestamp(date) + seconds))
    return F.coalesce(iso, with_time)


# --- risk ------------------------------------------------------------------


def risk_bucket(p: Column) -> Column:
    """Inclusive upper bounds 0.30 / 0.70; null stays null."""
    return (
        F.when(p.isNull(), F.lit(None).cast("string"))
        .when(p <= F.lit(C.LOW_RISK_MAX), F.lit(C.LOW_RISK))
        .when(p <= F.lit(C.MEDIUM_RISK_MAX), F.lit(C.MEDIUM_RISK))
        .otherwise(F.lit(C.HIGH_RISK))
    )


def predicted_class(p: Column) -> Column:
    return (p > F.lit(C.DECISION_THRESHOLD)).cast("int")


def predicted_outcome(p: Column) -> Column:
    return F.when(p > F.lit(C.DECISION_THRESHOLD), F.lit(C.LIKELY_LEAVE)).otherwise(F.lit(C.LIKELY_STAY))


def percent_text(p: Column, decimals: int = 2) -> Column:
    """``{p:.2%}`` style text; the number is rounded first so ties agree across engines."""
    return F.format_string(f"%.{decimals}f%%", F.round(p * 100.0, decimals))


def signed_text(x: Column, decimals: int = 4) -> Column:
    """``{x:+.4f}`` style text, pre-rounded (and -0.0 folded into +0.0)."""
    return F.format_string(f"%+.{decimals}f", F.round(x, decimals) + F.lit(0.0))


def slug(c: Column) -> Column:
    """File-name slug: lower case, spaces -> underscores."""
    return F.lower(F.replace(c, F.lit(" "), F.lit("_")))


def label_to_int(c: Column) -> Column:
    """Yes/No label -> 1/0, other values -> null."""
    s = c.cast("string")
    return F.when(s == "Yes", F.lit(1)).when(s == "No", F.lit(0))


def label_truthy(c: Column) -> Column:
    return F.lower(c.cast("string")).isin(*C.TRUTHY_LABELS)


def round_double(x: Column, decimals: int) -> Column:
    """Round half away from zero in double arithmetic: sign(x) * floor(|x| * 10^d + 0.5) / 10^d.

    Codegen-friendly (Spark's ``round`` on doubles goes through BigDecimal per value) and the
    same arithmetic SQL engines commonly use for DOUBLE rounding; ``+ 0.0`` folds -0.0 into 0.0."""
    m = float(10**decimals)
    return F.signum(x) * F.floor(F.abs(x) * F.lit(m) + F.lit(0.5)) / F.lit(m) + F.lit(0.0)
