"""Property: the exact search fast path equals substring search over the joined row text."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.operators.views import row_text, search_predicate

ROWS = [
    (1, "Sales Rep", 1.5e7, None, 3),
    (2, "x", 0.25, "nan", -4),
    (3, "abc", -3.0, "2-HIGH", 0),
    (4, "Research & Development", 4573.51, "1-URGENT", 12),
    (5, None, None, "Infinity", None),
]
TEXTS = [" ".join("" if v is None else str(v) for v in r).lower() for r in ROWS]


@st.composite
def terms(draw):
    if draw(st.booleans()):
        text = draw(st.sampled_from(TEXTS))
        i = draw(st.integers(0, max(0, len(text) - 1)))
        j = draw(st.integers(i + 1, len(text)))
        return text[i:j]
    return draw(st.text(alphabet="abcdeinfty0123456789.-+ &rhgu", min_size=1, max_size=6))


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(term=terms())
def test_fast_path_equals_joined_text(spark, term):
    df = spark.createDataFrame(ROWS, "id int, a string, v double, s string, n int")
    if not term.strip():
        return
    fast = sorted(r.id for r in df.where(search_predicate(df, term)).collect())
    full = sorted(r.id for r in df.where(F.contains(row_text(df), F.lit(term.strip().lower()))).collect())
    assert fast == full
