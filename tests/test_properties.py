"""Property tests: Spark expressions agree with Python's own string semantics
on generated input (whitespace incl. Unicode and 0x1c-0x1f separators)."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidings.functions import parse, text

ALPHABET = st.sampled_from(list("ab xyz019234\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f  　é-+.,"))
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=1, max_size=60)
ASCII = st.lists(st.text(alphabet=st.sampled_from(list(" +-0123456789x.\t\n")), max_size=6), min_size=1, max_size=60)


def run(spark, values, col):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[1] for r in df.select("i", col.alias("r")).orderBy("i").collect()]


@settings(max_examples=8, deadline=None)
@given(TEXTS)
def test_word_count_is_python_split(spark, values):
    assert run(spark, values, text.word_count("s")) == [len(v.split()) for v in values]


@settings(max_examples=8, deadline=None)
@given(TEXTS)
def test_strip_is_python_strip(spark, values):
    assert run(spark, values, text.py_strip("s")) == [v.strip() for v in values]


@settings(max_examples=8, deadline=None)
@given(TEXTS)
def test_tokens_and_blank(spark, values):
    assert run(spark, values, text.estimate_tokens("s")) == [len(v) // 4 for v in values]
    assert run(spark, values, text.is_blank("s")) == [not v.strip() for v in values]


@settings(max_examples=8, deadline=None)
@given(TEXTS)
def test_first_digit(spark, values):
    def first(v):
        m = re.search("[0-4]", v)
        return int(m.group(0)) if m else -1
    assert run(spark, values, parse.parse_first_digit("s")) == [first(v) for v in values]


@settings(max_examples=8, deadline=None)
@given(ASCII)
def test_strict_label_is_python_int(spark, values):
    def strict(v):
        try:
            x = int(v)
        except ValueError:
            return 2
        return x if 0 <= x <= 4 else 2
    assert run(spark, values, parse.parse_label_strict("s")) == [strict(v) for v in values]


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ID_PARTS = st.tuples(
    st.sampled_from(["business", "money", "x"]),
    st.one_of(st.integers(1990, 2030).map(str), st.sampled_from(["article", "20x4", ""])),
    st.one_of(st.sampled_from(MONTHS), st.sampled_from(["Feb", "JUN", "june", "13", ""])),
    st.one_of(st.integers(0, 40).map(lambda d: f"{d:02d}"), st.integers(1, 9).map(str), st.just("xx")),
    st.sampled_from(["slug", "a-b", ""]))


def _valid_date(parts):
    import datetime as dt
    try:
        y, m, d = int(parts[1]), MONTHS.index(parts[2].lower()) + 1, int(parts[3])
        return dt.date(y, m, d)
    except ValueError:
        return None


@settings(max_examples=8, deadline=None)
@given(st.lists(ID_PARTS, min_size=1, max_size=60))
def test_strict_date_is_calendar_validity(spark, parts_list):
    from tidings.functions import dates
    ids = ["/".join(p) for p in parts_list]
    expected = [_valid_date(p.split("/")) if len(p.split("/")) >= 4 else None for p in ids]
    assert run(spark, ids, dates.strict_article_date("s")) == expected


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=40))
def test_consensus_rounds_like_python(spark, pairs):
    from tidings.operators import labels as L
    rows = [(str(i), r, float(v)) for i, (a, b) in enumerate(pairs) for r, v in (("a", a), ("b", b))]
    df = spark.createDataFrame(rows, "article_id string, rater string, label double")
    got = {r.article_id: r.label for r in L.consensus(df).collect()}
    assert got == {str(i): float(round((a + b) / 2)) for i, (a, b) in enumerate(pairs)}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(-5, 5)), min_size=1, max_size=30))
def test_safe_corr_matches_numpy(spark, pairs):
    import math

    import numpy as np

    from tidings.operators.metrics import safe_corr
    df = spark.createDataFrame([(float(x), float(y)) for x, y in pairs], "x double, y double")
    got = df.select(safe_corr("x", "y")).first()[0]
    xs, ys = np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs], float)
    if len(pairs) < 2 or xs.std() == 0 or ys.std() == 0:
        assert got is None
    else:
        assert math.isclose(got, float(np.corrcoef(xs, ys)[0, 1]), rel_tol=1e-9, abs_tol=1e-12)
