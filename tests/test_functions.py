"""Unit vectors for the scalar operators (FIXTURES.md section 6)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidings.functions import dates, parse, text


def one(spark, col, value, schema="s string"):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("aid,expected", [
    ("business/2024/apr/22/x", dt.date(2024, 4, 22)),
    ("business/2024/APR/22/x", dt.date(2024, 4, 22)),
    ("business/article/2024/jun/09/x", None),
    ("business/2024/feb/31/x", None),
    ("business/2024/june/09/x", None),
    ("a/b/c", None),
    (None, None),
])
def test_strict_date(spark, aid, expected):
    assert one(spark, dates.strict_article_date("s"), aid) == expected


def test_lenient_date(spark):
    assert one(spark, dates.lenient_article_date("s"), "business/article/2024/jun/09/x") == dt.date(2024, 6, 9)
    assert one(spark, dates.lenient_article_date("s"), "business/2024/apr/22/x") == dt.date(2024, 4, 22)
    assert one(spark, dates.lenient_article_date("s"), "nothing/here") is None


def test_strict_dates_subset_of_lenient(spark):
    ids = ["business/2024/apr/22/x", "business/article/2024/jun/09/x", "money/col/2025/jan/01/y", "a/b/c"]
    df = spark.createDataFrame([(i,) for i in ids], "s string").select(
        dates.strict_article_date("s").alias("a"), dates.lenient_article_date("s").alias("b"))
    assert df.where(F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("a") != F.col("b")))).count() == 0


def test_publication_day(spark):
    assert one(spark, dates.publication_day("s"), "2026-02-09T18:05:12Z") == dt.date(2026, 2, 9)
    assert one(spark, dates.publication_day("s"), "") is None


@pytest.mark.parametrize("raw,expected", [
    ("3", 3), (" 4\n", 4), ("+3", 3), ("7", 2), ("4.", 2), ("positive", 2), ("", 2), (None, 2)])
def test_strict_label(spark, raw, expected):
    assert one(spark, parse.parse_label_strict("s"), raw) == expected


@pytest.mark.parametrize("raw,ref,default", [
    ("LEANING POSITIVE", "positive", "leaning_positive"),
    ("1", "leaning_negative", "leaning_negative"),
    ("negative", "negative", "negative"),
    ("leaning negative", "leaning_negative", "leaning_negative"),
    ("", "neutral", "neutral"),
    (None, "neutral", "neutral"),
    ("xyz", "neutral", "neutral"),
])
def test_ladder(spark, raw, ref, default):
    assert one(spark, parse.parse_sentiment_ladder("s", mode="reference"), raw) == ref
    assert one(spark, parse.parse_sentiment_ladder("s"), raw) == default


def test_first_digit(spark):
    assert one(spark, parse.parse_first_digit("s"), "Answer: 7 then 3 or 4") == 3
    assert one(spark, parse.parse_first_digit("s"), "none") == -1


@pytest.mark.parametrize("label,score,expected", [
    ("negative", .76, 0), ("negative", .75, 1), ("neutral", .99, 2), ("Positive", .9, 4),
    ("positive", .5, 3), ("other", .9, None)])
def test_polarity_bucket(spark, label, score, expected):
    df = spark.createDataFrame([(label, score)], "l string, s double")
    assert df.select(parse.bucket_polarity("l", "s")).first()[0] == expected


def test_label_names(spark):
    df = spark.createDataFrame([(2, "Leaning_Negative"), (4, "leaning positive")], "v int, n string")
    r = df.select(parse.label_name("v"), parse.ladder_name("v"), parse.label_value("n")).collect()
    assert [tuple(x) for x in r] == [("neutral", "neutral", 1), ("positive", "positive", 3)]


def test_html_strip(spark):
    assert one(spark, text.strip_html("s"), "<p>a<br/>b</p>") == "ab"
    assert one(spark, text.strip_html("s"), "a < b") == "a < b"


@pytest.mark.parametrize("value,expected", [(" a  b c\n", 3), ("", 0), (None, None), ("a b\x1cc", 3)])
def test_word_count(spark, value, expected):
    assert one(spark, text.word_count("s"), value) == expected


def test_tokens(spark):
    assert one(spark, text.estimate_tokens("s"), "abcde") == 1
    assert one(spark, text.estimate_tokens("s"), "abc") == 0


def test_py_strip_and_blank(spark):
    assert one(spark, text.py_strip("s"), "  x y \n") == "x y"
    assert one(spark, text.is_blank("s"), " \n\t") is True
    assert one(spark, text.is_blank("s"), None) is True
    assert one(spark, text.is_blank("s"), " a ") is False


def test_title_body_code_points(spark):
    df = spark.createDataFrame([("T", "é" * 2500)], "webTitle string, bodyText string")
    whole, cut, body = df.select(text.title_body(), text.title_body(n=2000), text.body_prefix()).first()
    assert whole == "T\n\n" + "é" * 2500 and cut == "T\n\n" + "é" * 2000 and body == "é" * 2500
    assert "é" * 2500 in df.withColumn("standfirst", F.lit("")).select(text.sectioned_prompt()).first()[0]


def test_default_article_id(spark):
    df = spark.createDataFrame([("a", 4), (None, 5)], "id string, idx long")
    assert [r[0] for r in df.select(text.default_article_id()).collect()] == ["a", "article_5"]


@pytest.mark.parametrize("raw,expected", [("\u00a03", 3), ("\u20033\x1c", 3), ("LEANING_POSITIVE", 2)])
def test_label_strict_strips_all_blanks(spark, raw, expected):
    assert one(spark, parse.parse_label_strict("s"), raw) == expected


@pytest.mark.parametrize("name", parse.LADDER_NAMES)
def test_ladder_reads_its_own_names(spark, name):
    assert one(spark, parse.parse_sentiment_ladder("s"), name) == name
    assert one(spark, parse.parse_sentiment_ladder("s"), name.upper()) == name


def test_prompt_sections(spark):
    df = spark.createDataFrame([("H", "<b>sum</b>", "body"), ("H", None, ""), (None, "", None)],
                               "webTitle string, standfirst string, bodyText string")
    r = [x[0] for x in df.select(text.prompt_sections()).collect()]
    assert r[0] == "Headline: H\n\nSummary: sum\n\nExcerpt: body\n\n"
    assert r[1] == "Headline: H\n\n"
    assert r[2] == "Headline: \n\n"


def test_simple_prompt_keeps_percent(spark):
    df = spark.createDataFrame([("100% up", "b")], "webTitle string, bodyText string")
    assert "100% up\n\nb" in df.select(text.simple_prompt()).first()[0]


def test_direction(spark):
    df = spark.createDataFrame([(2.0,), (2.5,), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(parse.direction("x", 2.0)).collect()] == [0, 1, -1, 0]


def test_argmax(spark):
    df = spark.createDataFrame([([1.0, 5.0, 5.0],)], "a array<double>")
    assert df.select(parse.argmax_class("a")).first()[0] == 1


def test_to_int_label(spark):
    assert one(spark, parse.to_int_label("s"), 2.5, "s double") == 2
