"""Column functions on small literal tables."""

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import text, vectors
from broadsheet.operators import sentiment
from broadsheet.operators.normalised import with_normalised


def one(spark, column, **values):
    row = spark.range(1).select(*[v.alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("given, expected", [
    ("pass  the   class", "pass the class"),
    ("a <b\nclass='x'>bold</b> end", "a bold end"),
    ("https://a.b/c?d start www.e.f", "start"),
    (" \t\n ", ""),
    ("x https://a.b", "x"),
    ("1 < 2", "1 < 2"),
    ("a \x0b b\u00a0c\t\nd", "a b\u00a0c d"),
    ("<www.x>www.y http", "http"),
    ("ht<b>tp://x", "ht tp://x"),
    ("ww<i>w.x y", "ww w.x y"),
])
def test_normalise(spark, given, expected):
    assert one(spark, text.normalise("t"), t=F.lit(given)) == expected
    rows = with_normalised(spark.createDataFrame([(given,)], "t string"), F.col("t"))
    assert rows.columns == ["t", "normalised_text"]
    assert rows.first().normalised_text == expected


@pytest.mark.parametrize("given, expected", [
    ("An award for the village", "negative"),  # 'war' inside 'award'
    ("GOOD and bad", "neutral"),
    ("good good good, bad and crisis", "negative"),  # each word counts once
    ("a great win", "positive"),
    ("", "neutral"),
    (None, "neutral"),
])
def test_sentiment(spark, given, expected):
    rows = spark.createDataFrame([(given,)], "t string")
    assert sentiment.with_sentiment(rows, F.col("t")).first().recalculated_sentiment == expected


@pytest.mark.parametrize("length, expected", [
    (0, 1), (100, 1), (101, 1), (480, 1), (500, 1), (501, 2), (950, 2), (951, 3), (5000, 11),
])
def test_chunk_estimate(spark, length, expected):
    assert one(spark, text.chunk_estimate("n"), n=F.lit(length)) == expected


def test_builders_and_defaults(spark):
    rows = spark.createDataFrame(
        [("t", None, "c", None, "")], "title string, description string, content string, a string, b string"
    )
    row = rows.select(
        text.index_text().alias("index"), text.sentiment_text().alias("sentiment"),
        text.full_text().alias("full"), text.or_default("a", "x").alias("a"),
        text.or_default("b", "x").alias("b"),
    ).first()
    assert tuple(row) == ("t. . c", "t ", "t  c", "x", "x")


def test_article_id(spark):
    import hashlib

    expected = hashlib.md5("Tïtle_src".encode()).hexdigest()
    assert one(spark, text.article_id("t", "s"), t=F.lit("Tïtle"), s=F.lit("src")) == expected


def test_first_category(spark):
    rows = spark.createDataFrame(
        [(["a", "b"], "r"), ([], "r"), (None, "r")], "c array<string>, r string"
    )
    got = [r.x for r in rows.select(text.first_category("c", "r").alias("x")).collect()]
    assert got == ["a", "r", "r"]


def test_tokens(spark):
    rows = spark.createDataFrame([("Über-cool Été: very nice words words",)], "t string")
    kept = rows.select(F.explode(text.tokens("t")).alias("w")).filter(text.keep_token("w"))
    assert sorted(r.w for r in kept.collect()) == ["cool", "nice", "words", "words"]


@pytest.mark.parametrize("length, expected", [(200, 200), (201, 203)])
def test_citation_snippet(spark, length, expected):
    snippet = one(spark, text.citation_snippet("t"), t=F.lit("x" * length))
    assert len(snippet) == expected and snippet.endswith("...") == (length > 200)


def test_keywords(spark):
    rows = spark.createDataFrame([(["a", 'b"c'],), ([],), (None,)], "k array<string>")
    stored = rows.select(text.keywords_json("k").alias("j"))
    assert [r.j for r in stored.collect()] == ['["a","b\\"c"]', "[]", "[]"]
    back = stored.select(text.keywords_list("j").alias("k"))
    assert [r.k for r in back.collect()] == [["a", 'b"c'], [], []]


@pytest.mark.parametrize("share, expected", [(0.005, 1), (0.0049, 0), (0.125, 13), (1.0, 100)])
def test_percent(spark, share, expected):
    assert one(spark, text.percent("s"), s=F.lit(share)) == expected


@pytest.mark.parametrize("a, b, expected", [
    ([1.0, 0.0], [2.0, 0.0], 1.0), ([1.0, 0.0], [-3.0, 0.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0),
    ([1.0, 1.0], [1.0, 0.0], 0.7071),
])
def test_relevance(spark, a, b, expected):
    rows = spark.createDataFrame([(a, b)], "a array<float>, b array<double>")
    score = vectors.relevance(vectors.cosine(F.col("a"), F.col("b")))
    assert rows.select(score.alias("x")).first().x == expected


def test_missing_vector(spark):
    rows = spark.createDataFrame([(None,), ([1.0, 2.0],)], "v array<float>")
    got = [r.x for r in rows.select(vectors.vector_or_zero("v", 2).alias("x")).collect()]
    assert got == [[0.0, 0.0], [1.0, 2.0]]
