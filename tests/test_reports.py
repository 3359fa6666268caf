"""Counts, pages and reports on hand-made corpora."""

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import counts, filters, scales, sentiment
from broadsheet.plans import reports, search
from broadsheet.sources.reports import as_json

SCHEMA = (
    "article_id string, title string, description string, content string, source_name string,"
    " category string, sentiment string, created_at timestamp, published_at string"
)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        ("a1", "good news", None, "some words here", "s1", "top", "positive", "2024-01-01 10:00:00"),
        ("a2", "an award", "", "", "s1", "top", "positive", "2024-01-01 11:00:00"),
        ("a3", "plain", "x", None, "s2", "world", "neutral", "2024-01-05 00:00:00"),
        ("a4", "plain", "x", "words again", "s2", "", "unheard-of", "2024-01-09 00:00:00"),
        ("a5", "plain", "x", "words", None, None, "", None),
        ("a6", "plain", "x", "words", "", "world", None, "2024-01-09 00:00:00"),
    ]
    return spark.createDataFrame([(*r, r[-1]) for r in rows], SCHEMA.replace("created_at timestamp", "created_at string")) \
        .withColumn("created_at", F.col("created_at").cast("timestamp"))


@pytest.fixture(scope="module")
def empty(corpus):
    return corpus.filter("article_id = 'none'")


def sections(report):
    found = {}
    for r in report.collect():
        found.setdefault(r.section, []).append((r.key, r.value))
    return {k: sorted(v, key=str) for k, v in found.items()}


def test_null_and_empty_values(corpus):
    assert [tuple(r) for r in counts.by_category(corpus).collect()] == [("top", 2), ("world", 2)]
    assert [tuple(r) for r in counts.by_category(corpus, keep_empty=True).collect()] == [
        ("top", 2), ("world", 2), ("", 1)
    ]
    assert [r.source for r in counts.top_sources(corpus).collect()] == ["s1", "s2"]
    assert [r.source for r in counts.top_sources(corpus, 1, keep_empty=True).collect()] == ["s1"]
    assert {tuple(r) for r in counts.sentiment_distribution(corpus).collect()} == {
        ("positive", 2), ("negative", 0), ("neutral", 1)
    }
    assert [tuple(r) for r in counts.avg_content_length(corpus).collect()] == [("top", 15.0), ("world", 5.0)]


def test_days(corpus):
    days = [(str(r.date), r["count"]) for r in counts.daily_trend_earliest(corpus, 2).collect()]
    assert days == [("2024-01-01", 2), ("2024-01-05", 1)]
    days = [(str(r.date), r["count"]) for r in counts.daily_trend_latest(corpus, 2).collect()]
    assert days == [("2024-01-09", 2), ("2024-01-05", 1)]
    bars = scales.trend_scale(counts.daily_trend_latest(corpus, 14)).collect()
    assert [(r.label, r.height_pct) for r in bars] == [("01/01", 100), ("01/05", 50), ("01/09", 100)]


def test_bar_height_has_a_floor(spark):
    daily = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 1000)], "date string, count long")
    bars = scales.trend_scale(daily.withColumn("date", F.to_date("date"))).collect()
    assert [r.height_pct for r in bars] == [8, 100]


def test_mismatches(corpus):
    row = sentiment.mismatch_rate(corpus).first()
    assert tuple(row) == (6, 2, 33.33)  # 'an award' holds 'war'; 'unheard-of' is no known label
    assert [r.article_id for r in sentiment.mismatch_sample(corpus, 1).collect()] == ["a2"]


def test_pages(corpus):
    ids = [r.article_id for r in filters.list_articles(corpus, limit=6).collect()]
    assert ids == ["a4", "a6", "a3", "a2", "a1", "a5"]
    assert [r.article_id for r in filters.list_articles(corpus, limit=2, offset=4).collect()] == ["a1", "a5"]
    assert [r.article_id for r in filters.list_articles(corpus, category="top").collect()] == ["a2", "a1"]
    assert filters.list_articles(corpus, offset=100).count() == 0
    for limit, offset in ((0, 0), (101, 0), (1, -1)):
        with pytest.raises(ValueError):
            filters.list_articles(corpus, limit, offset)


def test_date_range(corpus):
    def ids(*bounds):
        return [r.article_id for r in filters.published_between(corpus, *bounds).orderBy("article_id").collect()]

    assert ids("2024-01-01 11:00:00", "2024-01-05") == ["a2", "a3"]
    assert ids(None, "2024-01-01 10:00:00") == ["a1"]
    assert len(ids()) == 6


def test_preview(corpus):
    rows = filters.preview(corpus, 2).collect()
    assert [(r.article_id, r.normalised_preview, r.text_length) for r in rows] == [
        ("a1", "good news some words here", 25), ("a2", "an award", 8)
    ]


def test_summary_and_shares(corpus, empty):
    assert tuple(counts.dashboard_summary(corpus).first()) == (6, 3, 3, 3)
    assert tuple(counts.dashboard_summary(empty).first()) == (0, 0, 0, 0)
    assert tuple(scales.sentiment_share(corpus).first()) == (2, 0, 1, 67, 0, 33)
    assert tuple(scales.sentiment_share(empty).first()) == (0, 0, 0, 0, 0, 100)


def test_analytics_report(corpus):
    got = sections(reports.analytics_report(corpus))
    assert got == {
        "total_articles": [("", 6.0)],
        "categories": [("top", 2.0), ("world", 2.0)],
        "sentiment_distribution": [("negative", 0.0), ("neutral", 1.0), ("positive", 2.0)],
        "top_sources": [("s1", 2.0), ("s2", 2.0)],
        "daily_trend": [("2024-01-01", 2.0), ("2024-01-05", 1.0), ("2024-01-09", 2.0)],
        "avg_content_length": [("top", 15.0), ("world", 5.0)],
    }


def test_overview_report(corpus):
    got = sections(reports.overview_report(corpus))
    assert got["categories"] == [("", 1.0), ("top", 2.0), ("world", 2.0)]
    assert got["top_sources"] == [("", 1.0), ("s1", 2.0), ("s2", 2.0)]
    assert "avg_content_length" not in got


def test_sections_are_cut_at_their_limits(spark):
    many = spark.range(6000).select(
        F.concat(F.lit("a"), "id").alias("article_id"), F.lit("t").alias("title"), F.lit("").alias("description"),
        F.concat_ws(" ", F.lit("word"), F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit("zzzz"))).alias("content"),
        # One source holds a third of all rows.
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 100)).alias("source_name"),
        F.concat(F.lit("c"), F.col("id") % 120).alias("category"), F.lit("neutral").alias("sentiment"),
        F.timestamp_seconds(F.col("id") % 60 * 86400).alias("created_at"),
    )
    got = sections(reports.analytics_report(many))
    assert len(got["categories"]) == len(got["avg_content_length"]) == 120
    assert len(got["top_sources"]) == 10 and ("hot", 2000.0) in got["top_sources"]
    assert [k for k, _ in got["daily_trend"]][::29] == ["1970-01-01", "1970-01-30"]
    assert [k for k, _ in sections(reports.overview_report(many))["recent_trend"]][::13] == ["1970-02-16", "1970-03-01"]
    words = sections(reports.preprocessing_report(many, words=60))["top_keywords"]
    assert len(words) == 60 and ("word", 6000.0) in words


def test_sentiment_report_parts_add_up(corpus):
    got = sections(reports.sentiment_report(corpus))
    assert sum(v for _, v in got["sentiment_distribution"]) == got["total_processed"][0][1] == 6.0
    assert got["category_sentiment"] == [("top/negative", 1.0), ("top/positive", 1.0), ("world/neutral", 2.0)]
    assert got["mismatch_count"] == [("", 2.0)] and got["mismatch_rate_pct"] == [("", 33.33)]
    assert [k for k, _ in got["mismatch_sample"]] == ["a2", "a4"]


def test_preprocessing_report(corpus):
    got = sections(reports.preprocessing_report(corpus, samples=2))
    assert got["total_processed"] == [("", 6.0)] and got["total_chunks"] == [("", 6.0)]
    assert ("words", 4.0) in got["top_keywords"] and ("plain", 4.0) in got["top_keywords"]
    assert [k for k, _ in got["sample_output"]] == ["a1", "a2"]


def test_empty_corpus(empty):
    zero = [(s, 0.0) for s in ("negative", "neutral", "positive")]
    assert sections(reports.analytics_report(empty)) == {
        "total_articles": [("", 0.0)], "sentiment_distribution": zero
    }
    assert sections(reports.sentiment_report(empty)) == {
        s: [("", 0.0)] for s in ("total_processed", "mismatch_count", "mismatch_rate_pct")
    }
    assert sections(reports.preprocessing_report(empty)) == {
        "total_processed": [("", 0.0)], "total_chunks": [("", 0.0)]
    }
    assert tuple(sentiment.mismatch_rate(empty).first()) == (0, 0, 0.0)
    assert counts.chunk_estimate_stats(empty).first().total_chunks == 0


def test_report_as_json(corpus):
    documents = [r.document for r in as_json(reports.analytics_report(corpus)).collect()]
    assert '{"section":"total_articles","key":"","value":6.0}' in documents


def test_context_without_hits(spark):
    queries = spark.createDataFrame([(1, "why?")], "query_id long, query string")
    nothing = spark.createDataFrame(
        [], "query_id long, source_no int, title string, source string, category string,"
        " published_at string, document string"
    )
    row = search.prompts(search.format_context(queries, nothing)).first()
    assert row.context == "No relevant news articles found in the database."
    assert row.prompt.endswith("USER QUESTION: why?\n\nPlease provide a comprehensive, well-cited answer.")
