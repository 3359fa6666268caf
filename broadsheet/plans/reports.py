"""Reports in long form: (section, key, value, detail), one row per number.

Every report groups its corpus once, by grouping sets, and shuffles only the groups. Long lists
are cut per section by a window over the groups; sections without a limit get a window partition
per key, so no task receives a whole section. Zero rows stand behind the real ones, so that an
empty corpus still gives its zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions import text
from broadsheet.operators.filters import preview
from broadsheet.operators.normalised import with_normalised
from broadsheet.operators.sentiment import is_mismatch, with_sentiment
from broadsheet.session import settle


def _entry(section: str, key: Column, value: Column, when: Column | None = None) -> Column:
    row = F.struct(
        F.lit(section).alias("section"),
        key.cast("string").alias("key"),
        value.cast("double").alias("value"),
    )
    return row if when is None else F.when(when, row)


def _rows(groups: DataFrame, *entries: Column) -> DataFrame:
    """Each group as the report rows it stands for."""
    filled = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return groups.select(F.inline(filled))


def _zeros(like: DataFrame, *rows: tuple[str, str]) -> DataFrame:
    zeros = F.array(*[_entry(section, F.lit(key), F.lit(0.0)) for section, key in rows])
    return like.sparkSession.range(1).select(F.inline(zeros))


def _cut(
    rows: DataFrame, limits: dict[str, int], by_key: dict[str, str] | None = None
) -> DataFrame:
    """Rows of the sections, at most `limits[section]` of each.

    A limited section is ordered by value, or by key in the direction `by_key` names.
    """
    section = F.col("section")
    limited = section.isin(*limits)
    ascending = [s for s, d in (by_key or {}).items() if d == "asc"]
    descending = [s for s, d in (by_key or {}).items() if d == "desc"]
    order = Window.partitionBy("section", F.when(~limited, F.col("key"))).orderBy(
        F.when(section.isin(descending), F.col("key")).desc(),
        F.when(~section.isin(ascending + descending), F.col("value")).desc(),
        F.col("key").asc(),
    )
    allowed = F.lit(1)
    for name, n in limits.items():
        allowed = F.when(section == name, n).otherwise(allowed)
    return (
        rows.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= max([1, *limits.values()]))  # a constant: cuts before the shuffle
        .filter(F.col("_n") <= allowed)
        .select("section", "key", "value", F.lit(None).cast("string").alias("detail"))
    )


def _facets(articles: DataFrame) -> DataFrame:
    """Counts per category, label, source and day and in total, from one pass."""
    base = articles.select(
        "category",
        "sentiment",
        F.col("source_name").alias("source"),
        text.day("created_at").cast("string").alias("day"),
        F.when(text.nonempty("content"), F.length("content")).alias("content_length"),
    )
    names = ["category", "sentiment", "source", "day"]
    return base.groupingSets([[], *[[n] for n in names]], *names).agg(
        *[(F.grouping(n) == 0).alias(f"by_{n}") for n in names],
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("content_length"), 1).alias("avg_length"),
    )


def _overview_rows(facets: DataFrame, present, trend: str, lengths: bool) -> DataFrame:
    by = {n: F.col(f"by_{n}") for n in ("category", "sentiment", "source", "day")}
    whole = ~(by["category"] | by["sentiment"] | by["source"] | by["day"])
    n = F.col("n")
    entries = [
        _entry("total_articles", F.lit(""), n, whole),
        _entry("categories", F.col("category"), n, by["category"] & present("category")),
        _entry(
            "sentiment_distribution", F.col("sentiment"), n,
            by["sentiment"] & F.col("sentiment").isin(*fixed.SENTIMENT_LABELS),
        ),
        _entry("top_sources", F.col("source"), n, by["source"] & present("source")),
        _entry(trend, F.col("day"), n, by["day"] & F.col("day").isNotNull()),
    ]
    if lengths:
        entries.append(_entry(
            "avg_content_length", F.col("category"), F.col("avg_length"),
            by["category"] & present("category") & F.col("avg_length").isNotNull(),
        ))
    zeros = _zeros(
        facets, ("total_articles", ""),
        *[("sentiment_distribution", s) for s in fixed.SENTIMENT_LABELS],
    )
    return _rows(facets, *entries).unionByName(zeros)


def analytics_report(articles: DataFrame) -> DataFrame:
    """Totals, categories, labels, top sources, earliest days and content lengths."""
    rows = _overview_rows(_facets(articles), text.nonempty, "daily_trend", lengths=True)
    return _cut(rows, {"top_sources": 10, "daily_trend": 30}, {"daily_trend": "asc"})


def overview_report(articles: DataFrame) -> DataFrame:
    """As the analytics report, but '' counts as a value and the days are the latest 14."""

    def present(column: str) -> Column:
        return F.col(column).isNotNull()

    rows = _overview_rows(_facets(articles), present, "recent_trend", lengths=False)
    return _cut(rows, {"top_sources": 10, "recent_trend": 14}, {"recent_trend": "desc"})


def sentiment_report(articles: DataFrame) -> DataFrame:
    """Recalculated labels overall and per category, and where the stored ones disagree.

    The articles are read and labelled once; what both parts of the report need of them, labels and
    the names of those that disagree, is written in between.
    """
    label = "recalculated_sentiment"
    named = F.when(is_mismatch(), F.struct("article_id", "title", "sentiment"))
    scored = settle(with_sentiment(articles).select("category", label, named.alias("mismatch")))
    groups = (
        scored
        .groupingSets([[], [label], ["category", label]], "category", label)
        .agg(
            (F.grouping(label) == 0).alias("by_label"),
            (F.grouping("category") == 0).alias("by_category"),
            F.count(F.lit(1)).alias("n"),
            F.count("mismatch").alias("wrong"),
        )
    )
    whole = ~F.col("by_label")
    rate = F.round(F.coalesce(F.try_divide("wrong", "n"), F.lit(0.0)) * 100, 2)
    rows = _rows(
        groups,
        _entry("total_processed", F.lit(""), F.col("n"), whole),
        _entry("mismatch_count", F.lit(""), F.col("wrong"), whole),
        _entry("mismatch_rate_pct", F.lit(""), rate, whole),
        _entry(
            "sentiment_distribution", F.col(label), F.col("n"),
            F.col("by_label") & ~F.col("by_category"),
        ),
        _entry(
            "category_sentiment", F.concat_ws("/", "category", label), F.col("n"),
            F.col("by_category") & text.nonempty("category"),
        ),
    )
    zeros = _zeros(
        articles, *[(s, "") for s in ("total_processed", "mismatch_count", "mismatch_rate_pct")]
    )
    wrong = scored.filter(F.col("mismatch").isNotNull()).select("mismatch.*", label)
    sample = wrong.orderBy("article_id", "title", "sentiment").limit(fixed.MISMATCH_SAMPLE).select(
        F.lit("mismatch_sample").alias("section"),
        F.col("article_id").alias("key"),
        F.lit(None).cast("double").alias("value"),
        F.concat_ws(" -> ", "sentiment", label).alias("detail"),
    )
    return _cut(rows.unionByName(zeros), {}).unionByName(sample)


def preprocessing_report(articles: DataFrame, words: int = 50, samples: int = 5) -> DataFrame:
    """Chunk estimates, the most frequent words and a few normalised texts.

    Words and estimates come from the same pass: each text gives its words and one row with its
    estimate, under the key NULL.
    """
    split = with_normalised(articles, text.full_text()).select(
        text.tokens("normalised_text").alias("_words"),
        text.chunk_estimate(F.length("normalised_text")).alias("_estimate"),
    )
    per_word = split.select(  # outer: an inner explode would normalise twice, to test for words
        "_estimate", F.explode_outer(F.concat("_words", F.array(F.lit(None).cast("string")))).alias("word")
    )
    estimate = F.when(F.col("word").isNull(), F.col("_estimate"))
    groups = (
        per_word.filter(F.col("word").isNull() | text.keep_token("word"))
        .groupBy("word")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg(estimate), 2).alias("mean"),
            F.max(estimate).alias("most"),
            F.min(estimate).alias("least"),
            F.sum(estimate).alias("all"),
        )
    )
    whole, none = F.col("word").isNull(), F.lit("")
    rows = _rows(
        groups,
        _entry("total_processed", none, F.col("n"), whole),
        _entry("avg_chunks_per_article", none, F.col("mean"), whole),
        _entry("max_chunks", none, F.col("most"), whole),
        _entry("min_chunks", none, F.col("least"), whole),
        _entry("total_chunks", none, F.col("all"), whole),
        _entry("top_keywords", F.col("word"), F.col("n"), F.col("word").isNotNull()),
    )
    zeros = _zeros(articles, ("total_processed", ""), ("total_chunks", ""))
    sample = preview(articles, samples).select(
        F.lit("sample_output").alias("section"),
        F.col("article_id").alias("key"),
        F.col("text_length").cast("double").alias("value"),
        F.col("normalised_preview").alias("detail"),
    )
    return _cut(rows.unionByName(zeros), {"top_keywords": words}).unionByName(sample)
