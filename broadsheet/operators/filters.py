"""Row filters and projections of the articles table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet import schemas
from broadsheet.functions import text
from broadsheet.operators.normalised import with_normalised


def of_category(rows: DataFrame, category: str | None) -> DataFrame:
    """Rows of one category; all rows if none is named."""
    return rows.filter(F.col("category") == category) if category else rows


def published_between(
    rows: DataFrame, date_from: str | None = None, date_to: str | None = None
) -> DataFrame:
    """Rows published within the bounds, both included; texts that are no time drop out."""
    published = F.try_to_timestamp("published_at")
    if date_from:
        rows = rows.filter(published >= F.lit(date_from).cast("timestamp"))
    if date_to:
        rows = rows.filter(published <= F.lit(date_to).cast("timestamp"))
    return rows


def get_article(articles: DataFrame, article_id: str) -> DataFrame:
    """The article with that id, if any."""
    return articles.filter(F.col("article_id") == article_id)


def list_articles(
    articles: DataFrame,
    limit: int = fixed.DEFAULT_PAGE,
    offset: int = 0,
    category: str | None = None,
    after: PageToken | None = None,
) -> DataFrame:
    """One page of articles, newest first; articles without a time come last.

    The time of the page's last row is found on that column alone; the wide rows are then filtered
    by it, which lets the scan skip the files and row groups of older articles. A page that is
    named by the one before it, with `after`, costs what the first one does; with an offset all
    rows before it are sorted.
    """
    if not 1 <= limit <= fixed.MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1 to {fixed.MAX_PAGE} and offset not negative")
    rows = of_category(articles, category)
    if after is not None:
        rows = rows.filter(after.beyond())
    newest = rows.select("created_at").orderBy(F.desc_nulls_last("created_at"))
    oldest = newest.limit(offset + limit).agg(F.min("created_at")).scalar()
    return (
        rows.filter((F.col("created_at") >= oldest) | F.col("created_at").isNull())
        .orderBy(F.desc_nulls_last("created_at"), "article_id")
        .offset(offset)
        .limit(limit)
    )


@dataclass(frozen=True)
class PageToken:
    """The last row of a page, after which the next one begins."""

    created_at: datetime | None
    article_id: str

    @staticmethod
    def of(page: DataFrame) -> PageToken | None:
        """The token of a page, of which the last row is collected; none for an empty one."""
        last = page.orderBy(F.asc_nulls_first("created_at"), F.desc("article_id"))
        row = last.select("created_at", "article_id").first()
        return row and PageToken(row.created_at, row.article_id)

    def beyond(self) -> Column:
        """Whether a row comes later in the order of pages; the bounds reach the scan."""
        later, at = F.col("article_id") > self.article_id, F.col("created_at")
        if self.created_at is None:
            return at.isNull() & later
        here = F.lit(self.created_at)
        return (at < here) | ((at == here) & later) | at.isNull()


def to_public(articles: DataFrame) -> DataFrame:
    """All columns as handed out: the load time as text, no list of keywords as the empty list."""
    changed = {
        "keywords": F.coalesce("keywords", F.array().cast("array<string>")),
        "created_at": F.col("created_at").cast("string"),
    }
    return articles.select(*[
        changed.get(c, F.col(c)).alias(c) for c in schemas.ARTICLE.fieldNames()
    ])


def preview(articles: DataFrame, n: int = 5) -> DataFrame:
    """Start and length of the normalised text of the first `n` articles by id.

    Only the ids up to the n-th pass the scan of the texts, and only n texts are normalised.
    """
    last = articles.select("article_id").orderBy("article_id").limit(n).agg(F.max("article_id"))
    first = (
        articles.filter(F.col("article_id") <= last.scalar())
        .select("article_id", "title", "description", "content")
        .orderBy("article_id", "content")
        .limit(n)
    )
    return (
        with_normalised(first, text.full_text(), into="normalised")
        .select(
            "article_id",
            "title",
            F.substring("normalised", 1, fixed.PREVIEW_CHARS).alias("normalised_preview"),
            F.length("normalised").alias("text_length"),
        )
    )
