"""What moves when tables are large: texts once, vectors not at all."""

import datetime as dt
from pathlib import Path

import pytest
from checks import fixtures as fx
from pyspark.sql import functions as F

from broadsheet.operators import chunks
from broadsheet.operators.chunks import chunk_articles, chunk_metadata
from broadsheet.plans import indexing
from broadsheet.session import fresh_path
from broadsheet.sources import payloads, tables


def plan(df, part="executedPlan"):
    return getattr(df._jdf.queryExecution(), part)().toString()


@pytest.fixture
def shuffled(spark):
    """Joins as between large tables."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture
def folder(spark, tmp_path):
    """Documents 1 to 3, and one without an id, with events, labels and pages of some."""
    day = dt.datetime(2024, 1, 5)
    made = {
        "documents": ([(i, f"Title {i}. Text {i}.", "en", "s", 15) for i in (1, 2, 3, None)],
                      "doc_id long, text string, lang string, source string, n_chars long"),
        "events": ([(5, day), (6, day), (10, day), (10, day), (-5, day), (None, day)], "event_id long, ts timestamp"),
        "labels": ([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"),
        "pages": ([(2, "u"), (None, "v")], "page_id long, url string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_texts_are_shuffled_once_for_all_joins(spark, folder, shuffled):
    """By doc_id: documents, labels, events and pages once each; events had a key of their own."""
    rows = fx.full_articles(spark, folder)
    assert plan(rows).count("Exchange hashpartitioning") == 4
    found = sorted((str(r.doc_id), r.published_at, r.sentiment, r.url) for r in rows.collect())
    at = "2024-01-05 00:00:00"
    assert found == [
        ("1", at, "positive", None), ("2", at, None, "u"), ("2", at, None, "u"), ("3", None, None, None),
        ("None", None, None, None),
    ]


def articles(spark, rows):
    return spark.createDataFrame(
        [(i, t, None, c, "s", None, None, None) for i, t, c in rows],
        "article_id string, title string, description string, content string, source_name string,"
        " category string, published_at string, url string",
    )


def test_only_chunks_of_repeated_articles_are_shuffled(spark, shuffled):
    path = fresh_path(spark, "chunks")
    tables.create_chunks(spark, path)
    several = articles(spark, [("a", "t", "x " * 400), ("a", "t", "x " * 900), ("b", "t", "c"), (None, "t", "c"), (None, "t", "d")])
    cut = chunk_metadata(chunk_articles(several))
    new = tables.new_chunks(cut, path, several, cut_once=True)
    expected = sorted(r[0] for r in cut.select("chunk_id").distinct().collect())
    assert sorted(r.chunk_id for r in new.collect()) == expected
    assert sorted(r.chunk_id for r in indexing.index_articles(several, path).collect()) == expected
    assert indexing.index_articles(several, path).filter("article_id IS NOT NULL").isEmpty()
    single = articles(spark, [("c", "t", "x " * 400), ("d", "t", "c")])
    new = tables.new_chunks(chunk_metadata(chunk_articles(single)), path, single, cut_once=True)
    assert "hashpartitioning(chunk_id" not in plan(new)
    assert new.count() == chunk_articles(single).count()


def test_vectors_are_made_after_the_shuffle(spark):
    path, seen = fresh_path(spark, "chunks"), []
    tables.create_chunks(spark, path)

    def vectoriser(rows):
        seen.append(plan(rows, "logical"))
        return chunks.hashed_vectors(rows)

    rows = articles(spark, [("a", "t", "x " * 400), ("b", "t", "c")])
    indexing.index_articles(rows, path, vectoriser)
    assert "rebalance" not in seen.pop().lower()  # one that does not say so may shuffle by itself
    vectoriser.by_row = True
    more = articles(spark, [("d", "t", "y " * 400), ("e", "t", "c")])
    added = indexing.index_articles(more, path, vectoriser)
    assert "rebalance" in seen.pop().lower()
    whole = chunks.hashed_vectors(chunk_metadata(chunk_articles(more)))
    same = ["chunk_id", "document", "category", "embedding"]
    assert added.select(same).exceptAll(whole.select(same)).isEmpty() and added.count() == whole.count()
    assert all(f.name.endswith(".zstd.parquet") for f in Path(path).rglob("category=*/**/*.parquet"))


def test_landed_files_are_packed_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(fx, "LAND_RECORDS", 3)
    answers = spark.range(10).coalesce(1).select(F.col("id").alias("fetch_id"), F.lit("success").alias("status"))
    folder = fx.land(answers)
    files = list(Path(folder).rglob("*.json.gz"))
    assert len(files) == 4
    assert payloads.read_payloads(spark, folder).count() == 10
