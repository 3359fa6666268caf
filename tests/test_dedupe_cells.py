"""First rows per key where the places are too many to be broadcast one by one."""

import pytest
from pyspark.sql import functions as F

from broadsheet import session
from broadsheet.operators import dedupe


@pytest.fixture
def many(monkeypatch, spark):
    """Joins and broadcasts as of very many places."""
    monkeypatch.setattr(session, "FEW_ROWS", 20)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def table(spark):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 50 == 7, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 2500)).alias("key"),
        F.when(F.col("id") % 97 != 3, F.struct(F.col("id"), (F.col("id") % 2).alias("position"))).alias("at"),
        F.concat(F.lit("text "), F.col("id")).alias("text"),
    )
    return rows.unionByName(rows.filter("text LIKE '%1'").withColumn("text", F.lit("also")))


def test_first_rows_by_bitmaps(spark, many, monkeypatch):
    rows = table(spark)
    plain = rows.groupBy("key").agg(F.min(F.struct("at", "text")).alias("r")).select("key", "r.at", "r.text")
    expected = sorted(map(str, plain.collect()))
    for cells in (32, 1):  # with one cell a place, about half of the places are told one by one
        monkeypatch.setattr(dedupe, "CELLS", cells)
        monkeypatch.setattr(dedupe, "BLOCK", 8 if cells == 1 else 32_768)
        assert sorted(map(str, dedupe.dedupe_first(rows, "key", "at").collect())) == expected


def test_whole_rows_do_not_move(spark, many, monkeypatch):
    monkeypatch.setattr(dedupe, "CELLS", 4096)  # hardly a cell has wanted and other places
    rows = table(spark).filter("at IS NOT NULL").dropDuplicates(["key", "at"])
    rows = session.settle(rows)
    first = dedupe.first_places(rows, "key", "at")
    assert first.count() > session.FEW_ROWS
    plan = dedupe.rows_at(rows, first, "key", "at")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan, plan


def test_loads_write_rows_where_they_are(spark, monkeypatch):
    """Neither articles nor chunks with vectors are shuffled for the folders they are written to."""
    from broadsheet.sources import tables

    hinted = []
    hint = type(spark.range(1)).hint
    monkeypatch.setattr(type(spark.range(1)), "hint", lambda df, name, *a: hinted.append(name) or hint(df, name, *a))
    path, chunk_path = session.fresh_path(spark, "articles"), session.fresh_path(spark, "chunks")
    tables.create_articles(spark, path)
    tables.create_chunks(spark, chunk_path)
    names = ("title", "description", "content", "source_name", "source_url", "category", "country", "language",
             "published_at", "url", "image_url", "sentiment")
    rows = spark.range(300).repartition(3).select(
        "id", F.concat(F.lit("a"), F.col("id") % 200).alias("article_id"),
        *[F.lit("x").alias(n) for n in names], F.array(F.lit("w")).alias("keywords"))
    tables.insert_new(rows, path, "id")
    assert tables.read_articles(spark, path).count() == 200
    from broadsheet.operators import chunks

    cut = chunks.chunk_metadata(chunks.chunk_articles(rows)).withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    tables.insert_new_chunks(cut, chunk_path, rows)
    assert tables.read_chunks(spark, chunk_path).count() == 200 and hinted == []
