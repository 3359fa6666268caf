"""Texts as queries, the inverted file, and lookups of what was found."""

import numpy as np
import pytest
from checks import fixtures as fx
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from broadsheet import schemas
from broadsheet.operators import chunks, filters, hits, ivf, knn, text_model
from broadsheet.plans import indexing, search
from broadsheet.session import fresh_path, settle
from broadsheet.sources import store as stores
from broadsheet.sources import tables

TEXTS = [
    "The river rose. The river fell.", "A market opens in the town square", "", None, "12 monkeys, 12 months",
    "Der Fluss stieg über die Ufer", "the RIVER fell the river rose", "the", "market market river",
]


@pytest.fixture(scope="module")
def rows(spark):
    made = [(f"a{i}_chunk_0", f"a{i}", t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(made, "chunk_id string, article_id string, document string")


def test_vectors_by_plain_code(rows):
    """Counts of hashed words, weighted by how rare the hash is, at length 1."""
    dim = 64
    model = text_model.fit(rows, dim)
    place = HashingTF(numFeatures=dim).indexOf

    def words(text):
        import re
        return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]

    seen = np.zeros(dim)
    for t in TEXTS:
        for i in {place(w) for w in words(t)}:
            seen[i] += 1
    weight = np.log((len(TEXTS) + 1) / (seen + 1))
    for r in model(rows).collect():
        expected = np.zeros(dim)
        for w in words(r.document):
            expected[place(w)] += 1
        expected *= weight
        length = np.linalg.norm(expected)
        assert np.allclose(r.embedding, expected / length if length else expected, atol=1e-6)
        assert r.model_id == model.model_id


def test_a_stored_model_is_the_same_and_is_kept(spark, rows):
    model, path = text_model.fit(rows, 64), fresh_path(spark, "model")
    text_model.save(model, path)
    loaded = text_model.load(path)
    assert loaded.model_id == model.model_id
    assert loaded(rows).exceptAll(model(rows)).count() == 0
    with pytest.raises(Exception, match="exists"):
        text_model.save(model, path)


def test_a_chunks_own_text_finds_it_first(spark, sf_dir):
    articles = fx.by_document(fx.articles(spark, sf_dir, times=True, urls=True)).limit(40)
    path = fresh_path(spark, "chunks")
    tables.create_chunks(spark, path)
    model = text_model.fit(settle(chunks.chunk_articles(articles)))
    indexing.index_articles(articles, path, model)
    store = tables.stored(spark, path, schemas.STORED_CHUNK)
    asked = store.filter("length(document) > 300").select(
        F.crc32("chunk_id").alias("query_id"), F.col("document").alias("query"), F.col("chunk_id").alias("own"))
    queries = settle(asked)
    found = search.search_text(queries.drop("own"), model, store, articles).filter("rank = 1")
    met = found.join(queries, "query_id").join(
        store.select(F.col("chunk_id"), F.col("document").alias("text")), "chunk_id").collect()
    assert len(met) == queries.count() > 20
    for r in met:
        assert r.relevance_score == 1.0 and (r.own == r.chunk_id or sorted(r.query.lower().split()) == sorted(r.text.lower().split()))


def test_chunks_of_another_model_are_refused(spark, rows):
    one, other = text_model.fit(rows, 64), text_model.fit(rows.limit(3), 64)
    assert one.model_id != other.model_id
    store = one(rows).withColumn("category", F.lit("c")).withColumn("published_at", F.lit(""))
    asked = spark.createDataFrame([(1, "river")], "query_id long, query string")
    with pytest.raises(Exception, match="of model"):
        search.retrieve_context(other.queries(asked), other.own(store)).collect()
    unknown = store.withColumn("model_id", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="of model"):
        search.retrieve_context(one.queries(asked), one.own(unknown)).collect()


def test_a_store_keeps_one_model(spark, sf_dir):
    store = stores.create(spark, fresh_path(spark, "store"))
    rows = fx.first_articles(spark, sf_dir).limit(30)
    tables.insert_new(rows, store.articles, "doc_id", "w1")
    stores.commit(spark, store, "l1", "w1")
    model = stores.fit_model(spark, store, 128)
    assert stores.load_model(store).model_id == model.model_id
    indexing.index_articles(stores.read_articles(spark, store), store.chunks, model, "w1")
    queries = spark.createDataFrame([(1, "the of"), (2, "zzzz")], "query_id long, query string")
    found = search.search_text(queries, stores.load_model(store), *stores.search_tables(spark, store))
    assert found.filter("is_stored").count() == found.count() > 0
    answers = search.chat(queries, stores.search_tables(spark, store)[0], model=model).collect()
    assert len(answers) == 2 and all("NEWS ARTICLES" in a.prompt for a in answers)


def test_texts_of_hits_are_read_from_their_buckets(spark, sf_dir):
    store, queries = fx.chunk_store(spark, sf_dir), fx.topics(spark, sf_dir)
    found = settle(knn.knn_topk(queries.filter("query_id = 1"), store, 2))
    plan = hits.with_chunk_columns(found, store)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "bucket" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "article_id" in scan.split("PushedFilters")[1]


def test_a_hit_has_its_whole_article(spark, sf_dir):
    store = fx.chunk_store(spark, sf_dir)
    known = fx.by_document(fx.full_articles(spark, sf_dir))
    found = search.search(fx.topics(spark, sf_dir), store, known).collect()
    contents = {str(r.doc_id): r for r in known.collect()}
    assert found
    for r in found:
        a = contents[r.article_id]
        assert (r.content, r.country, r.language, r.keywords) == (a.content, a.country, a.language, a.keywords)


# --- inverted file ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def filed(spark):
    store = settle(fx.text_store(spark, "/root/testdata/sf0.01"))
    cells, path = ivf.fit(store, 16), fresh_path(spark, "cells")
    ivf.write(store.select("chunk_id", "embedding"), cells, path)
    cells.save(f"{path}-model")
    return store, ivf.Cells.load(f"{path}-model"), ivf.read(spark, path)


def test_recall_from_less_than_half_of_the_table(filed):
    store, cells, table = filed
    queries = store.filter("crc32(chunk_id) % 30 = 0").select(F.crc32("chunk_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.chunk_id) for r in knn.knn_topk(queries, store, 10).collect()}
    got = {(r.query_id, r.chunk_id) for r in ivf.ivf_topk(queries, table, cells, 10, 6).collect()}
    sizes = {r.cell: r["count"] for r in table.groupBy("cell").count().collect()}
    read = [sum(sizes.get(c, 0) for c in r.cells) for r in ivf.probed(queries, cells, 6).collect()]
    assert len(got & exact) >= 0.9 * len(exact)
    assert sum(read) / len(read) <= 0.5 * store.count()
    assert table.count() == store.count()


def test_the_plan_reads_the_probed_cells_only(filed):
    store, cells, table = filed
    one = store.filter("chunk_id = '7_chunk_0'").select(F.lit(7).alias("query_id"), "embedding")
    found = ivf.ivf_topk(one, table, cells, 5, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "cell" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert found.filter("rank = 1").first().relevance == 1.0


def test_all_probes_are_exact_also_for_large_batches(filed, monkeypatch):
    store, cells, table = filed
    queries = store.filter("crc32(chunk_id) % 90 = 0").select(F.crc32("chunk_id").alias("query_id"), "embedding")
    table = table.filter(f"cell != {ivf.NO_CELL}")
    exact = sorted(map(tuple, knn.knn_topk(queries, store, 5).filter("cosine > 0").collect()))
    assert sorted(map(tuple, ivf.ivf_topk(queries, table, cells, 5, 16).filter("cosine > 0").collect())) == exact
    monkeypatch.setattr(knn, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(knn, "GRID_CHUNKS", 200)  # cells are cut into parts
    monkeypatch.setattr(knn, "GRID_QUERIES", 20)
    assert sorted(map(tuple, ivf.ivf_topk(queries, table, cells, 5, 16).filter("cosine > 0").collect())) == exact


def test_odd_vectors_have_no_cell(spark, filed):
    _, cells, _ = filed
    dim = cells.centroids.shape[1]
    odd = [("a", None), ("b", [0.0] * dim), ("c", [float("nan")] * dim), ("d", [1.0] * dim), ("e", [1.0] * (dim - 1) + [None])]
    placed = ivf.with_cell(spark.createDataFrame(odd, "chunk_id string, embedding array<float>"), cells)
    assert {r.chunk_id for r in placed.collect() if r.cell == ivf.NO_CELL} == {"a", "b", "c", "e"}
    assert placed.count() == 5


# --- large batches, own dates, pages ------------------------------------------------------------


def test_ten_thousand_queries_in_one_scan(spark, sf_dir):
    store = fx.vector_store(spark, sf_dir)
    n = store.count()
    queries = spark.range(10_000).select(F.col("id").alias("query_id"), (F.col("id") % n).alias("vec_id")).join(
        store.select("vec_id", "embedding"), "vec_id").drop("vec_id")
    found = knn.knn_topk(queries, store, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scored = plan[plan.rindex("MapInArrow"):]
    assert "Exchange" not in scored and "CoGroup" not in plan
    rows = found.collect()
    assert len(rows) == 20_000
    first = {r.query_id: r for r in rows if r.rank == 1}
    assert all(first[i].cosine == pytest.approx(1.0) and first[i].chunk_id == first[i % n].chunk_id for i in range(10_000))


def test_own_dates_are_applied_before_the_best_are_taken(spark):
    store = spark.createDataFrame(
        [(f"c{i}", None, f"2024-01-{i + 1:02d} 12:00:00" if i < 28 else t, [1.0, i / 100])
         for i, t in [*((i, "") for i in range(28)), (28, ""), (29, None), (30, "no time")]],
        "chunk_id string, category string, published_at string, embedding array<float>")
    asked = [(1, "2024-01-10", "2024-01-12 12:00:00"), (2, None, "2024-01-03"), (3, "", None), (4, "2024-01-28", None)]
    queries = spark.createDataFrame(
        [(i, a, b, [1.0, 0.0]) for i, a, b in asked],
        "query_id long, date_from string, date_to string, embedding array<double>")
    got = {}
    for r in knn.knn_topk(queries, store, 50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {1: ["c9", "c10", "c11"], 2: ["c0", "c1"], 3: [f"c{i}" for i in range(31)], 4: ["c27"]}
    wrong = queries.withColumn("date_from", F.lit("someday"))
    with pytest.raises(Exception, match="is no time"):
        knn.knn_topk(wrong, store, 5).collect()


def test_pages_by_token_follow_each_other(spark):
    rows = spark.range(230).select(
        F.format_string("a%03d", "id").alias("article_id"), F.lit("t").alias("title"),
        F.when(F.col("id") % 7 != 0, F.timestamp_seconds(F.col("id") % 40)).alias("created_at"))
    whole = [r.article_id for r in rows.orderBy(F.desc_nulls_last("created_at"), "article_id").collect()]
    got, token = [], None
    while True:
        page = filters.list_articles(rows, 50, after=token)
        found = [r.article_id for r in page.collect()]
        got += found
        token = filters.PageToken.of(page)
        if token is None:
            break
    assert got == whole
