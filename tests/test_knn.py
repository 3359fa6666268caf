"""Exact search against brute force, small and large batches; recall of the approximate one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.operators import ann, hits, knn
from broadsheet.plans import search
from checks import fixtures as fx

SCHEMA = "query_id long, category string, embedding array<float>"
STORE = "chunk_id string, category string, embedding array<float>"


def brute(queries, store, k):
    """Top k by (rounded cosine, chunk id), one pair at a time."""
    found = set()
    for query_id, wanted, q in queries:
        scored = []
        for chunk_id, category, v in store:
            if wanted is not None and category != wanted:
                continue
            v = np.zeros(len(q)) if v is None else np.array(v, dtype="float32").astype(float)
            u = np.array(q, dtype="float32").astype(float)
            lengths = np.linalg.norm(u) * np.linalg.norm(v)
            cosine = float(u @ v) / lengths if lengths else 0.0
            scored.append((-round(cosine, 12) + 0.0, chunk_id))
        for rank, (cosine, chunk_id) in enumerate(sorted(scored)[:k], 1):
            found.add((query_id, rank, chunk_id, round(max(0.0, -cosine), 4)))
    return found


def data(n_queries=7, n_chunks=400, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    copy = rng.normal(size=dim).astype("float32")
    store = []
    for i in range(n_chunks):
        if i % 3 == 0:
            v = copy.tolist()  # a third of the table is one and the same vector
        elif i % 50 == 1:
            v = [0.0] * dim
        elif i % 50 == 2:
            v = None
        else:
            v = rng.normal(size=dim).astype("float32").tolist()
        store.append((f"c{i:04d}", "ab"[i % 2] if i % 7 else None, v))
    queries = [
        (i, [None, "a", "b"][i % 3], copy.tolist() if i == 0 else rng.normal(size=dim).astype("float32").tolist())
        for i in range(n_queries)
    ]
    return queries, store


def tables(spark, queries, store):
    return spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(store, STORE).repartition(5)


def result(found):
    return {(r.query_id, r["rank"], r.chunk_id, r.relevance) for r in found.collect()}


@pytest.mark.parametrize("k", [1, 10, 50])
def test_against_brute_force(spark, k):
    queries, store = data()
    assert result(knn.knn_topk(*tables(spark, queries, store), k)) == brute(queries, store, k)


def test_grid_for_large_batches(spark, monkeypatch):
    monkeypatch.setattr(knn, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(knn, "GRID_QUERIES", 3)
    monkeypatch.setattr(knn, "GRID_CHUNKS", 70)
    queries, store = data(n_queries=11)
    got = knn.knn_topk(*tables(spark, queries, store), 10)
    assert "CoGroup" in got._jdf.queryExecution().toString()
    assert result(got) == brute(queries, store, 10)


def test_batch_larger_than_a_block(spark):
    queries, store = data(n_queries=600, n_chunks=60)
    assert result(knn.knn_topk(*tables(spark, queries, store), 3)) == brute(queries, store, 3)


def test_category_of_the_batch_and_own_top_k(spark):
    queries, store = data()
    q, s = tables(spark, [(i, None, v) for i, _, v in queries], store)
    q = q.withColumn("top_k", F.when(F.col("query_id") > 0, F.col("query_id").cast("int")))
    got = knn.knn_topk(q, s, 10, category="a")
    expected = brute([(i, "a", v) for i, _, v in queries], store, 10)
    assert result(got) == {h for h in expected if h[1] <= (h[0] or 10)}


def test_own_top_k_beyond_the_default_and_out_of_bounds(spark):
    queries, store = data(n_queries=2)
    q, s = tables(spark, queries, store)
    assert knn.knn_topk(q.withColumn("top_k", F.lit(30)), s, 5).count() == 60
    with pytest.raises(Exception, match="top_k must be"):
        knn.knn_topk(q.withColumn("top_k", F.lit(51)), s, 5).collect()


def test_search_by_time_and_category(spark, sf_dir):
    store, queries = fx.chunk_store(spark, sf_dir), fx.topics(spark, sf_dir)
    known = fx.by_document(fx.full_articles(spark, sf_dir))
    dates = [r.published_at for r in store.select("published_at").distinct().orderBy("published_at").collect()]
    middle = dates[len(dates) // 2]
    found = search.search(queries, store, known, 50, date_from=middle)
    assert found.count() and found.filter(F.col("published_at") < middle).count() == 0
    of_one = search.search(queries, store, known, 50, category="3").select("chunk_id").distinct()
    expected = store.filter("category = '3'").select("chunk_id")
    assert of_one.join(expected, "chunk_id", "left_anti").count() == 0


def test_hits_do_not_shuffle_the_tables(spark, sf_dir):
    store, queries = fx.chunk_store(spark, sf_dir), fx.topics(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = hits.with_chunk_columns(knn.knn_topk(queries, store, 5), store)
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    first_join = plan[plan.index("Join"):].splitlines()[0]
    assert "chunk_id" in first_join and "BuildLeft" in first_join
    assert "BroadcastHashJoin" in plan[:plan.index("BuildLeft")]


def test_no_queries_and_no_chunks(spark):
    queries, store = data()
    q, s = tables(spark, queries, store)
    assert knn.knn_topk(q.limit(0), s, 5).count() == 0
    assert knn.knn_topk(q, s.limit(0), 5).count() == 0


def test_missing_vectors_only(spark):
    queries, store = data(n_chunks=30)
    q, s = tables(spark, [(i, c, None) for i, c, _ in queries], store)
    assert {r.relevance for r in knn.knn_topk(q, s, 2).collect()} == {0.0}
    q, s = tables(spark, queries, [(i, c, None) for i, c, _ in store])
    assert {r.relevance for r in knn.knn_topk(q, s, 2).collect()} == {0.0}


def test_components_that_are_not_finite_are_missing_vectors(spark):
    queries, store = data(5, 60)
    plain = [(c, g, None) for c, g, _ in store[:3]] + store[3:]
    bad = [[float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0] * 7 + [float("-inf")]]
    odd = [(c, g, v) for (c, g, _), v in zip(store[:3], bad, strict=True)] + store[3:]
    q, chunks = tables(spark, queries, odd)
    assert result(knn.knn_topk(q, chunks, 10)) == brute(queries, plain, 10)


@pytest.mark.parametrize("k", [0, 51])
def test_refuses_k(spark, k):
    with pytest.raises(ValueError):
        knn.knn_topk(*tables(spark, *data()), k)


def test_stored_vector_finds_itself(spark, sf_dir):
    store = fx.vector_store(spark, sf_dir)
    queries = store.select(F.col("vec_id").alias("query_id"), "embedding")
    first = knn.knn_topk(queries, store, 1).join(store.select("vec_id", "chunk_id"), "chunk_id")
    assert first.count() == store.count()
    assert first.filter("query_id <> vec_id OR relevance <> 1.0").count() == 0


def _recall(approximate, exact):
    a = {(r.query_id, r.chunk_id) for r in approximate.collect()}
    e = {(r.query_id, r.chunk_id) for r in exact.collect()}
    return len(a & e) / len(e)


def test_approximate_recall_and_scores(spark, sf_dir):
    store, queries = fx.vector_store(spark, sf_dir), fx.topics(spark, sf_dir)
    exact, approximate = knn.knn_topk(queries, store, 10), ann.ann_topk(queries, store, 10)
    assert _recall(approximate, exact) >= 0.95
    both = approximate.alias("a").join(exact.alias("e"), ["query_id", "chunk_id"])
    assert both.filter(F.abs(F.col("a.cosine") - F.col("e.cosine")) > 1e-9).count() == 0


def test_candidates_are_met_once(spark, sf_dir):
    store, queries = fx.vector_store(spark, sf_dir), fx.topics(spark, sf_dir)
    model = ann.fit_buckets(store, 0.2, 4)
    q, c = ann.with_buckets(queries, model), ann.with_buckets(store, model)
    pairs = [tuple(p) for p in ann.candidates(q, c).collect()]
    expected = {
        (x.query_id, y.chunk_id) for x in q.collect() for y in c.collect()
        if any(a == b for a, b in zip(x.buckets, y.buckets))
    }
    assert len(pairs) == len(set(pairs)) < queries.count() * store.count()
    assert set(pairs) == expected


def test_approximate_is_alike_for_many_queries(spark, sf_dir, monkeypatch):
    store, queries = fx.vector_store(spark, sf_dir), fx.topics(spark, sf_dir)
    few = result(ann.ann_topk(queries, store, 10, 0.2, 3))
    monkeypatch.setattr(knn, "BROADCAST_ROWS", 3)
    got = ann.ann_topk(queries, store, 10, 0.2, 3)
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    assert result(got) == few
