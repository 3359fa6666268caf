"""The work of a search by cells: bounded per task, and only pairs that share a cell."""

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from broadsheet.operators import ivf, knn
from broadsheet.session import fresh_path, settle, settle_packed, shared_dir


def test_tasks_of_a_search_by_cells_are_bounded(spark, monkeypatch):
    rng = np.random.default_rng(7)
    made = [(f"a{i}_chunk_0", [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    made += [("zero_chunk_0", [0.0] * 8), ("none_chunk_0", None)]
    store = spark.createDataFrame(made, "chunk_id string, embedding array<float>")
    cells = ivf.fit(store, 4)
    path = fresh_path(spark, "cells")
    ivf.write(store, cells, path)
    table = ivf.read(spark, path)
    queries = store.filter("chunk_id LIKE 'a1%'").select(
        F.regexp_extract("chunk_id", r"a(\d+)_", 1).cast("long").alias("query_id"), "embedding")
    few = sorted(map(tuple, ivf.ivf_topk(queries, table, cells, 5, 2).collect()))
    monkeypatch.setattr(ivf, "TASK_PAIRS", 1000)
    assert sorted(map(tuple, ivf.ivf_topk(queries, table, cells, 5, 2).collect())) == few
    asking = dict.fromkeys(range(4), queries.count())
    dealt = ivf._dealt(table.filter("cell >= 0"), asking)
    assert dealt.rdd.getNumPartitions() == -(-300 * queries.count() // 1000)
    exact = {(r.query_id, r.chunk_id) for r in knn.knn_topk(queries, store.withColumn("category", F.lit(None).cast("string")), 5).collect()}
    all_cells = ivf.ivf_topk(queries, table, cells, 5, 4).collect()
    assert {(r.query_id, r.chunk_id) for r in all_cells} == exact


def test_chunks_meet_the_queries_of_their_cell_only():
    """Equal cosines in blocks of any size are decided by the chunk id."""
    ids = [f"c{i:05d}" for i in range(9000)]
    part = pa.table({
        "chunk_id": ids[::-1], "category": pa.nulls(9000, pa.string()),
        "embedding": pa.array([[1.0, 0.0], [0.0, 1.0]] * 4500, pa.list_(pa.float32())),
        "cell": pa.array([0, 1, 2] * 3000, pa.int32()),
    })
    asked = pa.table({
        "query_id": [7, 8], "category": pa.nulls(2, pa.string()),
        "embedding": pa.array([[2.0, 0.0], [1.0, 1.0]], pa.list_(pa.float64())),
        "cells": pa.array([[0], [1]], pa.list_(pa.int32())),
    })
    found = knn.scorer(3)(asked, [part.slice(0, 5000), part.slice(5000)]).to_pylist()
    kept = dict(zip(part["chunk_id"].to_pylist(), part["cell"].to_pylist(), strict=True))
    first = {c: sorted(i for i in ids if kept[i] == c) for c in (0, 1)}
    along = [i for i in first[0] if (8999 - int(i[1:])) % 2 == 0][:3]
    assert [r["chunk_id"] for r in found if r["query_id"] == 7] == along
    assert [r["chunk_id"] for r in found if r["query_id"] == 8] == first[1][:3]


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def _made(spark, n, parts=3):
    """Chunks of random vectors in a few partitions, and as many queries that share ids, or have none."""
    rng = np.random.default_rng(11)
    made = [(f"c{i:04d}", [float(x) for x in rng.normal(size=8)]) for i in range(n)]
    store = spark.createDataFrame(made, "chunk_id string, embedding array<float>").repartition(parts, "chunk_id")
    number = F.substring("chunk_id", 2, 4).cast("long")
    queries = store.select(F.when(number % 9 != 0, F.least(number, F.lit(150))).alias("query_id"), "embedding")
    return settle(store), settle(queries)


def test_large_batches_leave_the_table_where_it_is(spark, monkeypatch):
    store, queries = _made(spark, 240)
    cells, path = ivf.fit(store, 4), fresh_path(spark, "cells")
    ivf.write(store, cells, path)
    table = ivf.read(spark, path)

    def found():
        rows = ivf.ivf_topk(queries, table, cells, 5, 2).collect()
        return sorted((r.query_id or -1, r["rank"], r.chunk_id, round(r.cosine, 9)) for r in rows)

    few, scans, scan = found(), [], knn.broadcast_topk

    def watched(batch, own, k):
        scans.append((batch.num_rows, _plan(own)))
        return scan(batch, own, k)

    monkeypatch.setattr(knn, "broadcast_topk", watched)
    monkeypatch.setattr(knn, "BROADCAST_ROWS", 60)
    assert found() == few
    assert len(scans) == 4 and sum(n for n, _ in scans) == 240  # also of the ids that most share
    assert max(n for n, _ in scans) < 90
    scans.clear()
    monkeypatch.setattr(knn, "BROADCAST_ROWS", 1000)
    monkeypatch.setattr(ivf, "TASK_PAIRS", 1000)  # more than a task's share: groups of queries, not of chunks
    monkeypatch.setattr(ivf, "SCAN_QUERIES", 1)
    assert found() == few
    assert len(scans) > 2 and sum(n for n, _ in scans) == 240
    assert not any("Exchange" in plan for _, plan in scans)


def test_cells_are_written_in_one_pass_without_a_shuffle(spark):
    store, _ = _made(spark, 60)
    odd = spark.createDataFrame(
        [("zero", [0.0] * 8), ("none", None), ("short", [float("nan")])], "chunk_id string, embedding array<float>")
    cells, path = ivf.fit(store, 4), fresh_path(spark, "cells")
    placed = ivf.with_cell(store, cells)
    assert _plan(placed).count("Scan") == 1
    ivf.write(store.unionByName(odd), cells, path)
    tasks = {f.rsplit("/part-", 1)[1][:5] for f in spark.read.parquet(path).inputFiles()}
    assert len(tasks) > 2  # those that had the chunks
    kept = ivf.read(spark, path).collect()
    assert {r.chunk_id: r.cell for r in kept if r.cell == ivf.NO_CELL} == dict.fromkeys(("zero", "none", "short"), ivf.NO_CELL)
    was = {r.chunk_id: r.embedding for r in store.collect()}
    assert {r.chunk_id: r.embedding for r in kept if r.cell != ivf.NO_CELL} == was


def test_packed_rows_keep_their_order_and_take_less_disk(spark):
    word = "concat('word', pmod(xxhash64(id, x), 300))"
    rows = spark.range(4000).repartition(5, "id").select(
        "id", F.expr(f"if(id % 30 = 0, null, array_join(transform(sequence(1, 60), x -> {word}), ' '))").alias("document"),
        F.array(F.col("id").cast("float"), F.lit(None).cast("float")).alias("embedding"))
    packed = settle_packed(rows)
    assert packed.schema.simpleString() == rows.schema.simpleString()
    assert packed.rdd.glom().collect() == rows.rdd.glom().collect()
    assert settle_packed(rows.filter("id < 0")).count() == 0

    folder = Path(shared_dir(spark).removeprefix("file:"))

    def written(settled):
        size = lambda: sum(f.stat().st_size for f in folder.rglob("part-*"))
        before, kept = size(), settled(rows)
        return size() - before, kept  # kept until it was measured

    assert written(settle_packed)[0] * 3 < written(settle)[0] * 2


def test_short_products_lose_no_near_tie():
    """Cosines that differ by less than a short float tells apart are ranked by their long ones."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=48)
    rows = np.concatenate([
        centre + rng.normal(size=(3000, 48)) * 1e-5, rng.normal(size=(3000, 48)), np.repeat(centre[None], 2000, axis=0)])
    rows = rows[rng.permutation(len(rows))]
    ids = [f"c{i:05d}" for i in range(len(rows))]
    asked = np.concatenate([centre + rng.normal(size=(40, 48)) * 1e-3, rng.normal(size=(40, 48))])
    cell = np.arange(len(rows)) % 3
    own = np.array([[i % 3, (i + 1) % 3] for i in range(80)])
    part = pa.table({
        "chunk_id": ids, "category": pa.nulls(len(ids), pa.string()),
        "embedding": pa.array(rows.tolist(), pa.list_(pa.float64())), "cell": pa.array(cell, pa.int32())})
    queries = pa.table({
        "query_id": np.arange(80), "category": pa.nulls(80, pa.string()),
        "embedding": pa.array(asked.tolist(), pa.list_(pa.float64())), "cells": pa.array(own.tolist(), pa.list_(pa.int32()))})
    found = knn.scorer(10)(queries, [part.slice(i, 1500) for i in range(0, len(ids), 1500)])
    got = {i: [] for i in range(80)}
    for r in sorted(found.to_pylist(), key=lambda r: (-r["cosine"], r["chunk_id"])):
        got[r["query_id"]].append((r["chunk_id"], r["cosine"]))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cosine = np.round(np.einsum("ij,kj->ik", unit(asked), unit(rows)), 12)
    for i in range(80):
        inside = np.nonzero(np.isin(cell, own[i]))[0]
        best = sorted(inside, key=lambda c: (-cosine[i, c], ids[c]))[:10]
        assert np.allclose([c for _, c in got[i]], cosine[i, best], rtol=0, atol=2e-12)
        clear = [ids[c] for c in best if cosine[i, c] > cosine[i, best[-1]] + 1e-11]
        assert set(clear) <= {c for c, _ in got[i]}


def test_a_small_scan_leaves_few_rows_per_query(spark, monkeypatch):
    store, queries = _made(spark, 240, 12)
    cells, path = ivf.fit(store, 4), fresh_path(spark, "cells")
    ivf.write(store, cells, path)
    monkeypatch.setattr(ivf, "CORE_TASKS", 1)
    scans, scan = [], knn.broadcast_topk

    def watched(batch, own, k):
        scans.append(own.rdd.getNumPartitions())
        return scan(batch, own, k)

    monkeypatch.setattr(knn, "broadcast_topk", watched)
    limit = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(limit)
    spark.conf.set(limit, "1k")  # many partitions
    try:
        table = ivf.read(spark, path)
        assert ivf.ivf_topk(queries, table, cells, 5, 4).count() > 0
        assert table.rdd.getNumPartitions() > scans[0] == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set(limit, was)
