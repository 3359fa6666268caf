import numpy as np
import pytest

from broadsheet.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score string, id string"


def brute(rows, k=10):
    good = [(i, np.array(v, np.float64)) for i, v in rows
            if i is not None and v is not None and all(x is not None for x in v)
            and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, qv in dict(good).items():
        if q % 100 == 0:
            found = sorted((float(np.sqrt(((v - qv) ** 2).sum())), i) for i, v in good if i != q)
            out[q] = found[:k]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)
    got = ann.search(df, df.filter("vec_id % 100 = 0"), **kw).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_on_the_table(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in rows.collect()]
    got, expected = run(spark, rows), brute(rows)
    found = sum(len(set(got[q]) & set(expected[q])) for q in expected)
    assert found >= 0.95 * sum(map(len, expected.values()))
    for q, near in got.items():
        assert near == sorted(near) and len(near) == 10


def test_edge_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(1, 40)]
    rows += [(0, rows[3][1]), (100, [0.0] * 8), (200, None), (300, [float("nan")] * 8), (None, rows[0][1]),
             (400, rows[5][1]), (401, rows[5][1]), (402, rows[5][1]), (402, rows[5][1]),
             (500, [1.0] * 7 + [None]), (600, [1.0, 2.0]), (700, [float("inf")] + [1.0] * 7)]
    same_length = [r for r in rows if r[1] is None or len(r[1]) == 8]
    got, expected = run(spark, rows), brute(same_length)
    assert set(got) == set(expected) == {0, 400}
    assert got == expected
    assert run(spark, []) == {} and run(spark, [(100, None)]) == {}


def test_queries_that_find_too_few_look_everywhere(spark):
    rng = np.random.default_rng(7)
    few = [(i, [float(np.float32(x)) for x in rng.normal(size=64)]) for i in range(8)]
    assert run(spark, few) == brute(few) and len(run(spark, few)[0]) == 7
    away = rng.normal(size=64)  # the queries lie opposite to all the rest
    rows = [(i, [float(np.float32(x)) for x in (-1 if i % 100 == 0 else 1) * away + 0.01 * rng.normal(size=64)])
            for i in range(300)]
    got, expected = run(spark, rows, block=2), brute(rows)
    assert {len(near) for near in got.values()} == {10} and set(got) == set(expected)
    for n in (15, 20):
        rows = [(i, [float(np.float32(x)) for x in rng.normal(size=64)]) for i in range(n)]
        got, expected = run(spark, rows), brute(rows)
        assert sum(len(set(got[q]) & set(expected[q])) for q in expected) >= 0.9 * sum(map(len, expected.values()))
        assert all(len(near) == 10 for near in got.values())


def test_lengths_that_differ_much(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16) * rng.uniform(0.2, 5)]) for i in range(2000)]
    got, expected = run(spark, rows, block=7), brute(rows)
    found = sum(len(set(got[q]) & set(expected[q])) for q in expected)
    assert found >= 0.9 * sum(map(len, expected.values()))


def test_rotations_keep_lengths():
    turn = ann.Rotations(64, 1.0, False, 2)
    x = np.random.default_rng(0).normal(size=(50, 64))
    axes = turn.axes(x, 1)[:, :64] / 8 ** 3
    assert np.allclose((axes ** 2).sum(1), (x ** 2).sum(1))
