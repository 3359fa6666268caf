"""Vectors made from texts."""

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import vectors
from broadsheet.operators import chunks


@pytest.fixture(scope="module")
def texts(spark):
    rows = [("c1", "war and peace"), ("c2", "war war war"), ("c3", "..."), ("c4", "Frieden über alles")]
    return spark.createDataFrame(rows, "chunk_id string, document string")


@pytest.mark.parametrize("make", [chunks.vectorise, chunks.hashed_vectors])
def test_unit_vectors(texts, make):
    got = make(texts).withColumn("norm", F.round(vectors.norm(F.col("embedding")), 5))
    assert {(r.chunk_id, len(r.embedding), r.norm) for r in got.collect()} == {
        ("c1", 256, 1.0), ("c2", 256, 1.0), ("c3", 256, 0.0), ("c4", 256, 1.0)
    }
    assert got.schema["embedding"].dataType.elementType.typeName() == "float"


def test_model_with_failures(texts):
    def embed(batch):
        if "..." in batch:
            raise RuntimeError("limit")
        return [[float(len(t)), 1.0] for t in batch]

    got = chunks.model_vectors(embed, 2, batch=1)(texts).collect()
    assert {(r.chunk_id, tuple(r.embedding)) for r in got} == {
        ("c1", (13.0, 1.0)), ("c2", (11.0, 1.0)), ("c3", (0.0, 0.0)), ("c4", (18.0, 1.0))
    }


def test_model_gets_batches(spark):
    rows = spark.range(45, numPartitions=1).select(F.col("id").cast("string").alias("document"))
    got = chunks.model_vectors(lambda batch: [[float(len(batch))]] * len(batch), 1)(rows)
    sizes = [r.n for r in got.groupBy(F.col("embedding")[0].alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect()]
    assert sizes == [5, 40]
