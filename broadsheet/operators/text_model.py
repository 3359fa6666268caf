"""A fitted model of texts that is stored beside an index, so that chunks and queries share a space.

The model is a Spark ML pipeline: words, hashed counts, how rare they are, length 1. Its id follows
from what was fitted; every chunk it vectorises carries the id, and a search refuses chunks that
another model has made.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, IDFModel, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 1024


def terms(dim: int) -> list:
    """The stages that need no fitting: words of letters and digits, and their hashed counts."""
    return [
        RegexTokenizer(inputCol="document", outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim),
    ]


def as_arrays(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumn("embedding", vector_to_array("_unit", "float32")).select(
        *columns, "embedding"
    )


@dataclass(frozen=True)
class TextModel:
    """A fitted pipeline; called on chunks it adds `embedding` and `model_id`."""

    fitted: PipelineModel
    model_id: str
    by_row = True  # see `tables.append_chunks`

    @staticmethod
    def of(fitted: PipelineModel) -> TextModel:
        weights = next(s for s in fitted.stages if isinstance(s, IDFModel)).idf.toArray()
        return TextModel(fitted, hashlib.md5(weights.tobytes()).hexdigest())

    def vectors(self, rows: DataFrame) -> DataFrame:
        """`rows` with the vector of their `document`; a missing one has no words."""
        given = rows.withColumn("document", F.coalesce("document", F.lit("")))
        return as_arrays(self.fitted.transform(given), rows.columns)

    def __call__(self, chunks: DataFrame) -> DataFrame:
        return self.vectors(chunks).withColumn("model_id", F.lit(self.model_id))

    def queries(self, asked: DataFrame) -> DataFrame:
        """Queries with the vector of their text in `query`."""
        if "document" in asked.columns:
            raise ValueError("queries must not have a column named document")
        return self.vectors(asked.withColumn("document", F.col("query"))).drop("document")

    def own(self, chunks: DataFrame) -> DataFrame:
        """`chunks`, failing on the first one that this model has not made."""
        wrong = F.raise_error(F.format_string(
            "chunk %s is of model %s, the queries are of model %s", "chunk_id",
            F.coalesce("model_id", F.lit("?")), F.lit(self.model_id),
        )).cast("boolean")
        return chunks.filter(F.when(F.col("model_id") == self.model_id, F.lit(True)).otherwise(wrong))


def fit(chunks: DataFrame, dim: int = DIM) -> TextModel:
    """A model of the texts in `document`. They are read once, or as often as `chunks` is computed."""
    stages = [
        *terms(dim),
        IDF(inputCol="_tf", outputCol="_weighted"),
        Normalizer(inputCol="_weighted", outputCol="_unit"),
    ]
    return TextModel.of(Pipeline(stages=stages).fit(chunks.select(F.coalesce("document", F.lit("")).alias("document"))))


def save(model: TextModel, path: str) -> None:
    """Store a model; fails if there is one already, as chunks may have been made with it."""
    model.fitted.write().save(path)


def load(path: str) -> TextModel:
    return TextModel.of(PipelineModel.load(path))
