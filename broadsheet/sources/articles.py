"""Articles as a named view and as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet import schemas
from broadsheet.functions import text

_CSV = {
    "header": True,
    "multiLine": True,
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def register(articles: DataFrame, name: str = "articles") -> DataFrame:
    """Make the articles available to SQL text under `name`."""
    articles.createOrReplaceTempView(name)
    return articles


def read_articles_csv(
    spark: SparkSession, path: str, schema: T.StructType = schemas.ARTICLE
) -> DataFrame:
    """Articles from CSV with a header and quoted line breaks; every column is text.

    CSV does not tell NULL from '': both come back as NULL. A file with quoted line breaks cannot
    be split, so the reading is as parallel as there are files.
    """
    strings = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    return spark.read.schema(strings).options(**_CSV).csv(path)


def write_articles_csv(articles: DataFrame, path: str) -> None:
    """Articles as CSV; lists as JSON text, NULL and '' both as an empty field."""
    flat = [
        text.keywords_json(f.name).alias(f.name)
        if isinstance(f.dataType, T.ArrayType)
        else F.col(f.name).cast("string").alias(f.name)
        for f in articles.schema.fields
    ]
    articles.select(*flat).write.options(**_CSV).csv(path)
