"""Column layouts of the tables."""

from pyspark.sql import types as T

ARTICLE = T.StructType([
    T.StructField("article_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("published_at", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("created_at", T.TimestampType()),
])

# Stored tables carry, as partition columns, a bucket of the article's id, so that a lookup of ids
# reads their buckets only, and the load that wrote a row: what a load has added, in all its tries,
# is read back from its own folders without touching the rest of the table.
BUCKET = T.StructField("bucket", T.StringType())
LOAD = T.StructField("load_id", T.StringType())
STORED_ARTICLE = T.StructType([*ARTICLE.fields, BUCKET, LOAD])

PAYLOAD_ITEM = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.ArrayType(T.StringType())),
    T.StructField("pubDate", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
])

# One landed answer of the news service. `fetch_id` grows from fetch to fetch; together with the
# position inside `results` it orders the landed articles, so "the first one" is well defined.
PAYLOAD = T.StructType([
    T.StructField("fetch_id", T.LongType()),
    T.StructField("requested_category", T.StringType()),
    T.StructField("requested_country", T.StringType()),
    T.StructField("requested_language", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("results", T.ArrayType(PAYLOAD_ITEM)),
])

CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("article_id", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("document", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("published_at", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("model_id", T.StringType()),  # of the stored model that made the vector, if any
    T.StructField("category", T.StringType()),
])

STORED_CHUNK = T.StructType([*CHUNK.fields, BUCKET, LOAD])

# One row per load that has ended: `write_id` names its folders in the tables of a store, and
# `replaced` those that it stands for from now on. The counters add up to what had landed.
COMMIT = T.StructType([
    T.StructField("load_id", T.StringType()),
    T.StructField("write_id", T.StringType()),
    T.StructField("replaced", T.ArrayType(T.StringType())),
    T.StructField("answers", T.LongType()),
    T.StructField("rejected", T.LongType()),
    T.StructField("fetched", T.LongType()),
    T.StructField("new_inserted", T.LongType()),
    T.StructField("indexed", T.LongType()),
    T.StructField("new_chunks", T.LongType()),
    T.StructField("committed_at", T.TimestampType()),
])

REJECT = T.StructType([
    T.StructField("fetch_id", T.LongType()),
    T.StructField("reason", T.StringType()),
    T.StructField("record", T.StringType()),
    LOAD,
])

QUERY = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("query", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("date_from", T.StringType()),
    T.StructField("date_to", T.StringType()),
    T.StructField("top_k", T.IntegerType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
])
