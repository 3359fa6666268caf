"""Articles, chunk store, queries and landed answers, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet import schemas
from broadsheet.functions import text
from broadsheet.operators import text_model
from broadsheet.operators.chunks import chunk_articles
from broadsheet.operators.dedupe import dedupe_first
from broadsheet.plans.indexing import index_articles
from broadsheet.session import fresh_path, settle_packed
from broadsheet.sources import tables

# Slots that categories are dealt out to; the last two become NULL and the empty string.
CATEGORY_SLOTS = (
    "top,technology,science,business,health,politics,sports,entertainment,world,none,"
)
N_SLOTS = 11

LAND_RECORDS = 20_000  # answers in a landed file, at most


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows over all cores, if the scan has fewer splits than there are cores.

    That is so for tables of a few MB per core only, such as the given ones, which have a single
    row group each. A table that fills the cores is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def sentence(column: str, n: int) -> Column:
    """The n-th part of a text between full stops, '' beyond the last; splits no further than that."""
    c = F.col(column)
    if n == 1:
        return F.substring_index(c, ".", 1)
    last = F.substring_index(F.substring_index(c, ".", n), ".", -1)
    return F.when(F.substring_index(c, ".", n - 1) != c, last).otherwise("")


def articles(
    spark: SparkSession,
    sf_dir: str,
    labels: bool = False,
    times: bool = False,
    urls: bool = False,
    heavy: bool = False,
) -> DataFrame:
    """Every document as an article, keyed by md5; what comes from other tables only if asked for.

    `doc_id` is the landing order. `heavy` is for work on the texts that needs all cores.
    """
    d = table(spark, sf_dir, "documents")
    if heavy:
        d = spread(d, "doc_id")
    slot = (F.col("doc_id") % N_SLOTS + 1).cast("int")
    a = d.select(
        "doc_id",
        text.article_id(sentence("text", 1), "source").alias("article_id"),
        sentence("text", 1).alias("title"),
        sentence("text", 2).alias("description"),
        F.col("text").alias("content"),
        F.col("source").alias("source_name"),
        F.lit(None).cast("string").alias("source_url"),
        F.nullif(F.split_part(F.lit(CATEGORY_SLOTS), F.lit(","), slot), F.lit("none")).alias("category"),
        F.lit("us").alias("country"),
        F.col("lang").alias("language"),
        F.lit(None).cast("string").alias("image_url"),
    )
    if labels:
        stored = (
            F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
            .when(F.col("quality").isNotNull(), "neutral")
        )
        keywords = F.when(F.col("quality").isNotNull(), F.array("language", "source_name"))
        a = (
            a.join(table(spark, sf_dir, "labels"), "doc_id", "left")
            .withColumn("sentiment", stored)
            .withColumn("keywords", keywords)
            .drop("quality", "toxic")
        )
    if times:
        # Every fifth event; by doc_id as all joins here, so that texts are shuffled once for all.
        e = table(spark, sf_dir, "events").filter("event_id % 5 = 0")
        at = e.select(F.expr("event_id div 5").alias("doc_id"), F.col("ts").alias("created_at"))
        a = (
            a.join(at, "doc_id", "left")
            .withColumn("published_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
        )
    if urls:
        p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
        a = a.join(p, "doc_id", "left")
    return a


def full_articles(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    return articles(spark, sf_dir, labels=True, times=True, urls=True, heavy=heavy)


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles that have a label: what an earlier load has stored."""
    known = table(spark, sf_dir, "labels").select("doc_id")
    return full_articles(spark, sf_dir, heavy=True).join(known, "doc_id", "left_semi")


def first_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_first(full_articles(spark, sf_dir), "article_id", "doc_id")


def kept(rows: DataFrame, name: str) -> DataFrame:
    """Rows as a packed file that several steps read, so that their texts are joined once."""
    path = fresh_path(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def by_document(rows: DataFrame) -> DataFrame:
    """Articles keyed by document, for the chunk store, where every vector has a document."""
    return rows.withColumn("article_id", F.col("doc_id").cast("string"))


def given_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five vectors per document: (article_id, chunk_index, embedding)."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(
        F.expr("vec_id div 5").cast("string").alias("article_id"),
        (F.col("vec_id") % 5).cast("int").alias("chunk_index"),
        "embedding",
    )


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a chunk of article `vec_id div 5`; the columns that searches score."""
    v = table(spark, sf_dir, "embeddings")
    article = F.expr("vec_id div 5").cast("string")
    return v.select(
        "vec_id",
        F.concat(article, F.lit("_chunk_"), F.col("vec_id") % 5).alias("chunk_id"),
        article.alias("article_id"),
        (F.col("vec_id") % 5).cast("int").alias("chunk_index"),
        "embedding",
        F.col("label").cast("string").alias("category"),
    )


def with_given_vectors(chunks: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with a vector of the table: number 5 * document + position, counted on from the
    start where the table ends, with its components turned by one place more in each round."""
    v = table(spark, sf_dir, "embeddings")
    n = v.count()
    number = F.col("article_id").cast("long") * 5 + F.col("chunk_index")
    numbered = chunks.withColumn("_vec", number % n).withColumn("_turn", (number / n).cast("int"))
    given = v.select(F.col("vec_id").alias("_vec"), F.col("embedding").alias("_given"), "label")
    turn = F.col("_turn") % F.size("_given")
    turned = F.concat(
        F.slice("_given", turn + 1, F.size("_given")), F.slice("_given", F.lit(1), turn)
    )
    joined = numbered.join(given, "_vec").withColumn("embedding", turned)
    return joined.withColumn("category", F.col("label").cast("string")).select(
        *chunks.columns, "embedding"
    )


def text_store(spark: SparkSession, sf_dir: str, dim: int = 256) -> DataFrame:
    """The chunks of all documents with vectors of a model that is fitted on them.

    Texts are stored packed; vectors, many times as large, are made where they are read.
    """
    rows = chunk_articles(by_document(articles(spark, sf_dir, heavy=True)))
    rows = settle_packed(rows.select("chunk_id", "article_id", "chunk_index", "document"))
    return text_model.fit(rows, dim)(rows).withColumn("category", F.lit(None).cast("string"))


_stores: dict[tuple[str, str], str] = {}  # the stored chunks of a session and a folder


def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the library cuts, indexes and stores them, with the given vectors.

    Written once per session, as those who search do not index each time.
    """
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stores:
        path = fresh_path(spark, "chunk-store")
        tables.create_chunks(spark, path)
        index_articles(
            by_document(articles(spark, sf_dir, times=True, urls=True, heavy=True)), path,
            lambda rows: with_given_vectors(rows, spark, sf_dir),
        )
        _stores[key] = path
    return tables.stored(spark, _stores[key], schemas.STORED_CHUNK)


def topics(spark: SparkSession, sf_dir: str, own_category: bool = False) -> DataFrame:
    """One query per label: the mean of the label's vectors, over the whole table."""
    v = table(spark, sf_dir, "embeddings")
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    q = v.groupBy("label").agg(vector_to_array(mean).alias("embedding")).select(
        F.col("label").cast("long").alias("query_id"),
        F.format_string("What is new about topic %s?", F.col("label").cast("string")).alias("query"),
        "embedding",
    )
    return q.withColumn("category", F.col("query_id").cast("string")) if own_category else q


def payloads(spark: SparkSession, sf_dir: str, only_reviewed: bool = False) -> DataFrame:
    """Each document as one answer with two articles: its first and its second sentence.

    Toxic documents stand for failed fetches; documents in German deliver no source name.
    """
    a = reviewed(spark, sf_dir) if only_reviewed else full_articles(spark, sf_dir, heavy=True)
    toxic = table(spark, sf_dir, "labels").select("doc_id", "toxic")

    def item(n: int):
        return F.struct(
            sentence("content", n).alias("title"),
            F.when(F.col("language") != "de", F.col("source_name")).alias("source_name"),
            F.col("source_name").alias("source_id"),
            F.col("source_url").alias("source_url"),
            F.col("content").alias("content"),
            sentence("content", n + 1).alias("description"),
            F.array_compact(F.array("category")).alias("category"),
            F.col("published_at").alias("pubDate"),
            F.col("url").alias("link"),
            F.col("image_url").alias("image_url"),
            F.col("keywords").alias("keywords"),
        )

    return a.join(toxic, "doc_id", "left").select(
        F.col("doc_id").alias("fetch_id"),
        F.lit("top").alias("requested_category"),
        F.when(F.col("toxic") == 1, "error").otherwise("success").alias("status"),
        F.array(item(1), item(2)).alias("results"),
    )


def land(answers: DataFrame, folder: str | None = None, *partitions: str) -> str:
    """Write answers as JSON lines, packed, as each has its text twice; returns the folder.

    Packed files are read whole by one task each, so they hold a bounded number of answers.
    """
    folder = folder or fresh_path(answers.sparkSession, "landing")
    writer = answers.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", LAND_RECORDS)
    writer.partitionBy(*partitions).json(folder)
    return folder
